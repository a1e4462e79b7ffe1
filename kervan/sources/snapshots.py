"""Versioned Parquet tables: a commit writes the touched buckets beside the old ones, then swaps one pointer file."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kervan.schema import CHUNKS, MEDICINES, migrate


class SnapshotStore:
    """Tables under one root folder on any file system Spark can write, each in buckets by medicine_id.

    A commit writes only the buckets it is told were touched. All tables of a commit become visible together, by the
    rename of the pointer file; a failed write leaves the earlier state current. Readers never see a folder that is
    being written; folders a commit replaced stay for readers that began before it, and go with the next commit. Ids
    that were handed out are never used again: the high-water marks live in the pointer.
    """

    SCHEMAS = {"medicines": MEDICINES, "document_chunks": CHUNKS}
    BUCKETS = 64

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._jvm = jvm

    def initialise(self) -> None:
        """Create empty tables if there are none; an existing store is left as it is."""
        self._fs.mkdirs(self._path(self.root))
        if not self._fs.exists(self._path(f"{self.root}/CURRENT")):
            self.commit({n: self.spark.createDataFrame([], s) for n, s in self.SCHEMAS.items()}, {})

    def pointer(self) -> dict:
        path = self._path(f"{self.root}/CURRENT")
        if not self._fs.exists(path):
            raise FileNotFoundError(f"no tables at {self.root}")
        stream = self._fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def table(self, name: str) -> DataFrame:
        """The current rows of a table, with columns added since they were written as nulls."""
        folders = sorted(self.pointer()["tables"].get(name, {}).values())
        if not folders:
            return self.spark.createDataFrame([], self.SCHEMAS[name])
        return migrate(self.spark.read.option("mergeSchema", "true").parquet(*[f"{self.root}/{f}" for f in folders]), self.SCHEMAS[name])

    def high_water(self, name: str) -> int:
        return self.pointer()["high_water"].get(name, 0)

    def bucket(self, medicine_id: Column) -> Column:
        return F.pmod(F.xxhash64(medicine_id), F.lit(self.BUCKETS)).cast("int")

    def buckets_of(self, ids: DataFrame) -> list[int]:
        """The buckets of a table of medicine ids, at most BUCKETS of them."""
        return sorted(r["b"] for r in ids.select(self.bucket(F.col("medicine_id")).alias("b")).distinct().collect())

    def commit(self, tables: dict[str, DataFrame], high_water: dict[str, int], touched: dict[str, list[int]] | None = None) -> None:
        """Make the given tables current at once, keep the others. touched: buckets of a table whose rows changed; the others are kept as they are."""
        try:
            now = self.pointer()
        except FileNotFoundError:
            now = {"tables": {}, "high_water": {}, "retired": []}
        gone, now["retired"], version = now["retired"], [], uuid.uuid4().hex
        for name, df in tables.items():
            held = now["tables"].setdefault(name, {})
            mine = list(range(self.BUCKETS)) if touched is None or name not in touched else touched[name]
            if not mine:
                continue
            folder = f"{name}/snapshot={version}"
            rows = df.withColumn("_bucket", self.bucket(F.col("medicine_id"))).filter(F.col("_bucket").isin(mine))
            rows.repartition(len(mine), "_bucket").write.mode("errorifexists").partitionBy("_bucket").parquet(f"{self.root}/{folder}")
            for b in mine:
                if (old := held.pop(str(b), None)) is not None:
                    now["retired"].append(old)
                if self._fs.exists(self._path(f"{self.root}/{folder}/_bucket={b}")):
                    held[str(b)] = f"{folder}/_bucket={b}"
        now["high_water"] |= {k: max(v, now["high_water"].get(k, 0)) for k, v in high_water.items()}
        self._swap(now, version)
        for folder in gone:
            self._fs.delete(self._path(f"{self.root}/{folder}"), True)

    def _swap(self, pointer: dict, version: str) -> None:
        draft = self._path(f"{self.root}/.next-{version}")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(pointer).encode()))
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context.rename(draft, self._path(f"{self.root}/CURRENT"), options)
