"""Keyed table changes: ids, upsert, child replacement, cascade, change detection, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kervan.functions.text import fold_ascii
from kervan.session import cut


def assign_ids(df: DataFrame, id_col: str, order: list[str], start: int) -> DataFrame:
    """Consecutive ids from start + 1 in the given order, without one task holding all rows.

    Rows are range-partitioned by the order; each partition numbers its own rows after the sum of the earlier
    partitions' counts. The one collected value per partition is its count. The order must be total.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    before, total = [], start
    for r in placed.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect():
        before.append((r["_part"], total))
        total += r["n"]
    offsets = F.broadcast(spark.createDataFrame(before, "_part int, _before long"))  # one row per partition
    w = Window.partitionBy("_part").orderBy(*order)
    return placed.join(offsets, "_part").withColumn(id_col, F.col("_before") + F.row_number().over(w)).drop("_part", "_before")


def _key(keys: list[str], folded: str | None) -> list[Column]:
    return [fold_ascii(F.col(k)) if k == folded else F.col(k) for k in keys]


def latest_per_key(df: DataFrame, keys: list[str], order: str, *, folded: str | None = None, first: list[str] = ()) -> DataFrame:
    """One row per key (nulls equal): the last by `order`, but the columns in `first` from the earliest row.

    Aggregation combines on the map side, so a key that holds a third of all rows is no hot group.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    rest = [c for c in df.columns if c not in first]
    out = df.withColumns(dict(zip(names, _key(keys, folded), strict=True))).groupBy(*names).agg(
        F.max_by(F.struct(*rest), F.col(order)).alias("_last"), *[F.min_by(c, order).alias(c) for c in first]
    )
    return out.select(*[F.col(c) if c in first else F.col(f"_last.{c}").alias(c) for c in df.columns])


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], id_col: str, *, folded: str | None = None, keep: list[str] = (), ordinal: str = "_ord", start: int | None = None) -> DataFrame:
    """stored with incoming rows merged by key: nulls are equal, `folded` ignores A-Z case, `keep` columns never change.

    Several incoming rows of one key act in `ordinal` order: the last one's values, the first one's `keep` columns.
    A key without a stored row gets the next id after `start` (default: the highest stored id), in ordinal order.
    If several stored rows share a key the one with the lowest id is the target. Empty inputs are fine.
    """
    cols = stored.columns
    values = [c for c in cols if c != id_col]
    batch = latest_per_key(incoming.select(*values, ordinal), keys, ordinal, folded=folded, first=[c for c in keep if c in values])
    target = stored.groupBy(*[k.alias(f"_k{i}") for i, k in enumerate(_key(keys, folded))]).agg(F.min(id_col).alias("_target"))
    b = batch.withColumns({f"_b{i}": k for i, k in enumerate(_key(keys, folded))})
    on = [F.col(f"_b{i}").eqNullSafe(F.col(f"_k{i}")) for i in range(len(keys))]
    matched = b.join(target, on, "left").drop(*[f"_k{i}" for i in range(len(keys))], *[f"_b{i}" for i in range(len(keys))])
    changed = matched.filter(F.col("_target").isNotNull()).select(F.col("_target").alias(id_col), *[F.col(c).alias(f"_n_{c}") for c in values])
    changed = changed.withColumn("_hit", F.lit(True))
    joined = stored.join(changed, id_col, "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    merged = joined.select(id_col, *[F.col(c) if c in keep else F.when(hit, F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) for c in values])
    new = matched.filter(F.col("_target").isNull()).select(*values, ordinal)
    base = start if start is not None else (stored.agg(F.max(id_col)).first()[0] or 0)
    added = assign_ids(new, id_col, [ordinal], base).select(*cols)
    return merged.select(*cols).unionByName(added)


def replace_children(stored: DataFrame, incoming: DataFrame, parent: str, replaced: DataFrame | None = None) -> DataFrame:
    """Children of the replaced parents are exactly the incoming ones; all others stay.

    `replaced` names the parents (default: those with incoming children); a parent listed there without incoming
    children loses all of its own.
    """
    gone = (incoming if replaced is None else replaced).select(parent).distinct()
    return stored.join(gone, parent, "left_anti").select(*stored.columns).unionByName(incoming.select(*stored.columns))


def cascade(children: DataFrame, parents: DataFrame, parent: str) -> DataFrame:
    """Children whose parent still exists."""
    return children.join(parents.select(parent), parent, "left_semi")


def positions(df: DataFrame, parent: str, order: str, position: str, slots: int | None = None) -> DataFrame:
    """df with the place of each row among its parent's, from 0, in the given order, which is total within a parent.

    Rows are range-partitioned by (parent, order), so that a parent with a third of all rows is spread over tasks;
    each row is counted within its task, after the sum of its parent's rows in the tasks before.
    """
    n = slots or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(df.repartitionByRange(n, parent, order).withColumn("_part", F.spark_partition_id()))
    counts = placed.groupBy(parent, "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(parent).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.withColumn("_before", F.coalesce(before, F.lit(0))).filter("_before > 0").select(parent, "_part", "_before")  # parents that lie in several tasks only
    own = F.row_number().over(Window.partitionBy(parent, "_part").orderBy(order)) - 1
    return placed.withColumn("_own", own).join(F.broadcast(starts), [parent, "_part"], "left").withColumn(position, F.coalesce("_before", F.lit(0)) + F.col("_own")).drop("_part", "_own", "_before")


def current_parents(stored: DataFrame, new: DataFrame, parent: str, model: str, order: str = "chunk_id", position: str = "pos") -> DataFrame:
    """Per parent of `new`: whether its stored chunks already are the new ones, in order, all embedded by `model`.

    Both sides are reduced to (position, text, type) rows and joined on (parent, position): no list per parent is
    built, and no task holds all rows of one parent.
    """
    mine = stored.join(new.select(parent).distinct(), parent, "left_semi").select(
        parent, order, F.col("chunk_text").alias("_text"), F.col("chunk_type").alias("_type"), F.coalesce((F.size("embedding") > 0) & (F.col("embedding_model") == model), F.lit(False)).alias("_fresh")
    )
    old = positions(mine, parent, order, position).drop(order)
    same = F.col("chunk_text").eqNullSafe(F.col("_text")) & F.col("chunk_type").eqNullSafe(F.col("_type")) & F.coalesce("_fresh", F.lit(False))
    return new.select(parent, position, "chunk_text", "chunk_type").join(old, [parent, position], "full").groupBy(parent).agg(F.bool_and(same).alias("is_current"))


def table_counts(**tables: DataFrame) -> DataFrame:
    """One row with the row count of each table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias(name))
        out = one if out is None else out.join(one, how="cross")
    return out
