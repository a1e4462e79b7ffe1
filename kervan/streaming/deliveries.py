"""Micro-batch ingestion of delivered JSON files and de-duplication of late, repeated messages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kervan.config import EngineConfig
from kervan.operators.embed import Embedder
from kervan.operators.ingest import ingest
from kervan.sources.snapshots import SnapshotStore


def stream_json_files(spark: SparkSession, directory: str, max_files: int = 1000) -> DataFrame:
    files = spark.readStream.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").option("maxFilesPerTrigger", max_files).load(directory)
    return files.select(F.col("_metadata.file_path").alias("file_path"), F.lit(0).alias("record_no"), F.col("value").alias("record_json"))


def ingest_stream(files: DataFrame, store: SnapshotStore, load: Callable[[], Embedder], checkpoint: str, config: EngineConfig = EngineConfig()) -> StreamingQuery:
    """Ingest every micro-batch in one commit; ingestion is idempotent, so a replayed batch changes nothing."""

    def one(batch: DataFrame, _: int) -> None:
        ingest(store, batch, load, config, strict=False)

    return files.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_deliveries(messages: DataFrame, keys: list[str], event_time: str, lateness: str = "7 days") -> DataFrame:
    """Each key once within the lateness bound; state is dropped behind the watermark. Batch input: each key once."""
    if messages.isStreaming:
        return messages.withWatermark(event_time, lateness).dropDuplicatesWithinWatermark(keys)
    return messages.dropDuplicates(keys)
