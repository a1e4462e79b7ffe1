"""Incremental ingestion: records -> upserted medicines and replaced chunks, re-embedding only what changed."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kervan.config import EngineConfig
from kervan.functions.text import chunk_header, fold_ascii, split_text
from kervan.operators.embed import Embedder, check_vectors, embed
from kervan.operators.tables import assign_ids, current_parents, latest_per_key, replace_children, upsert
from kervan.schema import CHUNKS, MEDICINE_FIELDS
from kervan.session import cut
from kervan.sources import json_records as jr
from kervan.sources.snapshots import SnapshotStore

KEYS = ["medicine_name", "source_name", "source_reference"]


def section_chunks(rows: DataFrame, max_chars: int = 1200) -> DataFrame:
    """Chunk rows of records: all columns but `rec`, then pos (from 0), chunk_type, chunk_text; a `pos` that tells
    records of one document apart comes out as record_pos.

    The header lines don't count toward max_chars. Records without a filled section give no rows.
    """
    keep = [c for c in rows.columns if c != "rec"]
    parts = rows.select(*keep, F.inline(jr.section_values(rows))).withColumn("_parts", split_text(F.col("text"), max_chars))
    parts = parts.select(*keep, "ordinal", "chunk_type", F.posexplode("_parts").alias("_p", "_part"))
    rank = F.struct("ordinal", "_p", "chunk_type", "_part")
    listed = parts.groupBy(*keep).agg(F.array_sort(F.collect_list(rank)).alias("_all"))  # one record's chunks
    out = listed.select(*keep, F.posexplode("_all").alias("_pos", "_c"))
    return out.select(*[c for c in keep if c != "pos"], *([F.col("pos").alias("record_pos")] if "pos" in keep else []), F.col("_pos").alias("pos"), F.col("_c.chunk_type").alias("chunk_type"), F.concat(chunk_header(F.col("medicine_name"), F.col("_c.chunk_type")), F.col("_c._part")).alias("chunk_text"))


def prepare(raw: DataFrame, *, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(parsed documents, named records with an order column `_ord`) of (file_path, record_no, record_json) rows."""
    parsed = cut(jr.parse(raw))
    rows = jr.named(jr.normalised(jr.without_examples(jr.records(parsed, strict=strict))), strict=strict)
    return parsed, rows.withColumn("_ord", F.struct(jr.path_order(F.col("file_path")).alias("path"), "record_no", "pos"))


def counters(parsed: DataFrame, rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: files, medicines, chunks, skipped examples. Unchanged records count too."""
    a = parsed.agg(F.count_distinct("file_path").alias("files"), F.coalesce(F.sum(F.size(F.filter("records", lambda r: r["is_example"]))), F.lit(0)).alias("skipped"))
    return a.join(rows.agg(F.count(F.lit(1)).alias("medicines")), how="cross").join(chunks.agg(F.count(F.lit(1)).alias("chunks")), how="cross").select("files", "medicines", "chunks", "skipped")


def ingest(store: SnapshotStore, raw: DataFrame, load: Callable[[], Embedder], config: EngineConfig = EngineConfig(), *, strict: bool = True) -> dict:
    """Merge raw records into the store in one commit and return the counters.

    Records of one key (name without regard to A-Z case, source, reference; nulls equal) within a batch: the last
    one's fields and chunks, the first one's spelling of the name. Parents whose stored chunks already equal the new
    ones, with vectors of the current model, are neither embedded nor rewritten. All or nothing.
    """
    store.initialise()
    parsed, rows = prepare(raw, strict=strict)
    rows = cut(rows)
    medicines, chunks = store.table("medicines"), store.table("document_chunks")
    merged = cut(upsert(medicines, rows.select(*MEDICINE_FIELDS, "_ord"), KEYS, "medicine_id", folded="medicine_name", keep=["medicine_name"], ordinal="_ord", start=store.high_water("medicines")))
    all_chunks = section_chunks(rows.select("_ord", "medicine_name", "source_name", "source_reference", "rec"), config.max_chunk_chars)
    last = latest_per_key(rows.select("rec", "_ord", *KEYS), KEYS, "_ord", folded="medicine_name")
    on = [fold_ascii(F.col("l.medicine_name")) == fold_ascii(F.col("m.medicine_name"))] + [F.col(f"l.{k}").eqNullSafe(F.col(f"m.{k}")) for k in KEYS[1:]]
    owner = last.alias("l").join(merged.alias("m"), on).groupBy(F.col("l.medicine_name"), F.col("l._ord"), F.col("l.rec")).agg(F.min("m.medicine_id").alias("medicine_id"))
    new = cut(section_chunks(owner.select("medicine_id", "medicine_name", "_ord", "rec"), config.max_chunk_chars))
    touched = owner.select("medicine_id")
    state = current_parents(chunks, new, "medicine_id", config.embedding_model)
    emptied = chunks.select("medicine_id").distinct().join(touched, "medicine_id", "left_semi").join(new.select("medicine_id").distinct(), "medicine_id", "left_anti")
    stale = cut(state.filter(~F.coalesce("is_current", F.lit(False))).select("medicine_id").unionByName(emptied).distinct())
    fresh = embed(new.join(stale, "medicine_id", "left_semi"), "chunk_text", load, config.embedding_model)
    numbered = cut(assign_ids(fresh, "chunk_id", ["_ord", "pos"], store.high_water("document_chunks")))
    tables = {"medicines": merged, "document_chunks": replace_children(chunks, numbered.select(*chunks.columns), "medicine_id", stale)}
    high = {"medicines": merged.agg(F.max("medicine_id")).first()[0] or 0, "document_chunks": numbered.agg(F.max("chunk_id")).first()[0] or 0}
    out = counters(parsed, rows, all_chunks).first().asDict()
    store.commit(tables, high, {"medicines": store.buckets_of(touched), "document_chunks": store.buckets_of(stale)})
    return out | {"embedded": numbered.count()}


def insert_chunk(store: SnapshotStore, medicine_id: int, chunk_text: str, chunk_type: str, embedding: list[float] | None = None, embedding_model: str | None = None, config: EngineConfig = EngineConfig()) -> int:
    """Add one chunk to an existing record and return its id; only the record's bucket is written.

    Blank text or type, an unknown record and an invalid vector raise. A vector without a model has the current one;
    a chunk without a vector has no model.
    """
    text, kind = str(chunk_text).strip(), str(chunk_type).strip()
    if not text or not kind:
        raise ValueError("chunk_text and chunk_type are required")
    if embedding is not None:
        check_vectors([embedding], 1)
    store.initialise()
    owner = store.table("medicines").filter(F.col("medicine_id") == medicine_id).select("medicine_id")
    if owner.isEmpty():
        raise ValueError(f"no medicine {medicine_id}")
    chunks, new_id = store.table("document_chunks"), store.high_water("document_chunks") + 1
    model = ((embedding_model or "").strip() or config.embedding_model) if embedding is not None else None
    row = store.spark.createDataFrame([(new_id, medicine_id, text, kind, None if embedding is None else [float(x) for x in embedding], model)], CHUNKS)
    store.commit({"document_chunks": chunks.unionByName(row, allowMissingColumns=True)}, {"document_chunks": new_id}, {"document_chunks": store.buckets_of(owner)})
    return new_id


def save_form(store: SnapshotStore, values: dict, load: Callable[[], Embedder], config: EngineConfig = EngineConfig()) -> tuple[int, int]:
    """Check one form and ingest it as a record: (medicine_id, number of its chunks). Without a filled section the model isn't asked."""
    record = jr.validate_form(values)
    raw = store.spark.createDataFrame([("form", 0, json.dumps({k: v for k, v in record.items() if v is not None}))], "file_path string, record_no int, record_json string")
    ingest(store, raw, load, config)
    m = store.table("medicines")
    same = fold_ascii(F.col("medicine_name")) == fold_ascii(F.lit(record["medicine_name"]))
    for k in KEYS[1:]:
        same = same & F.col(k).eqNullSafe(F.lit(record[k]))
    mine = m.filter(same).agg(F.min("medicine_id")).first()[0]
    return mine, store.table("document_chunks").filter(F.col("medicine_id") == mine).count()
