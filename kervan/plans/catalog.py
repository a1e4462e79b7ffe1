"""Registered queries over the test tables: each runs one operator family over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kervan.config import EngineConfig
from kervan.functions import guard, text, vector
from kervan.functions.udfs import casefold_udf
from kervan.operators import answer as ans
from kervan.operators import filters, retrieve, tables
from kervan.operators.embed import embed, letter_embedder
from kervan.operators.ingest import prepare, section_chunks
from kervan.operators.names import named_in
from kervan.schema import SECTION_FIELDS, SECTIONS
from kervan.session import spread
from kervan.sources import json_records as jr

Query = Callable[[SparkSession, str], DataFrame]
MODEL, DIMS = "leaflet-embed-2", 64
KEYS = ["medicine_name", "source_name", "source_reference"]


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def stats_counts(spark, d):
    return tables.table_counts(medicines=read(spark, d, "medicines"), document_chunks=read(spark, d, "document_chunks"))


def chunk_parent_join(spark, d):
    c, m = read(spark, d, "document_chunks"), read(spark, d, "medicines")
    return c.join(m.select("medicine_id", "medicine_name", "source_name", "source_reference"), "medicine_id").select(
        "chunk_id", "medicine_id", "medicine_name", "source_name", "source_reference", "chunk_type", F.length("chunk_text").alias("n_chars"), "embedding_model"
    )


def filter_optional(spark, d):
    return filters.where_equal(read(spark, d, "document_chunks"), medicine_id=1, chunk_type="warnings").select("chunk_id", "medicine_id", "chunk_type")


def filter_no_terms(spark, d):
    return filters.where_equal(read(spark, d, "document_chunks"), medicine_id=None, chunk_type=None).groupBy("chunk_type").agg(F.count("*").alias("n"))


def lookup_nocase(spark, d):
    return filters.lookup_by_name(read(spark, d, "medicines"), "  LEPEBIKES 500 MG FILM TABLET ", "medicine_name", "medicine_id").select("medicine_id", "medicine_name", "source_name")


def nullsafe_upsert_match(spark, d):
    m = read(spark, d, "medicines").select("medicine_id", *KEYS)
    first = m.groupBy(text.fold_ascii(F.col("medicine_name")).alias("k"), F.col("source_name").alias("s"), F.col("source_reference").alias("r")).agg(F.min("medicine_id").alias("target_id"))
    on = (text.fold_ascii(F.col("medicine_name")) == F.col("k")) & F.col("source_name").eqNullSafe(F.col("s")) & F.col("source_reference").eqNullSafe(F.col("r"))
    return m.join(first, on, "left").select("medicine_id", "target_id")


def _incoming(m: DataFrame) -> DataFrame:
    up = m.select(F.translate("medicine_name", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("medicine_name"), F.concat(F.lit("yeni "), F.coalesce("warnings", F.lit(""))).alias("warnings"), "source_name", "source_reference", F.col("medicine_id").alias("_ord"))
    new = m.select(F.concat(F.lit("Q "), F.col("medicine_name")).alias("medicine_name"), "warnings", "source_name", "source_reference", (F.col("medicine_id") + 1_000_000_000).alias("_ord"))
    return up.unionByName(new)


def upsert_merge(spark, d):
    m = read(spark, d, "medicines").select("medicine_id", "medicine_name", "warnings", "source_name", "source_reference")
    return tables.upsert(m, _incoming(m), KEYS, "medicine_id", folded="medicine_name", keep=["medicine_name"])


def replace_children(spark, d):
    c = read(spark, d, "document_chunks").select("chunk_id", "medicine_id", "chunk_type", F.length("chunk_text").alias("n"))
    new = c.filter(F.col("chunk_type") == "warnings").select((F.col("chunk_id") + 1_000_000_000).alias("chunk_id"), "medicine_id", "chunk_type", (F.col("n") + 1).alias("n"))
    return tables.replace_children(c, new, "medicine_id")


def cascade_delete(spark, d):
    m = read(spark, d, "medicines").filter(F.col("source_name").isNotNull())
    return tables.cascade(read(spark, d, "document_chunks").select("chunk_id", "medicine_id"), m, "medicine_id")


def assign_ids(spark, d):
    return tables.assign_ids(read(spark, d, "part").select("p_partkey", "p_brand"), "new_id", ["p_brand", "p_partkey"], 1000)


def alias_coalesce(spark, d):
    m = read(spark, d, "medicines")
    blank = lambda c: text.optional_text(F.col(c))
    return m.select("medicine_id", F.coalesce(blank("dosage_information"), blank("frequency_information"), blank("usage_information")).alias("dosage"), F.coalesce(blank("source_name"), F.lit("-")).alias("source"))


def section_unpivot(spark, d):
    m = read(spark, d, "medicines")
    kinds = {f: k for _, f, k in reversed(SECTIONS)}
    parts = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(kinds[f]).alias("chunk_type"), text.optional_text(F.col(f)).alias("body")) for i, f in enumerate(SECTION_FIELDS)])
    return m.select("medicine_id", F.inline(F.filter(parts, lambda p: p["body"].isNotNull()))).select("medicine_id", "ordinal", "chunk_type", F.md5("body").alias("digest"))


def text_split_units(spark, d):
    docs = spread(read(spark, d, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.posexplode(text.split_units(F.col("text"))).alias("pos", "unit")).select("doc_id", "pos", F.length("unit").alias("n"), F.md5("unit").alias("digest"))


def text_pack_chunks(spark, d):
    docs = spread(read(spark, d, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.posexplode(text.split_text(F.col("text"))).alias("pos", "chunk")).select("doc_id", "pos", F.length("chunk").alias("n"), F.md5("chunk").alias("digest"))


def change_detect(spark, d):
    """Stored chunks against the same ones, where those that mention a dose line were edited."""
    c = read(spark, d, "document_chunks")
    edited = F.when(F.contains("chunk_text", F.lit("1.25 g")), F.concat("chunk_text", F.lit("!"))).otherwise(F.col("chunk_text"))
    new = tables.positions(c.select("chunk_id", "medicine_id", edited.alias("chunk_text"), "chunk_type"), "medicine_id", "chunk_id", "pos").drop("chunk_id")
    return tables.current_parents(c, new, "medicine_id", MODEL).select("medicine_id", F.coalesce("is_current", F.lit(False)).alias("is_current"))


def vector_validity(spark, d):
    c = read(spark, d, "document_chunks")
    e = F.col("embedding")
    return c.select("chunk_id", F.coalesce(F.size(e), F.lit(-1)).alias("n"), vector.is_valid(e).alias("is_valid"), vector.is_usable(e, F.col("embedding_model"), MODEL, DIMS).alias("is_usable"))


def embed_json_roundtrip(spark, d):
    c = read(spark, d, "document_chunks").filter(vector.is_valid(F.col("embedding")))
    back = vector.from_json_text(vector.to_json_text(F.col("embedding")))
    return c.select("chunk_id", F.size(back).alias("n"), F.round(F.aggregate(back, F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.round(F.element_at(vector.preview(back), 1), 6).alias("head"))


def embed_json_invalid(spark, d):
    """Which texts are vectors: the payloads of all events, and every stored vector as it would be typed, damaged ones included."""
    events = read(spark, d, "events").select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.col("props").alias("s"))
    typed = F.concat(F.lit("["), F.array_join(F.transform("embedding", lambda x: F.coalesce(x.cast("string"), F.lit("null"))), ","), F.lit("]"))
    stored = read(spark, d, "document_chunks").select(F.lit("chunk").alias("kind"), F.col("chunk_id").alias("id"), typed.alias("s"))
    return events.unionByName(stored).select("kind", "id", vector.from_json_text(F.col("s")).isNotNull().alias("is_vector"))


def _vectors(spark, d) -> DataFrame:
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").cast("long").alias("medicine_id"), F.col("embedding").cast("array<double>").alias("embedding"))


def _as_store(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The embeddings table as chunks of records named "marka<label> tablet", with every 50th vector as a question."""
    v = _vectors(spark, d)
    chunks = v.withColumns({"chunk_text": F.lit("metin"), "chunk_type": F.lit("usage"), "embedding_model": F.lit(MODEL)})
    medicines = v.select("medicine_id").distinct().select("medicine_id", F.concat(F.lit("marka"), F.col("medicine_id"), F.lit(" tablet")).alias("medicine_name"), F.lit("kaynak").alias("source_name"))
    queries = v.filter(F.col("chunk_id") % 50 == 0).select(F.col("chunk_id").alias("query_id"), F.concat(F.lit("Marka"), F.col("medicine_id"), F.lit(" yan etkileri?")).alias("query_text"), F.col("embedding").alias("query_vec"))
    return queries, chunks, medicines


def cosine_pairs(spark, d):
    queries, chunks, _ = _as_store(spark, d)
    out = None
    for block in retrieve.blocks(queries.select("query_id", "query_vec").orderBy("query_id").toLocalIterator()):
        part = retrieve.score(chunks, [r["query_id"] for r in block], np.array([r["query_vec"] for r in block]), None, 0.35, 0.0)
        out = part if out is None else out.unionByName(part)
    return out.select("query_id", "chunk_id", F.round("sim", 6).alias("sim"))


def topk_batch(spark, d):
    queries, chunks, medicines = _as_store(spark, d)
    return retrieve.top_chunks(queries.withColumn("query_text", F.lit("")), chunks, medicines, min_score=-1.0).select("query_id", "rank", "chunk_id", F.round("similarity_score", 6).alias("sim"))


def topk_boosted(spark, d):
    queries, chunks, medicines = _as_store(spark, d)
    return retrieve.top_chunks(queries, chunks, medicines, min_score=0.0).select("query_id", "rank", "chunk_id", F.round("similarity_score", 6).alias("sim"), F.round("rank_score", 6).alias("score"))


#: Questions rank by meaning alone here, and some find nothing.
ASK = EngineConfig(embedding_model="letters", name_boost=0.0, min_score=0.8)


def _questions(spark, d) -> DataFrame:
    """Every text that users wrote in the chats, once, by the first message that holds it."""
    chat = read(spark, d, "chat_messages").filter((F.col("role") == "user") & (text.strip(F.col("content")) != ""))
    first = chat.groupBy("content").agg(F.min(F.struct("conv_id", "turn")).alias("at"))
    return first.select((F.col("at.conv_id") * 1000 + F.col("at.turn")).alias("query_id"), F.col("content").alias("query_text"))


def _hits(spark, d) -> tuple[DataFrame, DataFrame]:
    """The chats' questions, and their hits in the whole store, embedded anew by the model that counts letters."""
    q, c = _questions(spark, d), spread(read(spark, d, "document_chunks").select("chunk_id", "medicine_id", "chunk_type", "chunk_text"))
    return q, retrieve.retrieve(q, embed(c, "chunk_text", letter_embedder, ASK.embedding_model), read(spark, d, "medicines"), letter_embedder, ASK)


def retrieve_chunks(spark, d):
    """Questions as texts, embedded, against all chunks."""
    return _hits(spark, d)[1].select("query_id", "rank", "chunk_id", "medicine_name", "chunk_type", "source_name", F.md5("chunk_text").alias("digest"), F.round("similarity_score", 6).alias("sim"))


def retrieve_named(spark, d):
    """Every 50th usable chunk as a question (its medicine's name, its own vector) against all chunks, named records first."""
    c, m = read(spark, d, "document_chunks"), read(spark, d, "medicines")
    own = c.filter((F.col("chunk_id") % 50 == 0) & vector.is_usable(F.col("embedding"), F.col("embedding_model"), MODEL, DIMS))
    q = own.join(m.select("medicine_id", "medicine_name"), "medicine_id").select(F.col("chunk_id").alias("query_id"), F.col("medicine_name").alias("query_text"), F.col("embedding").alias("query_vec"))
    return retrieve.top_chunks(q, c, m, EngineConfig()).select("query_id", "rank", "chunk_id", F.round("similarity_score", 6).alias("sim"), F.round("rank_score", 6).alias("score"))


def retrieve_unnamed(spark, d):
    """The same by the vectors alone: models, lengths and damage of the stored vectors decide what may be a hit."""
    c, m = read(spark, d, "document_chunks"), read(spark, d, "medicines")
    own = c.filter((F.col("chunk_id") % 50 == 0) & vector.is_usable(F.col("embedding"), F.col("embedding_model"), MODEL, DIMS))
    q = own.select(F.col("chunk_id").alias("query_id"), F.lit(None).cast("string").alias("query_text"), F.col("embedding").alias("query_vec"))
    return retrieve.top_chunks(q, c, m, EngineConfig()).select("query_id", "rank", "chunk_id", F.round("similarity_score", 6).alias("sim"))


def ordered_scan(spark, d):
    """Every chunk with its record's name and source, in order."""
    rows = filters.ordered_chunks(read(spark, d, "document_chunks"), read(spark, d, "medicines"))
    return rows.select("chunk_id", "medicine_id", F.md5("chunk_text").alias("digest"), "chunk_type", F.coalesce(F.size("embedding"), F.lit(-1)).alias("n"), "embedding_model", "medicine_name", "source_name", "source_reference")


def stale_filter_trace(spark, d):
    return retrieve.trace(read(spark, d, "document_chunks"), read(spark, d, "medicines"), MODEL)


def embedding_dims(spark, d):
    c = read(spark, d, "document_chunks").filter(F.col("embedding").isNotNull())
    return c.groupBy(F.coalesce("embedding_model", F.lit("")).alias("model")).agg(F.count_distinct(F.size("embedding")).alias("n_dims"), F.count("*").alias("n"))


def name_match(spark, d):
    parts = read(spark, d, "part").select("p_partkey", "p_name")
    brands = parts.groupBy(F.split("p_name", " ")[0].alias("w")).agg(F.min("p_partkey").alias("query_id"))
    q = brands.select("query_id", F.concat(F.lit("Is "), F.upper("w"), F.lit(", safe?")).alias("query_text"))
    return named_in(q, parts, "query_id", "query_text", "p_partkey", "p_name")


def name_match_chat(spark, d):
    """Which medicines the user messages of the chats name."""
    return named_in(_questions(spark, d), read(spark, d, "medicines"), "query_id", "query_text", "medicine_id", "medicine_name")


def quantity_extract(spark, d):
    docs = spread(read(spark, d, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.explode(text.quantities(casefold_udf("text"))).alias("quantity")).groupBy("doc_id", "quantity").agg(F.count("*").alias("n"))


def quantity_unsupported(spark, d):
    """Quantities of assistant turns that their question didn't state: set difference over (number, unit)."""
    chat = read(spark, d, "chat_messages").groupBy("conv_id", "turn", "role").agg(F.min("content").alias("content"))
    found = chat.select("conv_id", "turn", "role", F.explode(F.array_distinct(text.quantities(casefold_udf("content")))).alias("quantity"))
    answers = found.filter(F.col("role") == "assistant").select("conv_id", "turn", "quantity")
    asked = found.filter(F.col("role") == "user").select("conv_id", (F.col("turn") + 1).alias("turn"), "quantity")
    return answers.join(asked, ["conv_id", "turn", "quantity"], "left_anti")


def guard_classify(spark, d):
    chat = read(spark, d, "chat_messages").select("conv_id", "turn", "received_at", casefold_udf("content").alias("t"), "content")
    return chat.select("conv_id", "turn", "received_at", guard.is_personal(F.col("t")).alias("personal"), guard.is_urgent(F.col("content")).alias("urgent"))


def critical_flag(spark, d):
    c = read(spark, d, "document_chunks")
    return c.groupBy("medicine_id").agg(F.bool_or(guard.is_critical_source(F.col("chunk_type"), F.col("chunk_text"))).alias("critical"))


def _collected(spark, d) -> DataFrame:
    return ans.collect_hits(_hits(spark, d)[1])


def overlap_flag(spark, d):
    """Whether two hits of a question share medicine and category."""
    return _collected(spark, d).select("query_id", ans.has_overlap(F.col("hits")).alias("overlap"))


def source_distinct(spark, d):
    """The sources of each question's hits, each once in rank order."""
    return _collected(spark, d).select("query_id", ans.source_line(F.col("hits")).alias("sources"))


def context_render(spark, d):
    return _collected(spark, d).select("query_id", F.md5(ans.render_context(F.col("hits"))).alias("digest"))


def safety_notes(spark, d):
    return _collected(spark, d).select("query_id", ans.safety_notes(F.col("hits")).alias("notes"))


def general_first2(spark, d):
    return _collected(spark, d).select("query_id", F.md5(F.array_join(ans.general_texts(F.col("hits")), "|")).alias("digest"))


def personal_answers(spark, d):
    """What a personal request about each question's hits is told."""
    return _collected(spark, d).select("query_id", F.md5(ans.personal_answer(F.col("hits"))).alias("digest"))


def finalised(spark, d):
    """Each question's first hit as a finished answer, with sources and disclaimer."""
    return _collected(spark, d).select("query_id", F.md5(ans.finalise(F.element_at("hits", 1)["chunk_text"], F.col("hits"))).alias("digest"))


def response_split(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "text", "source", "lang")
    made = F.when(F.col("lang").isNull(), F.col("text")).otherwise(F.concat(F.col("text"), F.lit(guard.MARKER), F.col("source"), F.lit("\n\nUyarı.")))
    s = text.split_response(made, guard.MARKER, guard.UNSTATED, "-")
    return docs.filter(F.col("text").isNotNull()).select("doc_id", F.md5(s["answer"]).alias("digest"), s["sources"].alias("sources"), s["disclaimer"].alias("disclaimer"))


def ingest_records(spark, d):
    """The deliveries as normalised records."""
    _, rows = prepare(read(spark, d, "raw_records"), strict=False)
    return rows.select("record_id", "pos", "medicine_name", *SECTION_FIELDS, "source_name", "source_reference")


def ingest_bad_documents(spark, d):
    return jr.bad_documents(jr.parse(read(spark, d, "raw_records"))).select("record_id", "file_path")


def ingest_chunks(spark, d):
    _, rows = prepare(read(spark, d, "raw_records"), strict=False)
    out = section_chunks(rows.select("record_id", "pos", "medicine_name", "rec"))
    return out.select("record_id", "record_pos", "pos", "chunk_type", F.length("chunk_text").alias("n"), F.md5("chunk_text").alias("digest"))


def answer_pipeline(spark, d):
    """The chats' questions, answered from the whole store by the stand-in model."""
    q, hits = _hits(spark, d)
    return ans.answer(q, hits).select("query_id", "outcome", F.md5("response").alias("digest"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        topk_batch, stats_counts, chunk_parent_join, filter_optional, filter_no_terms, lookup_nocase, nullsafe_upsert_match, upsert_merge,
        replace_children, cascade_delete, assign_ids, alias_coalesce, section_unpivot, text_split_units, text_pack_chunks, change_detect,
        vector_validity, embed_json_roundtrip, embed_json_invalid, cosine_pairs, topk_boosted, retrieve_chunks, retrieve_named, retrieve_unnamed, ordered_scan,
        stale_filter_trace, embedding_dims, name_match, name_match_chat, quantity_extract, quantity_unsupported, guard_classify, critical_flag, overlap_flag,
        source_distinct, context_render, safety_notes, general_first2, personal_answers, finalised, response_split, ingest_records, ingest_bad_documents, ingest_chunks, answer_pipeline,
    )
}
