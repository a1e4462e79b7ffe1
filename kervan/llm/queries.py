"""Registered queries of the training-data operators, each over its whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kervan.llm import containers, entities, near_copies, neighbours, pieces, sentences, tokens, truncation, unicode_form
from kervan.functions import vector
from kervan.session import ensure_checkpoint_dir, spread, task_slots

Query = Callable[[SparkSession, str], DataFrame]


def read(spark: SparkSession, d: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table, in at least as many partitions as there are cores."""
    return spread(spark.read.parquet(f"{d}/{name}.parquet").select(*columns))


def fields(df: DataFrame, key: str, *names: str) -> DataFrame:
    """field, row_id, value: one row per filled value of the named columns, from one scan."""
    parts = F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).alias("value")) for n in names])
    return df.select(F.col(key).alias("row_id"), F.inline(parts)).filter(F.col("value").isNotNull()).select("field", "row_id", "value")


def body(c: Column) -> Column:
    """Text after the two header lines; '' where there are fewer than three lines."""
    return F.coalesce(F.get(F.split(c, "\n", 3), F.lit(2)), F.lit(""))


def _named(spark: SparkSession, d: str) -> DataFrame:
    names = fields(read(spark, d, "medicines", "medicine_id", "medicine_name"), "medicine_id", "medicine_name")
    return names.unionByName(fields(read(spark, d, "document_chunks", "chunk_id", "chunk_text"), "chunk_id", "chunk_text"))


def p1_forms(spark, d):
    """Every value in its consistent form."""
    return unicode_form.with_form(_named(spark, d), "value").select("field", "row_id", "form", "disguised")


def p1_found(spark, d):
    return unicode_form.with_form(_named(spark, d), "value").filter("disguised").select("field", "row_id")


COPY_FIELDS = ("chunk_text", "warnings", "common_side_effects")


def _copy_texts(spark: SparkSession, d: str) -> DataFrame:
    """gid (row id * 4 + place of the field in COPY_FIELDS) and text of the three fields."""
    c = read(spark, d, "document_chunks", "chunk_id", "chunk_text").select("chunk_id", body(F.col("chunk_text")).alias("chunk_text"))
    m = fields(read(spark, d, "medicines", "medicine_id", "warnings", "common_side_effects"), "medicine_id", "warnings", "common_side_effects")
    place = F.array_position(F.array(*map(F.lit, COPY_FIELDS)), F.col("field")) - 1
    values = fields(c, "chunk_id", "chunk_text").unionByName(m)
    return values.select((F.col("row_id") * 4 + place).alias("gid"), F.col("value").alias("text"))


def _field(gid: str) -> Column:
    return F.element_at(F.array(*map(F.lit, COPY_FIELDS)), (F.col(gid) % 4 + 1).cast("int"))


def _row(gid: str) -> Column:
    return F.shiftright(gid, 2)


def p2_found(spark, d):
    """Pairs of texts that share at least half of their three-word sequences, copies included."""
    pairs, members = near_copies.near_copies(_copy_texts(spark, d), 3, 0.5, form=unicode_form.form_in_worker)
    return near_copies.expand(pairs, members).select(_field("a").alias("field"), _row("a").alias("id_a"), _row("b").alias("id_b"))


def p2_classes(spark, d):
    """Every text with its class of near copies (five words, 0.8)."""
    pairs, members = near_copies.near_copies(_copy_texts(spark, d), every=False, form=unicode_form.form_in_worker)
    return near_copies.classes_of(pairs, members).select(_field("gid").alias("field"), _row("gid").alias("row_id"), _row("class_id").alias("class_id"))


MODEL, DIMS = "leaflet-embed-2", 64


def p3_neighbours(spark, d):
    """chunk_id, near_id, sim: the five most similar usable chunks of every usable chunk."""
    c = read(spark, d, "document_chunks", "chunk_id", "embedding", "embedding_model")
    rows = c.filter(vector.is_usable(F.col("embedding"), F.col("embedding_model"), MODEL, DIMS)).select(F.col("chunk_id").alias("id"), F.col("embedding").alias("vec"))
    near = neighbours.nearest(rows)
    return near.select(F.col("id").alias("chunk_id"), F.explode("near").alias("x")).select("chunk_id", F.col("x.id").alias("near_id"), F.round("x.sim", 9).alias("sim"))


def p3_found(spark, d):
    n = p3_neighbours(spark, d)
    return n.select(F.least("chunk_id", "near_id").alias("chunk_id_a"), F.greatest("chunk_id", "near_id").alias("chunk_id_b")).distinct()


def _oversized(spark: SparkSession, d: str) -> DataFrame:
    m = fields(read(spark, d, "medicines", "medicine_id", "dosage_information", "warnings"), "medicine_id", "dosage_information", "warnings")
    return m.unionByName(fields(read(spark, d, "document_chunks", "chunk_id", "chunk_text"), "chunk_id", "chunk_text"))


def p4_pieces(spark, d):
    return pieces.cut_values(_oversized(spark, d), "value", ["field", "row_id"])


def p4_found(spark, d):
    """Values that come out in more than one piece."""
    return p4_pieces(spark, d).filter(F.col("piece_no") == 1).select("field", "row_id")


def p4_files(spark, d):
    """The documents written as text files by source, and each file cut by byte ranges."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/files-{uuid.uuid4().hex}"
    docs = read(spark, d, "documents", "doc_id", "text", "source").filter(F.col("text").isNotNull()).withColumn("part", F.floor(F.col("doc_id") / 50_000))
    placed = docs.repartition(task_slots(spark), "source", "part").sortWithinPartitions("source", "part", "doc_id")
    placed.select("text", "source", "part").write.partitionBy("source", "part").text(folder)
    at = [F.regexp_extract("path", f"{name}=([^/]*)/", 1).alias(name) for name in ("source", "part")]
    return pieces.cut_files(spark, [folder]).select(*at, "piece_no", "start_pos", "fresh_pos", "end_pos", F.md5("piece").alias("digest"))


def p5_products(spark, d):
    """medicine_id, product: rows of one product, however typed, share the value."""
    return entities.resolve_names(read(spark, d, "medicines", "medicine_id", "medicine_name"), "medicine_id", "medicine_name")


def p5_found(spark, d):
    p = p5_products(spark, d)
    left, right = p.withColumnRenamed("medicine_id", "left_id"), p.withColumnRenamed("medicine_id", "right_id")
    names = left.join(right, "product").filter(F.col("left_id") < F.col("right_id")).select(F.lit("medicine_name").alias("field"), "left_id", "right_id")
    refs = spark.read.parquet(f"{d}/ingredient_refs.parquet")
    found = entities.link_ingredients(read(spark, d, "medicines", "medicine_id", "active_ingredient"), "medicine_id", "active_ingredient", refs)
    return names.unionByName(found.select(F.lit("active_ingredient").alias("field"), F.col("medicine_id").alias("left_id"), F.col("ingredient_id").alias("right_id")))


def p6_found(spark, d):
    names = ("dosage_information", "usage_information", "interactions")
    values = fields(read(spark, d, "medicines", "medicine_id", *names), "medicine_id", *names)
    return sentences.split_sentences(values, "value", ["field", "row_id"]).select("field", F.col("row_id").alias("medicine_id"), "start_pos", "end_pos")


def p7_ids(spark, d):
    return tokens.encode_texts(read(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


def p8_containers(spark, d):
    """Every document, or piece of one above 2,048 ids, with its container."""
    sizes = tokens.encode_texts(read(spark, d, "documents", "doc_id", "text"), "doc_id", "text").select("doc_id", F.size("ids").alias("n_ids"))
    return containers.fill(sizes, "doc_id", "n_ids")


def p8_usage(spark, d):
    """Containers used, the least that any packing needs, and the share left unused."""
    return containers.usage(p8_containers(spark, d))


def _judged(spark: SparkSession, d: str) -> DataFrame:
    return truncation.judge(read(spark, d, "documents", "doc_id", "text", "source"), "doc_id", "text", "source")


def p9_found(spark, d):
    return _judged(spark, d).filter("is_cut").select("doc_id")


def p9_sources(spark, d):
    """How often each source cuts."""
    return truncation.report(_judged(spark, d))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_forms, p2_found, p2_classes, p3_found, p3_neighbours, p4_found, p4_pieces, p4_files, p5_found, p5_products, p6_found, p7_ids, p8_containers, p8_usage, p9_found, p9_sources)}
