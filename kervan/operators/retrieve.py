"""Exact top-k retrieval for many queries at once, in one pass over the chunks.

The query vectors travel to the chunks, as many at once as a bound in bytes allows, and every task scores its chunks
against all of them, block by block with one matrix product each, and passes on no more than its own best k per query.
Only those survivors are shuffled for the final ranking. Chunks and their vectors aren't moved: which records exist,
and which are named by a query, travels to them while the lists are small, which is checked; beyond that they are joined.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kervan.config import EngineConfig
from kervan.functions import vector
from kervan.functions.text import strip
from kervan.operators.embed import Embedder, embed_column, embed_one
from kervan.operators.filters import check_arguments, check_limits, current_model, is_stale, require
from kervan.operators.names import named_in

#: Bytes of query vectors that travel at once; more queries take another pass. Queries in one matrix product.
QUERY_BYTES, BLOCK_ROWS = 128 << 20, 1024
#: Record ids, and (query, record) names, up to which they travel to the chunks.
FEW_RECORDS, FEW_NAMES = 5_000_000, 200_000


def _better(held: tuple, new: tuple, k: int) -> tuple:
    """The k best of two (rank, sim, chunk_id) tables with a row per query; ties to the higher sim, then the lower id."""
    r, s, c = (np.concatenate(x, axis=1) for x in zip(held, new, strict=True))
    order = np.lexsort((c, -s, -r), axis=1)[:, :k]
    return tuple(np.take_along_axis(x, order, 1) for x in (r, s, c))


def _best_of(rank: np.ndarray, sim: np.ndarray, ids: np.ndarray, k: int) -> tuple:
    """(rank, sim, chunk_id), a row per query: its k best of these chunks, -inf where there are fewer."""
    if rank.shape[1] > k:
        cols = np.argpartition(-rank, k - 1, axis=1)[:, :k]
        kth = np.take_along_axis(rank, cols, 1).min(1)
        tied = np.flatnonzero(((rank >= kth[:, None]).sum(1) > k) & (kth > -np.inf))  # as many as tie at the last place
        for i in tied:
            at = np.flatnonzero(rank[i] >= kth[i])
            cols[i] = at[np.lexsort((ids[at], -sim[i, at], -rank[i, at]))[:k]]
    else:
        cols = np.tile(np.arange(rank.shape[1]), (len(rank), 1))
    return np.take_along_axis(rank, cols, 1), np.take_along_axis(sim, cols, 1), ids[cols]


def score(chunks: DataFrame, ids: list[int], vectors: np.ndarray, k: int | None, min_score: float, boost: float, names: dict[int, list[int]] | None = None) -> DataFrame:
    """(query_id, chunk_id, sim, rank_score): each task's best k of its own chunks, per query; k None: all above min_score.

    chunks: chunk_id, medicine_id, embedding (valid), and, if names isn't given, named (array of the query ids whose
    text names the chunk's record, or null). names: record id -> query ids. sim has twelve decimals. Chunks of another length or with a zero
    norm are skipped.
    """
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    at = {q: i for i, q in enumerate(ids)}
    places = None if names is None else {m: [at[q] for q in qs if q in at] for m, qs in names.items()}
    shared = chunks.sparkSession.sparkContext.broadcast((np.asarray(ids, np.int64), vectors / np.where(norms > 0, norms, 1), at, places))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, q, at, places = shared.value
        parts = [slice(i, i + BLOCK_ROWS) for i in range(0, len(qid), BLOCK_ROWS)]
        held = [tuple(np.full((len(qid[p]), 0), fill) for fill in (-np.inf, 0.0, 0)) for p in parts]
        for b in batches:
            lists = b.column("embedding")
            size = np.diff(lists.offsets.to_numpy())
            rows = np.flatnonzero(size == q.shape[1])
            if not rows.size:
                continue
            start = lists.offsets.to_numpy()[rows] - lists.offsets.to_numpy()[0]
            m = lists.flatten().to_numpy(zero_copy_only=False)[start[:, None] + np.arange(q.shape[1])]
            mn = np.linalg.norm(m, axis=1)
            m, rows = m[mn > 0] / mn[mn > 0, None], rows[mn > 0]
            cid = b.column("chunk_id").to_numpy()[rows]
            if not boost:
                lifted = []
            elif places is None:
                lifted = [(at[x], j) for j, named in enumerate(b.column("named").take(pa.array(rows)).to_pylist()) for x in named or () if x in at]
            else:
                lifted = [(x, j) for j, r in enumerate(b.column("medicine_id").to_numpy()[rows].tolist()) for x in places.get(r, ())]
            lift = np.array(sorted(lifted), np.int64).reshape(-1, 2)
            for n, p in enumerate(parts):
                sim = np.round(np.clip(q[p] @ m.T, -1.0, 1.0), 12)  # what differs by the order of additions only is a tie
                rank = np.where(sim >= min_score, sim, -np.inf)
                lo, hi = np.searchsorted(lift[:, 0], [p.start, p.start + len(sim)])
                rank[lift[lo:hi, 0] - p.start, lift[lo:hi, 1]] += boost
                if k is None:
                    i, j = np.nonzero(rank > -np.inf)
                    yield pa.RecordBatch.from_arrays([pa.array(qid[p][i]), pa.array(cid[j]), pa.array(sim[i, j]), pa.array(rank[i, j])], names=["query_id", "chunk_id", "sim", "rank_score"])
                else:
                    held[n] = _better(held[n], _best_of(rank, sim, cid, k), k)
        for p, (r, s, c) in zip(parts, held, strict=True):
            i, j = np.nonzero(r > -np.inf)
            if i.size:
                yield pa.RecordBatch.from_arrays([pa.array(qid[p][i]), pa.array(c[i, j].astype(np.int64)), pa.array(s[i, j]), pa.array(r[i, j])], names=["query_id", "chunk_id", "sim", "rank_score"])

    columns = ["chunk_id", "embedding", *(["medicine_id"] if names is not None else ["named"] if boost else [])]
    return chunks.select(*columns).mapInArrow(best, "query_id long, chunk_id long, sim double, rank_score double")


def candidates(chunks: DataFrame, medicines: DataFrame, model: str) -> DataFrame:
    """chunk_id, medicine_id, embedding of the chunks that may be hits: a record of theirs exists, the vector is valid and not stale."""
    fine = chunks.filter(F.col("embedding").isNotNull() & current_model(F.col("embedding_model"), model) & vector.is_valid(F.col("embedding")))
    records = medicines.select("medicine_id")
    records = F.broadcast(records) if medicines.count() <= FEW_RECORDS else records
    return fine.select("chunk_id", "medicine_id", "embedding").join(records, "medicine_id", "left_semi")


def top_chunks(queries: DataFrame, chunks: DataFrame, medicines: DataFrame, config: EngineConfig = EngineConfig(), *, k: int | None = None, min_score: float | None = None) -> DataFrame:
    """The k best chunks of every query: (query_id, rank, chunk_id, medicine_id, similarity_score, rank_score, ...).

    queries: query_id, query_text (null or blank names nothing), query_vec. chunks and medicines as in kervan.schema;
    extra columns are ignored. Chunks without a medicine, without a vector, with a stale model, an invalid, zero or
    differently sized vector give no hit. The threshold holds for the raw score; the boost of named records only
    ranks. Ties go to the lower chunk_id. Invalid query vectors raise; zero ones and empty tables give no hits. A k
    below 1 or a threshold outside [-1, 1] raises.
    """
    k = config.top_k if k is None else k
    low = config.min_score if min_score is None else min_score
    check_limits(k, low)
    spark = queries.sparkSession
    usable = candidates(chunks, medicines, config.embedding_model)
    out = None
    for rows in blocks(queries.select("query_id", "query_text", "query_vec").orderBy("query_id").toLocalIterator(prefetchPartitions=False)):
        sizes = {len(r["query_vec"] or ()) for r in rows}
        if 0 in sizes or not all(np.isfinite(np.asarray(r["query_vec"], float)).all() for r in rows):
            raise ValueError("query vectors must be non-empty and finite")
        texts = [(r["query_id"], r["query_text"]) for r in rows if (r["query_text"] or "").strip()]
        names, rows_of = {}, usable
        if texts and config.name_boost:
            asked = spark.createDataFrame(texts, "query_id long, query_text string")
            named = named_in(asked, medicines, "query_id", "query_text", "medicine_id", "medicine_name")
            found = named.limit(FEW_NAMES + 1).collect()
            if len(found) <= FEW_NAMES:
                for r in found:
                    names.setdefault(r["medicine_id"], []).append(r["query_id"])
            else:
                names = None
                rows_of = usable.join(named.groupBy("medicine_id").agg(F.collect_list("query_id").alias("named")), "medicine_id", "left")
        for d in sorted(sizes):
            mine = [r for r in rows if len(r["query_vec"]) == d and any(r["query_vec"])]
            if mine:
                part = score(rows_of, [r["query_id"] for r in mine], np.array([r["query_vec"] for r in mine], float), k, low, config.name_boost if names is None or names else 0.0, names)
                out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], "query_id long, chunk_id long, sim double, rank_score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("rank_score"), F.desc("sim"), "chunk_id")
    hits = out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    texts = chunks.select("chunk_id", "medicine_id", "chunk_type", "chunk_text")
    shown = medicines.select("medicine_id", "medicine_name", "source_name")
    return hits.join(texts, "chunk_id").join(shown, "medicine_id").select(
        "query_id", "rank", "chunk_id", "medicine_id", "medicine_name", "chunk_type", "chunk_text", F.col("sim").alias("similarity_score"), "rank_score", "source_name"
    )


def with_vectors(queries: DataFrame, load: Callable[[], Embedder], name: str) -> DataFrame:
    """queries (query_id, query_text) with the model's query_vec of the stripped text; a null or blank text raises when it is read."""
    asked = require(queries.select("query_id", "query_text"), strip(F.col("query_text")) != "", "a query must be a text that isn't blank", "query_text")
    return asked.withColumn("query_vec", embed_column(load, name)(strip(F.col("query_text"))))


def retrieve(queries: DataFrame, chunks: DataFrame, medicines: DataFrame, load: Callable[[], Embedder], config: EngineConfig = EngineConfig(), *, k: int | None = None, min_score: float | None = None) -> DataFrame:
    """top_chunks for questions that are texts (query_id, query_text). Without any candidate chunk the model isn't asked."""
    check_limits(config.top_k if k is None else k, config.min_score if min_score is None else min_score)
    if candidates(chunks, medicines, config.embedding_model).isEmpty():
        asked = queries.select("query_id", "query_text", F.lit(None).cast("array<double>").alias("query_vec")).limit(0)
    else:
        asked = with_vectors(queries, load, config.embedding_model)
    return top_chunks(asked, chunks, medicines, config, k=k, min_score=min_score)


def retrieve_one(query: str, chunks: DataFrame, medicines: DataFrame, load: Callable[[], Embedder], config: EngineConfig = EngineConfig(), *, k: int | None = None, min_score: float | None = None) -> DataFrame:
    """The hits of one question, as retrieve gives them with query_id 0; its vector is made in this process. Arguments are checked at once."""
    check_arguments(query, config.top_k if k is None else k, config.min_score if min_score is None else min_score)
    spark, text = chunks.sparkSession, query.strip()
    found = not candidates(chunks, medicines, config.embedding_model).isEmpty()
    rows = [(0, text, embed_one(text, load, config.embedding_model))] if found else []
    return top_chunks(spark.createDataFrame(rows, "query_id long, query_text string, query_vec array<double>"), chunks, medicines, config, k=k, min_score=min_score)


def query_trace(queries: DataFrame, hits: DataFrame, chunks: DataFrame, medicines: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """One row per query (query_id, query_vec): what was asked and found, and the state of the store.

    dimension and preview (first eight values) of its vector, threshold, k, chunks, stale and candidate counts, and
    top_chunks, its hits in rank order (k of them at most).
    """
    fields = ["rank", "medicine_name", "chunk_type", "chunk_text", "similarity_score", "source_name"]
    top = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("top_chunks"))
    state = trace(chunks, medicines, config.embedding_model).first()
    out = queries.select("query_id", F.size("query_vec").alias("dimension"), vector.preview(F.col("query_vec")).alias("preview")).join(top, "query_id", "left")
    empty = F.array().cast(top.schema["top_chunks"].dataType)
    counts = [F.lit(state[n]).alias(n) for n in ("chunks", "stale", "candidates")]
    return out.select("query_id", "dimension", "preview", F.lit(config.min_score).alias("min_score"), F.lit(config.top_k).alias("top_k"), *counts, F.coalesce("top_chunks", empty).alias("top_chunks"))


def blocks(rows) -> Iterator[list]:
    """Lists of rows whose query vectors stay within QUERY_BYTES."""
    block, held = [], 0
    for r in rows:
        block.append(r)
        held += 8 * len(r["query_vec"] or ())
        if held >= QUERY_BYTES:
            yield block
            block, held = [], 0
    if block:
        yield block


def trace(chunks: DataFrame, medicines: DataFrame, current: str) -> DataFrame:
    """One row: chunks with a medicine, those embedded, those skipped as stale, the candidates left."""
    e, m = F.col("embedding"), F.col("embedding_model")
    rows = chunks.select("medicine_id", e, m).join(medicines.select("medicine_id"), "medicine_id")
    return rows.agg(
        F.count(F.lit(1)).alias("chunks"),
        F.count_if(e.isNotNull()).alias("embedded"),
        F.count_if(is_stale(e, m, current)).alias("stale"),
        F.count_if(e.isNotNull() & current_model(m, current)).alias("candidates"),
    )


