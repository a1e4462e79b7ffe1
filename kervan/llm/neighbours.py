"""The k most similar vectors of every vector.

TABLES hash tables, each with a hash of its own: the direction, of K fitted on a bounded sample, that a vector projects
on most, and p-stable functions floor((a.r + b) / w), with Gaussian a, of the residual r from that direction; every
bucket of every table is made by at least one of them, fuller cells by more. In each table a vector is sent to the
buckets, its own and perturbed ones (next directions, one or two p-stable values up or down), that are most likely to
hold its neighbours, in estimated order of success, and meets there both the vectors that belong there and those that
probe it, so that a pair is found when the probe lists of its two sides share any bucket of any table. Distances in a
bucket are exact; the lists of all buckets and tables are merged and ranked again; vectors whose list stays short are
compared with all. Equal vectors travel once, as the lowest id of their class.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kervan.session import cut

#: Hash tables, buckets of each that a vector of a cell with one p-stable function is sent to, and their factor for each further function.
TABLES, PROBES, GROWTH = 3, 2, 1.5
#: Most directions of a table, and vectors one is meant for; vectors of the fitting sample for each direction, and at most.
DIRECTIONS, PER_DIRECTION, PER_SAMPLE, SAMPLE = 8_192, 48, 16, 131_072
#: Vectors of a cell from which it gets a second p-stable function; vectors of a bucket from which it is compared in tiles.
FULL, SPLIT = 8_192, 16_384
#: Width of a p-stable function, in standard deviations of the residuals.
WIDTH = 4.0
#: Vectors with short lists that are compared with all others at once.
BLOCK_ROWS = 1_024
_ROUNDS = 5


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (fixed multipliers)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fit(sample: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """k unit directions: spherical k-means over the sample, started from k of its rows."""
    rng = np.random.default_rng(seed)
    c = sample[rng.permutation(len(sample))[:k]].copy()
    for _ in range(_ROUNDS):
        near = np.concatenate([np.argmax(sample[i : i + 2048] @ c.T, 1) for i in range(0, len(sample), 2048)])
        order = np.argsort(near, kind="stable")
        found, start = np.unique(near[order], return_index=True)
        c[found] = np.add.reduceat(sample[order], start)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c.astype(np.float32)


def directions_for(total: int) -> int:
    """How many directions a table has for so many vectors."""
    return int(np.clip(2 ** round(np.log2(max(total / PER_DIRECTION, 1))), 1, DIRECTIONS))


class Table:
    """One hash table's bucket function: directions, p-stable functions, and how many of these each direction's cell takes."""

    def __init__(self, sample: np.ndarray, total: int, seed: int, probes: int = PROBES, full: int = FULL):
        k = max(1, min(directions_for(total), len(sample) // 4))
        self.seed, self.directions = seed, fit(sample, k, seed)
        near = np.concatenate([np.argmax(sample[i : i + 2048] @ self.directions.T, 1) for i in range(0, len(sample), 2048)])
        load = np.bincount(near, minlength=k) * (total / max(1, len(sample))) * probes
        self.depth = np.maximum(1, np.ceil(np.log2(np.maximum(load, 1) / full))).astype(int)
        m = int(self.depth.max())
        self.probes = np.round(probes * GROWTH ** (self.depth - 1)).astype(int)
        rng = np.random.default_rng(seed)
        self.a = rng.normal(size=(m, sample.shape[1])).astype(np.float32)
        spread = np.median(np.abs((sample - self.directions[near]) @ self.a[0])) / 0.6745
        self.width = np.float32(WIDTH * spread + 1e-6)
        self.b = rng.uniform(0, 1, m).astype(np.float32)
        self.shift = self.directions @ self.a.T
        #: perturbations: none, one value up or down, two of different functions; and which functions each touches
        single = [((j, d),) for j in range(m) for d in (-1, 1)]
        self.moves = [(), *single, *[x + y for x, y in combinations(single, 2) if x[0][0] != y[0][0]]]
        self.delta = np.array([[sum(d for i, d in mv if i == j) for j in range(m)] for mv in self.moves], np.int64)

    def buckets(self, v: np.ndarray) -> np.ndarray:
        """(n, most probes) bucket keys in the order of their estimated success; the first again where a vector has fewer."""
        m, most = len(self.a), int(self.probes.max())
        t = min(most, len(self.directions))
        sim = v @ self.directions.T
        near = np.argpartition(-sim, t - 1, axis=1)[:, :t] if t < sim.shape[1] else np.tile(np.arange(t), (len(v), 1))
        s = np.take_along_axis(sim, near, 1)
        gap = (s.max(1, keepdims=True) - s) ** 2
        allowed = self.probes[near[np.arange(len(v)), s.argmax(1)]]
        x = ((v @ self.a.T)[:, None] - self.shift[near]) / self.width + self.b  # vector, cell, function
        h = np.floor(x)
        f = (x - h).astype(np.float32)
        used = np.arange(m) < self.depth[near][:, :, None]
        down, up = np.where(used, f * f, np.inf), np.where(used, (1 - f) ** 2, np.inf)
        cost = np.repeat(gap[:, :, None], len(self.moves), 2)
        for i, move in enumerate(self.moves):
            for j, d in move:
                cost[:, :, i] += (up if d > 0 else down)[:, :, j] * float(self.width) ** 2 / 4
        flat = cost.reshape(len(v), -1)
        order = np.argsort(flat, 1, kind="stable")[:, :most]
        order = np.where(np.isfinite(np.take_along_axis(flat, order, 1)) & (np.arange(order.shape[1]) < allowed[:, None]), order, order[:, :1])
        cell, move = order // len(self.moves), order % len(self.moves)
        code = np.take_along_axis(np.where(used, h, 0), cell[:, :, None], 1).astype(np.int64) + self.delta[move]
        key = _mix(np.take_along_axis(near, cell, 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(self.seed))
        for j in range(m):
            key = _mix(key * np.uint64(0xD6E8FEB86659FD93) + code[:, :, j].astype(np.uint64))
        return key.view(np.int64)


class Hash:
    """All tables, and the buckets that the sample shows to be too full for one task: these are compared in tiles."""

    def __init__(self, sample: np.ndarray, total: int, probes: int = PROBES, tables: int = TABLES, full: int = FULL, split: int = SPLIT):
        self.tables = [Table(sample, total, seed, probes, full) for seed in range(1, tables + 1)]
        keys = np.concatenate([self._keys(sample[i : i + 2048]) for i in range(0, len(sample), 2048)]) if len(sample) else np.empty((0, 1), np.int64)
        found, n = np.unique(keys, return_counts=True)
        parts = np.ceil(n * (total / max(1, len(sample))) / split).astype(int)
        self.split = {int(k): int(p) for k, p in zip(found[parts > 1], parts[parts > 1], strict=True)}

    def _keys(self, v: np.ndarray) -> np.ndarray:
        return np.concatenate([t.buckets(v) for t in self.tables], 1)

    def places(self, v: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, bucket), each once: where each vector is sent. A split bucket's vectors lie in blocks by their ids, and every two blocks meet in a bucket of their own."""
        keys = np.sort(self._keys(v), 1)
        row, column = np.nonzero(np.c_[np.ones(len(v), bool), keys[:, 1:] != keys[:, :-1]])
        bucket = keys[row, column]
        if self.split:
            parts = np.fromiter((self.split.get(k, 1) for k in bucket.tolist()), int, len(bucket))
            row, bucket, other = np.repeat(row, parts), np.repeat(bucket, parts), np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            parts = np.repeat(parts, parts)
            own = (_mix(ids[row].astype(np.uint64)) % parts.astype(np.uint64)).astype(np.int64)
            tile = np.minimum(own, other) * parts + np.maximum(own, other)
            bucket = np.where(parts > 1, _mix(bucket.astype(np.uint64) + _mix(tile.astype(np.uint64) + np.uint64(1))).view(np.int64), bucket)
        return row, bucket


def _vectors(rows: DataFrame) -> DataFrame:
    """id, digest of the stored vector, the unit vector as 32-bit values; rows: id, vec (valid, not all zero)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ids, lists = b.column(0), b.column(1)
            offsets = lists.offsets.to_numpy()
            m = lists.values.to_numpy()[offsets[0] : offsets[-1]].reshape(len(ids), -1)
            unit = (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32)
            digest = [hashlib.blake2b(r.tobytes(), digest_size=16).digest() for r in m]
            yield pa.RecordBatch.from_arrays([ids, pa.array(digest), pa.array([r.tobytes() for r in unit])], names=["id", "digest", "unit"])

    return rows.select("id", "vec").mapInArrow(make, "id long, digest binary, unit binary")


def _matrix(units) -> np.ndarray:
    return np.frombuffer(b"".join(units), np.float32).reshape(len(units), -1) if len(units) else np.empty((0, 1), np.float32)


def _best(ids: np.ndarray, m: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, similarities rounded to nine decimals) of each row's k best others, ties to the lower id; rows sorted by id."""
    n = len(ids)
    take = min(k + 3, n - 1)
    places, sims = np.empty((n, min(k, n - 1)), np.int64), np.empty((n, min(k, n - 1)))
    wide = m.astype(np.float64)
    step = max(1, 4_000_000 // n)
    for at in range(0, n, step):
        q = np.arange(at, min(n, at + step))
        s = m[q] @ m.T
        s[np.arange(len(q)), q] = -2
        some = np.argpartition(-s, take - 1, axis=1)[:, :take] if take < n else np.argsort(-s, 1)[:, :take]
        exact = np.round(np.einsum("qd,qkd->qk", wide[q], wide[some]), 9)
        order = np.lexsort((some, -exact), axis=1)[:, : places.shape[1]]
        places[q], sims[q] = np.take_along_axis(some, order, 1), np.take_along_axis(exact, order, 1)
    return places, sims


_LIST = "id long, near array<struct<away:double,id:long>>"


def _lists(ids: np.ndarray, places: np.ndarray, sims: np.ndarray) -> pa.Table:
    flat = pa.StructArray.from_arrays([pa.array(-sims.ravel()), pa.array(places.ravel())], names=["away", "id"])
    offsets = pa.array(np.arange(0, places.size + 1, max(1, places.shape[1])) if places.size else np.zeros(1), pa.int32())
    return pa.table({"id": pa.array(ids, pa.int64()), "near": pa.ListArray.from_arrays(offsets, flat)})


def _merged(parts: DataFrame, k: int) -> DataFrame:
    """One list of the k best per vector: at most k entries come from each bucket or task."""
    return parts.groupBy("id").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))), 1, k).alias("near"))


def _against_all(asked: list, reps: DataFrame, k: int) -> DataFrame:
    """Lists of the asked vectors (id, unit), compared with every representative; every task passes on its own k best."""
    ids, m = np.array([r["id"] for r in asked], np.int64), _matrix([bytes(r["unit"]) for r in asked])
    block = reps.sparkSession.sparkContext.broadcast((ids, m))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, m = block.value
        held, names = np.full((len(ids), 0), -2.0), np.empty((len(ids), 0), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            other = b.column(0).to_numpy()
            sim = np.round(m.astype(np.float64) @ _matrix(b.column(1).to_pylist()).astype(np.float64).T, 9)
            sim[ids[:, None] == other[None]] = -2
            held, names = np.c_[held, sim], np.c_[names, np.tile(other, (len(ids), 1))]
            order = np.lexsort((names, -held), axis=1)[:, :k]
            held, names = np.take_along_axis(held, order, 1), np.take_along_axis(names, order, 1)
        for i, n, s in zip(ids, names, held, strict=True):
            kept = s > -2
            if kept.any():
                yield from _lists(np.array([i]), n[None, kept], s[None, kept]).to_batches()

    return reps.select("id", "unit").mapInArrow(best, _LIST)


def nearest(rows: DataFrame, k: int = 5, probes: int = PROBES, tables: int = TABLES, full: int = FULL, split: int = SPLIT) -> DataFrame:
    """id, near (array of (sim, id), best first, k of them): the k most similar others of every vector.

    rows: id, vec (arrays of one length, finite, not all zero; anything else must be filtered before). Null ids and
    vectors are left out, a repeated row counts once, other columns don't matter. Equal vectors are different items;
    ties go to the lower id. Where the buckets hold fewer than k others of a vector it is compared with all, so every
    list has k entries, or as many as there are others. Empty input gives no rows. Approximate: tests measure recall
    against brute force and ask for 0.9. `full` and `split` say from how many vectors on a cell gets further p-stable
    functions and a bucket is compared in tiles.
    """
    spark = rows.sparkSession
    sc = spark.sparkContext
    all_ = cut(_vectors(rows.filter(F.col("id").isNotNull() & F.col("vec").isNotNull())))
    classes = all_.groupBy("digest").agg(F.min("id").alias("rep"))
    members = cut(all_.select("id", "digest").join(classes, "digest").select("id", "rep").distinct())
    reps = all_.join(members.filter(F.col("id") == F.col("rep")).select("id"), "id", "left_semi").select("id", "unit").dropDuplicates(["id"])
    total = members.filter(F.col("id") == F.col("rep")).count()
    if total < 2:
        return _with_copies(spark.createDataFrame([], _LIST), members, k)
    wanted = min(SAMPLE, max(256, PER_SAMPLE * directions_for(total)))
    share = F.pmod(F.xxhash64("digest"), F.lit(1 << 20)) < int(min(1.0, wanted / total) * (1 << 20))
    drawn = all_.filter(share).groupBy("digest").agg(F.first("unit").alias("unit")).collect()  # classes, each once: `wanted` of them
    hashing = sc.broadcast(Hash(_matrix(sorted(bytes(r["unit"]) for r in drawn)), total, probes, tables, full, split))

    def send(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = hashing.value
        for f in frames:
            for at in range(0, f.num_rows, 1024):
                b = f.slice(at, 1024)
                row, bucket = h.places(_matrix(b.column(1).to_pylist()), b.column(0).to_numpy())
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(bucket), b.column(0).take(take), b.column(1).take(take)], names=["bucket", "id", "unit"])

    def search(f: pa.Table) -> pa.Table:
        ids = f.column("id").to_numpy()
        order = np.argsort(ids)
        ids = ids[order]
        if len(ids) < 2:
            return _lists(np.empty(0, np.int64), np.empty((0, 1), np.int64), np.empty((0, 1)))
        units = f.column("unit").to_pylist()
        places, sims = _best(ids, _matrix([units[i] for i in order]), k)
        return _lists(ids, ids[places], sims)

    found = cut(_merged(reps.mapInArrow(send, "bucket long, id long, unit binary").groupBy("bucket").applyInArrow(search, _LIST), k))
    lone = cut(members.filter(F.col("id") == F.col("rep")).select("id").join(found.filter(F.size("near") >= min(k, total - 1)).select("id"), "id", "left_anti"))
    short = iter(()) if lone.isEmpty() else reps.join(lone, "id", "left_semi").toLocalIterator()  # vectors move only where there is such a list
    more, asked = None, []
    for r in chain(short, (None,)):
        if r is not None:
            asked.append(r)
        if asked and (r is None or len(asked) == BLOCK_ROWS):
            part = cut(_merged(_against_all(asked, reps, k), k))
            more, asked = part if more is None else more.unionByName(part), []
    if more is not None:
        found = found.join(more.select("id"), "id", "left_anti").unionByName(more)
    return _with_copies(found, members, k)


def _with_copies(found: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """Lists of representatives as lists of all vectors: each class stands for its k + 1 lowest ids."""
    w = Window.partitionBy("rep").orderBy("id")
    low = members.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k + 1).select("rep", "id")
    other = found.select(F.col("id").alias("of"), F.explode("near").alias("x")).select("of", F.col("x.away").alias("away"), F.col("x.id").alias("rep"))
    own = members.groupBy("rep").agg(F.count("*").alias("n")).filter(F.col("n") > 1).select(F.col("rep").alias("of"), F.lit(-1.0).alias("away"), "rep")
    near = other.unionByName(own).join(low, "rep").groupBy("of").agg(F.array_sort(F.collect_list(F.struct("away", "id"))).alias("near"))  # (k + 1) ** 2 at most
    out = members.join(near, F.col("rep") == F.col("of"))
    kept = F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, k)
    return out.select("id", F.transform(kept, lambda x: F.struct((-x["away"]).alias("sim"), x["id"].alias("id"))).alias("near"))
