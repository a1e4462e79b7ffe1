"""Groups of texts that repeat each other with small edits.

Texts become sets of hashed word sequences. Texts with the same set are one class, found by an aggregation that
combines before the shuffle. The representatives of the classes get a one-permutation sketch: each sequence falls
into one bin by its hash, a bin keeps its least value, and empty bins borrow from bins that a fixed random walk per
bin visits (optimal densification). Bands of the sketch are buckets. A bucket proposes a star: its lowest member with
every other one, as many edges as members, first within the rows a task has at hand, so that a bucket with a third of
all texts reaches the shuffle as a few rows. Edges are checked exactly, each once however many buckets propose it; the
members of a bucket whose edge fails make a star of their own, and after a few rounds the few that are left are
compared with each other. Where all pairs are asked for, pairs around a shared neighbour are added and checked too,
until none is new.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kervan.session import cut, task_slots

#: A pair of the least similarity s shares a bucket with probability 1 - (1 - s**rows) ** bands: this, or more, below and from WIDE.
WIDE, SURE, SURER = 0.7, 0.92, 0.99
#: Rounds of stars among the members of a bucket that failed; the rest is compared as a whole.
STARS = 2
#: Similarity from which a checked edge may lead to further pairs around a shared neighbour.
NEAR = 0.3
#: Members of a bucket from which its pairs are compared block by block.
BLOCK = 512
_WORD = re.compile(r"[^\W_]+")
_MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (fixed multipliers)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """Word -> 64-bit hash of its lower case, the same in every process; emptied when it grows large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = int.from_bytes(hashlib.blake2b(word.lower().encode(), digest_size=8).digest(), "little")
        return h


def sequences(text: str, size: int, words: _Words) -> np.ndarray:
    """Sorted distinct 32-bit hashes of the word sequences; empty where the text has fewer than `size` words."""
    found = _WORD.findall(text)
    if len(found) < size:
        return np.empty(0, np.int32)
    w = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    n = len(w) - size + 1
    h = w[:n].copy()
    for k in range(1, size):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + w[k : k + n])
    return np.unique((_mix(h) >> np.uint64(32)).astype(np.uint32).view(np.int32))


def sketch(values: np.ndarray, owner: np.ndarray, n: int, bins: int) -> np.ndarray:
    """(n, bins) sketch of n non-empty sets given as flat hashes and the set each belongs to."""
    h = _mix(values.view(np.uint32).astype(np.uint64) + np.uint64(0x51ED270B))
    slot = owner * bins + (h % np.uint64(bins)).astype(np.int64)
    least = h // np.uint64(bins)
    order = np.lexsort((least, slot))
    slot, least = slot[order], least[order]
    first = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
    table = np.full(n * bins, _MASK, np.uint64)
    table[slot[first]] = least[first]
    table = table.reshape(n, bins)
    empty_rows, empty_bins = np.nonzero(table == _MASK)
    out, attempt = table.copy(), 0
    while empty_rows.size:
        attempt += 1
        donor = (_mix(empty_bins.astype(np.uint64) * np.uint64(0x10001) + np.uint64(attempt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) % np.uint64(bins)).astype(np.int64)
        got = table[empty_rows, donor]
        ok = got != _MASK
        out[empty_rows[ok], empty_bins[ok]] = got[ok]
        empty_rows, empty_bins = empty_rows[~ok], empty_bins[~ok]
    return out


def band_keys(table: np.ndarray, group: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(n, bands) bucket keys; texts of different groups (fields) never share one."""
    out = np.empty((len(table), bands), np.uint64)
    for b in range(bands):
        k = _mix(group.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(b + 1))
        for r in range(rows):
            k = _mix(k * np.uint64(0x9E3779B97F4A7C15) + table[:, b * rows + r])
        out[:, b] = k
    return out.view(np.int64)


def _sets(values: DataFrame, size: int, form: Callable[[str], str] | None = None) -> DataFrame:
    """gid, digest of the set, the set; values: gid (its lowest bits are the group), text. Too short texts go."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for b in batches:
            gid, sets, digests = [], [], []
            for g, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = sequences(form(t) if form else t, size, words) if t else ()
                if len(s):
                    gid.append(g)
                    sets.append(s)
                    digests.append(hashlib.blake2b(s.tobytes() + bytes([g & 3]), digest_size=16).digest())
            flat = np.concatenate(sets) if sets else np.empty(0, np.int32)
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(gid, pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["gid", "digest", "seqs"]
            )

    return values.select("gid", "text").filter(F.col("gid").isNotNull()).mapInArrow(make, "gid long, digest binary, seqs array<int>")


def bands_for(least: float) -> tuple[int, int]:
    """(bands, rows): the fewest bands with which a pair of the least similarity is as sure to share a bucket as asked.

    Rows are what keeps foreign texts apart: of five, those of similarity 0.2 share a bucket once in forty times.
    """
    rows, sure = (5, SURE) if least < WIDE else (6, SURER)
    return math.ceil(math.log(1 - sure) / math.log(1 - least**rows)), rows


def _buckets(reps: DataFrame, bands: int, rows: int) -> DataFrame:
    """key, gid: one row per band of every representative."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 2048):
                b = big.slice(at, 2048)
                gid, lists = b.column(0).to_numpy(), b.column(1)
                offsets = lists.offsets.to_numpy()
                values = lists.values.to_numpy()[offsets[0] : offsets[-1]]
                owner = np.repeat(np.arange(len(gid)), np.diff(offsets))
                keys = band_keys(sketch(values, owner, len(gid), bands * rows), gid & 3, bands, rows)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(gid, bands))], names=["key", "gid"])

    return reps.select("gid", "seqs").mapInArrow(make, "key long, gid long")


def _stars(buckets: DataFrame, partitions: int) -> DataFrame:
    """key, a, b (a < b): every member of a bucket (key, gid) with the lowest one; buckets of one member give nothing.

    Tasks make the stars of what they have at hand first and pass on one row per bucket and batch, its lowest member;
    edges are spread by a hash of their own. After the shuffle partitions arrive sorted, so that no bucket is held.
    """

    def batch(k: np.ndarray, a: np.ndarray, b: np.ndarray, alone: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64(), mask=alone)], names=["key", "a", "b"])

    def here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            k, g = big.column(0).to_numpy(), big.column(1).to_numpy()
            order = np.lexsort((g, k))
            k, g = k[order], g[order]
            first = np.r_[np.ones(min(len(k), 1), bool), k[1:] != k[:-1]]
            low = g[first][np.cumsum(first) - 1]
            kept = first | (g != low)
            yield batch(k[kept], low[kept], g[kept], first[kept])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, centre = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            edge = b.column(2).is_valid().to_numpy(zero_copy_only=False)
            k, a = (b.column(i).to_numpy(zero_copy_only=False)[~edge] for i in (0, 1))
            first = np.r_[np.array([key is None or k[0] != key])[: len(k)], k[1:] != k[:-1]]
            low = np.where(first, a, 0)
            at = np.maximum.accumulate(np.where(first, np.arange(len(k)), -1)) if len(k) else np.empty(0, int)
            low = np.where(at >= 0, a[at], centre) if len(k) else low
            if len(k):
                key, centre = k[-1], low[-1]
            new = a != low
            yield batch(k[new], low[new], a[new], np.zeros(new.sum(), bool))
            if edge.any():
                yield b.filter(pa.array(edge))

    local = buckets.mapInArrow(here, "key long, a long, b long")
    route = F.when(F.col("b").isNull(), F.col("key")).otherwise(F.xxhash64("a", "b"))
    return local.repartition(partitions, route).sortWithinPartitions("key", "a").mapInArrow(join, "key long, a long, b long")


def _within(buckets: DataFrame, partitions: int) -> DataFrame:
    """key, a, b. With a null key: a < b, a pair of members of one bucket. With a key: member a of a bucket of more than BLOCK, and the block b it belongs to.

    Partitions arrive sorted, so only the ids of the bucket at hand are held.
    """

    def split(k: np.ndarray, g: np.ndarray) -> pa.RecordBatch:
        once = np.r_[np.ones(min(len(k), 1), bool), (k[1:] != k[:-1]) | (g[1:] != g[:-1])]
        k, g = k[once], g[once]
        start = np.flatnonzero(np.r_[np.ones(min(len(k), 1), bool), k[1:] != k[:-1]])
        size = np.diff(np.r_[start, len(k)])
        size, place = np.repeat(size, size), np.arange(len(k)) - np.repeat(start, size)
        hot = np.flatnonzero(size > BLOCK)
        left, right, at, apart = [g[hot]], [place[hot] // BLOCK], np.flatnonzero((size > 1) & (size <= BLOCK)), 1
        while (at := at[place[at] + apart < size[at]]).size:
            left.append(g[at])
            right.append(g[at + apart])
            apart += 1
        n = sum(map(len, left[1:]))
        key = pa.concat_arrays([pa.array(k[hot], pa.int64()), pa.nulls(n, pa.int64())])
        return pa.RecordBatch.from_arrays([key, pa.array(np.concatenate(left), pa.int64()), pa.array(np.concatenate(right), pa.int64())], names=["key", "a", "b"])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, g = np.empty(0, np.int64), np.empty(0, np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            k, g = np.r_[k, b.column(0).to_numpy()], np.r_[g, b.column(1).to_numpy()]
            last = np.searchsorted(k, k[-1])  # the last bucket may go on in the next batch
            yield split(k[:last], g[:last])
            k, g = k[last:], g[last:]
        yield split(k, g)

    return buckets.repartition(partitions, "key").sortWithinPartitions("key", "gid").mapInArrow(make, "key long, a long, b long")


def _common(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """(len(x), len(y)) numbers of values that the sets have in common."""
    out = np.zeros((len(x), len(y)), np.float32)
    fx, fy = np.concatenate(x), np.concatenate(y)
    ox, oy = np.repeat(np.arange(len(x)), list(map(len, x))), np.repeat(np.arange(len(y)), list(map(len, y)))
    known = np.intersect1d(fx, fy)
    for at in range(0, len(known), 4096):
        part = known[at : at + 4096]
        sides = []
        for flat, owner, n in ((fx, ox, len(x)), (fy, oy, len(y))):
            place = np.minimum(np.searchsorted(part, flat), len(part) - 1)
            hit = part[place] == flat
            m = np.zeros((n, len(part)), np.float32)
            m[owner[hit], place[hit]] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out.astype(np.int64)


def _tiles(hot: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """a < b, sim >= least: all pairs of the members (a) of large buckets (key), which lie in blocks (b); two blocks a task."""

    def check(tile: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        i, j = tile[1].as_py(), tile[2].as_py()
        gid, block = t.column("gid").to_numpy(), t.column("b").to_numpy()
        seqs = [np.asarray(v, np.int32) for v in t.column("seqs").to_pylist()]
        x, y = np.flatnonzero(block == i), np.flatnonzero(block == j)
        common = _common([seqs[r] for r in x], [seqs[r] for r in y])
        size = np.array([len(v) for v in seqs])
        sim = common / (size[x][:, None] + size[y][None] - common)
        r, c = np.nonzero((sim >= least) & (gid[x][:, None] < gid[y][None]))
        return pa.table({"a": pa.array(gid[x][r], pa.int64()), "b": pa.array(gid[y][c], pa.int64()), "sim": pa.array(sim[r, c], pa.float64())})

    blocks = hot.groupBy("key").agg(F.max("b").alias("_last"))
    placed = hot.join(blocks, "key").select("key", F.col("a").alias("gid"), "b", F.explode(F.sequence(F.lit(0), F.col("_last"))).alias("_o"))
    placed = placed.join(sets, "gid").select("key", F.least("b", "_o").alias("_i"), F.greatest("b", "_o").alias("_j"), "gid", "b", "seqs")
    return placed.groupBy("key", "_i", "_j").applyInArrow(check, "a long, b long, sim double")


def _around(new: DataFrame, linked: DataFrame) -> DataFrame:
    """a < b: pairs that share a neighbour, at least one of the two links being new."""
    x, y = (e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) for e in (new, linked))
    both = x.alias("x").join(y.alias("y"), F.col("x.a") == F.col("y.a")).filter(F.col("x.b") != F.col("y.b"))
    return both.select(F.least("x.b", "y.b").alias("a"), F.greatest("x.b", "y.b").alias("b")).distinct()


def _similar(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """edges (a, b) with their exact similarity `sim`."""
    left = sets.select(F.col("gid").alias("a"), F.col("seqs").alias("_sa"))
    right = sets.select(F.col("gid").alias("b"), F.col("seqs").alias("_sb"))
    both = edges.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("_sa", "_sb"))
    return both.select("a", "b", (common / (F.size("_sa") + F.size("_sb") - common)).alias("sim"))


def near_copies(values: DataFrame, size: int = 5, least: float = 0.8, every: bool = True, form: Callable[[str], str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(pairs of representatives, members).

    values: gid (row id * 4 + field), text (any string; null, blank and too short ones are left out, as are null gids;
    a repeated row counts once). Other columns don't matter.
    pairs: a < b, sim >= least, between texts whose sets of `size`-word sequences differ, each pair once: every such
    pair found, or, if not `every`, enough to connect the texts of a group, about as many as it has texts.
    members: gid, rep: every text with the lowest gid among the texts of the same set. Ties can't occur.
    form: what is done to every text before its words are taken.
    The candidate search is probabilistic as SURE states; every pair given was checked exactly.
    """
    spark = values.sparkSession
    slots, (bands, rows) = task_slots(spark), bands_for(least)
    sets = cut(_sets(values, size, form))
    classes = sets.groupBy("digest").agg(F.min("gid").alias("rep"))
    members = cut(sets.select("gid", "digest").join(classes, "digest").select("gid", "rep").distinct())
    reps = sets.join(members.filter(F.col("gid") == F.col("rep")).select("gid"), "gid", "left_semi").select("gid", "seqs")
    stars = cut(_stars(_buckets(reps, bands, rows), slots))
    nodes = stars.select(F.col("a").alias("gid")).unionByName(stars.select(F.col("b").alias("gid"))).distinct()
    sets = cut(sets.join(nodes, "gid", "left_semi").select("gid", "seqs").dropDuplicates(["gid"]))
    near = min(NEAR, least) if every else least
    linked = cut(_similar(stars.select("a", "b").distinct(), sets).filter(F.col("sim") >= near))
    for left in range(STARS - 1, -1, -1):
        failed = stars.join(linked.select("a", "b"), ["a", "b"], "left_anti").select("key", F.col("b").alias("gid"))
        if left:
            stars = cut(_stars(failed, slots))
            edges, hot = stars.select("a", "b"), None
        else:
            stars = cut(_within(failed, slots))
            edges, hot = stars.filter(F.col("key").isNull()).select("a", "b"), stars.filter(F.col("key").isNotNull())
        if stars.isEmpty():
            break
        fresh = edges.distinct().join(linked.select("a", "b"), ["a", "b"], "left_anti")
        new = _similar(fresh, sets).filter(F.col("sim") >= near)
        if hot is not None and not hot.isEmpty():
            new = new.unionByName(_tiles(hot, sets, near).join(linked.select("a", "b"), ["a", "b"], "left_anti")).groupBy("a", "b").agg(F.max("sim").alias("sim"))
        linked = cut(linked.unionByName(new))
    new = linked
    while every:
        more = _around(new, linked).join(linked.select("a", "b"), ["a", "b"], "left_anti")
        new = cut(_similar(more, sets).filter(F.col("sim") >= least))
        if new.isEmpty():
            break
        linked = cut(linked.unionByName(new))
    return linked.filter(F.col("sim") >= least), members


def expand(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """a < b: every pair of texts, copies included. As many rows as there are such pairs."""
    m = members.select(F.col("gid"), F.col("rep"))
    same = m.alias("x").join(m.alias("y"), F.col("x.rep") == F.col("y.rep")).filter(F.col("x.gid") < F.col("y.gid")).select(F.col("x.gid").alias("a"), F.col("y.gid").alias("b"))
    left, right = m.select(F.col("rep").alias("a"), F.col("gid").alias("_a")), m.select(F.col("rep").alias("b"), F.col("gid").alias("_b"))
    other = pairs.select("a", "b").join(left, "a").join(right, "b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))
    return same.unionByName(other)


def components(pairs: DataFrame) -> DataFrame:
    """node, label: every node of the pairs (a, b) with the least node of its connected class; nodes of any ordered type.

    Labels travel along the edges and are shortened by pointer jumping, every round cut from its lineage in the
    shared folder; rounds grow with the logarithm of a class's diameter.
    """
    links = cut(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = cut(links.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        seen = links.join(label.select(F.col("a").alias("b"), F.col("label").alias("_l")), "b").groupBy("a").agg(F.min("_l").alias("_n"))
        step = label.join(seen, "a").select("a", "label", F.least("label", "_n").alias("_m"))
        jump = label.select(F.col("a").alias("_m"), F.col("label").alias("_j"))
        new = cut(step.join(jump, "_m", "left").select("a", "label", F.least("_m", F.coalesce("_j", "_m")).alias("_new")))
        done = new.filter(F.col("_new") != F.col("label")).isEmpty()
        label = new.select("a", F.col("_new").alias("label"))
        if done:
            return label.select(F.col("a").alias("node"), "label")


def classes_of(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """gid, class_id: every text with the lowest gid of its connected class."""
    known = components(pairs).withColumnRenamed("node", "rep")
    return members.join(known, "rep", "left").select("gid", F.coalesce("label", "rep").alias("class_id"))
