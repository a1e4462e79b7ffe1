"""Filling containers of fixed capacity with items of varying length.

Planning sees only how many items have each length, a table with at most `capacity` rows however many items there
are. Linear grouping: lengths above a threshold are sorted, split into groups of equal cardinality and rounded up to
the largest of their group; the few-size problem is solved as a linear programme over container configurations by
column generation; actual items are substituted by rank; the space that is left, actual slack included, is filled
with the small items by best fit. The plan is a list of ranges of ranks, and every item finds its container by
arithmetic on its own rank, without any task seeing more than a share of the items.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kervan.session import cut, task_slots

CAPACITY = 2048
#: Groups of the rounding; a length is large above capacity / SMALL.
GROUPS, SMALL = 32, 8


def _knapsack(sizes: list[int], worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Best configuration for the given worths: value and how often it holds each size."""
    order = np.argsort(sizes)
    lengths, value = np.asarray(sizes)[order], worth[order]
    fits = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if k := fits[c]:
            gain = best[c - lengths[:k]] + value[:k]
            i = int(gain.argmax())
            if gain[i] > best[c] + 1e-12:
                best[c], pick[c] = gain[i], order[i]
    held, c = np.zeros(len(sizes), int), capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
            continue
        held[pick[c]] += 1
        c -= sizes[pick[c]]
    return float(best[capacity]), held


def configurations(sizes: list[int], demand: np.ndarray, capacity: int, rounds: int = 400) -> list[tuple[np.ndarray, int]]:
    """(configuration, times) that together hold every demand: the linear programme's optimum, rounded, rest appended."""
    k = len(sizes)
    basis = np.diag([capacity // s for s in sizes]).astype(float)
    left = demand.astype(float)
    for _ in range(rounds):
        dual = np.linalg.solve(basis.T, np.ones(k))
        value, column = _knapsack(sizes, np.maximum(dual, 0), capacity)
        if value <= 1 + 1e-7:
            break
        direction = np.linalg.solve(basis, column.astype(float))
        x = np.linalg.solve(basis, left)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(direction > 1e-9, np.maximum(x, 0) / direction, np.inf)
        leave = int(np.argmin(ratio))
        if not np.isfinite(ratio[leave]):
            break
        basis[:, leave] = column
    x = np.maximum(np.linalg.solve(basis, left), 0)
    out, rest = [], demand.astype(int).copy()
    for j in np.argsort(-x):
        held, times = basis[:, j].astype(int), int(np.floor(x[j] + 1e-9))
        if times:
            out.append((held, times))
            rest -= held * times
    rest = np.maximum(rest, 0)
    order = np.argsort(-np.asarray(sizes))
    while rest.any():  # at most one container per configuration's fraction: the largest first into one at a time
        held, room = np.zeros(k, int), capacity
        for i in order:
            n = min(rest[i], room // sizes[i])
            held[i] += n
            room -= n * sizes[i]
        times = max(1, int(min(rest[i] // held[i] for i in range(k) if held[i])))
        out.append((held, times))
        rest -= held * times
    return out


class Plan:
    """Where the items of each length go, as ranges of ranks; ranks count items of one length from 0."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: int = SMALL):
        if any(s > capacity or s < 0 for s in counts):
            raise ValueError("lengths must lie between 0 and the capacity")
        self.capacity = capacity
        self.full = counts.get(capacity, 0)
        large = sorted((s, n) for s, n in counts.items() if capacity // small < s < capacity)
        self.sizes = np.array([s for s, _ in large], np.int64)
        self.start = np.concatenate([[0], np.cumsum([n for _, n in large])]).astype(np.int64)
        total = int(self.start[-1])
        self.card = max(1, -(-total // groups))
        self.segments: list[tuple[int, int, int, int, int]] = []  # group, first rank, items, first container, per container
        self.next = self.full
        if total:
            k = -(-total // self.card)
            tops, demand = [], np.zeros(k, int)
            for g in range(k):
                last = min(total, (g + 1) * self.card)
                tops.append(int(self.sizes[np.searchsorted(self.start, last, "left") - 1]))
                demand[g] = last - g * self.card
            merged: dict[int, list[int]] = defaultdict(list)
            for g, s in enumerate(tops):
                merged[s].append(g)
            sizes = sorted(merged)
            need = np.array([sum(demand[g] for g in merged[s]) for s in sizes])
            used = defaultdict(int)
            for held, times in configurations(sizes, need, capacity):
                placed = 0
                for i, per in enumerate(held):
                    todo = min(int(per) * times, int(need[i]) - used[i])
                    if per and todo > 0:
                        self._place(merged[sizes[i]], demand, used[i], todo, int(per))
                        used[i] += todo
                        placed = max(placed, -(-todo // int(per)))
                self.next += placed
        self.segments.sort()

    def _place(self, groups: list[int], demand: np.ndarray, done: int, todo: int, per: int) -> None:
        """Items done .. done + todo of groups of one rounded size go to the containers from `next` on, `per` to each."""
        at, base = 0, 0
        for g in groups:
            lo, hi = max(done, base), min(done + todo, base + int(demand[g]))
            if lo < hi:
                self.segments.append((g, lo - base, hi - lo, self.next * per + (lo - done), per))
            base += int(demand[g])
            at += hi - lo

    def large_container(self, size: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Containers of large items by length and rank."""
        out = np.full(len(size), -1, np.int64)
        whole = size == self.capacity
        out[whole] = rank[whole]
        rest = ~whole
        if rest.any():
            r = self.start[np.searchsorted(self.sizes, size[rest])] + rank[rest]
            g, k = r // self.card, r % self.card
            keys = np.array([s[0] * self.card + s[1] for s in self.segments], np.int64)
            seg = np.array([s[1:] for s in self.segments], np.int64)
            i = np.searchsorted(keys, g * self.card + k, "right") - 1
            out[rest] = (seg[i, 2] + (k - seg[i, 0])) // seg[i, 3]
        return out


def best_fit(room: dict[int, int], items: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(moves, new containers): best fit of counted items, longest first, into counted containers by free room.

    A move (length, first rank, items, first room, first place) puts `items` items of a length, from a rank on, into
    as many containers, from a place on among those that had that room at first; containers opened anew have room
    `capacity` and places after the given ones.
    """
    free: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # room now -> (first room, place, containers)
    for r, n in room.items():
        if r > 0 and n:
            free[r].append((r, 0, n))
    rooms = sorted(free)
    moves, opened = [], room.get(capacity, 0)

    def put(r: int, segment: tuple[int, int, int]) -> None:
        if r > 0:
            if not free[r]:
                insort(rooms, r)
            free[r].append(segment)

    for size in sorted((s for s in items if s > 0), reverse=True):
        rank, left = 0, items[size]
        while left:
            i = bisect_left(rooms, size)
            if i == len(rooms):
                n = -(-left // (capacity // size))
                put(capacity, (capacity, opened, n))
                opened += n
                continue
            r = rooms[i]
            first, place, n = free[r].pop()
            if not free[r]:
                rooms.pop(i)
            each = r // size
            filled = min(n, left // each)
            for j in range(each if filled else 0):
                moves.append((size, rank + j * filled, filled, first, place))
            rank, left = rank + each * filled, left - each * filled
            if filled:
                put(r - each * size, (first, place, filled))
            if filled < n:
                if left and left < each:
                    for j in range(left):
                        moves.append((size, rank + j, 1, first, place + filled))
                    put(r - left * size, (first, place + filled, 1))
                    rank, left = rank + left, 0
                    filled += 1
                if filled < n:
                    put(r, (first, place + filled, n - filled))
    return moves, opened - room.get(capacity, 0)


def _ranked(df: DataFrame, by: str, order: list[str], rank: str, buckets: int) -> DataFrame:
    """df with the rank of each row among those of the same `by`, from 0: salted, so no task holds one value's rows."""
    salted = df.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    counts = salted.groupBy(by, "_b").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    w = Window.partitionBy(by, "_b").orderBy(*order)
    return salted.withColumn("_r", F.row_number().over(w) - 1).join(before, [by, "_b"]).withColumn(rank, F.col("_before") + F.col("_r")).drop("_b", "_r", "_before")


def fill(df: DataFrame, key: str, size: str, capacity: int = CAPACITY) -> DataFrame:
    """key, piece_no, n, container: every item in a container; the pieces' n in a container never exceed the capacity.

    Items above the capacity are cut into full pieces and a rest, others stay whole. Items of size 0 or null take no
    room and stand in container 0. key is unique (a null is one more key); other columns don't travel. Ties are settled by key. An empty table
    gives no rows.
    """
    spark = df.sparkSession
    sized = df.select(F.col(key).alias("_key"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("_size"))
    pieces = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("_size") / capacity).cast("int") - 1, F.lit(0)))
    items = sized.select("_key", "_size", F.explode(pieces).alias("piece_no")).select("_key", "piece_no", F.least(F.lit(capacity), F.col("_size") - F.col("piece_no") * capacity).alias("n"))
    items = cut(items)  # ranking reads its input twice, and what gives the sizes is far dearer than the sizes
    items = cut(_ranked(items, "n", ["_key", "piece_no"], "rank", task_slots(spark)))
    counts = {r["n"]: r["c"] for r in items.groupBy("n").agg(F.count("*").alias("c")).collect()}  # at most capacity + 1 rows
    plan = Plan(counts, capacity)
    shared = spark.sparkContext.broadcast(plan)

    @F.pandas_udf("bigint")
    def place(n: pd.Series, rank: pd.Series) -> pd.Series:
        return pd.Series(shared.value.large_container(n.to_numpy(), rank.to_numpy()))

    big = capacity // SMALL
    large = cut(items.filter(F.col("n") > big).select("_key", "piece_no", "n", place("n", "rank").alias("container")))
    used = large.groupBy("container").agg((capacity - F.sum("n")).alias("room"))
    used = cut(_ranked(used.filter(F.col("room") > 0), "room", ["container"], "place", task_slots(spark)))
    room = {r["room"]: r["c"] for r in used.groupBy("room").agg(F.count("*").alias("c")).collect()}  # at most capacity rows
    moves, opened = best_fit(room, {s: c for s, c in counts.items() if 0 < s <= big}, capacity)
    table = np.array(sorted(moves), np.int64).reshape(-1, 5)
    steps = spark.sparkContext.broadcast((table[:, 0] * (1 << 44) + table[:, 1], table))

    @F.pandas_udf("struct<room:bigint,place:bigint>")
    def settle(n: pd.Series, rank: pd.Series) -> pd.DataFrame:
        keys, t = steps.value
        i = np.searchsorted(keys, n.to_numpy().astype(np.int64) * (1 << 44) + rank.to_numpy(), "right") - 1
        return pd.DataFrame({"room": t[i, 3], "place": t[i, 4] + rank.to_numpy() - t[i, 1]})

    small = items.filter((F.col("n") > 0) & (F.col("n") <= big)).select("_key", "piece_no", "n", settle("n", "rank").alias("_s")).select("_key", "piece_no", "n", "_s.room", "_s.place")
    old = small.join(used.select("room", "place", "container"), ["room", "place"]).select("_key", "piece_no", "n", "container")
    known = room.get(capacity, 0)
    new = small.filter((F.col("room") == capacity) & (F.col("place") >= known)).select("_key", "piece_no", "n", (F.col("place") - known + plan.next).alias("container"))
    none = items.filter(F.col("n") == 0).select("_key", "piece_no", "n", F.lit(0).cast("long").alias("container"))
    return large.unionByName(old).unionByName(new).unionByName(none).withColumnRenamed("_key", key)


def usage(filled: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, ids held, the least number of containers any packing needs, share of space left unused."""
    g = filled.filter(F.col("n") > 0).groupBy("container").agg(F.sum("n").alias("n"))
    t = g.agg(F.count("*").alias("n_containers"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_ids"), F.coalesce(F.max("n"), F.lit(0)).alias("fullest"))
    return t.withColumns({"least_containers": F.ceil(F.col("n_ids") / capacity), "unused_share": F.round(1 - F.col("n_ids") / F.greatest(F.col("n_containers") * capacity, F.lit(1)), 6)})
