import random

import numpy as np

from kervan.llm import near_copies as N
from kervan.llm.near_copies import components

WORDS = [f"söz{i}" for i in range(300)]


def texts(rng, n):
    out = []
    for i in range(n):
        base = [rng.choice(WORDS) for _ in range(rng.randrange(20, 60))]
        out.append(" ".join(base))
        for _ in range(rng.randrange(0, 4)):
            v = list(base)
            for _ in range(rng.randrange(0, 4)):
                v[rng.randrange(len(v))] = rng.choice(WORDS)
            out.append(" ".join(v).upper() if rng.random() < 0.2 else " ".join(v))
    return out


def brute(rows, size, least):
    sets = []
    for gid, t in rows:
        w = [x.lower() for x in N._WORD.findall(t or "")]
        s = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}
        if s:
            sets.append((gid, s))
    return {(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[i + 1 :] if a % 4 == b % 4 and len(x & y) >= least * len(x | y)}


def test_pairs_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(i * 4 + i % 2, t) for i, t in enumerate(texts(rng, 80))]
    hot = " ".join(rng.choice(WORDS) for _ in range(30))
    rows += [(100_000 + 4 * i, hot) for i in range(60)] + [(200_000, None), (200_004, ""), (200_008, "bir iki"), (200_012, "a b c " * 20_000)]
    given = [*rows, *rows[:25], (None, hot), (None, None)]
    df = spark.createDataFrame([(g, t, "x") for g, t in given], "gid long, text string, a string")
    pairs, members = N.near_copies(df, 3, 0.5)
    got = [tuple(r) for r in N.expand(pairs, members).collect()]
    want = brute(rows, 3, 0.5)
    assert len(got) == len(set(got)) and set(got) <= want
    assert len(set(got)) >= 0.99 * len(want)
    classes = {r.gid: r.class_id for r in N.classes_of(pairs, members).collect()}
    assert all(classes[a] == classes[b] for a, b in got)
    assert set(classes) == {g for g, t in rows if len(N._WORD.findall(t or "")) >= 3}


def test_empty(spark):
    pairs, members = N.near_copies(spark.createDataFrame([], "gid long, text string"))
    assert pairs.count() == 0 and members.count() == 0
    assert N.expand(pairs, members).count() == 0 and N.classes_of(pairs, members).count() == 0


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    base = rng.integers(-(2**31), 2**31 - 1, 80).astype(np.int32)
    agree = []
    for _ in range(40):
        other = np.concatenate([base[:60], rng.integers(-(2**31), 2**31 - 1, 20).astype(np.int32)])
        a, b = np.unique(base), np.unique(other)
        t = N.sketch(np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)]), 2, 256)
        agree.append((t[0] == t[1]).mean())
    assert abs(np.mean(agree) - 0.6) < 0.05


def test_components(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 105)], "a long, b long")
    got = {r.node: r.label for r in components(pairs).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 105: 100}


def bucketed(spark, monkeypatch, block):
    """True pairs and given pairs of foreign texts that interleave by gid, all in one bucket and in no other."""
    rng = random.Random(6)
    bases = [[f"k{b}s{i}" for i in range(30)] for b in range(7)]
    rows = []
    for i in range(42):  # member i is a copy of base i % 7 with one word replaced
        v = list(bases[i % 7])
        v[rng.randrange(30)] = f"x{i}"
        rows.append((4 * i, " ".join(v)))
    monkeypatch.setattr(N, "BLOCK", block)
    monkeypatch.setattr(N, "_buckets", lambda reps, bands, rows: reps.selectExpr("cast(7 as bigint) key", "gid"))
    pairs, members = N.near_copies(spark.createDataFrame(rows, "gid long, text string"), 3, 0.5)
    return brute(rows, 3, 0.5), [tuple(r) for r in N.expand(pairs, members).collect()]


def test_all_members_of_a_bucket_are_compared(spark, monkeypatch):
    want, got = bucketed(spark, monkeypatch, 512)
    assert want and len(got) == len(set(got)) and set(got) == want


def test_large_buckets_are_compared_in_blocks(spark, monkeypatch):
    want, got = bucketed(spark, monkeypatch, 5)
    assert want and len(got) == len(set(got)) and set(got) == want


def test_neighbours_until_no_new_pair(spark, monkeypatch):
    """A chain of texts in buckets of two: pairs two and three links apart are found around found pairs."""
    words = [f"z{i}" for i in range(60)]
    rows = [(4 * i, " ".join(words[i : i + 40])) for i in range(12)]
    keys = ", ".join(f"({4 * i}, {i}), ({4 * i + 4}, {i})" for i in range(11))
    monkeypatch.setattr(N, "_buckets", lambda reps, bands, rows: reps.select("gid").join(spark.sql(f"select cast(col1 as bigint) gid, cast(col2 as bigint) key from values {keys}"), "gid").select("key", "gid"))
    pairs, members = N.near_copies(spark.createDataFrame(rows, "gid long, text string"), 3, 0.5)
    assert {tuple(r) for r in N.expand(pairs, members).collect()} == brute(rows, 3, 0.5)


def test_lone_pairs_at_the_threshold(spark):
    """300 pairs of similarity exactly a half, each alone: 40 of 60 sequences in common."""
    rows = []
    for i in range(300):
        head = [f"p{i}s{j}" for j in range(42)]
        rows += [(8 * i, " ".join([*head, *(f"a{i}s{j}" for j in range(20))])), (8 * i + 4, " ".join([*head, *(f"b{i}s{j}" for j in range(20))]))]
    pairs, _ = N.near_copies(spark.createDataFrame(rows, "gid long, text string"), 3, 0.5)
    got = {(r.a, r.b, r.sim) for r in pairs.collect()}
    assert got <= {(8 * i, 8 * i + 4, 0.5) for i in range(300)} and len(got) >= 0.9 * 300  # 0.92 are expected


def test_groups_are_connected_by_as_many_pairs_as_texts(spark):
    rng = random.Random(7)
    base = [f"g{i}" for i in range(120)]
    sizes = {}
    for n in (100, 400):
        rows = [(4 * i, " ".join([*base[:k], f"x{i}", *base[k + 1 :]])) for i in range(n) for k in [rng.randrange(120)]]
        pairs, members = N.near_copies(spark.createDataFrame(rows, "gid long, text string"), every=False)
        sizes[n] = pairs.count()
        assert {r.class_id for r in N.classes_of(pairs, members).collect()} == {0}
    assert sizes[400] < 6 * sizes[100] and sizes[400] < 400 * 25


def test_stars_hold_every_member(spark):
    """Within a task or over tasks: each member of a bucket once with the lowest one of the task, these with the lowest of all."""
    rng = random.Random(8)
    rows = list({(rng.choice([1, 1, 1, 2, 3, 4, 5]), rng.randrange(4000)) for _ in range(3000)}) + [(77, 5)]
    for parts in (1, 7):
        edges = N._stars(spark.createDataFrame(rows, "key long, gid long").repartition(parts), 3).collect()
        assert all(r.a < r.b for r in edges) and not [r for r in edges if r.key == 77]
        for key in range(1, 6):
            mine = {g for k, g in rows if k == key}
            assert len([r for r in edges if r.key == key]) == len(mine) - 1 and {r.b for r in edges if r.key == key} == mine - {min(mine)}
