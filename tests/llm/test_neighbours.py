import numpy as np

from kervan.llm import neighbours as N


def brute(ids, v, k):
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    np.fill_diagonal(s, -2)
    order = np.argsort(ids)
    ids, s = ids[order], s[order][:, order]
    return {int(ids[i]): [int(ids[j]) for j in np.argsort(-s[i], kind="stable")[:k]] for i in range(len(ids))}


def run(spark, ids, v, **kw):
    rows = spark.createDataFrame([(int(i), [float(x) for x in r], "x") for i, r in zip(ids, v, strict=True)], "id long, vec array<double>, near string")
    return {r.id: [x.id for x in r.near] for r in N.nearest(rows, **kw).collect()}


def test_recall(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(60, 16))
    v = centres[rng.integers(0, 60, 2500)] + rng.normal(size=(2500, 16)) * rng.choice([0.2, 0.6, 1.2], 2500)[:, None]
    ids = rng.permutation(10_000)[:2500]
    want, got = brute(ids, v, 5), run(spark, ids, v)
    assert np.mean([len(set(want[i]) & set(got.get(i, ()))) / 5 for i in want]) >= 0.9


def test_copies_and_ties(spark):
    rng = np.random.default_rng(4)
    v = np.concatenate([np.repeat(rng.normal(size=(1, 8)), 40, 0), rng.normal(size=(30, 8))])
    ids = np.arange(70) * 3
    got, want = run(spark, np.r_[ids, ids[:9]], np.r_[v, v[:9]]), brute(ids, v, 5)  # repeated rows count once
    assert all(got[i] == want[i] for i in range(0, 120, 3))  # copies: the lowest other ids
    assert np.mean([got.get(i) == w for i, w in want.items()]) >= 0.9


def test_small(spark):
    assert run(spark, [], np.empty((0, 4))) == {}
    assert run(spark, [7], np.ones((1, 4))) == {} or run(spark, [7], np.ones((1, 4))) == {7: []}
    assert run(spark, [1, 2], np.ones((2, 4))) == {1: [2], 2: [1]}


def clustered(n=2500, d=16, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(60, d))
    return rng.permutation(4 * n)[:n], centres[rng.integers(0, 60, n)] + rng.normal(size=(n, d)) * rng.choice([0.2, 0.6, 1.2], n)[:, None]


def recall(want, got):
    return np.mean([len(set(w) & set(got.get(i, ()))) / len(w) for i, w in want.items()])


def test_full_cells_take_more_functions_and_keep_recall(spark):
    ids, v = clustered()
    sample = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    for full in (40, 80):
        h = N.Hash(sample, len(sample), full=full)
        assert max(t.depth.max() for t in h.tables) > 1
        assert recall(brute(ids, v, 5), run(spark, ids, v, full=full)) >= 0.9


def test_every_bucket_has_a_function_and_probes_are_ordered():
    _, v = clustered()
    sample = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    for t in N.Hash(sample, 2500).tables:
        assert (t.depth >= 1).all()
        own, moved = t.buckets(sample), t.buckets(sample + t.a[0] * t.width)
        assert own.shape == (2500, N.PROBES) and (own[:, 0] != moved[:, 0]).mean() > 0.5


def test_split_buckets_lose_no_pair(spark):
    ids, v = clustered(900)
    v[:300] = v[0] + np.random.default_rng(1).normal(size=(300, 16)) * 0.05  # a third of all in one cell
    want = brute(ids, v, 5)
    plain, tiled = run(spark, ids, v), run(spark, ids, v, split=40)
    assert plain == tiled
    assert recall(want, plain) >= 0.9


def test_every_list_is_filled(spark):
    ids, v = clustered(400)
    v[::20] = np.random.default_rng(2).normal(size=(20, 16)) * 5  # vectors alone in their cells
    got = run(spark, ids, v, probes=1, tables=1)
    assert all(len(got[int(i)]) == 5 for i in ids)
    assert {len(x) for x in run(spark, [1, 2, 3], np.eye(3, 4)).values()} == {2}
