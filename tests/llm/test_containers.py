import random

import pytest

from kervan.llm import containers as C


def check(spark, sizes, capacity):
    df = spark.createDataFrame([(i, s, 5) for i, s in enumerate(sizes)], "id long, n_ids long, container int")
    rows = C.fill(df, "id", "n_ids", capacity).collect()
    held, got = {}, {}
    for r in rows:
        held[r.container] = held.get(r.container, 0) + r.n
        got.setdefault(r.id, {})[r.piece_no] = r.n
    assert len(rows) == sum(len(g) for g in got.values())
    assert {i: sum(g.values()) for i, g in got.items()} == {i: s or 0 for i, s in enumerate(sizes)}
    assert all(len(g) == max(1, -(-(sizes[i] or 0) // capacity)) and all(g[p] == capacity for p in range(len(g) - 1)) for i, g in got.items())
    assert not held or max(held.values()) <= capacity
    used = sum(1 for v in held.values() if v)
    return used, -(-sum(s or 0 for s in sizes) // capacity)


def test_fill(spark):
    rng = random.Random(2)
    used, least = check(spark, [int(rng.lognormvariate(5, 1)) for _ in range(3000)] + [0, None, 5000, 2048, 2049], 2048)
    assert used <= 1.02 * least + 2
    used, least = check(spark, [700] * 400 + [640] * 300, 2048)  # one length holds most
    assert used <= 1.02 * (400 * 700 + 300 * 640) / 2048 * 1.06
    assert check(spark, [51] * 30, 100)[0] == 30
    assert check(spark, [], 100) == (0, 0)
    assert check(spark, [3], 100) == (1, 1)
    assert check(spark, [0, None], 100)[0] == 0


def test_plan_bounds():
    with pytest.raises(ValueError):
        C.Plan({2049: 1})
    held = C.configurations([30, 50, 70], __import__("numpy").array([10, 7, 3]), 100)
    assert all(sum(h * s for h, s in zip(c, (30, 50, 70), strict=True)) <= 100 for c, _ in held)
    assert [sum(c[i] * t for c, t in held) >= d for i, d in enumerate((10, 7, 3))] == [True] * 3
