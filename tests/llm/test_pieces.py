import random

import pytest

from kervan.llm.pieces import anchor, boundaries, cut_files, cut_values, plan


def random_text(rng, n):
    return "".join(rng.choice(["Doz ", "ver. ", "İlk ", "\n", "\n\n", "x" * 70, "é", "。", "，", "ü", "3.5 ", "🙏"]) for _ in range(n))


def test_plan_covers():
    rng = random.Random(1)
    for _ in range(300):
        t = random_text(rng, rng.randrange(50, 400))
        limit, overlap = rng.choice([60, 150]), rng.choice([0, 20, 30])
        at, rank = boundaries(t, 0, len(t))
        ps = plan(0, len(t), at, rank, limit, overlap)
        assert "".join(t[f:e] for _, f, e in ps) == t
        assert all(0 < e - s <= limit and f - s <= overlap and s <= f < e for s, f, e in ps)


def test_prefers_natural_ends():
    t = ("Bir cümle burada biter. " * 80).strip()
    at, rank = boundaries(t, 0, len(t))
    assert all(t[:e].endswith(". ") for _, _, e in plan(0, len(t), at, rank)[:-1])
    t = ("a" * 700 + "\n\n" + "b c. " * 60) * 3
    at, rank = boundaries(t, 0, len(t))
    assert t[: plan(0, len(t), at, rank)[0][2]].endswith("\n\n")


def check(rows, texts, limit, overlap):
    by = {}
    for r in sorted(rows, key=lambda r: (r.id, r.piece_no)):
        by.setdefault(r.id, []).append(r)
    assert set(by) == {i for i, t in texts if t and len(t) > limit}
    for i, t in texts:
        if t and len(t) > limit:
            ps = by[i]
            assert [p.piece_no for p in ps] == list(range(len(ps)))
            assert "".join(t[p.fresh_pos : p.end_pos] for p in ps) == t
            for a, p in zip([None, *ps], ps, strict=False):
                assert p.piece == t[p.start_pos : p.end_pos] and len(p.piece) <= limit and p.fresh_pos - p.start_pos <= overlap
                assert a is None or a.end_pos == p.fresh_pos


def test_values(spark):
    rng = random.Random(3)
    texts = [(i, random_text(rng, rng.randrange(1, 600))) for i in range(40)] + [(90, None), (91, ""), (92, "y" * 10_000), (93, "x" * 150), (94, "x" * 151)]
    df = spark.createDataFrame([(i, t, "c") for i, t in texts], "id long, t string, piece string")
    for span in (65_536, 500):  # the second plans by ranges
        check(cut_values(df, "t", ["id"], 150, 30, span).collect(), texts, 150, 30)
    assert cut_values(df.limit(0), "t", ["id"]).count() == 0
    twice = spark.createDataFrame([(None, "z" * 400), (None, "z" * 400), (1, "ab " * 900)], "id long, t string")  # null keys and repeated rows
    got = cut_values(twice, "t", ["id"], 150, 30, 500).collect()
    assert sorted(r.piece_no for r in got if r.id is None) == sorted([*range(4), *range(4)]) and max(r.end_pos for r in got) == 2700
    with pytest.raises(ValueError):
        cut_values(df, "t", ["id"], 100, 60)


def in_place(t, limit, overlap, span):
    """The rule of ranges in one plain loop over the whole value."""
    at, rank = boundaries(t, 0, len(t))
    out, begin, end = [], 0, 0
    while begin < len(t):
        stop = min(begin + span, len(t))
        mine = at[(at <= stop)], rank[at <= stop]
        inside = mine[0] > begin
        end = stop if stop == len(t) else anchor(mine[0][inside], mine[1][inside], begin, stop, limit)
        out += plan(out[-1][2] if out else 0, end, *mine, limit, overlap)
        begin = stop
    return out


def test_ranges_give_what_one_worker_gives(spark):
    rng = random.Random(9)
    texts = [(i, random_text(rng, rng.randrange(200, 2500))) for i in range(12)]
    df = spark.createDataFrame(texts, "id long, t string")
    for span in (700, 3000, 10**6):
        got = {}
        for r in cut_values(df, "t", ["id"], 150, 30, span).collect():
            got.setdefault(r.id, []).append((r.start_pos, r.fresh_pos, r.end_pos))
        assert {i: sorted(v) for i, v in got.items()} == {i: in_place(t, 150, 30, span) for i, t in texts if len(t) > 150}


def test_files(spark, tmp_path):
    rng = random.Random(5)
    data = random_text(rng, 3000).encode() + b"\xff\xfe bad \xe2\x82 bytes. "
    (tmp_path / "a.txt").write_bytes(data)
    (tmp_path / "empty.txt").write_bytes(b"")
    rows = cut_files(spark, [str(tmp_path)], 200, 40, 1000).orderBy("piece_no").collect()
    assert b"".join(data[r.fresh_pos : r.end_pos] for r in rows) == data
    for r in rows:
        assert r.end_pos - r.start_pos <= 200 and r.piece == data[r.start_pos : r.end_pos].decode("utf-8", "replace")
