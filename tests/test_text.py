import random
import re

import pytest
from pyspark.sql import functions as F

from kervan.functions import text, vector
from kervan.functions.udfs import as_text, match_key, parse_document


A, B, C = "a" * 30, "b" * 30, "c" * 50
SPLITS = {
    None: [], "": [], " \n ": [], f"  {A} ": [A],
    f"{A}\n\n{B}\n \n{C}": [f"{A} {B}", C],  # paragraphs, packed in order while they fit
    f"{A}\n{B}\n\n{C}": [f"{A}\n{B}", C],  # a paragraph that fits keeps its lines
    f"{A}\nx\n\n{B}\n\n{C}": [f"{A}\nx\n\n{B}", C],  # a blank line where either side has lines
    f"{A}\n{B}\r\n{C}": [f"{A} {B}", C],  # a paragraph that doesn't fit falls into lines
    f"İlk {A}. Sonra {B}! 3 {C}? Çok.": [f"İlk {A}. Sonra {B}!", f"3 {C}? Çok."],  # a line that doesn't fit falls into sentences
    f"Doz {A}. ve {B}. {C}": [f"Doz {A}. ve {B}. {C}"],  # a small letter begins no sentence
    f"{'x' * 130} {A}": [f"{'x' * 130} {A}"], f"{'x' * 130}. {A.upper()}": [f"{'x' * 130}.", A.upper()],  # a sentence is never cut
}


def test_split_cases(spark):
    rows = spark.createDataFrame(list(enumerate(SPLITS)), "i int, t string").select("i", text.split_text(F.col("t"), 100).alias("c")).collect()
    want = list(SPLITS.values())
    for r in rows:
        assert r.c == want[r.i], (list(SPLITS)[r.i], r.c)


def test_split_loses_nothing(spark):
    """Whatever the text: all its letters come out, in order; pieces keep the limit unless they are one sentence; none is blank."""
    rng = random.Random(7)
    words = ["Doz", "2.5 mg", "verilir.", "İlk", "gün!", "mi?", "\n", "\n\n", "\n \n", "ölçek", "\t", "Şurup", "x" * 60, " ", "3. gün"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 120))) for _ in range(200)] + ["a" * 5000]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for limit in (100, 240):
        for r in rows.select("t", text.split_text(F.col("t"), limit).alias("c")).collect():
            assert "".join("".join(r.c).split()) == "".join(r.t.split())
            assert all(p == p.strip() != "" for p in r.c)
            assert all(len(p) <= limit or not re.search(r"[.!?]\s+[A-ZÇĞİÖŞÜ0-9]|\n", p) for p in r.c)


def test_sentence_never_cut(spark):
    s = "A" + "b" * 109 + "."
    got = spark.createDataFrame([(f"{s} {s}",)], "t string").select(text.split_text(F.col("t"), 100)).first()[0]
    assert got == [s, s]
    with pytest.raises(ValueError):
        text.split_text(F.col("t"), 99)


def test_quantities(spark):
    cases = {
        "0,5 mg ve 0.5 mg": [".5 mg", ".5 mg"], "1.0 g": ["1.0 g"], "1 gram": ["1 g"], "10 µg": ["10 µg".replace("µg", "mcg")], "10 μg": ["10 μg"],
        "1-2 tablet": ["2 tablet"], "2 tablettir": [], "000 ml": ["0 ml"], None: [], "5 kapsul 3 gun": ["5 kapsül", "3 gün"],
    }
    rows = spark.createDataFrame([(k,) for k in cases], "t string")
    for r in rows.select("t", text.quantities(F.col("t")).alias("q")).collect():
        assert r.q == cases[r.t], r


def test_nocase_leaves_other_letters(spark):
    r = spark.sql("select 'ÇA' a, 'Ça' b, 'ça' c").select(text.same_name(F.col("a"), F.col("b")), text.same_name(F.col("a"), F.col("c"))).first()
    assert tuple(r) == (True, False)


def test_response_split(spark):
    rows = spark.createDataFrame([("x\n\nKaynaklar: a\n\nKaynaklar: b\n\nu",), ("only",), ("y\n\nKaynaklar: ",)], "t string")
    got = [tuple(r[0]) for r in rows.select(text.split_response(F.col("t"), "\n\nKaynaklar: ", "-", "d")).collect()]
    assert got == [("x\n\nKaynaklar: a", "b", "u"), ("only", "-", "d"), ("y", "-", "d")]


def test_body_without_header(spark):
    r = spark.createDataFrame([("İlaç: A 10 mg\nKategori: usage\nbody\nKategori: x",), ("plain",)], "t string").select(text.chunk_body(F.col("t")).alias("b")).collect()
    assert [x.b for x in r] == ["body\nKategori: x", "plain"]


def test_match_key_and_coercion():
    assert match_key("ŞURUP İçin Ⅳ µg") == "surup icin iv μg"
    assert match_key(None) == ""
    assert as_text([" a ", "", 1, None, True]) == "a\n1\nNone\nTrue"
    assert as_text({"a": "ş"}) == '{"a": "ş"}'
    assert as_text(5.0) == "5.0" and as_text(True) == "True" and as_text(None) == ""
    assert parse_document('\ufeff[{"medicine_name": "a"}, {"medicine_name": "b", "is_example": "true"}]')["records"][1]["is_example"] is False
    assert parse_document("[1]")["error"] and parse_document("{")["error"] and parse_document(None)["error"]


def test_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = spark.createDataFrame([(0, [1.0, 2.0]), (1, []), (2, [nan]), (3, [inf]), (4, [None]), (5, None), (6, [0.0, 0.0])], "i int, v array<double>")
    got = [r[0] for r in rows.orderBy("i").select(vector.is_valid(F.col("v"))).collect()]
    assert got == [True, False, False, False, False, False, True]
    one = F.array(F.lit(1.0), F.lit(0.0))
    sims = [r[0] for r in rows.filter("i in (0, 1, 6)").orderBy("i").select(vector.cosine(F.col("v"), one)).collect()]
    assert sims[0] == pytest.approx(1 / 5**0.5) and sims[1:] == [None, None]
    texts = ["[1,2.5]", "[]", '[1,"x"]', "[NaN]", "[1,null]", "nope", '{"a":1}', "[1e400]"]
    back = spark.createDataFrame([(t,) for t in texts], "s string").select(vector.from_json_text(F.col("s"))).collect()
    assert [r[0] for r in back] == [[1.0, 2.5]] + [None] * 7
    with pytest.raises(Exception, match="invalid embedding"):
        rows.filter("i = 2").select(vector.to_json_text(F.col("v"))).collect()
