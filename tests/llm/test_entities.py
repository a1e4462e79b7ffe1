import random

import pytest

from kervan.llm import entities as E


def test_reads_names():
    same = ["Kaborkuyol Forte 100 mg film tablet", "kaborkuyol fort. 0,1 g ftb", "FİLM TABLET KABORKUYOL FORTE 100MG", "100 miligram Kaborkuyol Forte f. tablet, 20'li", "Kabor-kuyol Forte (100 mg.) film kaplı tablet - yeni kutu"]
    assert {E.read_name(n) for n in same} == {("kaborkuyol", False, "forte|100 mg|film tablet")}
    assert E.read_name("Hazuk. Plus flk. 20 mg") == ("hazuk", True, "plus|20 mg|flakon")
    assert E.read_name("Hazukson + 20 mg flakon")[2] == "plus|20 mg|flakon"
    assert E.read_name(None) == E.read_name("  ") == ("", False, "")
    assert E.read_name("Şurupan")[0] == "surupan"


def test_distance():
    assert [E.distance(a, b, 3) for a, b in (("abcd", "abdc"), ("abc", "abc"), ("abc", "xbcd"), ("kitap", "k"), ("", "ab"))] == [1, 0, 2, 4, 2]
    rng = random.Random(1)
    for _ in range(500):
        a = "".join(rng.choice("abc") for _ in range(rng.randrange(3, 9)))
        b = "".join(rng.choice("abc") for _ in range(rng.randrange(3, 9)))
        if E.distance(a, b, 2) <= 2:
            assert set(E.without(a)) & set(E.without(b))


def test_products(spark):
    rows = [
        (1, "Hazukson Plus 20 mg flakon"), (2, "Hazuksno + 20 mg flk."), (3, "Hazuk. Plus 0,02 g flakon"), (4, "Hazukson Plus 20 mg krem"), (5, "Hazukson 20 mg flakon"),
        (6, "Hazzuksonn Plus 20 mg flakon"), (7, None), (8, " "), (9, "Berdolifat 5 mg krem"), (10, "Berd. 5 mg kr."), (11, "Berd. 10 mg kr."), (12, "Hazukson Plus 20 mg flakon"),
    ]
    df = spark.createDataFrame([(i, n, "p") for i, n in [*rows, *rows[:4]]], "id long, n string, product string")
    all_ = E.resolve_names(df, "id", "n").collect()
    got = {r.id: r.product for r in all_}
    assert len(all_) == len(got) == 10 and got[1] == got[2] == got[3] == got[6] == got[12]
    assert len({got[i] for i in (1, 4, 5, 9)}) == 4 and got[9] == got[10] != got[11]
    assert E.resolve_names(df.limit(0), "id", "n").count() == 0


@pytest.mark.parametrize("limit", [100_000, 1])  # all known ingredients at once, and one or so at a time
def test_ingredients(spark, monkeypatch, limit):
    monkeypatch.setattr(E.Ingredients, "LIMIT", limit)
    refs = spark.createDataFrame(
        [(1, "fenmosartan asetat", None, "FNTN-369"), (2, "gemvimin sodyum", "tuz E86", None), (3, "gemvimin fosfat", None, None), (4, "Zinnebaprofen", "vitamin A6", None)],
        "ingredient_id long, ingredient_name string, common_name string, short_code string",
    )
    rows = [
        (1, "FENMOSARTAN (Asetat)"), (2, "fntn-369 + gemvimin Na"), (3, "gemvimin"), (4, "phenmosartane aset."), (5, "Vitamin-A6, tuz e86"), (6, "fosfat gevmimin ve zinebaprofen"),
        (7, "bambaşka"), (8, None), (9, " "), (10, "fenmosartan"), (11, "fenmosartan sodyum"), (12, "zinnebaprofen / zinnebaprofen"),
    ]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "id long, v string, ingredient_id int")
    got = {}
    for r in E.link_ingredients(df, "id", "v", refs).collect():
        got.setdefault(r.id, set()).add(r.ingredient_id)
    assert got == {1: {1}, 2: {1, 2}, 4: {1}, 5: {4, 2}, 6: {3, 4}, 10: {1}, 12: {4}}
    assert E.link_ingredients(df.limit(0), "id", "v", refs).count() == 0


def test_initials_of_different_lengths_without_a_full_name_of_their_marks(spark):
    names = ["Hazukson 10 mg tablet", "Hazuk. 20 mg tablet", "Hazuks. 20 mg tablet", "Bel. 5 mg tablet", "Belt. 5 mg tablet", "Cor. 5 mg tablet", "Cora. 5 mg tablet", "Cort. 5 mg tablet"]
    got = {r.id: r.product for r in E.resolve_names(spark.createDataFrame(list(enumerate(names)), "id long, name string"), "id", "name").collect()}
    assert got[1] == got[2] != got[0] and got[3] == got[4]
    assert len({got[5], got[6], got[7]}) == 3  # "Cor." may be either


def brands(spark, *names):
    rows = [(i, n) for i, n in enumerate(n for n, times in names for _ in range(times))]
    got = {n: r.product for (i, n), r in zip(rows, sorted(E.resolve_names(spark.createDataFrame(rows, "id long, n string"), "id", "n").collect()), strict=True)}
    return {n.split()[0].lower(): p for n, p in got.items()}


def test_frequent_brands_do_not_merge_through_a_rare_spelling(spark):
    got = brands(spark, ("Abadolin 5 mg krem", 6), ("Abadokan 5 mg krem", 1), ("Abarokan 5 mg krem", 5))
    assert got["abadolin"] != got["abarokan"]


def test_a_later_round_finds_what_the_first_cannot(spark):
    """Kalimorten takes in two mistyped spellings; only both of them together draw in a third, three edits away from the centre."""
    a, b, c, far = "kalimorten", "kalizyrten", "kalizorzen", "kalizyrzen"
    assert E.distance(a, far, 3) == 3 and E.distance(b, far, 2) == E.distance(c, far, 2) == 1
    got = brands(spark, (f"{a} 5 mg krem", 6), (f"{b} 5 mg krem", 2), (f"{c} 5 mg krem", 2), (f"{far} 5 mg krem", 1))
    assert len(set(got.values())) == 1
    assert len(set(brands(spark, (f"{a} 5 mg krem", 6), (f"{far} 5 mg krem", 1)).values())) == 2


def test_initials_bring_their_marks_to_the_profile(spark):
    """"Hazukk." can only be Hazukkson; from then on it has 20 mg, so that "Hazuk. 20 mg", which may also begin Hazukdar, is its own."""
    names = ["Hazukkson 10 mg tablet", "Hazukdaran 10 mg tablet", "Hazukk. 20 mg tablet", "Hazuk. 20 mg tablet", "Hazuk. 30 mg tablet"]
    got = {r.id: r.product for r in E.resolve_names(spark.createDataFrame(list(enumerate(names)), "id long, name string"), "id", "name").collect()}
    assert got[2] == got[3] and len({got[i] for i in (0, 1, 3, 4)}) == 4
