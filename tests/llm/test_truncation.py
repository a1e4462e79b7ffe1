import random

import numpy as np

from kervan.llm import truncation as T

SENTENCES = ["Hastanın kilosu kayıt altına alınır.", "Doz yarıya indirilebilir.", "İlk kontrolde tuz tüketimi yakından takip edilir.", "Sabah aç karnına alınmalıdır!", "Neden beklenenden farklı olabilir?"]


def corpus():
    rng = random.Random(8)
    rows, cut = [], set()
    for i in range(1500):
        text = " ".join(rng.choice(SENTENCES) for _ in range(max(1, int(rng.lognormvariate(2.4, 0.8)))))
        source = ("sabit", "serbest", "kelime")[i % 3]
        if source == "sabit" and len(text) > 320:
            text = text[:320]
        elif source == "kelime" and len(text) > 500:
            text = text[: text.rfind(" ", 0, 500)] + "…"
        if not text.endswith((".", "!", "?")):
            cut.add(i)
        rows.append((i, text, source))
    n = len(rows)
    extra = [
        ("Giriş yapılır.\n- Doz yarıya indirilebilir\n- Hastanın kilosu kayıt altına alınır", False), ("Giriş yapılır.\n- Doz yarıya indirilebilir\n- Hastanın kilosu kayıt al", True),
        ("Doz yarıya indirilebilir.\n\nBelge no: KT-1/22", False), ("Doz yarıya indirilebilir.\n— Eczane kayıt birimi", False), ("Doz yarıya indirilebilir. 🙏", False),
        ("Doz yarıya indirilebilir. Sabah aç<br", True), ("Doz yarıya indirilebilir. Sabah a�", True), ("Doz yarıya indirilebilir. Sabah aç kar", True), ("Doz yarıya indirilebilir...", False),
        ("", False), (" \n", False), (rows[min(cut)][1], True), ("“Doz yarıya indirilebilir.”", False),
    ]
    for k, (t, is_cut) in enumerate(extra):
        rows.append((n + k, t, "serbest" if k % 2 else None))
        if is_cut:
            cut.add(n + k)
    return [*rows, (9999, None, "serbest")], cut


def test_judge(spark):
    rows, cut = corpus()
    df = spark.createDataFrame([(i, t, s, 1) for i, t, s in [*rows, *rows[:2]]], "doc_id long, text string, source string, is_cut int")
    judged = T.judge(df, "doc_id", "text", "source")
    got = {r.doc_id for r in judged.filter("is_cut").collect()}
    assert judged.count() == len(rows) - 1
    assert len(got & cut) / len(cut) > 0.98 and len(got & cut) / len(got) > 0.98
    assert any(r.by_length for r in judged.collect())  # the length decides where the ending alone can't
    shares = {r.source: r.share for r in T.report(judged).collect()}
    assert shares["sabit"] > 0.4 and shares["serbest"] < 0.05
    assert T.judge(df.limit(0), "doc_id", "text", "source").count() == 0


def test_limit_is_found():
    rng = np.random.default_rng(1)
    x = np.minimum(np.exp(rng.normal(6, 0.8, 3000)).astype(int) + 1, 700)
    length, n = np.unique(x, return_counts=True)
    limit, share = T.find_limit(length, n)
    assert limit == 700 and share[700] > 0.95 and max(v for k, v in share.items() if k < 700) < 0.9
    length, n = np.unique(np.exp(rng.normal(6, 0.8, 3000)).astype(int) + 1, return_counts=True)
    assert T.find_limit(length, n) == (0, {})


def test_long_limit_reaches_its_texts(spark):
    """The lengths at a limit of 32,767 bytes have its posterior in the judgement."""
    rng = random.Random(9)
    rows = []
    for i in range(60):
        data = (rng.choice(SENTENCES) + " " + "ş" * int(rng.lognormvariate(9.7, 0.4))).encode()[:32_767]
        rows.append((i, data.decode(errors="ignore"), "uzun"))
    judged = {r.doc_id: r for r in T.judge(spark.createDataFrame(rows, "doc_id long, text string, source string"), "doc_id", "text", "source").collect()}
    at_limit = [i for i, t, _ in rows if 32_750 < len(t.encode()) <= 32_767]
    assert len(at_limit) > 15 and all(judged[i].posterior > 0.5 for i in at_limit)


def test_every_limit_is_found():
    """A limit that the mode of a large source outnumbers, and one that only some texts meet."""
    rng = np.random.default_rng(2)
    x = np.exp(rng.normal(5.5, 0.8, 60_000)).astype(int) + 1
    x[:1500] = np.minimum(np.exp(rng.normal(6, 1.2, 1500)).astype(int) + 1, 900)
    x = np.minimum(x, 4000)
    ends_open = (x == 4000) | (x == 900)
    length, at = np.unique(x, return_inverse=True)
    found = {limit: share for _, limit, share in T.find_limits({"chars": length}, np.bincount(at), np.bincount(at, ends_open))}
    assert set(found) == {900, 4000} and found[900][900] > 0.8 and found[4000][4000] > 0.8


def test_endings_are_weighed_by_the_corpus():
    """Marks come from the texts at limits, the other kinds from drawn cuts and natural ends; an ambiguous tail needs the length."""
    cuts, ends = {"open": 900, "stop": 30, "list_final": 2, "short": 3}, {"stop": 900, "list_final": 40, "trail_final": 8, "short": 1}
    odds, share = T.weigh(cuts, 0.02, ends, [("open", 0.97, 80), ("trail_open", 0.97, 15), ("trail_final", 0.97, 2), ("stop", 0.0, 900), ("open", 0.0, 20)])
    log = lambda p: np.log(p / (1 - p))
    assert odds["open"] + log(share) > 0 and odds["trail_open"] + log(share) > 0
    assert odds["trail_final"] + log(share) < 0 < odds["trail_final"] + log(0.97)
    assert odds["list_final"] + log(share) < 0 and odds["short"] + log(share) < 0
    assert 0.005 < share < 0.1
    assert T.weigh({}, 0.5, {}, [])[0].keys() == set(T.KINDS)
