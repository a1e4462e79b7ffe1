import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from kervan.config import EngineConfig, env_flag
from kervan.functions import guard
from kervan.operators import answer as ans
from kervan.operators import embed as emb
from kervan.operators import filters, models, retrieve, tables
from kervan.operators.ingest import ingest, insert_chunk, save_form
from kervan.operators.names import named_in
from kervan.schema import CHUNKS, MEDICINES, migrate
from kervan.sources import json_records as jr
from kervan.sources.snapshots import SnapshotStore
from kervan.streaming.deliveries import ingest_stream, stream_json_files

RECORD = {"medicine_name": "ALFA 10 mg", "active_ingredient": "a", "side_effects": ["bulantı", " "], "warnings": "Acil durumda başvurun.", "source": {"name": "S", "url": "u"}}


def store_of(spark, vectors):
    meds = spark.createDataFrame([(1, "ALFA 10 mg", "S1"), (2, "ALFA PLUS", "S2"), (3, "BETA", None)], "medicine_id long, medicine_name string, source_name string")
    chunks = spark.createDataFrame(
        [(i, m, f"İlaç: x\nKategori: {t}\n{body}", t, v, model) for i, (m, t, body, v, model) in enumerate(vectors, 1)],
        "chunk_id long, medicine_id long, chunk_text string, chunk_type string, embedding array<double>, embedding_model string",
    )
    return meds, chunks


def hot(i, n=6):
    return [float(j == i) for j in range(n)]


@pytest.fixture(scope="module")
def scene(spark):
    m = EngineConfig().embedding_model
    return store_of(
        spark,
        [
            (1, "side_effects", "Bulantı görülür.", hot(0), m), (1, "frequency", "Günde 2 doz.", hot(1), None), (1, "serious_side_effects", "Acil.", hot(2), ""),
            (2, "side_effects", "Baş ağrısı.", hot(3), m), (3, "indications", "Ağrı.", hot(4), m),
            (3, "usage", "eski", hot(0), "old"), (3, "usage", "bozuk", [float("nan")] * 6, m), (3, "usage", "sıfır", [0.0] * 6, m), (3, "usage", "kısa", [1.0], m), (3, "usage", "yok", None, m),
            (99, "usage", "sahipsiz", hot(0), m),
        ],
    )


def ask(spark, scene, text, i, chat=ans.echo_chat, **kw):
    meds, chunks = scene
    q = spark.createDataFrame([(7, text, hot(i))], "query_id long, query_text string, query_vec array<double>")
    hits = retrieve.top_chunks(q, chunks, meds)
    return hits.orderBy("rank").collect(), ans.answer(q, hits, chat, **kw).first()


def test_scenarios(spark, scene):
    hits, r = ask(spark, scene, "ALFA yan etkileri", 0)
    assert [h.chunk_id for h in hits] == [1] and r.outcome == "answered" and "Bulantı" in r.response
    assert r.response.index("Bulantı") < r.response.index("Kaynaklar: S1") < r.response.index(guard.DISCLAIMER)
    assert ask(spark, scene, "bilinmeyen", 5)[1].outcome == "no_hits"
    hits, r = ask(spark, scene, "20 kg çocuğum için doz?", 1)
    assert hits[0].chunk_type == "frequency" and r.outcome == "refused" and guard.REFUSAL in r.response and "Günde 2 doz." in r.response
    assert ask(spark, scene, "20 kg", 5)[1].outcome == "no_hits"
    _, r = ask(spark, scene, "ALFA PLUS", 3)
    assert "Kaynaklar: S2" in r.response
    _, r = ask(spark, scene, "ciddi etki", 2, lambda m: "Başvurun.")
    assert r.response.startswith(guard.WARNING_PREFIX)
    _, r = ask(spark, scene, "etki", 0, lambda m: "Günde 50 mg alın.")
    assert r.outcome == "rejected" and "50" not in r.response
    _, r = ask(spark, scene, "etki", 0, lambda m: "  ")
    assert r.outcome == "no_reply"
    _, r = ask(spark, scene, "BETA", 4)
    assert guard.UNSTATED in r.response


def test_boost_and_ties(spark):
    meds, chunks = store_of(spark, [(1, "usage", "a", [0.8, 0.6], None), (3, "usage", "b", [0.85, 0.5268], None), (3, "usage", "c", [0.85, 0.5268], None)])
    q = spark.createDataFrame([(1, "alfa nedir", [1.0, 0.0]), (2, None, [1.0, 0.0]), (3, "x", [0.0, 0.0])], "query_id long, query_text string, query_vec array<double>")
    got = retrieve.top_chunks(q, chunks, meds, min_score=0.0, k=2).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.chunk_id) for r in got] == [(1, 1), (1, 2), (2, 2), (2, 3)]
    with pytest.raises(ValueError):
        retrieve.top_chunks(spark.createDataFrame([(1, "a", [float("nan")])], q.schema), chunks, meds)
    assert retrieve.top_chunks(q.limit(0), chunks, meds).count() == 0
    assert retrieve.top_chunks(q, chunks.limit(0), meds).count() == 0


def test_trace(spark, scene):
    r = retrieve.trace(scene[1], scene[0], EngineConfig().embedding_model).first()
    assert (r.chunks, r.embedded, r.stale, r.candidates) == (10, 9, 1, 8)


def test_names(spark):
    q = spark.createDataFrame([(1, "Parol ne işe yarar"), (2, "parolun"), (3, "film tablet mg"), (4, None)], "q long, t string")
    m = spark.createDataFrame([(1, "PAROL 500 mg tablet"), (2, "Film tablet"), (3, None), (4, "")], "m long, n string")
    got = {tuple(r) for r in named_in(q, m, "q", "t", "m", "n").collect()}
    assert got == {(1, 1), (3, 2)}


def test_store_round_trip(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "db"))
    raw = lambda *docs: spark.createDataFrame([(f"f{i}.json", 0, json.dumps(d)) for i, d in enumerate(docs)], "file_path string, record_no int, record_json string")
    calls = lambda: emb.hashing_embedder(8)
    out = ingest(store, raw(RECORD, {**RECORD, "medicine_name": "örnek", "is_example": True}), calls)
    assert out == {"files": 2, "medicines": 1, "chunks": 3, "skipped": 1, "embedded": 3}
    before = store.table("document_chunks").collect()
    assert [r.chunk_type for r in sorted(before)] == ["active_ingredient", "side_effects", "warnings"]
    out = ingest(store, raw(RECORD), calls)
    assert out["embedded"] == 0 and out["chunks"] == 3 and sorted(store.table("document_chunks").collect()) == sorted(before)
    out = ingest(store, raw({**RECORD, "medicine_name": "alfa 10 MG"}), calls, EngineConfig(embedding_model="other"))
    assert out["embedded"] == 3 and store.table("medicines").first().medicine_name == "ALFA 10 mg"
    assert min(r.chunk_id for r in store.table("document_chunks").collect()) == 4
    ingest(store, raw({"medicine_name": "YALIN"}, {"medicine_name": "yalin", "dosage": "x", "dosage_information": " "}), calls)
    assert store.table("medicines").count() == 2 and store.table("medicines").filter("medicine_id = 2").first().medicine_name == "YALIN"
    with pytest.raises(Exception, match="f0.json"):
        ingest(store, spark.createDataFrame([("f0.json", 0, "{")], "file_path string, record_no int, record_json string"), calls)
    assert store.table("medicines").count() == 2


def test_files_and_stream(spark, tmp_path):
    src = tmp_path / "in" / "sub"
    src.mkdir(parents=True)
    (src / "a.json").write_text("\ufeff" + json.dumps([RECORD, {**RECORD, "medicine_name": "B"}]), encoding="utf-8")
    (src / "b.json").write_text("[1]")
    parsed = jr.parse(jr.read_json_files(spark, str(tmp_path / "in")))
    assert jr.records(parsed).count() == 2 and jr.bad_documents(parsed).count() == 1
    store = SnapshotStore(spark, str(tmp_path / "db"))
    q = ingest_stream(stream_json_files(spark, str(tmp_path / "in")), store, lambda: emb.hashing_embedder(8), str(tmp_path / "cp"))
    q.awaitTermination()
    assert store.table("medicines").count() == 2 and store.table("document_chunks").count() == 6


def test_alias_order(spark):
    rec = {"medicine_name": "A", "serious_side_effects": "s", "side_effects": "c"}
    rows = jr.records(jr.parse(spark.createDataFrame([("f", 0, json.dumps(rec))], "file_path string, record_no int, record_json string")))
    from kervan.operators.ingest import section_chunks

    got = section_chunks(jr.normalised(rows).select("medicine_name", "rec")).orderBy("pos").collect()
    assert [r.chunk_type for r in got] == ["serious_side_effects", "side_effects"]
    assert got[0].chunk_text == "İlaç: A\nKategori: serious_side_effects\ns"


def test_upsert_nulls_and_skew(spark):
    stored = spark.createDataFrame([(1, "A", None, "x"), (2, "a", None, "y"), (5, "ç", "s", "z")], "id long, n string, s string, v string")
    inc = spark.createDataFrame([("a", None, "1", 1), ("A", None, "2", 2), ("Ç", "s", "3", 3)] + [("hot", "h", str(i), 10 + i) for i in range(300)], "n string, s string, v string, _ord long")
    got = {r.id: (r.n, r.s, r.v) for r in tables.upsert(stored, inc, ["n", "s"], "id", folded="n", keep=["n"]).collect()}
    assert got == {1: ("A", None, "2"), 2: ("a", None, "y"), 5: ("ç", "s", "z"), 6: ("Ç", "s", "3"), 7: ("hot", "h", "299")}
    assert tables.upsert(stored, inc.limit(0), ["n", "s"], "id").count() == 3
    assert tables.upsert(stored.limit(0), inc, ["n", "s"], "id", folded="n", start=9).agg(F.min("id")).first()[0] == 10


def test_children(spark):
    old = spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (3, 2, "c")], "chunk_id long, medicine_id long, t string")
    new = spark.createDataFrame([(9, 1, "n")], old.schema)
    assert {r.chunk_id for r in tables.replace_children(old, new, "medicine_id").collect()} == {3, 9}
    gone = spark.createDataFrame([(2,)], "medicine_id long")
    assert {r.chunk_id for r in tables.replace_children(old, new.limit(0), "medicine_id", gone).collect()} == {1, 2}
    assert {r.chunk_id for r in tables.cascade(old, gone, "medicine_id").collect()} == {3}


def test_lookup_filter_require(spark):
    df = spark.createDataFrame([(2, "x'; DROP TABLE m;--"), (1, "X'; drop table m;--")], "id long, n string")
    assert filters.lookup_by_name(df, " x'; DROP table m;-- ", "n", "id").first().id == 1
    assert filters.where_equal(df, id=2, n=None).count() == 1
    good, bad = filters.quarantine(df.withColumn("e", F.lit(None).cast("boolean")), F.col("e"))
    assert good.count() == 0 and bad.count() == 2
    with pytest.raises(Exception, match="needed"):
        filters.require(df, F.col("id") > 1, "needed", "id").collect()
    for args in ((" ", 1, 0.0), ("a", 0, 0.0), ("a", True, 0.0), ("a", 1, float("nan"))):
        with pytest.raises(ValueError):
            filters.check_arguments(*args)


def test_migrate(spark):
    old = spark.createDataFrame([(1, 1, "t", "k", [1.0], "more")], "chunk_id long, medicine_id long, chunk_text string, chunk_type string, embedding array<double>, extra string")
    assert migrate(old, CHUNKS).columns == [*CHUNKS.names, "extra"]
    with pytest.raises(ValueError):
        migrate(old, MEDICINES)


def test_config_and_form():
    assert env_flag({"A": " Yes "}, "A", False) and not env_flag({"A": "2"}, "A", True)
    for bad in ({"max_chunk_chars": 99}, {"top_k": 0}, {"min_score": 1.1}, {"name_boost": -0.1}, {"min_score": float("nan")}):
        with pytest.raises(ValueError):
            EngineConfig(**bad)
    assert EngineConfig.from_env({"RETRIEVAL_TOP_K": "3"}).top_k == 3
    assert jr.validate_form({"medicine_name": " A ", "warnings": " "})["warnings"] is None
    for bad, kind in (({"x": "y"}, ValueError), ({"medicine_name": 1}, TypeError), ({"medicine_name": " "}, ValueError)):
        with pytest.raises(kind):
            jr.validate_form(bad)


def test_embedder_checks(spark):
    for texts, kind in (("abc", TypeError), ([1], TypeError), (["a", " "], ValueError)):
        with pytest.raises(kind):
            emb.check_texts(texts)
    for vectors, n in (([[1.0]], 2), ([[1.0], [1.0, 2.0]], 2), ([[float("nan")]], 1)):
        with pytest.raises(ValueError):
            emb.check_vectors(vectors, n)
    df = spark.createDataFrame([(1, "a"), (2, None)], "i int, t string")
    got = {r.i: r.embedding for r in emb.embed(df, "t", lambda: emb.hashing_embedder(4), "m").collect()}
    assert len(got[1]) == 4 and got[2] is None


def test_messages(spark):
    rows = spark.createDataFrame([([("user", "a")],), ([("robot", "a")],), ([("user", " ")],), ([],), (None,)], "m array<struct<role:string,content:string>>")
    assert [r[0] for r in rows.select(ans.valid_messages(F.col("m"))).collect()] == [True, False, False, False, False]


def test_header_evidence(spark):
    meds, chunks = store_of(spark, [(1, "usage", "metin", [1.0], None)])
    chunks = chunks.withColumn("chunk_text", F.lit("İlaç: A 10 mg\nKategori: usage\nmetin"))
    q = spark.createDataFrame([(1, "a", [1.0])], "query_id long, query_text string, query_vec array<double>")
    hits = retrieve.top_chunks(q, chunks, meds)
    say = lambda m: "10 mg alınır"
    assert ans.answer(q, hits, say).first().outcome == "rejected"
    assert ans.answer(q, hits, say, header_is_evidence=True).first().outcome == "answered"


def test_text_questions(spark, scene):
    """Questions as texts: the model makes their vectors; blank ones and bad limits raise; without candidates it isn't asked."""
    meds, chunks = scene
    model = lambda: lambda texts: [hot(0) for _ in texts]
    q = spark.createDataFrame([(1, " alfa plus "), (2, "x")], "query_id long, query_text string")
    got = retrieve.retrieve(q, chunks, meds, model).collect()
    assert [(r.query_id, r.chunk_id, round(r.rank_score, 2)) for r in sorted(got)] == [(1, 1, 1.12), (2, 1, 1.0)]
    failing = lambda: lambda texts: 1 / 0
    assert retrieve.retrieve(q, chunks.filter("embedding is null"), meds, failing, EngineConfig()).count() == 0
    for bad in ({"k": 0}, {"min_score": 2.0}):
        with pytest.raises(ValueError):
            retrieve.retrieve(q, chunks, meds, model, **bad)
    with pytest.raises(Exception, match="blank"):
        retrieve.retrieve(spark.createDataFrame([(1, "  ")], q.schema), chunks, meds, model).collect()
    assert [r.chunk_id for r in retrieve.retrieve_one(" alfa ", chunks, meds, model, k=1).collect()] == [1]
    assert retrieve.retrieve_one("a", chunks.limit(0), meds, failing).count() == 0
    for bad in ((" ", {}), (None, {}), ("a", {"k": True})):
        with pytest.raises(ValueError):
            retrieve.retrieve_one(bad[0], chunks, meds, model, **bad[1])
    vec = retrieve.with_vectors(q, model, "trace-model")
    t = {r.query_id: r for r in retrieve.query_trace(vec, retrieve.top_chunks(vec, chunks, meds), chunks, meds).collect()}[1]
    assert (t.dimension, t.preview, t.chunks, t.stale, t.candidates, t.top_k) == (6, hot(0), 10, 1, 8, 5) and t.top_chunks[0].medicine_name == "ALFA 10 mg"
    assert emb.embed_one("a", lambda: emb.hashing_embedder(4), "one") == emb.hashing_embedder(4)(["a"])[0]


def test_many_queries_in_few_passes(spark, monkeypatch):
    """Blocks of queries and passes give what one query at a time gives, names joined or sent."""
    rng = np.random.default_rng(3)
    v = np.round(rng.normal(size=(300, 4)), 1)  # with ties
    meds = spark.createDataFrame([(i, f"MARKA{i} tablet", None) for i in range(7)], "medicine_id long, medicine_name string, source_name string")
    chunks = spark.createDataFrame([(i, i % 8, "t", "usage", v[i].tolist(), None) for i in range(300)], CHUNKS)
    q = spark.createDataFrame([(i, f"marka{i % 9} nedir", (v[i] + 0.01).tolist()) for i in range(40)], "query_id long, query_text string, query_vec array<double>")

    def run():
        return sorted(tuple(r) for r in retrieve.top_chunks(q, chunks, meds, min_score=0.0).select("query_id", "rank", "chunk_id", F.round("rank_score", 6)).collect())

    want = run()
    unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    for i in (0, 17, 39):
        a = (v[i] + 0.01) / np.linalg.norm(v[i] + 0.01)
        s = [(round(float(u @ a), 12), j) for j, u in enumerate(unit) if j % 8 < 7 and np.any(v[j])]
        best = sorted(((-(x + 0.12 * (j % 8 == i % 9)), -x, j) for x, j in s if x >= 0))[:5]
        assert [c for qi, _, c, _ in want if qi == i] == [j for *_, j in best]
    monkeypatch.setattr(retrieve, "BLOCK_ROWS", 7)
    monkeypatch.setattr(retrieve, "QUERY_BYTES", 8 * 4 * 15)
    assert run() == want
    monkeypatch.setattr(retrieve, "FEW_NAMES", 0)
    monkeypatch.setattr(retrieve, "FEW_RECORDS", 0)
    assert run() == want


def test_ordered_scan(spark, scene):
    meds, chunks = scene
    rows = filters.ordered_chunks(chunks, meds.withColumn("source_reference", F.lit("r"))).collect()
    assert [r.chunk_id for r in rows] == list(range(1, 11)) and len(rows[0]) == 9 and rows[0].medicine_name == "ALFA 10 mg"
    assert [r.chunk_id for r in filters.ordered_chunks(chunks, meds.withColumn("source_reference", F.lit("r")), 1, "frequency").collect()] == [2]


def test_chat_messages_and_models(spark, scene):
    assert ans.check_messages([{"role": "user", "content": " a "}]) == [{"role": "user", "content": "a"}]
    for bad in ([], [{"role": "robot", "content": "a"}], [{"role": "user", "content": " "}], [{"role": "user", "content": 1}]):
        with pytest.raises(ValueError):
            ans.check_messages(bad)
    seen = []
    model = type("Model", (), {"unload": lambda self: seen.append("gone")})()
    assert models.loaded("m", lambda: model) is model and models.loaded("m", lambda: 1 / 0) is model
    assert models.unload("m") == ["m"] and seen == ["gone"] and models.unload("m") == []
    meds, chunks = scene
    q = spark.createDataFrame([(7, "ALFA etkileri", hot(0)), (8, "yok", hot(5))], "query_id long, query_text string, query_vec array<double>")
    hits = retrieve.top_chunks(q, chunks, meds)
    got = {r.query_id: r for r in ans.answer(q, hits, load=lambda: ans.echo_chat, name="echo", trace=True).collect()}
    assert got[7].model_called and got[7].prompt.startswith("Retrieved context:\n[KAYNAK 1]") and "Soru: ALFA etkileri" in got[7].prompt and got[7].question == "ALFA etkileri"
    assert not got[8].model_called and got[8].prompt is None and got[8].retrieved_context == ""
    with pytest.raises(Exception, match="blank"):
        ans.answer(q, hits, system=" ").collect()


def test_forms_and_single_chunks(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "db"))
    calls = lambda: emb.hashing_embedder(8)
    assert save_form(store, {"medicine_name": " ÖRNEK ", "warnings": "a", "usage_information": "b", "interactions": "c", "source_name": " "}, calls) == (1, 3)
    assert save_form(store, {"medicine_name": "örnek"}, lambda: lambda texts: 1 / 0) == (2, 0)
    before = json.loads((tmp_path / "db" / "CURRENT").read_text())["tables"]
    assert insert_chunk(store, 2, " metin ", "usage", [1.0, 2]) == 4
    after = json.loads((tmp_path / "db" / "CURRENT").read_text())["tables"]
    assert after["medicines"] == before["medicines"]  # only the touched bucket was written
    assert len(set(after["document_chunks"].values()) - set(before["document_chunks"].values())) == 1
    row = store.table("document_chunks").filter("chunk_id = 4").first()
    assert (row.chunk_text, row.embedding, row.embedding_model) == ("metin", [1.0, 2.0], EngineConfig().embedding_model)
    assert insert_chunk(store, 2, "b", "usage") == 5 and store.table("document_chunks").filter("chunk_id = 5").first().embedding_model is None
    for args in ((2, " ", "usage"), (2, "a", " "), (77, "a", "usage"), (2, "a", "usage", [float("nan")])):
        with pytest.raises(ValueError):
            insert_chunk(store, *args)
    kept = [p for p in (tmp_path / "db").rglob("_bucket=*")]
    assert len(kept) <= 2 * sum(map(len, after.values()))  # replaced folders go with the next commit


def test_positions_of_a_hot_parent(spark):
    rows = [(1, i) for i in range(700)] + [(2 + i % 50, 1000 + i) for i in range(300)]
    got = tables.positions(spark.createDataFrame(rows, "p long, o long"), "p", "o", "pos", 16).collect()
    by = {}
    for r in sorted(got):
        by.setdefault(r.p, []).append(r.pos)
    assert len(got) == 1000 and all(v == list(range(len(v))) for v in by.values())


def test_overlap_in_any_case(spark):
    hits = "array<struct<medicine_name:string,chunk_type:string>>"
    rows = spark.createDataFrame([([("STRASSE", "usage"), ("straße", "USAGE")],), ([("a", "usage"), ("a", "dosage")],), ([(None, None), ("", "")],), ([],)], f"hits {hits}")
    assert [r[0] for r in rows.select(ans.has_overlap(F.col("hits"))).collect()] == [True, False, True, False]
