"""Command line: ingest a folder of JSON records, print the state of a store, or run one record and question through all of it."""

from __future__ import annotations

import argparse
import json

from kervan.config import EngineConfig
from kervan.operators.embed import hashing_embedder
from kervan.operators import retrieve
from kervan.operators.answer import answer
from kervan.operators.ingest import ingest, save_form
from kervan.session import build_session
from kervan.sources.json_records import read_json_files
from kervan.sources.snapshots import SnapshotStore


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="kervan")
    p.add_argument("command", choices=("ingest", "status", "smoke"))
    p.add_argument("--directory")
    p.add_argument("--database", required=True)
    p.add_argument("--max-chars", type=int, default=1200)
    a = p.parse_args(argv)
    spark = build_session()
    store = SnapshotStore(spark, a.database)
    if a.command == "ingest":
        if not a.directory:
            p.error("ingest needs --directory")
        print(json.dumps(ingest(store, read_json_files(spark, a.directory), hashing_embedder, EngineConfig(max_chunk_chars=a.max_chars))))
    elif a.command == "smoke":
        config = EngineConfig(min_score=-1.0)
        record = {"medicine_name": "DENEME", "common_side_effects": "Baş ağrısı görülebilir.", "warnings": "Araç kullanmadan önce bekleyin.", "source_name": "deneme"}
        medicine_id, chunks = save_form(store, record, hashing_embedder, config)
        asked = spark.createDataFrame([(1, "DENEME yan etkileri nelerdir?")], "query_id long, query_text string")
        hits = retrieve.retrieve(asked, store.table("document_chunks"), store.table("medicines"), hashing_embedder, config)
        got = answer(asked, hits, trace=True).first()
        print(json.dumps({"medicine_id": medicine_id, "chunks": chunks, "hits": hits.count(), "model_called": got["model_called"], "response": got["response"]}, ensure_ascii=False))
    else:
        store.initialise()
        config = EngineConfig.from_env()
        print(json.dumps({"database": a.database, "embedding_model": config.embedding_model, "chat_model": config.chat_model} | {n: store.table(n).count() for n in SnapshotStore.SCHEMAS}))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
