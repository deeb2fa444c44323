"""Commands: ingest, sync, batch, query, list, stats, status, retry, delete, evaluate, run, compact."""

from __future__ import annotations

import argparse
import sys

from lodestone.api import Engine
from lodestone.errors import EngineError
from lodestone.session import session
from lodestone.sources import datasets


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodestone", description=__doc__)
    p.add_argument("--collection", required=True)
    p.add_argument("--master")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("ingest", "sync"):
        c = sub.add_parser(name)
        c.add_argument("path")
        c.add_argument("--extension", action="append")
        if name == "sync":
            c.add_argument("--dry-run", action="store_true")
    c = sub.add_parser("query")
    c.add_argument("text", nargs="+")
    c.add_argument("--mode", default="hybrid")
    c.add_argument("--top-k", type=int, default=5)
    sub.add_parser("list")
    sub.add_parser("stats")
    sub.add_parser("delete").add_argument("source")
    sub.add_parser("batch").add_argument("item", nargs="+")
    sub.add_parser("status").add_argument("--status")
    sub.add_parser("retry").add_argument("--part")
    sub.add_parser("compact")
    c = sub.add_parser("run")
    c.add_argument("golden")
    c.add_argument("name")
    c = sub.add_parser("evaluate")
    c.add_argument("golden")
    c.add_argument("--top-k", type=int, default=5)
    return p


def main(argv: list[str] | None = None, spark=None) -> int:
    a = parser().parse_args(argv)
    spark = spark or session(master=a.master)
    engine = Engine(spark, a.collection)
    show = lambda df: print("\n".join("\t".join(str(v) for v in r) for r in [df.columns, *df.collect()]))
    try:
        if a.command == "ingest":
            print(engine.ingest_files(a.path, a.extension), "chunks")
        elif a.command == "sync":
            show(engine.sync(a.path, a.extension, a.dry_run).orderBy("source"))
        elif a.command == "query":
            show(engine.query(a.text, a.mode, a.top_k).select("query_id", "rank", "source", "score").orderBy("query_id", "rank"))
        elif a.command == "list":
            show(engine.documents())
        elif a.command == "stats":
            show(engine.stats())
        elif a.command == "delete":
            print(engine.delete(a.source), "chunks deleted")
        elif a.command == "batch":
            show(engine.ingest_batch(a.item))
        elif a.command == "status":
            counts, records = engine.processing_status(a.status)
            print(", ".join(f"{k} {n}" for k, n in counts.items()))
            show(records.select("source", "status", "stage", "chunks", "error"))
        elif a.command == "retry":
            print(engine.retry(a.part), "sources are due")
        elif a.command == "compact":
            print(engine.collection.compact(), "segments became one")
        else:
            with open(a.golden, encoding="utf-8") as f:
                text = f.read()
            golden = datasets.from_json(spark, text) if a.golden.endswith(".json") else datasets.from_yaml(spark, text)
            print(engine.run(golden, a.name)) if a.command == "run" else show(engine.evaluate(golden, a.top_k))
    except EngineError as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
