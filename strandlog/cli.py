"""Command line: ``python -m strandlog.cli COMMAND ...``."""

from __future__ import annotations

import argparse
import json
import sys

VERSION = "0.1.0"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strandlog", description="Typed tables as change logs, on Spark.")
    p.add_argument("--version", action="version", version=f"strandlog {VERSION}")
    sub = p.add_subparsers(dest="command", required=True)
    check = sub.add_parser("check", help="check a schema file")
    check.add_argument("schema")
    for name, text in (("inspect", "what the tables hold"), ("build", "refresh snapshots"), ("compact", "rewrite live rows"), ("get", "a row by id"), ("get-by", "rows by lookup"), ("put", "put a record"), ("delete", "a tombstone"), ("index", "store a word index"), ("search", "word search"), ("vacuum", "delete what readers no longer need"), ("repair", "mend broken last lines of segments")):
        c = sub.add_parser(name, help=text)
        c.add_argument("root")
        c.add_argument("schema")
        c.add_argument("table")
        c.add_argument("rest", nargs="*")
        c.add_argument("--workspace", default="main")
    return p


def main(args: list[str] | None = None) -> int:
    try:
        a = parser().parse_args(args)
    except SystemExit as e:
        return int(e.code or 0)
    from .ddl import compile_schema
    from .errors import StrandlogError

    try:
        with open(a.schema, encoding="utf-8") as f:
            schema = compile_schema(f.read())
        if a.command == "check":
            print(f"{len(schema.tables)} tables, hash {schema.hash()}")
            return 0
        return _run(a, schema)
    except StrandlogError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


def _run(a: argparse.Namespace, schema) -> int:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from .database import Database
    from .sources import segment

    spark = SparkSession.builder.getOrCreate()
    db = Database(spark, a.root, a.workspace, schema).init()
    show = lambda row: print(json.dumps(row.asDict(), ensure_ascii=False) if row else "null")
    if a.command == "inspect":
        s = db.manifest()["tables"].get(a.table, {})
        print(json.dumps({"table": a.table, "rows": db.count(a.table), "batches": len(s.get("batches", [])), "bytes": db.statistics(a.table)["bytes"], "snapshot": s.get("snapshot")}))
    elif a.command == "build":
        print(json.dumps({"refreshed": db.refresh(a.table)}))
    elif a.command == "compact":
        c = db.compact(a.table)
        print(json.dumps({"rows": c.live_rows, "next_tx": c.next_tx}))
    elif a.command == "get":
        show(db.get_by_id(a.table, a.rest[0]))
    elif a.command == "get-by":
        t = schema.table(a.table)
        for row in [db.get_by(a.table, *a.rest[:2])] if t.lookup(a.rest[0]).unique else db.get_many_by(a.table, *a.rest[:2]):
            show(row)
    elif a.command == "put":
        print(db.upsert(a.table, json.loads(a.rest[0])).first_tx)
    elif a.command == "delete":
        print(db.delete(a.table, a.rest[0]).first_tx)
    elif a.command == "index":
        db.index_text(a.table, a.rest[0])
    elif a.command == "vacuum":
        print(db.vacuum())
    elif a.command == "search":
        for row in db.search(a.table, a.rest[0], " ".join(a.rest[1:])).orderBy(F.desc("score"), "id").limit(100).collect():
            show(row)
    elif a.command == "repair":
        print(json.dumps(segment.repair_files(spark, a.rest[0], schema.table(a.table))))
    return 0


if __name__ == "__main__":
    sys.exit(main())
