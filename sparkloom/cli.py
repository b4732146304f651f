"""``python -m sparkloom.cli index DIR`` and ``... search DIR QUERY [--json] [--explain]``."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import functions as F

from sparkloom.api import Engine
from sparkloom.session import session


def main(arguments: list[str] | tuple[str, ...] | None = None) -> int:
    p = argparse.ArgumentParser(prog="sparkloom")
    p.add_argument("--master", default="local[*]")
    p.add_argument("--index-dir", help="default: .sparkloom in the workspace's parent")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("index").add_argument("workspace")
    s = sub.add_parser("search")
    s.add_argument("workspace")
    s.add_argument("query")
    s.add_argument("--language")
    s.add_argument("--top-k", default=10, type=int)
    s.add_argument("--file-pattern")
    s.add_argument("--tag", action="append", default=[])
    s.add_argument("--json", action="store_true")
    s.add_argument("--explain", action="store_true")
    a = p.parse_args(arguments)
    spark = session(master=a.master, partitions=8)
    engine = Engine(spark, a.workspace, a.index_dir or a.workspace.rstrip("/") + ".index", auto_index=a.command == "search")
    if a.command == "index":
        print(json.dumps(engine.index()))
        return 0
    trace, rows = engine.search_explain(a.query, top_k=a.top_k, language=a.language, file_pattern=a.file_pattern, tags=a.tag)
    if not a.explain:
        rows = rows.select("id", "symbol_name", "file_path", "line_number", "chunk_type", "score", "snippet", "docstring", "tags", "channel_ranks", "language")
    found = rows.withColumn("score", F.round("score", 6)).toJSON().collect()  # at most top_k rows
    if a.json or a.explain:
        print(json.dumps({"trace": trace, "results": [json.loads(r) for r in found]} if a.explain else [json.loads(r) for r in found], indent=1))
    else:
        for k, r in enumerate(map(json.loads, found), 1):
            print(f"{k:3}  {r['score']:.6f}  {r['file_path']}:{r.get('line_number', 0)}  {r.get('symbol_name') or ''}")
    return 0


if __name__ == "__main__":
    import sys

    sys.exit(main())
