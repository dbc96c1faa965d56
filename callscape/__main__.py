"""Command line: index, diagnose, query, tools, install."""

from __future__ import annotations

import argparse
import json
import shutil
import sys

from pyspark.sql import SparkSession

from .plans.compiler import execute, json_lines
from .plans.errors import QueryError
from .sources.scip import INDEXERS
from .tools import Tools, to_dot


def session() -> SparkSession:
    return SparkSession.builder.appName("callscape").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="callscape")
    sub = parser.add_subparsers(dest="command", required=True)
    index = sub.add_parser("index", help="bring a project's graph up to date")
    index.add_argument("root")
    index.add_argument("--rebuild", action="store_true")
    index.add_argument("--dot", action="store_true")
    index.add_argument("--scip", help="a reference index whose edges join the graph")
    query = sub.add_parser("query", help="run a query, one JSON object a row")
    query.add_argument("text")
    query.add_argument("--root", default=".")
    tool = sub.add_parser("tools", help="answer tool requests, one JSON object a line")
    tool.add_argument("--root", default=".")
    tool.add_argument("--check", action="store_true")
    sub.add_parser("diagnose", help="show what is installed")
    install = sub.add_parser("install", help="show what external indexers would be needed")
    install.add_argument("--with-scip", action="store_true")
    install.add_argument("--dry-run", action="store_true")
    args = parser.parse_args(argv)
    if args.command in ("diagnose", "install"):
        for lang, program in INDEXERS:
            print(f"{lang}\t{program}\t{shutil.which(program) or 'missing'}")
        return 0
    tools = Tools(session(), args.root)
    if args.command == "index":
        report = tools.index_repository(rebuild=args.rebuild, scip=args.scip)
        print(to_dot(report, args.root) if args.dot else json.dumps(report))
        return 0
    if args.command == "query":
        try:
            for row in json_lines(execute(tools.store.graph(), args.text)).toLocalIterator():
                print(row.value)
            return 0
        except QueryError as e:
            print(e, file=sys.stderr)
            return 2
    if args.check:
        print(json.dumps(tools.index_status()))
        return 0
    for line in sys.stdin:
        request = json.loads(line)
        print(tools.call_json(request["tool"], **request.get("params", {})), flush=True)
    return 0


if __name__ == "__main__":
    sys.exit(main())
