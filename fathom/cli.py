"""The command line over the engine's functions."""

from __future__ import annotations

import argparse
import os
import sys

from . import report
from .operators.search import Filters
from .schema import CATEGORY_ALIASES, RELATED_LIMIT

PROGRAM, VERSION = "fathom", "0.1.0"


def _limit(value: str) -> int:
    n = int(value)
    if n < 1:
        raise argparse.ArgumentTypeError("must be at least 1")
    return n


def _list(value: str) -> list[str]:
    return [x for x in value.split(",") if x]


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog=PROGRAM, description="Search and inspect a repository.")
    top.add_argument("--version", action="version", version=VERSION)
    both = argparse.ArgumentParser(add_help=False)
    both.add_argument("--format", choices=["human", "json"], default="human")
    both.add_argument("--no-color", action="store_true")
    sub = top.add_subparsers(dest="command")

    def command(name: str, about: str, directory: bool = True) -> argparse.ArgumentParser:
        p = sub.add_parser(name, help=about, description=about, parents=[both])
        if directory:
            p.add_argument("-d", "--directory", default=".")
        return p

    p = command("index", "Index a repository and save a snapshot", False)
    p.add_argument("directory")
    p.add_argument("--exclude", type=_list, action="extend", default=[])
    p = command("search", "Rank files for a query")
    p.add_argument("query")
    p.add_argument("--match-all", action="store_true")
    p.add_argument("--category", type=_list, action="extend", default=[])
    p.add_argument("--path")
    p.add_argument("--extension", type=_list, action="extend", default=[])
    p.add_argument("--limit", type=_limit)
    command("symbol", "Find definitions and likely references").add_argument("name")
    command("overview", "Summarise the project")
    p = command("related", "Rank files related to a file")
    p.add_argument("path")
    p.add_argument("--limit", type=_limit, default=RELATED_LIMIT)
    command("audit-docs", "Find stale references in documentation").add_argument("--confidence", choices=["high", "medium", "low"], default="low")
    command("stats", "Show a snapshot's figures")
    command("clear", "Delete a snapshot")
    sub.add_parser("help", help="Show help").add_argument("topic", nargs="?")
    return top


def catalog(top: argparse.ArgumentParser | None = None) -> tuple[dict[str, str], set[str]]:
    """Commands with what they do, and all long options."""
    top = top or parser()
    subs = next(a for a in top._actions if isinstance(a, argparse._SubParsersAction))
    about = {a.dest: a.help for a in subs._choices_actions}
    options = {o for p in [top, *subs.choices.values()] for a in p._actions for o in a.option_strings if o.startswith("--")}
    return about, options


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName(PROGRAM).config("spark.ui.enabled", "false").getOrCreate()


def run(args: argparse.Namespace, spark=None) -> dict:
    from .operators.index import Index
    from .sources import directory, snapshot

    about, options = catalog()
    if args.command is None:
        return report.root(PROGRAM, VERSION, about)
    where = os.path.realpath(args.directory)
    if args.command == "clear":
        return report.clear(where, snapshot.clear(where))
    bad = [c for c in getattr(args, "category", []) if c.lower() not in CATEGORY_ALIASES]
    if bad:
        raise ValueError(f"unknown category: {', '.join(bad)}")
    spark = spark or _session()
    if args.command == "index":
        names = directory.exclusions(where, args.exclude)
        saved = snapshot.save(Index(directory.read(spark, where, args.exclude)), where, names)
        return report.index(where, snapshot.load(spark, where).index, saved, names)
    if args.command == "stats":
        found = snapshot.load(spark, where)
        if found is None:
            raise ValueError(f"no snapshot in {where}; run {PROGRAM} index first")
        return report.stats(where, found)
    index = snapshot.load_or_read(spark, where)
    if args.command == "search":
        return report.search(where, index, args.query, args.match_all, Filters(args.category, args.path, args.extension, args.limit))
    if args.command == "symbol":
        return report.symbol(where, index, args.name)
    if args.command == "overview":
        return report.overview(where, index)
    if args.command == "related":
        return report.related(where, index, args.path, args.limit)
    return report.audit(where, index, args.confidence, PROGRAM, about, options)


def main(argv: list[str] | None = None) -> int:
    top = parser()
    args = top.parse_args(argv)
    if args.command == "help":
        top.parse_args([args.topic, "--help"] if args.topic else ["--help"])
    try:
        result = run(args)
    except (ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    sys.stdout.write(report.as_json(result) if getattr(args, "format", "human") == "json" else report.as_text(result))
    return 0


if __name__ == "__main__":
    sys.exit(main())
