"""python -m linescan PATTERN [PATH]: prints matching lines."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from linescan import api
from linescan.config import SearchConfig
from linescan.errors import SearchError, exit_code
from linescan.operators import index, output
from linescan.operators.search import compiled
from linescan.operators.stats import search_stats, stats_report


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("linescan", description="Searches text for a pattern.")
    p.add_argument("pattern")
    p.add_argument("path", nargs="?", default=".")
    p.add_argument("--device", help="an image to search in; PATH is inside it")
    p.add_argument("--stats", action="store_true")
    p.add_argument("--no-color", action="store_true")
    p.add_argument("--jump", action="store_true", help="path:line: before every match")
    p.add_argument("-F", "--force-literal", action="store_true")
    p.add_argument("-u", "--unrestricted", action="count", default=0)
    p.add_argument("-a", "--all", action="store_true")
    p.add_argument("--binary", action="store_true")
    p.add_argument("--no-ignore", action="store_true")
    p.add_argument("--large", action="store_true")
    p.add_argument("--no-cache", action="store_true")
    p.add_argument("--rebuild-cache", action="store_true")
    p.add_argument("--cache-dir", help="folder of the fragment index; without, none is kept")
    return p


def config_of(args: argparse.Namespace) -> SearchConfig:
    config = SearchConfig(args.pattern, force_literal=args.force_literal, use_index=not args.no_cache)
    return config.with_flags(args.unrestricted, args.all, args.large, args.no_ignore, args.binary)


def run(spark: SparkSession, args: argparse.Namespace, out=sys.stdout) -> None:
    config = config_of(args)
    pattern = compiled(config)
    searcher = api.Searcher(spark)
    files = searcher.files(config, args.path, args.device)
    skip = None
    wanted = index.pattern_grams(pattern) if config.use_index and args.cache_dir else []
    if wanted:
        known = index.load(spark, args.cache_dir, args.rebuild_cache)
        skip = index.skippable(known, files, pattern)
    found = searcher.search(files, config, skip=skip)
    root = "" if args.device else args.path
    if args.jump:
        shown = output.match_lines(found, root, color=not args.no_color)
    else:
        shown = output.with_headers(found, root, color=not args.no_color)
    for row in searcher.rows(shown.orderBy("path", "line_num").select("formatted")):
        print(row.formatted, file=out)
    if wanted:
        index.save(index.upserted(known, index.build(files.where(F.col("text").isNotNull()), wanted)), args.cache_dir)
    if args.stats:
        for row in stats_report(search_stats(files, config, skip=skip)).orderBy("line_no").collect():
            print(row.line, file=out)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        config_of(args)
        spark = SparkSession.builder.appName("linescan").getOrCreate()
        run(spark, args)
    except (SearchError, OSError, ValueError) as bad:
        print(f"linescan: {bad}", file=sys.stderr)
        return 2 if isinstance(bad, ValueError) else exit_code(bad)
    return 0
