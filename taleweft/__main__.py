"""Ingest book files into a chunk store: ``python -m taleweft ingest 'books/*.txt' --series-id 1 --out store``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .plans.ingest import ingest, store
from .sources.writers import write_chunk_tree


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="taleweft")
    commands = parser.add_subparsers(dest="command", required=True)
    books = commands.add_parser("ingest", help="read books, chunk them, build the hierarchy, and store what is new")
    books.add_argument("paths", nargs="+")
    books.add_argument("--series-id", type=int, required=True)
    books.add_argument("--out", required=True)
    books.add_argument("--tree", help="a folder for chunk trees as JSON, too")
    books.add_argument("--levels", type=int, default=3)
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName("taleweft ingest").getOrCreate()
    done = ingest(spark, given.paths, given.series_id, max_levels=given.levels)
    store(done, given.series_id, given.out)
    if given.tree:
        write_chunk_tree(done.chunks, given.tree)


if __name__ == "__main__":
    main()
