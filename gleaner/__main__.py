"""``python -m gleaner index|search|stats``: a small command line over one folder."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from gleaner.plans.engine import Engine


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="gleaner")
    p.add_argument("--store", default="gleaner-index")
    sub = p.add_subparsers(dest="what", required=True)
    i = sub.add_parser("index")
    i.add_argument("folder")
    s = sub.add_parser("search")
    s.add_argument("query")
    s.add_argument("--limit", type=int, default=20)
    s.add_argument("--mode", default="ngram", choices=["ngram", "code", "semantic", "hybrid"])
    s.add_argument("--language")
    sub.add_parser("stats")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("gleaner").getOrCreate()
    engine = Engine(spark, a.store)
    if a.what == "index":
        print(engine.index_directory(a.folder).count(), "documents indexed")
    elif a.what == "search":
        engine.search(a.query, limit=a.limit, mode=a.mode, language=a.language).show(a.limit, False)
    else:
        engine.stats().show()


if __name__ == "__main__":
    main()
