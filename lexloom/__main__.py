"""python -m lexloom: list the queries, or run one and show or write its rows."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from lexloom import catalogue


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lexloom")
    p.add_argument("query", nargs="?", help="a query's name; without one, all names are listed")
    p.add_argument("folder", nargs="?", default="/root/testdata/sf0.01", help="folder of the input tables")
    p.add_argument("--out", help="folder to write parquet to, instead of showing rows")
    p.add_argument("--explain", action="store_true", help="show the plan")
    args = p.parse_args(argv)
    queries = catalogue.queries()
    if args.query not in queries:
        print("\n".join(sorted(queries)))
        return int(args.query is not None)
    spark = SparkSession.builder.appName("lexloom").getOrCreate()
    df = queries[args.query](spark, args.folder)
    if args.explain:
        df.explain("formatted")
    if args.out:
        df.write.parquet(args.out)
    else:
        df.show(50, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
