"""``python -m mossgrid detect|extract|report …``: the library from a shell, over files."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="mossgrid")
    sub = p.add_subparsers(dest="command", required=True)
    d = sub.add_parser("detect", help="platforms of a table of sites (Parquet)")
    d.add_argument("sites")
    x = sub.add_parser("extract", help="replay recipes over a table of pages")
    x.add_argument("pages"), x.add_argument("recipes"), x.add_argument("out")
    x.add_argument("--fields", nargs="*", default=None)
    q = sub.add_parser("report", help="run a registered query over a data folder")
    q.add_argument("query"), q.add_argument("folder"), q.add_argument("--out")
    args = p.parse_args(argv)
    spark = SparkSession.builder.appName("mossgrid").getOrCreate()
    if args.command == "detect":
        from mossgrid.operators.detect import detected

        df = detected(spark.read.parquet(args.sites))
    elif args.command == "extract":
        from mossgrid.html.extract import replayed
        from mossgrid.operators.governance import with_recipe
        from mossgrid.operators.schema import PRODUCT, Schema

        schema = Schema.of(args.fields) if args.fields else PRODUCT
        pages = with_recipe(spark.read.parquet(args.pages), spark.read.parquet(args.recipes), schema.name)
        df = schema.typed(replayed(pages, schema).select("url", "read"))
    else:
        from mossgrid.plans import registry

        df = registry.queries()[args.query](spark, args.folder)
    if getattr(args, "out", None):
        from mossgrid.sinks.files import write

        print(write(df, args.out))
    else:
        # decimals leave as text, with the digits as recorded
        text = [F.col(c).cast("string").alias(c) if kind.startswith("decimal") else F.col(c) for c, kind in df.dtypes]
        for line in df.select(F.to_json(F.struct(*text))).toLocalIterator():
            print(line[0])
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
