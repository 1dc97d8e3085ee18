"""Command line: ``python -m huegraph.cli --mat NAME_OR_PATH`` prints collisions by width, or writes the report."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.columns import KS
from .operators.collisions import d1_collisions, d2_collisions
from .sources.graphs import Catalog, grid, parse_cuboid


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--mat", required=True, help="name of the catalogue, path of a .mtx file, or a cuboid such as 10x10x10")
    p.add_argument("--folder", default=".", help="where the catalogue's files are")
    p.add_argument("--distance", type=int, choices=(1, 2), default=2)
    p.add_argument("--k", type=int, choices=KS, help="one hash parameter; all where it is not given")
    p.add_argument("--out", help="write the report to this folder as Parquet instead of printing it")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("huegraph").getOrCreate()
    try:
        edges, _ = grid(spark, *parse_cuboid(args.mat))
    except ValueError:
        edges, _ = Catalog(spark, args.folder).load(args.mat)
    report = (d1_collisions if args.distance == 1 else d2_collisions)(edges, [args.k] if args.k else KS)
    if args.out:
        report.write.mode("overwrite").parquet(args.out)
        return
    for row in report.orderBy("k", "w").select("k", "w", (F.lit(1) * F.expr("shiftleft(1, w)")).alias("colors"), "total", "max").collect():
        print(f"k={row.k} colors={row.colors} total={row.total} max={row.max}")


if __name__ == "__main__":
    main()
