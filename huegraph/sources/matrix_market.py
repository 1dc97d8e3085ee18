"""Matrix Market text as an edge list, and back."""

from __future__ import annotations

from typing import NamedTuple
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Header(NamedTuple):
    """What the first lines say. ``symmetry``: general, symmetric, skew-symmetric or hermitian."""

    field: str
    symmetry: str
    rows: int
    cols: int
    entries: int
    #: Text of the size line; entries come after it.
    size_line: str


def read_header(spark: SparkSession, path: str) -> Header:
    """Banner and size line. No banner: symmetric, as a matrix without a storage word is taken.

    ``path`` is a file, or a folder whose files are parts of one text in the order of their names, whatever their sizes. Only the lines
    above the entries travel to the driver: at most the comments and one line.
    """
    if len(path) < 5 or not path.endswith(".mtx"):
        raise ValueError(f"not a Matrix Market file: {path}")
    parts = sorted(spark.read.text(path).inputFiles())
    if not parts:
        raise ValueError(f"{path}: no size line")
    first = spark.read.text(unquote(parts[0]))
    head: list[str] = []
    n = 64
    while True:  # comments may be many; the size line is the first line without a percent sign
        head = [r.value for r in first.limit(n).collect()]
        if any(x.strip() and not x.startswith("%") for x in head) or len(head) < n:
            break
        n *= 16
    banner = head[0].lower().split() if head and head[0].startswith("%%") else []
    field = banner[3] if len(banner) > 3 else "real"
    symmetry = banner[4] if len(banner) > 4 else "symmetric"
    size = next((x for x in head if x.strip() and not x.startswith("%")), "")
    try:
        rows, cols, entries = (int(x) for x in size.split()[:3])
    except ValueError:
        raise ValueError(f"{path}: no size line") from None
    if min(rows, cols, entries) <= 0:
        raise ValueError(f"{path}: rows, columns and entries must be positive")
    return Header(field, symmetry, rows, cols, entries, size)


def mirrored(entries: DataFrame, sign: int = 1) -> DataFrame:
    """``entries`` and the mirror image of those off the diagonal. Repeated entries stay repeated."""
    back = entries.filter("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("val") * sign).alias("val"))
    return entries.unionByName(back)


def read_matrix_market(spark: SparkSession, path: str, precision: str = "double") -> tuple[DataFrame, DataFrame]:
    """``edges(src, dst, val)`` and ``nodes(id)`` of a file, ids from 0.

    ``path`` may be a folder of part files (see ``read_header``). Entries outside the stated size are left out. ``pattern`` files have val 1. Anything but ``general`` is mirrored, a
    skew-symmetric matrix with the sign changed. ``precision``: double or float. Repeated entries stay.
    """
    head = read_header(spark, path)
    lines = spark.read.text(path).filter(~F.col("value").startswith("%") & (F.trim("value") != ""))
    parts = F.split(F.trim("value"), r"\s+")
    kind = "float" if precision == "float" else "double"
    val = F.lit(1.0) if head.field == "pattern" else F.coalesce(F.try_element_at("p", F.lit(3)).try_cast("double"), F.lit(1.0))
    # of the lines that read like the size line one goes; the others are entries, and alike wherever they stand
    same = lines.filter(F.col("value") == head.size_line).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    again = same.select(F.explode(F.expr("sequence(2, n)")).alias("i")).select(F.lit(head.size_line).alias("value"))
    rows = lines.filter(F.col("value") != head.size_line).select("value").unionByName(again).select(parts.alias("p"))
    at = lambda i: F.try_element_at("p", F.lit(i)).try_cast("long") - 1
    edges = rows.select(at(1).alias("src"), at(2).alias("dst"), val.cast(kind).alias("val"))
    edges = edges.filter(F.col("src").between(0, head.rows - 1) & F.col("dst").between(0, head.cols - 1))
    if head.symmetry != "general":
        edges = mirrored(edges, -1 if head.symmetry == "skew-symmetric" else 1)
    return edges, spark.range(head.rows).select("id")


def write_matrix_market(edges: DataFrame, path: str, rows: int, cols: int | None = None, per_file: int = 2_000_000) -> None:
    """One ``general`` Matrix Market text in the folder ``path``: part files in order, the header in the first, and ``per_file`` entries
    or so in each."""
    spark = edges.sparkSession
    n = edges.count()
    head = spark.createDataFrame([(-1, 0, f"%%MatrixMarket matrix coordinate real general\n{rows} {cols or rows} {n}")], "src long, dst long, value string")
    line = F.concat_ws(" ", F.col("src") + 1, F.col("dst") + 1, F.col("val"))
    body = edges.select("src", "dst", line.alias("value"))
    head.unionByName(body).repartitionByRange(n // per_file + 1, "src", "dst").sortWithinPartitions("src", "dst").select("value").write.mode("overwrite").text(path)
