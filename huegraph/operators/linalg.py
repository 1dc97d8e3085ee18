"""Sparse linear algebra on edge lists: product, permutations, comparison of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import is_infinite, relative_difference

#: Ids in a block of a distributed prefix sum.
BLOCK = 65_536


def with_precision(edges: DataFrame, precision: str, column: str = "val") -> DataFrame:
    """``edges`` with values as ``double`` or ``float``."""
    if precision not in ("double", "float"):
        raise ValueError(f"precision must be double or float: {precision}")
    return edges.withColumn(column, F.col(column).cast(precision))


def spmv(edges: DataFrame, x: DataFrame, nodes: DataFrame) -> DataFrame:
    """``y(id, y)`` = A x for every row id in ``nodes``; rows without entries are 0. Sums are in double."""
    terms = edges.join(x.select(F.col("id").alias("dst"), F.col("x").cast("double").alias("x")), "dst").select("src", (F.col("val").cast("double") * F.col("x")).alias("t"))
    sums = terms.groupBy(F.col("src").alias("id")).agg(F.sum("t").alias("y"))
    return nodes.select("id").join(sums, "id", "left").select("id", F.coalesce("y", F.lit(0.0)).alias("y"))


def permute_matrix(edges: DataFrame, perm: DataFrame, precision: str = "double") -> DataFrame:
    """Rows and columns renamed by ``perm(old, new)``, values in ``double`` or ``float``."""
    edges = with_precision(edges, precision)
    rows = perm.select(F.col("old").alias("src"), F.col("new").alias("new_src"))
    cols = perm.select(F.col("old").alias("dst"), F.col("new").alias("new_dst"))
    return edges.join(rows, "src").join(cols, "dst").select(F.col("new_src").alias("src"), F.col("new_dst").alias("dst"), "val")


def inverse(perm: DataFrame) -> DataFrame:
    return perm.select(F.col("new").alias("old"), F.col("old").alias("new"))


def unpermute_matrix(edges: DataFrame, perm: DataFrame, precision: str = "double") -> DataFrame:
    return permute_matrix(edges, inverse(perm), precision)


def permute_vector(x: DataFrame, perm: DataFrame, precision: str = "double") -> DataFrame:
    """``x(id, x)`` with ids renamed by ``perm(old, new)``, values in ``double`` or ``float``."""
    return with_precision(x, precision, "x").join(perm.select(F.col("old").alias("id"), "new"), "id").select(F.col("new").alias("id"), "x")


def unpermute_vector(x: DataFrame, perm: DataFrame, precision: str = "double") -> DataFrame:
    return permute_vector(x, inverse(perm), precision)


def compare(solution: DataFrame, reference: DataFrame) -> DataFrame:
    """One row: ``max_abs``, ``max_rel``, ``rms`` and, among rows that differ, ``zeros`` and ``infinite`` of the solution.

    Rows whose reference is zero, or where either value is infinite or no number, add no difference to the maxima and the root mean square,
    but the mean is over all rows.
    """
    both = solution.select("id", F.col("x").cast("double").alias("s")).join(reference.select("id", F.col("x").cast("double").alias("r")), "id")
    rel, differs = relative_difference("s", "r"), ~F.col("s").eqNullSafe(F.col("r"))
    d = F.when(rel.isNotNull(), F.abs(F.col("s") - F.col("r")))
    return both.select("s", "r", rel.alias("rel"), d.alias("d"), differs.alias("differs")).agg(
        F.coalesce(F.max("d"), F.lit(0.0)).alias("max_abs"),
        F.coalesce(F.max("rel"), F.lit(0.0)).alias("max_rel"),
        F.sqrt(F.coalesce(F.sum(F.col("d") * F.col("d")), F.lit(0.0)) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("rms"),
        F.count_if(F.col("differs") & (F.col("s") == 0)).alias("zeros"),
        F.count_if(F.col("differs") & is_infinite("s")).alias("infinite"),
    )


def durations(blocks: DataFrame, start: str = "start", stop: str = "stop") -> DataFrame:
    """One row: least, greatest and mean duration of blocks of work, as ``stop - start`` (numbers). Blocks without one of both do not count."""
    d = F.col(stop) - F.col(start)
    return blocks.agg(F.min(d).alias("min"), F.max(d).alias("max"), F.avg(d).alias("mean"))


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``degree`` of every vertex: its stored entries, the diagonal included."""
    counts = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    return nodes.select("id").join(counts, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def prefix_sum(df: DataFrame, value: str, out: str, block: int = BLOCK) -> DataFrame:
    """Append the sum of ``value`` over all ids up to a row's own (ids are distinct and not negative).

    Blocks of ids are summed first; the window over all of them has one row a block, the window within a block only its own rows.
    """
    numbered = df.withColumn("__block", F.expr(f"id div {block}"))
    sums = numbered.groupBy("__block").agg(F.sum(value).alias("__sum"))
    before = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("__block", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__start"))
    within = Window.partitionBy("__block").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    own = numbered.withColumn("__own", F.sum(value).over(within))
    return own.join(starts, "__block").withColumn(out, F.col("__start") + F.col("__own")).drop("__block", "__start", "__own")


def symmetrize(edges: DataFrame) -> DataFrame:
    """``edges(src, dst)`` with the mirror image of those off the diagonal; repeated edges stay repeated."""
    return edges.select("src", "dst").unionByName(edges.filter("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def pattern_symmetry(edges: DataFrame) -> DataFrame:
    """One row: distinct ``pairs`` off the diagonal, and those whose mirror image is missing (``asymmetric``)."""
    pairs = edges.filter("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.max(F.col("src") < F.col("dst")).alias("up"), F.max(F.col("src") > F.col("dst")).alias("down"))
    one = (F.col("up") & F.col("down")).cast("long")
    return pairs.agg(F.coalesce(F.sum(one + 1), F.lit(0)).cast("long").alias("pairs"), F.coalesce(F.sum(1 - one), F.lit(0)).cast("long").alias("asymmetric"))
