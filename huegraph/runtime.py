"""Lineage cuts through the shared folder of the cluster."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where that is unset, a temporary folder in local mode (tests); on a
    cluster that is an error, since a folder of one machine would lose data."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local:
        _local.append("file://" + tempfile.mkdtemp(prefix="stages-"))
    return _local[0]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may be gone at exit; the folder is scratch space
        pass


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the program ends."""
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}-{name}"
    atexit.register(_remove, spark, path)
    return path


def materialize(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors. ``by``: a column whose values get folders of
    their own, so that a filter on it reads no others."""
    spark = df.sparkSession
    path = scratch(spark, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path) if by else spark.read.parquet(path)
    out._stage = path
    return out


def is_stage(df: DataFrame) -> bool:
    """Whether ``df`` is what ``materialize`` returned, all of it."""
    return "_stage" in vars(df)


def release(*frames: DataFrame) -> None:
    """Remove the files of materialized frames that nothing reads any more."""
    for df in frames:
        _remove(df.sparkSession, df._stage)
