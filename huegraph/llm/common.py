"""Helpers shared by the training-data operators."""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import materialize as materialize
from ..runtime import release as release

#: Characters of text that one Arrow result batch holds at most (one document may exceed it).
BATCH_CHARS = 4_000_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


@contextmanager
def settings(spark: SparkSession, **values: str):
    """SQL settings (dots written as double underscores) for the actions inside, put back afterwards."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def crc_mod(column: str | Column, mod: int) -> Column:
    """crc32 of the id written as text, modulo ``mod``; a null id counts as the empty text."""
    c = F.col(column) if isinstance(column, str) else column
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % mod


def bounded_sample(df: DataFrame, key: str, rows: int, over: int = 2, of: DataFrame | None = None, where: Column | None = None) -> DataFrame:
    """At most ``rows`` rows of ``df`` (of those with ``where``), those with the smallest hash of ``key``: the same rows however the table is
    partitioned. Only for fitting classifiers.

    Hashes above a share of ``over * rows`` rows of ``of`` (``df`` where it is not given; counted first) are filtered where
    they are read, so that what the tasks send together does not grow with their number. ``where`` is asked of the rows left only.
    """
    n = (df if of is None else of).select(key).count()
    if n > over * rows:
        df = df.filter(F.xxhash64(F.col(key)) <= -(2**63) + int(2**64 * over * rows / n))
    if where is not None:
        df = df.filter(where)
    return df.orderBy(F.xxhash64(F.col(key)), F.col(key)).limit(rows)


def one_label(labels: DataFrame, doc_id: str, label: str) -> DataFrame:
    """(doc_id, y): the label of each document, 0 or 1; where a document has clashing labels the least of them."""
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("y")).filter("doc_id IS NOT NULL AND y IN (0, 1)")
    return known.groupBy("doc_id").agg(F.min("y").alias("y"))


def text_batches(batches, size: int = BATCH_CHARS, name: str = "text"):
    """Split Arrow batches with a column ``name`` of texts into (batch, texts) runs of bounded size."""
    for batch in batches:
        texts = batch.column(name).to_pylist()
        start, held = 0, 0
        for i, text in enumerate(texts):
            held += len(text or "")
            if held >= size:
                yield batch.slice(start, i + 1 - start), texts[start : i + 1]
                start, held = i + 1, 0
        if start < len(texts):
            yield batch.slice(start), texts[start:]


def byte_windows(texts: list[bytes], size: int, tail: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of ``size`` bytes of all texts (``tail`` more bytes of the next one behind each, zeros behind the
    text), the text each belongs to, and its bytes. A text has one window at least."""
    counts = np.array([max(1, -(-len(b) // size)) for b in texts], np.int64)
    x = np.zeros((counts.sum(), size + tail), np.uint8)
    filled = np.zeros(len(x))
    row = 0
    for b, n in zip(texts, counts, strict=True):
        flat = np.zeros(n * size + tail, np.uint8)
        flat[: len(b)] = np.frombuffer(b, np.uint8)
        x[row : row + n] = np.lib.stride_tricks.sliding_window_view(flat, size + tail)[::size]
        filled[row : row + n] = np.clip(len(b) - size * np.arange(n), 0, size)
        row += n
    return x, np.repeat(np.arange(len(texts)), counts), filled


class Adam:
    """Adam over a dictionary of arrays."""

    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.p, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, g: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, d in g.items():
            self.m[k] += 0.1 * (d - self.m[k])
            self.v[k] += 0.001 * (d * d - self.v[k])
            m, v = self.m[k] / (1 - 0.9**self.t), self.v[k] / (1 - 0.999**self.t)
            self.p[k] -= (self.rate * m / (np.sqrt(v) + 1e-8)).astype(self.p[k].dtype)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def with_columns(batch: pa.RecordBatch, drop: list[str], **columns: pa.Array) -> pa.RecordBatch:
    """``batch`` without the columns ``drop`` and with ``columns`` appended."""
    keep = [n for n in batch.schema.names if n not in drop and n not in columns]
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), *columns.values()], names=[*keep, *columns])


def fresh_name(taken: list[str], name: str = "given_text") -> str:
    """``name``, with more underscores behind it where a column is called so already (in any case of letters)."""
    used = {c.lower() for c in taken}
    while name in used:
        name += "_"
    return name


def fields(df: DataFrame) -> str:
    """The columns of ``df`` as the start of a schema text."""
    return "".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}, " for f in df.schema)


def resolve_vocabulary(name_or_path: str) -> str:
    """A vocabulary file by path, or by name among the installed public tokenizers. Called on workers."""
    import os

    if os.path.isabs(name_or_path):
        return name_or_path
    import public_tokenizers

    return public_tokenizers.path(name_or_path)
