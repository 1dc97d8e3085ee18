"""Token counts by a two-tier lookup on the map side.

A pre-token is a run of spaces with the word after it, or a line feed and what follows. No vocabulary piece has a space mark behind
another character, so no merge crosses the start of a pre-token and the counts of pre-tokens add up.

Tier one: the lengths of the most frequent pre-tokens of the whole corpus, broadcast. Every task sums up what it sees in one
bounded summary; summaries are merged in a tree of fixed levels. No pre-token is a key of any shuffle.
Tier two: what misses is encoded by the library and kept in a bounded cache of the worker.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import resolve_vocabulary, text_batches

MODEL = "piece_bpe_32k.model"
_PRE = re.compile(r"\n[^ \n]*| *[^ \n]+| +")
_MARK = "▁"
#: Longer pre-tokens are not counted for tier one.
LONGEST = 32
#: Summaries that are left after each merging.
LEVELS = (1024, 32, 1)


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens of a text: a line feed with what follows it up to a space, or what follows a space (which is left
    out here, so that plain prose is split at C speed)."""
    if not text:
        return []
    if _MARK in text:
        text = text.replace(_MARK, " ")
    parted = text.replace("\n", " \n") if "\n" in text else text
    if parted[0] != " " and "  " not in parted:
        return parted.split(" ")
    return [p if p[0] == "\n" else p[1:] for p in _PRE.findall(" " + text)]


def _length(pre: str, encode) -> int:
    # the line feed in front keeps the library's dummy prefix apart: both are one token
    return len(encode("\n" + pre if pre[:1] == "\n" else "\n " + pre)) - 2


def _load(model: str):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=resolve_vocabulary(model))
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    if any(_MARK in p.lstrip(_MARK) or "\n" in p for p in pieces) or len(sp.encode("\n")) != 2:
        raise ValueError(f"{model}: pieces cross word starts or lines; pre-tokens can't be counted alone")
    return sp


class _Lengths(dict):
    """Pre-token to number of tokens: tier one, and below it the cache of this worker."""

    def __init__(self, frequent: dict[str, int], sp, most: int):
        super().__init__(frequent)
        self.frequent, self.encode, self.most = frequent, sp.encode, most + len(frequent)

    def __missing__(self, pre: str) -> int:
        n = _length(pre, self.encode)
        if len(pre) <= 64:
            if len(self) >= self.most:
                self.clear()
                self.update(self.frequent)
            self[pre] = n
        return n


def summarize(texts, entries: int, most: int = 200_000) -> list[tuple[str, int]]:
    """The most frequent pre-tokens of ``texts`` of at most ``LONGEST`` characters, counted in a dictionary of at most ``most`` entries and those
    of one text: when it is full, the rarest go."""
    counts: Counter = Counter()
    least = 1
    for t in texts:
        counts.update([p for p in pre_tokens(t or "") if len(p) <= LONGEST])
        while len(counts) > most:
            counts = Counter({p: n for p, n in counts.items() if n > least})
            least += 1
    return counts.most_common(entries)


def frequent_pre_tokens(docs: DataFrame, rows: int, summary_rows: int, text: str = "text") -> list[str]:
    """The ``rows`` most frequent pre-tokens, from a summary of ``summary_rows`` entries of every task. Only the speed of the main pass depends
    on the result."""

    def summaries(batches):
        top = summarize((t for _, texts in text_batches(batches) for t in texts), summary_rows)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([pickle.dumps(top)], pa.binary())], names=["at", "summary"])

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        total: Counter = Counter()
        for part in pdf["summary"]:
            total.update(dict(pickle.loads(part)))
        return pd.DataFrame({"at": [int(pdf["at"].iloc[0])], "summary": [pickle.dumps(total.most_common(rows))]})

    found = docs.select(F.col(text).alias("text")).mapInArrow(summaries, "at long, summary binary")
    for left in LEVELS:
        found = found.withColumn("at", F.pmod("at", F.lit(left))).groupBy("at").applyInPandas(merged, "at long, summary binary")
    last = found.first()  # one row of at most ``rows`` entries
    return [p for p, _ in pickle.loads(last.summary)] if last else []


def count_tokens(docs: DataFrame, text: str = "text", out: str = "n_tokens", model: str = MODEL, frequent: int = 32_768, summary_rows: int = 4_096, cache: int = 300_000) -> DataFrame:
    """Append ``out`` (long): the number of tokens of the whole ``text``, without added tokens.

    Null and empty texts: 0. Texts of any length count whole. Rows, repeated ones too, and all other columns stay as they are; an
    input column named ``out`` is replaced. An empty table gives an empty table. ``frequent``: size of tier one; 0 does
    without it and its pass over the corpus, the counts are the same. ``model``: name or
    path of a sentencepiece model; the path must be readable on every worker.
    """
    spark = docs.sparkSession
    sp = _load(model)
    top = frequent_pre_tokens(docs, frequent, summary_rows, text) if frequent else []
    first = {p: _length(p, sp.encode) for p in top}
    shared = spark.sparkContext.broadcast(first)  # at most ``frequent`` entries of 32 characters

    def counted(texts_iter):
        lengths = _Lengths(shared.value, _load(model), cache)
        for texts in texts_iter:
            yield pd.Series([sum(map(lengths.__getitem__, pre_tokens(t))) if t else 0 for t in texts], dtype="int64")

    from collections.abc import Iterator

    counted.__annotations__ = {"texts_iter": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.withColumn(out, F.pandas_udf(counted, "long")(F.col(text)))
