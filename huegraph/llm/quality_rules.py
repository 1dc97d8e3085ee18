"""Quality rules with a verdict on hosts, in DataFrame functions only.

Every document is tested by its own rules. The failures are summed by host, each host's failure rate is
shrunk towards the corpus by a beta prior fitted to the hosts' rates (method of moments, over all
hosts), and documents of hosts whose shrunk rate is above ``host_limit`` go too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

_SPACE = r"[ \t-\r]+"
_SYMBOLS = r"[#*$%&|<>]"
#: Parts that the rows of a host are dealt to for its verdict.
SALTS = 64


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, evaluated once for a row however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _windows(words: Column, width: int) -> Column:
    """A 64-bit hash of each window of ``width`` words, by position; there are at least ``width`` words."""
    starts = F.sequence(F.lit(1), F.size(words) - (width - 1))
    return F.transform(starts, lambda i: F.xxhash64(*(F.element_at(words, i + k) for k in range(width))))


def _covered(windows: Column, width: int) -> Column:
    """Words in windows whose hash occurs twice or more: sort, keep equal neighbours, add up the union."""
    pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def positions(s: Column) -> Column:
        twin = F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
        return F.array_sort(F.transform(twin, lambda x: x["i"]))

    zero = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("end"))
    add = lambda acc, p: F.struct((acc["sum"] + p + width - F.greatest(p, acc["end"])).alias("sum"), (p + width).alias("end"))
    return F.aggregate(_let(pairs, positions), zero, add, lambda acc: acc["sum"])


def _repeated(words: Column, width: int) -> Column:
    found = _let(_windows(words, width), lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), _covered(w, width)).otherwise(0))
    return F.when(F.size(words) >= width, found).otherwise(0)


def document_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", min_words: int = 10, max_repeat_percent: int = 20, width: int = 5) -> DataFrame:
    """One row a document: its id, ``host``, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words
    and ``base_failed``. Windows are compared by a 64-bit hash within their document."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
    counts = _let(
        F.array_remove(F.split(whole, _SPACE), ""),
        lambda ws: F.struct(
            F.size(ws).cast("long").alias("n_words"),
            F.char_length(F.array_join(ws, "")).cast("long").alias("word_chars"),
            _repeated(ws, width).cast("long").alias("n_repeat_words"),
        ),
    )
    dup_lines = _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(host).alias("host"), counts.alias("c"), F.regexp_count(whole, F.lit(_SYMBOLS)).cast("long").alias("n_symbols"), dup_lines.cast("long").alias("n_dup_lines"))
    rows = rows.select("doc_id", "host", "c.n_words", "c.word_chars", "n_symbols", "n_dup_lines", "c.n_repeat_words")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def host_rates(rules: DataFrame) -> DataFrame:
    """For each host: n, failed, and ``rate``, its failure rate shrunk by the corpus's beta prior."""
    hosts = rules.filter(F.col("host").isNotNull()).groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    m = F.sum("failed") / F.sum("n")
    row = hosts.agg(m.alias("m"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("hosts"), F.sum(F.col("failed") * F.col("failed") / F.col("n")).alias("squares")).first()
    mean, strength = float(row.m or 0), 1e6
    if row.n and 0 < mean < 1:
        spread = row.squares / row.n - mean * mean - mean * (1 - mean) * row.hosts / row.n
        strength = min(1e6, max(1.0, mean * (1 - mean) / spread - 1)) if spread > 0 else 1e6
    return hosts.withColumn("rate", (F.col("failed") + mean * strength) / (F.col("n") + strength))


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", host_limit: float = 0.5, **rules) -> DataFrame:
    """One row a document: the rules' counts, ``base_failed``, ``host_rejected`` and ``kept``.

    Null text: no words, so the document fails. Null host: no verdict of a host, its own rules alone
    decide. Texts of any length count whole, in one row. Repeated rows stay rows and all count for their host. An empty table gives an empty table;
    further columns of the input, whatever their names, are not read.
    """
    own = materialize(document_rules(docs, doc_id, text, host, **rules), "rules")
    # a host, or those without one, may have a large part of the rows: its verdict stands in every salt
    bad = host_rates(own).filter(F.col("rate") > host_limit).select("host", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(True).alias("host_rejected"))
    salted = own.withColumn("salt", F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(SALTS)).cast("int"))
    out = salted.join(bad, ["host", "salt"], "left").drop("salt").withColumn("host_rejected", F.coalesce("host_rejected", F.lit(False)))
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))
