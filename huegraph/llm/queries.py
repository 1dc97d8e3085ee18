"""The registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe_codec import encode_decode
from .common import crc_mod, documents, labels
from .langid import identify, train
from .ngram_join import ngram_join
from .packing import best_fit_pack
from .pii import find_pii
from .pii import train as train_pii
from .quality_mil import score_quality
from .quality_mil import train as train_quality
from .quality_rules import quality_rules
from .token_counts import count_tokens
from .topk import top_k
from .toxicity import score_toxicity
from .toxicity import train as train_toxicity


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = count_tokens(documents(spark, sf_dir).select("doc_id", "text"))
    n_bytes = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    return counted.select("doc_id", n_bytes.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = find_pii(docs.select("doc_id", "text"), train_pii(docs))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    kinds = F.array(*(F.lit(k) for k in ("email", "ip", "card", "phone")))
    keyed = F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"].alias("start"), F.array_position(kinds, s["kind"]).alias("k"), s["end"].alias("end"), s["kind"].alias("kind")))
    counts = [count(k) for k in ("email", "ip", "card", "phone")]
    spans = text(F.array_sort(keyed))
    return found.select("doc_id", *counts, F.sha2(text(F.col("base")), 256).alias("base_sha256"), spans.alias("spans"), F.size("added").cast("long").alias("n_added"))


def op3_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_decode(documents(spark, sf_dir).select("doc_id", "text"))
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP4_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT r, unnest(range(1, len(ws) - 3)) AS i, ws FROM w WHERE len(ws) >= 5),
h AS (SELECT r, i, count(*) OVER (PARTITION BY r, ws[i:i+4]) AS c FROM g),
p AS (SELECT r, i, lag(i + 5) OVER (PARTITION BY r ORDER BY i) AS e FROM h WHERE c > 1),
s AS (SELECT r, sum(i + 5 - greatest(i, coalesce(e, i))) AS n FROM p GROUP BY r),
m AS (SELECT doc_id, source, CAST(len(ws) AS BIGINT) AS n_words,
  CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(s.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN s USING (r)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
o AS (SELECT source, count(*) AS n, sum(CAST(base_failed AS INT)) AS failed FROM f WHERE source IS NOT NULL GROUP BY source),
a AS (SELECT sum(failed) / sum(n) AS q, sum(n) AS n, count(*) AS k, sum(failed * failed / n) AS sq FROM o),
b AS (SELECT q, CASE WHEN q <= 0 OR q >= 1 OR v <= 0 THEN 1e6 ELSE least(1e6, greatest(1.0, q * (1 - q) / v - 1)) END AS st
  FROM (SELECT q, sq / n - q * q - q * (1 - q) * k / n AS v FROM a)),
x AS (SELECT source FROM o, b WHERE (failed + q * st) / (n + st) > 0.5)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(source NOT IN (SELECT source FROM x), TRUE) AS kept FROM f
"""


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(documents(spark, sf_dir)).select("doc_id", "class_id", "n_links")


OP5_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i+4], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 5 * c >= 4 * (x.n + y.n - c)),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
k AS (SELECT a, min(b) AS low FROM r GROUP BY a),
c AS (SELECT a, count(*) AS links FROM e GROUP BY a)
SELECT doc_id, least(doc_id, coalesce(low, doc_id)) AS class_id, CAST(coalesce(links, 0) AS BIGINT) AS n_links
FROM documents LEFT JOIN k ON k.a = doc_id LEFT JOIN c ON c.a = doc_id
"""


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP6_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""

def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    fold = crc_mod("doc_id", 4)
    model = train(docs.filter(fold != 2))
    return identify(docs.select("doc_id", "text", (fold == 2).alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = documents(spark, sf_dir), crc_mod("doc_id", 5)
    model = train_toxicity(docs, labels(spark, sf_dir).filter(fold != 0))
    scored = score_toxicity(docs.select("doc_id", "text", (fold == 0).alias("held_out")), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = documents(spark, sf_dir), crc_mod("doc_id", 5)
    model = train_quality(docs, labels(spark, sf_dir).filter(fold != 0))
    scored = score_quality(docs.select("doc_id", "text", (fold == 0).alias("held_out")), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = count_tokens(documents(spark, sf_dir).select("doc_id", "text"), frequent=0)
    return best_fit_pack(counted.select("doc_id", "n_tokens"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_pii": op2_pii,
    "op3_bpe_codec": op3_bpe_codec,
    "op4_quality_rules": op4_quality_rules,
    "op5_ngram_join": op5_ngram_join,
    "op6_top_k": op6_top_k,
    "op7_language_id": op7_language_id,
    "op8_toxicity": op8_toxicity,
    "op9_quality": op9_quality,
    "op10_best_fit_packing": op10_best_fit_packing,
}
ORACLE_SQL: dict[str, str] = {"op4_quality_rules": OP4_SQL, "op5_ngram_join": OP5_SQL, "op6_top_k": OP6_SQL}
