"""A corpus pipeline: quality, language, near duplicates, personal data, packing.

Every stage takes (spark, docs, sf_dir), works on all documents that its predecessor kept and returns a frame, which
is written as Parquet and read again for the next one. All stages but the last return the columns of documents.
SQL can't express trained classifiers, so there is no SQL twin: tests/llm/test_pipeline.py compares every stage with a plain version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from huegraph.llm import langid, packing, pii, quality_mil
from huegraph.llm.common import crc_mod, documents, labels, materialize
from huegraph.llm.ngram_join import ngram_join
from huegraph.llm.token_counts import count_tokens

#: Documents below these scores go.
LEAST_QUALITY = 0.3
LEAST_LANGUAGE = 0.3
#: Name of a column beside those of documents.
KEY = "row_key"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores ``LEAST_QUALITY`` or more."""
    model = quality_mil.train(docs, labels(spark, sf_dir).filter(crc_mod("doc_id", 5) != 0))
    scored = quality_mil.score_quality(docs, model)
    return scored.filter(F.col("score") >= LEAST_QUALITY).select(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; those without letters or with no language of ``LEAST_LANGUAGE`` or more go."""
    model = langid.train(docs.filter(crc_mod("doc_id", 4) != 2))
    found = langid.identify(docs, model)
    return found.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every class of near duplicates the document with the smallest id, once. Rows are told apart by id and text: those alike in both are
    one document, those with one id and different texts are several, and those without an id come behind all others of their class."""
    keyed = docs.withColumn(KEY, F.xxhash64("doc_id", "text"))
    found = ngram_join(keyed.select(F.col(KEY).alias("doc_id"), "text")).select(F.col("doc_id").alias(KEY), "class_id")
    ids = keyed.select(KEY, "doc_id")
    named = found.dropDuplicates([KEY]).join(ids.hint("merge"), KEY)
    first = named.groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", KEY)).alias("m")).select(f"m.{KEY}")
    # one plan for every size: keys against keys, never a broadcast of what grows with the corpus; rows alike stand together afterwards
    kept = keyed.join(first.hint("merge"), KEY, "left_semi").dropDuplicates([KEY, "doc_id"])
    return kept.select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind, ``n_chars`` counted again."""
    clean = pii.redact(docs, pii.train(docs))
    return clean.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in bins of the permitted sequence lengths."""
    counted = count_tokens(docs.select("doc_id", "text"), frequent=0)
    return packing.best_fit_pack(counted.select("doc_id", "n_tokens"))


STAGES = [
    ("quality classifier", quality),
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("PII", personal_data),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{i}")
    return docs


ORACLE_SQL = None
