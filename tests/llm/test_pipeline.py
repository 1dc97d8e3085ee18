"""The pipeline against plain versions of its stages on a small table."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from huegraph.llm import langid, pii, quality_mil
from huegraph.llm.common import crc_mod
from huegraph.llm.pii import base_spans, replaced

from .test_near import brute as near_brute
from .test_packing import check

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def docs(spark):
    real = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(9000, None, None, None, None), (9001, "", "en", "src1", 0), (9002, "12 34", None, "src1", 5), (None, "words without an id " * 5, "en", None, 100)]
    return real.unionByName(spark.createDataFrame(odd, real.schema)).unionByName(real.limit(3)).cache()


def rows(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def test_stages_are_the_five_in_order():
    assert [n for n, _ in pipeline.STAGES] == ["quality classifier", "language ID", "n-gram Jaccard join", "PII", "best-fit packing"]
    assert pipeline.ORACLE_SQL is None


def test_quality_stage(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet").filter(crc_mod("doc_id", 5) != 0)
    model = quality_mil.train(docs, labels)
    score = {}
    for r in docs.collect():
        f, owner = quality_mil.passage_features([(r.text or "").encode()])
        score[r.doc_id, r.text] = float(model.forward(f, [0], owner)["score"][0])
    want = sorted((tuple(r) for r in docs.collect() if score[r.doc_id, r.text] >= 0.3), key=str)
    got = pipeline.quality(spark, docs, SF)
    assert got.columns == COLUMNS and rows(got) == want
    # what is labelled good stays
    bad = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 0").collect()}
    gone = {r.doc_id for r in docs.collect()} - {r.doc_id for r in got.collect()}
    assert gone & bad and len(gone - bad) < 25


def test_language_stage(spark, docs):
    net = langid.train(docs.filter(crc_mod("doc_id", 4) != 2))
    kept = pipeline.language(spark, docs, SF)
    pred = langid.identify(docs, net).filter("lang_pred = 'und' OR score < 0.3").select(*COLUMNS)
    assert rows(kept) == rows(docs.exceptAll(pred))
    assert {9000, 9001, 9002}.isdisjoint(r.doc_id for r in kept.collect())


def test_near_duplicate_stage(spark, docs):
    table = sorted({(r.doc_id, r.text) for r in docs.collect()}, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    classes = {i: c for i, c, _ in near_brute([(i, t) for i, (_, t) in enumerate(table)])}
    want = sorted({table[c] for c in classes.values()}, key=str)
    got = pipeline.near_duplicates(spark, docs, SF)
    assert got.columns == COLUMNS and sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == want


def test_near_duplicate_stage_tells_rows_apart(spark):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(1, long), (2, long + " more"), (2, "another text under the same id"), (None, long), (None, "a text without an id"), (None, "a text without an id"), (5, None), (5, None), (6, "")]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], ", ".join(f"{c} {'long' if c in ('doc_id', 'n_chars') else 'string'}" for c in COLUMNS))
    got = sorted(((r.doc_id, r.text) for r in pipeline.near_duplicates(spark, df, SF).collect()), key=str)
    assert got == sorted([(1, long), (2, "another text under the same id"), (None, "a text without an id"), (5, None), (6, "")], key=str)


def test_personal_data_stage(spark, docs):
    got = pipeline.personal_data(spark, docs, SF)
    model = pii.train(docs)
    want = []
    for r in docs.collect():
        text = r.text
        if text:
            base = base_spans(text)
            text = replaced(text, [*base, *pii.added_spans([text], [base], model, 0.8)[0]])
        want.append((r.doc_id, text, r.lang, r.source, None if text is None else len(text)))
    assert rows(got) == sorted(want, key=str)


def test_packing_stage(spark, docs):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    check([(r.doc_id, len(sp.encode(r.text or ""))) for r in docs.collect()], pipeline.pack(spark, docs, SF).collect(), (512, 1024, 2048, 4096))


def test_run_chains_the_stages(spark):
    got = pipeline.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    assert {r.doc_id for r in got.collect()} == {r.doc_id for r in docs.collect()}
    assert got.filter(F.col("bin_offset") + F.col("n_tokens") > F.col("capacity")).count() == 0


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.collect() == []
