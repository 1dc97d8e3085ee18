import hashlib

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from huegraph.llm.bpe_codec import Codec, encode_decode
from huegraph.llm.token_counts import count_tokens

from .texts import ODD

SCHEMA = "doc_id long, text string, n_tokens string, ids string"
SF = "/root/testdata/sf0.001"


def frame(spark, texts=ODD):
    return spark.createDataFrame([(i, t, "clash", "clash") for i, t in enumerate(texts)], SCHEMA)


def test_counts_equal_the_library(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    real = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    texts = ODD + real
    # few tier-one entries and a small cache: both tiers and the eviction are used
    for sizes in ({"frequent": 5, "cache": 20}, {}):
        got = {r.doc_id: r.n_tokens for r in count_tokens(frame(spark, texts), **sizes).collect()}
        assert got == {i: len(sp.encode(t or "")) for i, t in enumerate(texts)}


def test_summaries_are_bounded_and_merged(spark):
    from huegraph.llm.token_counts import frequent_pre_tokens, summarize

    many = [" ".join(f"x{i}y" for i in range(k, k + 500)) + " the the the" + " " + "z" * 50 for k in range(0, 5000, 500)]
    top = summarize(many, 10, most=600)
    assert top[0] == ("the", 30) and len(top) <= 10 and all(len(p) <= 32 for p, _ in top)
    df = spark.createDataFrame([(t,) for t in many], "text string").repartition(6)
    got = frequent_pre_tokens(df, 50, 20)
    assert got[0] == "the" and len(got) == 50
    assert frequent_pre_tokens(df.limit(0), 50, 20) == []


def test_codec_equals_the_library(spark):
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    real = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    texts = ODD + real
    for cache in (10, 200_000):
        for r in encode_decode(frame(spark, texts), cache=cache).collect():
            want = lib.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
            assert r.ids == want, texts[r.doc_id]
            assert r.decoded == lib.decode(want, skip_special_tokens=False)


def test_decoding_reads_the_ids_alone():
    import random

    lib, codec, rng = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), Codec(), random.Random(2)
    for _ in range(300):
        ids = [rng.randrange(49_408) for _ in range(rng.randint(0, 12))]
        assert codec.decode(ids) == lib.decode(ids, skip_special_tokens=False)
    assert codec.decode([320, 10**6, 321]) == lib.decode([320, 10**6, 321], skip_special_tokens=False)
    ids = np.frombuffer(codec.encode("a changed id changes the text"), np.int32).tolist()
    assert all(codec.decode([*ids[:k], ids[k] + 1, *ids[k + 1 :]]) != codec.decode(ids) for k in range(len(ids)))


def test_other_text_column_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "other", "the body", "x")], "doc_id long, text string, body string, given_text string")
    row = encode_decode(df, text="body").first()
    assert (row.text, row.given_text, row.decoded) == ("other", "x", "the</w> body</w>")


def test_very_long_texts(spark):
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = ["some words of a text that goes on. " * 40_000, "x" * 200_000]
    for r in encode_decode(frame(spark, texts)).collect():
        want = lib.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.ids == want and r.decoded == lib.decode(want, skip_special_tokens=False)
    assert [r.n_tokens for r in count_tokens(frame(spark, texts)).orderBy("doc_id").collect()] == [len(sp.encode(t)) for t in texts]


def test_fragments_join_to_the_word_and_some_word_is_cut():
    codec = Codec()
    words = ["hello", "qxzqj", "vqjxk", "straße", "zqzqzx"]
    mapped = [w for x in words for w, _ in codec.split(x)]
    assert all("".join(codec.fragments(w)) == w for w in mapped)
    assert any(len(codec.fragments(w)) > 1 for w in mapped)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert count_tokens(empty).collect() == [] and encode_decode(empty).collect() == []


def test_queries_have_the_contract(spark):
    from huegraph.llm.queries import op1_token_counts, op3_bpe_codec

    one = op1_token_counts(spark, SF)
    assert dict(one.dtypes) == {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"}
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in op3_bpe_codec(spark, SF).collect():
        ids = lib.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
