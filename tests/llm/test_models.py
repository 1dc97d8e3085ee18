import numpy as np
import pytest

from huegraph.llm import langid, quality_mil, toxicity
from huegraph.llm.common import crc_mod
from huegraph.llm.queries import op7_language_id, op8_toxicity, op9_quality

from .texts import ODD

SF = "/root/testdata/sf0.01"
MORE = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "x", "x") for i, t in enumerate(ODD)], "doc_id long, text string, score string, lang_pred string")


def labelled(spark, column, got, sf=SF):
    truth = {r.doc_id: r[column] for r in spark.read.parquet(f"{sf}/{'documents' if column == 'lang' else 'labels'}.parquet").collect()}
    return [(r, truth[r.doc_id]) for r in got if r.held_out and truth.get(r.doc_id) is not None]


def test_language_query(spark):
    got = op7_language_id(spark, SF).collect()
    pairs = labelled(spark, "lang", got)
    assert len(pairs) > 100 and np.mean([r.lang_pred == y for r, y in pairs]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_language_of_odd_texts(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    net = langid.train(docs, sample_rows=200)
    got = {r.doc_id: r for r in langid.identify(odd, net).collect()}
    assert len(got) == len(ODD)
    for i, t in enumerate(ODD):
        letter = any(c.isalpha() for c in t or "")
        assert (got[i].lang_pred == "und") == (not letter), t
    assert {r.lang_pred for r in langid.identify(odd, None).collect()} == {"und"}
    assert langid.train(docs.limit(0)) is None and langid.identify(odd.limit(0), net).collect() == []


def test_tables_equal_the_network(spark):
    net, rng = langid.ByteConvNet(["a", "b"]), np.random.default_rng(0)
    x = rng.integers(0, 256, (5, langid.WINDOW + langid.TAIL)).astype(np.uint8)
    conv = net._columns(x) @ net.p["conv"] + net.p["conv_b"]
    want = langid._softmax(np.maximum(conv.max(1), 0) @ net.p["out"] + net.p["out_b"])
    assert np.allclose(net.probabilities(x, net.tables()), want, atol=1e-4)


def area(pairs, column):
    pos = [r.score for r, y in pairs if y == 1]
    neg = [r.score for r, y in pairs if y == 0]
    return np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])


def test_quality_query(spark):
    pairs = labelled(spark, "quality", op9_quality(spark, SF).collect())
    assert area(pairs, "quality") > 0.95
    assert np.mean([r.predicted == y for r, y in pairs]) > 0.9


def test_toxicity_query(spark):
    pairs = labelled(spark, "toxic", op8_toxicity(spark, MORE).collect(), MORE)
    assert area(pairs, "toxic") > 0.9  # a tenth of the toxic labels stand on texts without any such word


def test_attention_gradients():
    rng = np.random.default_rng(0)
    net = quality_mil.AttentionMil(4)
    f, starts, owner, y = rng.normal(size=(6, 4)), np.array([0, 2, 3]), np.array([0, 0, 1, 2, 2, 2]), np.array([1.0, 0.0, 1.0])
    g = net.gradients(f, starts, owner, y)[1]
    for k, v in net.p.items():
        at = tuple(rng.integers(0, s) for s in v.shape)
        v[at] += 1e-5
        up = net.gradients(f, starts, owner, y)[0]
        v[at] -= 2e-5
        down = net.gradients(f, starts, owner, y)[0]
        v[at] += 1e-5
        assert abs((up - down) / 2e-5 - g[k][at]) < 1e-6, k


def test_quality_of_odd_texts_and_without_labels(spark, odd):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality_mil.train(docs, labels, sample_rows=100)
    got = quality_mil.score_quality(odd, model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert quality_mil.train(docs, labels.limit(0)) is None
    assert {r.score for r in quality_mil.score_quality(odd, None).collect()} == {0.5}
    assert quality_mil.score_quality(odd.limit(0), model).collect() == []


def test_restoration(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    chars = toxicity.CharModel(toxicity.count_trigrams(docs))
    for noisy, plain in {"m0r0n": "moron", "tr@sh": "trash", "looooser": "loser", "c l o w n": "clown", "$tupid": "stupid"}.items():
        assert toxicity.restore(noisy, chars) == plain
    assert toxicity.token_words("Hello,", chars) == ["hello"] and toxicity.text_tokens("a b t r a s h") [-1] == "a b t r a s h"
    model = toxicity.ToxicModel(chars, {"trash.": 5.0, "moro": 4.0}, -4.0)
    df = spark.createDataFrame([(0, "such tr@sh"), (1, "m 0 r 0 n"), (2, "fine words"), (3, None), (4, "")], "doc_id long, text string")
    got = {r.doc_id: (r.score, r.toxic_hits) for r in toxicity.score_toxicity(df, model).collect()}
    assert got[0][1] == ["trash."] and got[1][1] == ["moro"] and got[0][0] > 0.9
    assert got[2] == got[3] == got[4] and got[2][0] < 0.1
    assert toxicity.score_toxicity(df.limit(0), model).collect() == []


def test_long_runs_are_restored(spark):
    df = spark.createDataFrame([(i, "what an idiot and a moron you are") for i in range(50)], "doc_id long, text string")
    chars = toxicity.CharModel(toxicity.count_trigrams(df))
    sentence = "what an idiot and a moron you are " * 4
    spaced = " ".join(sentence.replace(" ", ""))
    glued = "_".join(["what", "an", "1d1ot", "you", "are"] * 6)
    assert len(spaced) > 80 and len(glued) > 80
    assert "idiot" in toxicity.token_words(spaced, chars) and "moron" in toxicity.token_words(spaced, chars)
    assert "idiot" in toxicity.token_words(glued, chars)
    model = toxicity.ToxicModel(chars, {"idiot.": 5.0}, -4.0)
    got = toxicity.score_toxicity(spark.createDataFrame([(0, spaced), (1, glued)], "doc_id long, text string"), model).collect()
    assert [r.toxic_hits for r in got] == [["idiot."], ["idiot."]]
    # linear in time and memory, and the end counts as the start does
    assert toxicity.restore("x1" * 200_000 + "_1d1ot", chars).endswith("_idiot")


def test_every_token_with_a_second_reading_is_restored(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    chars = toxicity.CharModel(toxicity.count_trigrams(docs))
    for token, word in {"stuupid": "stupid", "mmoorroonn": "moron", "iiddiioott": "idiot", "!diot": "idiot", '"!diot!!"': "idiot", "!!diot": "idiot", "|oser": "loser", "(lown,": "clown", "evi|": "evil", "! d i o t": "idiot"}.items():
        assert word in toxicity.token_words(token, chars), token
    # punctuation stays punctuation beside it
    for token in ("idiot!", "(idiot", "|idiot|", "!idiot!!!"):
        assert "idiot" in toxicity.token_words(token, chars), token
    for token in ("", "!", "(!|", "1337", "..", "a", "l|!(", "word"):
        assert len(toxicity.lattice(token)) == len(token)
        paths = 1
        for readings, _ in toxicity.lattice(token):
            paths *= len(readings)
        assert toxicity.noisy(token) == (paths > 1), token
    assert toxicity.token_words("word", chars) == ["word"] and toxicity.token_words("...", chars) == []


def test_trigrams_equal_a_count(spark):
    df = spark.createDataFrame([(1, "abab"), (2, None), (3, "AB.")], "doc_id long, text string").coalesce(1)
    m = toxicity.CharModel()
    c = toxicity.count_trigrams(df).reshape(m.k, m.k, m.k)
    a, b = m.of("a"), m.of("b")
    assert c[a, b, a] == 1 and c[0, a, b] == 2 and c[a, b, 0] == 2


def all_readings(token, model):
    """Every path through a token's lattice with its log probability."""
    log, out = model.rows(), [((0, 0), 0.0, "")]
    for readings, spaced in toxicity.lattice(token):
        new = []
        for (a, b), p, s in out:
            starts = [((a, b), p + toxicity.COST_JOIN, s), ((b, 0), p + toxicity.COST_BREAK + log[a][b][0], s + " ")] if spaced else [((a, b), p, s)]
            for (x, y), q, t in starts:
                for ch, cost in readings:
                    c = model.of(ch) if ch else 0
                    new.append(((y, c), q + cost + log[x][y][c], t + ch) if ch else ((x, y), q + cost, t))
        out = new
    return [(p + log[a][b][0], s) for (a, b), p, s in out]


def test_restoration_equals_all_paths(spark):
    import random

    rng = random.Random(5)
    chars = toxicity.CharModel(toxicity.count_trigrams(spark.read.parquet(f"{SF}/documents.parquet")))
    for _ in range(300):
        token = "".join(rng.choice("aeo10!|($  stl") for _ in range(rng.randint(1, 6))).strip() or "x"
        token = " ".join(token.split())
        every = all_readings(token, chars)
        most = max(p for p, _ in every)
        assert any(s == toxicity.restore(token, chars) and abs(p - most) < 1e-9 for p, s in every), token


def test_trigrams_do_not_depend_on_the_partitions(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(40).cache()
    one, many = (toxicity.count_trigrams(df.repartition(n)) for n in (1, 7))
    assert (one == many).all() and one.sum() == sum(len(r.text) + 2 for r in df.collect() if r.text)


def test_signs_alone_and_long_runs_are_read(spark):
    chars = toxicity.CharModel(toxicity.count_trigrams(spark.createDataFrame([("lass loser clown idiot ass",)] * 20, "text string")))
    for token, word in {"@$$": "ass", "455": "ass", "l" + "o" * 91 + "ser": "loser", "(lown": "clown", "!diot": "idiot", "|oser": "loser"}.items():
        assert word in toxicity.token_words(token, chars), token


def test_clashing_labels_and_names(spark):
    from huegraph.llm.common import one_label

    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (2, 1), (3, None), (None, 1), (4, 7)], "doc_id long, toxic int")
    assert sorted(tuple(r) for r in one_label(labels, "doc_id", "toxic").collect()) == [(1, 0), (2, 1)]
    df = spark.createDataFrame([(1, "some words", "x", "x")], "doc_id long, text string, given_text string, Given_Text_ string")
    model = toxicity.ToxicModel(toxicity.CharModel(), {"words.": 3.0}, -4.0)
    net = langid.ByteConvNet(["a", "b"])
    for got, new in ((toxicity.score_toxicity(df, model), ["score", "toxic_hits"]), (langid.identify(df, net), ["lang_pred", "score"]), (quality_mil.score_quality(df, None), ["score"])):
        assert got.columns == [*df.columns, *new] and got.first().given_text == "x"


def plain_language(net, text):
    """Every filter at every byte of every window, with loops."""
    data = text.encode()
    n, total = max(1, -(-len(data) // langid.WINDOW)), np.zeros(len(net.langs))
    flat = np.zeros(n * langid.WINDOW + langid.TAIL, np.uint8)
    flat[: len(data)] = np.frombuffer(data, np.uint8)
    for i in range(n):
        best = np.full(len(langid.WIDTHS), -np.inf)
        for j in range(i * langid.WINDOW, (i + 1) * langid.WINDOW):
            best = np.maximum(best, net.p["embed"][flat[j : j + 4]].ravel() @ net.p["conv"] + net.p["conv_b"])
        share = min(langid.WINDOW, len(data) - i * langid.WINDOW) / len(data)
        total += share * langid._softmax(np.maximum(best, 0)[None] @ net.p["out"] + net.p["out_b"])[0]
    return total


def test_language_of_whole_texts_equals_a_plain_version(spark):
    net = langid.ByteConvNet(["a", "b", "c"], seed=3)
    texts = ["x", "some words", "é" * 200, "many more words and äöü " * 60, " ".join(str(i) + "w" for i in range(700))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in langid.identify(df, net).collect():
        want = plain_language(net, texts[r.doc_id])
        assert r.lang_pred == net.langs[int(want.argmax())] and abs(r.score - want.max()) < 1e-4


def test_quality_equals_a_plain_version(spark):
    import math

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    mil = quality_mil.train(docs, labels, sample_rows=60)
    texts = ["", "one passage", "words of a text, one after the other. " * 40, "# $ % | " * 300 + "and words " * 200]
    scored = {r.doc_id: r.score for r in quality_mil.score_quality(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), mil).collect()}
    dot = lambda m, v: [sum(m[i][j] * v[i] for i in range(len(v))) for j in range(len(m[0]))]
    for i, text in enumerate(texts):
        codes, weights = [], []
        for row in quality_mil.passage_features([text.encode()])[0]:
            f = [max(-8.0, min(8.0, (x - m) / s)) for x, m, s in zip(row.tolist(), mil.mean.tolist(), mil.scale.tolist(), strict=True)]
            z = [math.tanh(x + b) for x, b in zip(dot(mil.p["enc"], f), mil.p["enc_b"], strict=True)]
            gate = [math.tanh(a) / (1 + math.exp(-b)) for a, b in zip(dot(mil.p["v"], z), dot(mil.p["u"], z), strict=True)]
            codes.append(z)
            weights.append(math.exp(sum(g * w for g, w in zip(gate, mil.p["w"], strict=True))))
        mean = [sum(w * z[k] for w, z in zip(weights, codes, strict=True)) / sum(weights) for k in range(len(codes[0]))]
        want = 1 / (1 + math.exp(-sum(m * o for m, o in zip(mean, mil.p["out"], strict=True)) - mil.p["out_b"][0]))
        assert abs(scored[i] - want) < 1e-6


def test_very_long_texts(spark):
    text = "plain words of a text that goes on and on. " * 30_000
    df = spark.createDataFrame([(0, text), (1, text + " tr@sh")], "doc_id long, text string")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.ToxicModel(toxicity.CharModel(toxicity.count_trigrams(docs)), {"trash.": 5.0}, -4.0)
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(df, model).collect()}
    assert got[0] < 0.1 < 0.9 < got[1]
    net = langid.train(docs, sample_rows=100)
    assert {r.lang_pred for r in langid.identify(df, net).collect()} <= set(net.langs)
    mil = quality_mil.train(docs, spark.read.parquet(f"{SF}/labels.parquet"), sample_rows=100)
    assert all(0 <= r.score <= 1 for r in quality_mil.score_quality(df, mil).collect())


def test_toxic_labels_are_enough_or_none(spark, odd):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    none = toxicity.train(docs, labels.limit(0))
    assert none.weights == {} and all(r.score < 0.5 for r in toxicity.score_toxicity(odd, none).collect())


def test_folds_follow_crc32(spark):
    import zlib

    df = spark.createDataFrame([(i,) for i in range(50)], "doc_id long")
    assert [r[0] for r in df.select(crc_mod("doc_id", 5)).collect()] == [zlib.crc32(str(i).encode()) % 5 for i in range(50)]
