import random
import re

import numpy as np
import pytest

from huegraph.llm import pii
from huegraph.llm.pii import BiLstmCrf, base_spans, find_pii, reconcile, redact, training_windows

from .texts import ODD

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": lambda: True, "ip": lambda m=m: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda d=d: 14 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0, "phone": lambda d=d: 10 <= len(d) <= 15}[kind]()
            if good:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], list(PATTERNS).index(s[2])))


def test_base_spans_equal_the_patterns():
    rng = random.Random(1)
    parts = ["a", "b.c", "@", ".", "-", "+", " ", "1", "23", "255", "256", "4495114827612972", "+1 (274) 555-9629", "17.57.238.115", "x.1@mail.ex.com", "(", ")", "\n", "é", "_%"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        assert base_spans(text) == brute(text), text


def test_long_runs_are_linear():
    for text in ("a" * 300_000, "1" * 300_000, "@" * 100_000, "+1" * 100_000, "+1" + "(" * 300_000, "1." * 150_000, "1 " * 150_000):
        base_spans(text)


def test_gradients_are_right():
    rng = np.random.default_rng(0)
    net = BiLstmCrf(embed=3, hidden=4, dtype=np.float64)
    x, y = rng.integers(1, 30, (3, 7)), np.zeros((3, 7), int)
    y[0, 2:4], y[1, :2], y[2, 4] = (1, 2), (5, 6), 7
    g = net.gradients(x, y)[1]
    for k, v in net.p.items():
        at = (x[0, 2], 1) if k == "embed" else tuple(rng.integers(0, s) for s in v.shape)
        v[at] += 1e-5
        up = net.gradients(x, y)[0]
        v[at] -= 2e-5
        down = net.gradients(x, y)[0]
        v[at] += 1e-5
        assert abs((up - down) / 2e-5 - g[k][at]) < 1e-6, k


def test_reconciliation_takes_the_greatest_total():
    got = reconcile([(0, 10, "ip", 0.9), (8, 12, "card", 0.95), (0, 10, "ip", 0.8), (20, 30, "phone", 0.9), (29, 60, "card", 0.9)])
    assert [g[:3] for g in got] == [(0, 10, "ip"), (29, 60, "card")]


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return pii.train(docs)


def test_held_out_windows(model):
    x, y = training_windows(["plain words of a sentence that carries things " * 5], 600, seed=99)
    assert (model.decode(x)[0] == y).all(1).mean() > 0.85


def test_windows_cover_whole_texts(model):
    for n in (1, 48, 95, 96, 97, 448, 511, 512, 513, 575, 576, 577, 3000):
        text = ("aé7\U0001fae8٣ " * n)[:n]
        starts, (full, last) = list(pii.window_starts(n)), pii.text_windows(text)
        assert len(starts) == len(full) + 1 and last.shape[1] in pii.WIDTHS
        classes, seen = pii.char_classes(text), np.full(n, -1)
        for s, x in zip(starts, [*full, last[0]], strict=True):
            own = x[: n - s]
            assert (own == classes[s : s + len(own)]).all() and not x[n - s :].any()
            seen[s : s + len(own)] = own
        assert (seen == classes).all()
    for text, shape in (("write to {} today", "jane at example dot com"), ("write to {} today", "jane {at} example.com"), ("write to {} today", "jane <at> example.com")):
        whole = text.format(shape)
        assert not pii._TRIGGER.search(whole)
        assert any(k == "email" for _, _, k in pii.added_spans([whole], [[]], model, 0.8)[0]), whole
    wide = "call " + "(274) 555-9629".translate({48 + d: 0xFF10 + d for d in range(10)}) + " now"
    assert pii.added_spans([wide], [[]], model, 0.8)[0] == [(5, 19, "phone")]
    assert pii.valid("ip", "１０.0.0.1") and not pii.valid("ip", "a.b.c.d") and not pii.valid("ip", "²⁵⁶.1.1.1")


def test_quick_inference_equals_the_network(model):
    x, _ = training_windows(["plain words of a sentence that carries things " * 5], 300, seed=7)
    em = model.quick_emissions(x)
    flat = em.transpose(0, 3, 1, 2).reshape(-1, pii.SHORT, pii.TAGS)[: len(x)]
    assert np.allclose(flat, model.emissions(x)[0], atol=1e-3)
    tags, prob = model.decode(x)
    hold = model.may_hold(em).ravel()[: len(x)]
    assert not tags[~hold].any()
    found = dict(model.spans(x))
    assert set(found) == set(np.flatnonzero(tags.any(1)))
    for i, spans in found.items():
        want = pii.tag_spans(tags[i], prob[i])
        assert [s[:3] for s in spans] == [s[:3] for s in want] and np.allclose([s[3] for s in spans], [s[3] for s in want], atol=1e-3)


def test_few_windows_without_spans_are_decoded(spark, model):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect() if r.text]
    x = np.concatenate([pii.text_windows(t)[0] for t in texts])[: pii.BATCH]
    em = model.quick_emissions(x)
    hold = model.may_hold(em).ravel()[: len(x)]
    spans = model.best_tags(em.transpose(0, 3, 1, 2).reshape(-1, pii.WINDOW, pii.TAGS)[: len(x)]).any(1)
    assert not (spans & ~hold).any() and (hold & ~spans).mean() < 0.1


def test_decoding_equals_all_tag_sequences():
    rng = np.random.default_rng(3)
    net = BiLstmCrf(dtype=np.float64)
    net.p["next"], net.p["first"] = rng.normal(size=(pii.TAGS, pii.TAGS)), rng.normal(size=pii.TAGS)
    em = rng.normal(0, 1.5, (6, 4, pii.TAGS))
    em[3:, :, 0] += 4  # some windows without spans
    every = np.stack(np.meshgrid(*[np.arange(pii.TAGS)] * 4, indexing="ij"), -1).reshape(-1, 4)
    trans, first = net.p["next"] + net.banned, net.p["first"] + net.banned_first
    best, (z, prob, pair) = net.best_tags(em), net.marginals(em)
    all_pairs = np.zeros_like(pair)
    for w in range(len(em)):
        score = first[every[:, 0]] + em[w, np.arange(4), every].sum(1) + trans[every[:, :-1], every[:, 1:]].sum(1)
        assert (every[score.argmax()] == best[w]).all()
        total = np.log(np.exp(score).sum())
        p = np.exp(score - total)
        assert abs(total - z[w]) < 1e-9
        for t in range(4):
            assert np.allclose(np.bincount(every[:, t], p, pii.TAGS), prob[w, t])
            if t:
                np.add.at(all_pairs, (every[:, t - 1], every[:, t]), p)
    assert np.allclose(all_pairs, pair)
    hold = net.may_hold(np.pad(em, ((0, pii.LANES - len(em)), (0, 0), (0, 0))).transpose(1, 2, 0)[None])[0, : len(em)]
    assert not best[~hold].any()


def test_reconciliation_equals_all_subsets():
    rng = random.Random(8)
    for _ in range(200):
        found = [(a := rng.randrange(20), a + rng.randint(1, 9), rng.choice(pii.KINDS), rng.choice([0.8, 0.85, 0.9, 1.0])) for _ in range(rng.randint(0, 7))]
        most = 0.0
        for mask in range(1 << len(found)):
            own = sorted(f for i, f in enumerate(found) if mask >> i & 1)
            if all(a[1] <= b[0] for a, b in zip(own, own[1:], strict=False)):
                most = max(most, sum(s * (b - a) for a, b, _, s in own))
        got = reconcile(found)
        assert all(a[1] <= b[0] for a, b in zip(got, got[1:], strict=False)) and abs(sum(s * (b - a) for a, b, _, s in got) - most) < 1e-9


def test_spans_cut_by_borders_are_joined():
    whole = (60, 120, "email", 0.9, False, False)
    assert pii.joined([(60, 96, "email", 0.9, False, True), whole]) [0] == whole[:4]
    long = [(60, 96, "email", 0.9, False, True), (60, 144, "email", 0.9, False, True), (96, 170, "email", 0.9, True, False), (144, 170, "email", 0.9, True, False)]
    assert [x[:3] for x in reconcile(pii.joined(long))] == [(60, 170, "email")]
    # 60 characters that no window holds whole
    assert [x[:3] for x in pii.joined([(90, 144, "email", 0.9, False, True), (96, 150, "email", 0.9, True, False)])] == [(90, 150, "email")]
    assert pii.joined([(90, 144, "email", 0.9, False, True), (96, 150, "card", 0.9, True, False), (300, 310, "ip", 0.9, True, False)]) == []


def test_very_long_text(model):
    plain = "plain words of a sentence that carries things. "
    text = plain * 3000 + "jane [at] mail [dot] example [dot] com " + plain * 3000 + "call (274) 555-9629 now " + plain * 50
    got = pii.added_spans([text], [[]], model, 0.8)[0]
    assert {k for _, _, k in got} == {"email", "phone"} and any("jane" in text[a:b] for a, b, _ in got) and any("555" in text[a:b] for a, b, _ in got)


def test_operator(spark, model):
    hard = ["write to jane [at] mail [dot] example [dot] com today", "call (274) 555-9629 now", None, "mail a.b@c.example.com or 10.0.0.1"]
    texts = ODD + hard
    df = spark.createDataFrame([(i, t, "x", "x") for i, t in enumerate(texts)], "doc_id long, text string, base string, added string")
    for r in find_pii(df, model).collect():
        t = texts[r.doc_id] or ""
        assert [(s.start, s.end, s.kind) for s in r.base] == brute(t)
        every = sorted((s.start, s.end) for s in r.added)
        assert all(a[1] <= b[0] for a, b in zip(every, every[1:], strict=False)) and all(b.end <= s.start or s.end <= b.start for s in r.added for b in r.base)
    clean = {r.doc_id: r.text for r in redact(df.select("doc_id", "text"), model).collect()}
    assert clean[len(texts) - 1] == "mail <email> or <ip>" and clean[0] is None
    names = df.withColumnRenamed("base", "given_text").withColumnRenamed("added", "Given_Text_")
    assert find_pii(names, model).columns == ["doc_id", "text", "given_text", "Given_Text_", "base", "added"]
    empty = df.limit(0)
    assert find_pii(empty, model).collect() == [] and redact(empty, model).collect() == []
