"""Document quality by attention-based multiple-instance learning, trained in numpy.

A document is a bag of passages of fixed length. Every passage of the whole text is described by its
characters and words and encoded by a small network; gated attention weighs the codes, and a logistic
output scores their weighted mean. Only documents are labelled: the weights of the passages are learned from
the labels of the documents.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Adam, bounded_sample, byte_windows, fields, fresh_name, one_label, sigmoid, text_batches, with_columns

PASSAGE = 512
CODE, GATE = 24, 16


def _classes() -> np.ndarray:
    """Class of each byte: 0 none, lower, upper, digit, space, line feed, stop, comma, call, symbol, bar, bracket, lead
    and continuation bytes of UTF-8, other."""
    table = np.full(256, 14, np.uint8)
    table[0] = 0
    table[ord("a") : ord("z") + 1], table[ord("A") : ord("Z") + 1], table[ord("0") : ord("9") + 1] = 1, 2, 3
    for k, chars in enumerate((" \t\r", "\n", ".", ",", "!?", "#*$%&", "|", "<>[]{}_=/\\~^"), 4):
        table[list(chars.encode())] = k
    table[0xC0:], table[0x80:0xC0] = 12, 13
    return table


_CLASS = _classes()
_MIX = np.random.default_rng(3).integers(-(2**62), 2**62, 256)


def passage_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A row of features for every passage of every text, and the text each belongs to."""
    x, owner, filled = byte_windows(texts, PASSAGE)
    n = len(x)
    kind = _CLASS[x]
    shares = np.stack([(kind == k).sum(1) for k in range(1, 15)], 1) / np.maximum(filled, 1)[:, None]
    inside = (kind != 4) & (kind != 5) & (kind != 0)
    start = inside.copy()
    start[:, 1:] &= ~inside[:, :-1]
    at = np.flatnonzero(start)
    row = at // PASSAGE
    words = np.bincount(row, minlength=n)
    whole = np.maximum(words, 1)
    if len(at):
        sums = np.add.reduceat(np.where(inside, _MIX[x], 0).ravel(), at)
        again = (sums[1:] == sums[:-1]) & (row[1:] == row[:-1])
        repeats = np.bincount(row[1:][again], minlength=n)
        cell = np.bincount(row * 64 + ((sums >> 20) & 63), minlength=n * 64).reshape(n, 64)
    else:
        repeats, cell = np.zeros(n), np.zeros((n, 64))
    more = np.stack([words / 100, inside.sum(1) / whole / 10, repeats / whole, (cell > 0).sum(1) / whole, (cell**2).sum(1) / whole**2, filled / PASSAGE], 1)
    return np.concatenate([shares, more], 1).astype(np.float32), owner


class AttentionMil:
    """Encoder, gated attention and output."""

    def __init__(self, features: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        draw = lambda a, b: rng.normal(0, 1 / np.sqrt(a), (a, b))
        self.mean, self.scale = np.zeros(features), np.ones(features)
        self.p = {"enc": draw(features, CODE), "enc_b": np.zeros(CODE), "v": draw(CODE, GATE), "u": draw(CODE, GATE), "w": draw(GATE, 1)[:, 0], "out": draw(CODE, 1)[:, 0], "out_b": np.zeros(1)}

    def forward(self, f: np.ndarray, starts: np.ndarray, owner: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        f = np.clip((f - self.mean) / self.scale, -8, 8)
        z = np.tanh(f @ p["enc"] + p["enc_b"])
        t, s = np.tanh(z @ p["v"]), sigmoid(z @ p["u"])
        e = (t * s) @ p["w"]
        a = np.exp(e - np.maximum.reduceat(e, starts)[owner])
        a /= np.add.reduceat(a, starts)[owner]
        m = np.add.reduceat(a[:, None] * z, starts)
        return {"f": f, "z": z, "t": t, "s": s, "a": a, "m": m, "score": sigmoid(m @ p["out"] + p["out_b"])}

    def gradients(self, f: np.ndarray, starts: np.ndarray, owner: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        p, h = self.p, self.forward(f, starts, owner)
        loss = -np.mean(y * np.log(h["score"] + 1e-9) + (1 - y) * np.log(1 - h["score"] + 1e-9))
        do = (h["score"] - y) / len(y)
        dm = (do[:, None] * p["out"])[owner]
        da = (h["z"] * dm).sum(1)
        de = h["a"] * (da - np.add.reduceat(h["a"] * da, starts)[owner])
        dt = de[:, None] * p["w"] * h["s"] * (1 - h["t"] ** 2)
        ds = de[:, None] * p["w"] * h["t"] * h["s"] * (1 - h["s"])
        dz = (h["a"][:, None] * dm + dt @ p["v"].T + ds @ p["u"].T) * (1 - h["z"] ** 2)
        g = {"enc": h["f"].T @ dz, "enc_b": dz.sum(0), "v": h["z"].T @ dt, "u": h["z"].T @ ds, "w": (h["t"] * h["s"]).T @ de, "out": h["m"].T @ do, "out_b": np.array([do.sum()])}
        return float(loss), g

    def fit(self, bags: list[np.ndarray], y: np.ndarray, epochs: int = 15, batch: int = 64, rate: float = 0.005, seed: int = 11) -> AttentionMil:
        every = np.concatenate(bags)
        self.mean, self.scale = every.mean(0), every.std(0) + 1e-3
        rng, adam = np.random.default_rng(seed), Adam(self.p, rate)
        for _ in range(epochs):
            order = rng.permutation(len(bags))
            for i in range(0, len(bags), batch):
                own = order[i : i + batch]
                sizes = np.array([len(bags[k]) for k in own])
                starts = np.r_[0, np.cumsum(sizes)[:-1]]
                adam.step(self.gradients(np.concatenate([bags[k] for k in own]), starts, np.repeat(np.arange(len(own)), sizes), y[own])[1])
        return self


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample_rows: int = 4_000) -> AttentionMil | None:
    """Fit on at most ``sample_rows`` labelled documents (smallest hashed ids). The driver gets their passages'
    features, not the texts. Of clashing labels of a document the least counts. None where there are no labels or all are the same."""
    known = one_label(labels, doc_id, label)
    chosen = F.broadcast(bounded_sample(known, "doc_id", sample_rows))  # ``sample_rows`` pairs of numbers

    def described(batches) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches):
            f, owner = passage_features([(t or "").encode("utf-8", "surrogatepass") for t in texts])
            bags = [x.tobytes() for x in np.split(f, np.flatnonzero(np.diff(owner)) + 1)]
            yield with_columns(batch, ["text"], bag=pa.array(bags, pa.binary()))

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(chosen, "doc_id").select("doc_id", "y", "text")
    got = sorted(rows.mapInArrow(described, "doc_id long, y int, bag binary").collect(), key=lambda r: (r.doc_id, r.bag))
    if len({r.y for r in got}) < 2:
        return None
    width = passage_features([b""])[0].shape[1]
    bags = [np.frombuffer(r.bag, np.float32).reshape(-1, width) for r in got]
    return AttentionMil(width).fit(bags, np.array([r.y for r in got], np.float64))


def score_quality(docs: DataFrame, model: AttentionMil | None, text: str = "text") -> DataFrame:
    """Append ``score`` (0 to 1, higher: better), an input column of that name is replaced; ``text`` stays, as do all rows.

    Null and empty texts are one empty passage. Without a model every score is 0.5. An empty table gives an
    empty table. Every passage of the whole text counts, of texts of any length. Repeated rows stay and score alike.
    """
    kept = [c for c in docs.columns if c != "score"]
    given = fresh_name([*kept, "score"])
    packed = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))  # a few thousand numbers

    def scored(batches) -> Iterator[pa.RecordBatch]:
        mil: AttentionMil | None = pickle.loads(packed.value)
        for batch, texts in text_batches(batches, 1_000_000, given):
            score = np.full(len(texts), 0.5)
            if mil:
                f, owner = passage_features([(t or "").encode("utf-8", "surrogatepass") for t in texts])
                starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                score = mil.forward(f, starts, owner)["score"]
            yield with_columns(batch, [given], score=pa.array(score, pa.float64()))

    return docs.select(*kept, F.col(text).alias(given)).mapInArrow(scored, fields(docs.select(*kept)) + "score double")
