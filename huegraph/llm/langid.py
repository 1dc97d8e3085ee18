"""Language identification by a byte convolutional network trained in numpy.

Bytes are embedded, filters of widths 2, 3 and 4 move over them byte by byte, the maximum of each filter over
a window of fixed length goes through a rectifier into a softmax over the languages. A text's scores are
the means of its windows', weighted by their bytes. For inference the embedding and the filters are folded into
two tables over pairs of bytes, which give the same sums.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Adam, bounded_sample, byte_windows, fields, fresh_name, text_batches, with_columns

#: A window's filters read ``TAIL`` bytes of the next one, so that every place of a text has its filters.
WINDOW, TAIL = 256, 3
EMBED, WIDTHS = 8, (2,) * 10 + (3,) * 11 + (4,) * 11


class ByteConvNet:
    """Parameters, training and inference."""

    def __init__(self, langs: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        f = len(WIDTHS)
        self.langs = langs
        #: Filters narrower than four bytes have zeros behind their width.
        self.mask = np.repeat(np.arange(4)[:, None] < np.array(WIDTHS)[None, :], EMBED, axis=0).astype(np.float32)
        self.p = {
            "embed": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32),
            "conv": (rng.normal(0, 0.3, (4 * EMBED, f)) * self.mask).astype(np.float32),
            "conv_b": np.zeros(f, np.float32),
            "out": rng.normal(0, 0.3, (f, len(langs))).astype(np.float32),
            "out_b": np.zeros(len(langs), np.float32),
        }

    def _columns(self, x: np.ndarray) -> np.ndarray:
        steps = x.shape[1] - TAIL
        return np.concatenate([self.p["embed"][x[:, k : k + steps]] for k in range(4)], axis=2)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        p, n = self.p, len(x)
        cols = self._columns(x)
        conv = cols @ p["conv"] + p["conv_b"]
        at = conv.argmax(1)
        top = np.take_along_axis(conv, at[:, None, :], 1)[:, 0]
        hidden = np.maximum(top, 0)
        probs = _softmax(hidden @ p["out"] + p["out_b"])
        loss = -np.log(probs[np.arange(n), y] + 1e-9).mean()
        d = probs.copy()
        d[np.arange(n), y] -= 1
        d /= n
        g = {"out": hidden.T @ d, "out_b": d.sum(0)}
        dh = (d @ p["out"].T) * (top > 0)
        g["conv_b"] = dh.sum(0)
        seen = cols[np.arange(n)[:, None], at]  # window, filter, column
        g["conv"] = np.einsum("nf,nfc->cf", dh, seen) * self.mask
        dcol = dh[:, :, None] * p["conv"].T[None]
        embed = np.zeros_like(p["embed"])
        for k in range(4):
            byte = x[np.arange(n)[:, None], at + k]
            np.add.at(embed, byte.ravel(), dcol[:, :, k * EMBED : (k + 1) * EMBED].reshape(-1, EMBED))
        g["embed"] = embed
        return float(loss), g

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 3, batch: int = 64, rate: float = 0.01, seed: int = 7) -> ByteConvNet:
        rng, adam = np.random.default_rng(seed), Adam(self.p, rate)
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                own = order[i : i + batch]
                adam.step(self.gradients(x[own], y[own])[1])
        return self

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Filter sums of the first and the second pair of bytes; the first holds the bias."""
        e, w = self.p["embed"], self.p["conv"]
        part = [e @ w[k * EMBED : (k + 1) * EMBED] for k in range(4)]
        first = (part[0][:, None] + part[1][None] + self.p["conv_b"]).reshape(65536, -1)
        return first, (part[2][:, None] + part[3][None]).reshape(65536, -1)

    def probabilities(self, x: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        pairs = x[:, :-1].astype(np.int32) * 256 + x[:, 1:]
        hidden = np.empty((len(x), len(WIDTHS)), np.float32)
        for i in range(0, len(x), 16):
            q = pairs[i : i + 16]
            s = tables[0][q[:, :-2]]
            s += tables[1][q[:, 2:]]
            hidden[i : i + 16] = s.max(1)
        return _softmax(np.maximum(hidden, 0) @ self.p["out"] + self.p["out_b"])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample_rows: int = 1_500) -> ByteConvNet | None:
    """Fit on every window of at most ``sample_rows`` labelled rows (those with the smallest hashed ids), whole texts. None
    where no row is labelled."""
    known = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang")).filter("lang IS NOT NULL")
    rows = bounded_sample(known.filter(F.length("text") > 0), "doc_id", sample_rows, of=known).collect()
    if not rows:
        return None
    rows = sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id, r.text, r.lang))
    langs = sorted({r.lang for r in rows})
    x, owner, _ = byte_windows([r.text.encode("utf-8", "surrogatepass") for r in rows], WINDOW, TAIL)
    return ByteConvNet(langs).fit(x, np.array([langs.index(r.lang) for r in rows])[owner])


def identify(docs: DataFrame, model: ByteConvNet | None, text: str = "text") -> DataFrame:
    """Append ``lang_pred`` and ``score``, the mean probability of that language; input columns of these names are
    replaced, all others and all rows stay.

    Null text, text without a letter, or no model (nothing to learn from): ``und`` with score 0. Every window of the
    whole text counts, of texts of any length; ties go to the first language by name. Repeated rows stay. An empty table gives an empty table.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    given = fresh_name([*kept, "lang_pred", "score"])
    packed = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))  # a few thousand numbers
    usable = F.when(F.col(text).rlike(r"\p{L}"), F.col(text))

    def predicted(batches) -> Iterator[pa.RecordBatch]:
        net: ByteConvNet | None = pickle.loads(packed.value)
        tables = net.tables() if net else None
        for batch, texts in text_batches(batches, 1_000_000, given):
            lang, score = ["und"] * len(texts), np.zeros(len(texts))
            have = [i for i, t in enumerate(texts) if t is not None] if net else []
            if have:
                x, owner, weight = byte_windows([texts[i].encode("utf-8", "surrogatepass") for i in have], WINDOW, TAIL)
                probs = net.probabilities(x, tables) * weight[:, None]
                starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                mean = np.add.reduceat(probs, starts) / np.add.reduceat(weight, starts)[:, None]
                for i, k, s in zip(have, mean.argmax(1), mean.max(1), strict=True):
                    lang[i], score[i] = net.langs[k], min(1.0, float(s))
            yield with_columns(batch, [given], lang_pred=pa.array(lang), score=pa.array(score))

    schema = fields(docs.select(*kept))
    return docs.select(*kept, usable.alias(given)).mapInArrow(predicted, schema + "lang_pred string, score double")
