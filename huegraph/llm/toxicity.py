"""Toxicity through a noisy channel: deobfuscate, then score the restored text.

A character language model (trigrams of all texts of the table) is the source; leetspeak, spacing and
repetition are the channel. A token or a spaced-out run that can be noisy spans a lattice: a digit or sign may
be itself or a letter, a run of one letter may be shorter, a space between single characters may be none. Viterbi
decoding takes the likeliest path. A token whose lattice is one path is its own restoration. Signs at the ends of a token are
punctuation, and where they can be letters they are read as such too.

Restored words and their beginnings are the features of a small additive model, fitted to labelled
documents: those that occur in toxic documents which are no copies of each other, and hardly in others.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, fields, fresh_name, one_label, sigmoid, text_batches, with_columns

#: Letters that a sign of leetspeak stands for (fixed values).
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l", "+": "t", "(": "c", "€": "e"}
#: Natural logarithms of the channel: a sign read as a letter, a sign among letters left as it is, a letter of a run left out, a
#: space of a spaced-out run left out, and one that stands between words.
COST_LEET, COST_SIGN, COST_DROP, COST_JOIN, COST_BREAK = -1.5, -2.0, -0.7, -0.1, -2.5

_WORD = re.compile(r"[^\W\d_]+")
_OUTER = ".,;:!?\"'()[]{}<>*#%&|-_=/\\~^`«»“”‘’…"
#: Outer signs that may be letters, next to the rest of the token.
_HEAD, _TAIL = re.compile(r"[!|( ]+$"), re.compile(r"^[!|( ]+")
_SPACED = re.compile(r"(?<!\S)\S(?: \S){3,}(?!\S)")
#: What gives a lattice a second path: a sign of leetspeak, a letter twice in a row, a space.
_NOISE = re.compile("[" + re.escape("".join(LEET)) + r" ]|([^\W\d_])\1")


class CharModel:
    """Trigram model over lower-case Latin-1 letters; all else is one boundary character."""

    def __init__(self, counts: np.ndarray | None = None):
        self.table = self.index()
        self.k = int(self.table.max()) + 1
        c = np.zeros((self.k, self.k, self.k)) if counts is None else counts.reshape(self.k, self.k, self.k)
        two = c.sum(2)
        # interpolation of three orders
        uni = (c.sum((0, 1)) + 1) / (c.sum() + self.k)
        bi = (c.sum(0) + 5 * uni[None]) / (c.sum(0).sum(1, keepdims=True) + 5)
        self.log = np.log((c + 5 * bi[None]) / (two[:, :, None] + 5))
        self._rows: list | None = None

    @staticmethod
    def index() -> np.ndarray:
        letters = [b for b in range(256) if chr(b).isalpha() and chr(b).islower() and chr(b) not in "ªº"]
        table = np.zeros(256, np.int64)
        table[letters] = np.arange(1, len(letters) + 1)
        return table

    def classes(self, text: str) -> np.ndarray:
        return self.table[np.frombuffer(text.encode("latin-1", "replace"), np.uint8)]

    def rows(self) -> list:
        """``log`` as nested lists, which are faster to look up one by one. Not pickled."""
        if self._rows is None:
            self._rows = self.log.tolist()
        return self._rows

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_rows": None}

    def of(self, char: str) -> int:
        return int(self.table[ord(char)]) if ord(char) < 256 else 0


def count_trigrams(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Trigram counts of all texts, each between two boundaries on either side, so that no trigram spans two texts. The driver gets one row
    for each trigram that occurs, at most alphabet cubed."""
    k = int(CharModel.index().max()) + 1

    def counted(batches) -> Iterator[pa.RecordBatch]:
        total, model = np.zeros(k**3, np.int64), CharModel()
        for _, texts in text_batches(batches, 1_000_000):
            c = model.classes("\n\n".join(["", *(t.lower() for t in texts if t), ""]))
            total += np.bincount((c[:-2] * k + c[1:-1]) * k + c[2:], minlength=k**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["t", "n"])

    rows = docs.select(F.col(text).alias("text")).mapInArrow(counted, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(k**3)
    for r in rows:
        out[r.t] = r.n
    return out


def lattice(token: str, letters: tuple[int, ...] = ()) -> list[tuple[list[tuple[str, float]], bool]]:
    """For each character of a lower-case token or spaced run: readings with their cost, and whether a space before it
    may be left out. A reading may be empty (a letter of a run that goes). The signs at the places ``letters`` are no signs."""
    out, spaced, before = [], False, ""
    for at, ch in enumerate(token):
        if ch == " ":
            spaced = True
            continue
        own = [] if at in letters else [(ch, COST_SIGN if ch in LEET else 0.0)]
        readings = own + [(x, COST_LEET) for x in LEET.get(ch, "")]
        if ch == before and not spaced and ch.isalpha():
            readings.append(("", COST_DROP))  # of a run, all but one may go
        out.append((readings, spaced))
        spaced, before = False, ch
    return out


def restore(token: str, model: CharModel, letters: tuple[int, ...] = ()) -> str:
    """The likeliest reading of ``token``, of any length: Viterbi over states of the last two characters, which link back to
    the characters before them, so that time and memory are linear."""
    log = model.rows()
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for readings, spaced in lattice(token, letters):
        if spaced:  # the space stays, or goes at a cost
            wide: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (p, s) in states.items():
                for key, q, blank in (((a, b), p + COST_JOIN, False), ((b, 0), p + COST_BREAK + log[a][b][0], True)):
                    if key not in wide or q > wide[key][0]:
                        wide[key] = q, (s, " ") if blank else s
            states = wide
        new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        known = [(ch, model.of(ch) if ch else 0, cost) for ch, cost in readings]
        for (a, b), (p, s) in states.items():
            row = log[a][b]
            for ch, c, cost in known:
                key, q = ((b, c), p + cost + row[c]) if ch else ((a, b), p + cost)
                if key not in new or q > new[key][0]:
                    new[key] = q, (s, ch) if ch else s
        states = new
    at, out = max(((p + log[a][b][0], s) for (a, b), (p, s) in states.items()), key=lambda x: x[0])[1], []
    while at:
        at, ch = at
        out.append(ch)
    return "".join(reversed(out))


def noisy(core: str) -> bool:
    """Whether a lower-case token or spaced run has a sign of leetspeak, a letter twice in a row, or spaces: else its lattice is one path."""
    return bool(_NOISE.search(core))


def readings_of(token: str) -> list[tuple[str, tuple[int, ...]]]:
    """A lower-case token without the signs at its ends, and with those that are next to the rest and may be letters: at one
    end, at the other, at both. With each the places of the signs that must be letters; those further out may be."""
    core = token.strip(_OUTER + " ")
    if not core:
        return [(token, ())]
    at = token.index(core)
    head, tail = _HEAD.search(token[:at]), _TAIL.search(token[at + len(core) :])
    out = []
    for h in ("", head.group().lstrip() if head else ""):
        for t in ("", tail.group().rstrip() if tail else ""):
            letters = ([len(h.rstrip()) - 1] if h else []) + ([len(h) + len(core) + len(t) - len(t.lstrip())] if t else [])
            out.append((h + core + t, tuple(letters)))
    return list(dict.fromkeys(out))


def token_words(token: str, model: CharModel) -> list[str]:
    """The words of a token as it stands, and those of its restorations."""
    token = token.lower()
    core = token.strip(_OUTER)
    if core.isalpha() and len(core) == len(token) and not noisy(core):
        return [core]
    words = [core] if core.isalpha() else _WORD.findall(core)
    for reading, letters in readings_of(token):
        if noisy(reading):
            plain = restore(reading, model, letters)
            words += _WORD.findall(plain)
            if " " in plain:  # a spaced-out run is also read as one word
                words += _WORD.findall(plain.replace(" ", ""))
    return list(dict.fromkeys(words))


def text_tokens(text: str) -> list[str]:
    """Tokens between white space, and spaced-out runs of single characters as tokens of their own."""
    tokens = text.split()
    if " " in text and _SPACED.search(text):
        tokens += _SPACED.findall(text)
    return tokens


def word_features(word: str) -> list[str]:
    """The word, marked by a full stop, and its beginnings of 4 to 8 letters."""
    return [word + ".", *(word[:k] for k in range(4, min(9, len(word) + 1)))]


class ToxicModel:
    """Weights of the selected features, and the deobfuscator."""

    def __init__(self, chars: CharModel, weights: dict[str, float], bias: float):
        self.chars, self.weights, self.bias = chars, weights, bias

    def token_hits(self, token: str) -> tuple[str, ...]:
        w = self.weights
        return tuple({f for word in token_words(token, self.chars) for f in word_features(word) if f in w})

    def score(self, hits: list[str]) -> float:
        """The log odds of the strongest feature and half of those of the others; without any the bias."""
        own = sorted((self.weights[h] for h in hits), reverse=True)
        return float(sigmoid(own[0] + 0.5 * sum(w for w in own[1:] if w > 0) if own else self.bias))


def distinct_bags(bags: Iterable[set[str]], most: float = 0.5) -> list[set[str]]:
    """The bags without near copies of earlier ones (Jaccard index above ``most``), so that copies don't make a feature."""
    kept: list[set[str]] = []
    for bag in bags:
        if all(len(bag & k) * (1 + most) <= most * (len(bag) + len(k)) for k in kept if most * len(bag) <= len(k) <= len(bag) / most):
            kept.append(bag)
    return kept


def select_features(toxic: list[set[str]], clean: list[set[str]], least: int = 8) -> tuple[dict[str, float], float]:
    """Features of at least ``least`` toxic documents, and of twelve times as many as clean ones. Their weights are smoothed
    log odds; the bias is that of documents without any."""
    df = Counter(f for d in toxic for f in d)
    df = Counter({f: n for f, n in df.items() if n >= least})
    bad = Counter(f for d in clean for f in d if f in df)
    chosen = {f: math.log(n + 0.5) - math.log(bad[f] + 0.5) for f, n in df.items() if n >= 12 * bad[f]}
    bare = [sum(1 for d in side if not d & chosen.keys()) for side in (toxic, clean)]
    return chosen, math.log((bare[0] + 0.5) / (bare[1] + 1))


def least_support(toxic: int, clean: Iterable[set[str]], most: int = 8) -> int:
    """The number of toxic documents a feature needs so that fewer than one word of the clean kind is expected to be
    in so many toxic documents and no other by chance; ``most`` suffices in any case."""
    seen, documents = Counter(), 0
    for d in clean:
        seen.update(d)
        documents += 1
    odds, by_support = toxic / max(1, documents), Counter(seen.values())
    for k in range(3, most):
        if 3 * sum(n * odds**j for j, n in by_support.items() if j >= k) < 1:
            return k
    return most


class TokenCache(dict):
    """What ``make`` gives for a token, kept for short tokens, ``most`` of them."""

    def __init__(self, make: Callable[[str], object], most: int):
        self.make, self.most = make, most

    def __missing__(self, token: str):
        made = self.make(token)
        if len(token) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[token] = made
        return made


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample_rows: int = 6_000, cache: int = 400_000) -> ToxicModel:
    """The language model of all of ``docs``, and weights from at most ``sample_rows`` labelled documents (smallest
    hashed ids), whole texts. The workers restore them; the driver gets the distinct words of each. Of clashing labels of a document the least
    counts. Without labels of both kinds there are no weights."""
    chosen = F.broadcast(bounded_sample(one_label(labels, doc_id, label), "doc_id", sample_rows))  # ``sample_rows`` pairs of numbers
    chars = CharModel(count_trigrams(docs, text))
    packed = docs.sparkSession.sparkContext.broadcast(pickle.dumps(chars))  # alphabet cubed

    def restored(batches) -> Iterator[pa.RecordBatch]:
        own: CharModel = pickle.loads(packed.value)
        known = TokenCache(lambda token: token_words(token, own), cache)
        for batch, texts in text_batches(batches, 1_000_000):
            words = [" ".join(sorted({w for token in set(text_tokens(t)) for w in known[token]})) for t in texts]
            yield with_columns(batch, ["text"], words=pa.array(words, pa.string()))

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).filter("text IS NOT NULL").join(chosen, "doc_id").select("doc_id", "y", "text")
    # a string a document: words become sets one document at a time
    got = sorted({(r.doc_id, r.y, r.words) for r in rows.mapInArrow(restored, "doc_id long, y int, words string").collect()})
    bags = {label: (lambda label=label: (set(words.split()) for _, y, words in got if y == label)) for label in (0, 1)}
    toxic = [{f for w in bag for f in word_features(w)} for bag in distinct_bags(bags[1]())]
    least = least_support(len(toxic), bags[0]())
    usable = {f for f, n in Counter(f for d in toxic for f in d).items() if n >= least}
    clean = [{f for w in bag for f in word_features(w) if f in usable} for bag in bags[0]()]
    if not toxic or not clean:
        return ToxicModel(chars, {}, math.log(0.01))
    return ToxicModel(chars, *select_features(toxic, clean, least))


def score_toxicity(docs: DataFrame, model: ToxicModel, text: str = "text", cache: int = 400_000) -> DataFrame:
    """Append ``score`` (0 to 1, higher: toxic) and ``toxic_hits`` (array of the features found); input columns of these names
    are replaced, all rows and other columns stay.

    The whole text counts, of texts and tokens of any length. Null and empty texts have no hits: the score of a text without any. Repeated
    rows stay and score alike. An empty table gives an empty table.
    """
    kept = [c for c in docs.columns if c not in ("score", "toxic_hits")]
    given = fresh_name([*kept, "score", "toxic_hits"])
    packed = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))  # alphabet cubed, and features of the bounded sample

    def scored(batches) -> Iterator[pa.RecordBatch]:
        own: ToxicModel = pickle.loads(packed.value)
        known = TokenCache(own.token_hits, cache)
        for batch, texts in text_batches(batches, 1_000_000, given):
            found = [sorted({h for own_hits in filter(None, map(known.__getitem__, text_tokens(t))) for h in own_hits}) if t else [] for t in texts]
            score = [own.score(h) for h in found]
            yield with_columns(batch, [given], score=pa.array(score, pa.float64()), toxic_hits=pa.array(found, pa.list_(pa.string())))

    return docs.select(*kept, F.col(text).alias(given)).mapInArrow(scored, fields(docs.select(*kept)) + "score double, toxic_hits array<string>")
