"""Personal data: exact base patterns, and a character-level bidirectional LSTM with CRF transitions on top.

The network is trained in numpy from labelled spans: places of the corpus labelled by the base patterns, and
made-up numbers and addresses, also in spellings that the patterns miss, set into sentences of the corpus. It reads overlapping windows
over the whole of every text. Each window is decoded by itself; the spans of all windows of a text are reconciled globally: those
cut by a window's border are joined with what the overlapping windows see of them, and of those that overlap the set of greatest total score stays.

Base spans always stay. The network adds spans that overlap none of them, score ``least`` at least, and pass the
same exact checks (number of digits, check sum, parts up to 255; of an address the at, the dot and what is between them).
"""

from __future__ import annotations

import pickle
import random
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Adam, bounded_sample, fields, fresh_name, text_batches, with_columns

KINDS = ("email", "ip", "card", "phone")
#: O, then begin and inside of each kind.
TAGS = 1 + 2 * len(KINDS)
#: All windows of a text but the last are of the greatest width, the last is of the least that holds it; neighbours share ``OVERLAP`` characters.
WIDTHS, OVERLAP = (64, 128, 192, 256, 384, 512), 64
WINDOW = WIDTHS[-1]
STRIDE = WINDOW - OVERLAP
#: Width of training windows, and the distance between them.
SHORT, SHORT_STRIDE = 96, 72
EMBED, HIDDEN = 8, 8
#: Windows read at once, in blocks of ``LANES``: the products of a block are few enough that the linear algebra library does not start
#: threads of its own in every worker, and of one shape, so that a window's result does not depend on its neighbours.
BATCH, LANES = 1024, 256
#: Characters of texts whose windows are sorted by width and read together.
RUN = 12_000_000
#: Texts and windows with a match are those that training mainly learns from.
TRIGGER = r"[0-9@]|[\[(] ?[aA][tT] ?[\])]"

_TRIGGER = re.compile(TRIGGER)
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
# a number's match never starts inside a run of digits: what fails at the run's start fails there too, so runs that begin none are skipped whole
_IP = re.compile(r"[0-9]++(\.[0-9]++\.[0-9]++\.[0-9]++)?+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

_AT, _DOT = (rf"(?:[{sign}]|[\[({{<]\s?(?:{word})\s?[\])}}>]|(?<![^\W_])(?:{word})(?![^\W_]))" for sign, word in (("@\uff20\ufe6b", "at|a|@"), (".\uff0e\u3002", "dot|[.]")))
#: What an address has in any spelling: "at" as a sign or word right between a name and a host, then a dot as a sign or word between parts.
_ADDRESS = [re.compile(p, re.I) for p in (rf"\w[\s_]?{_AT}[\s_]?(?=\w)", rf"\w[\s_]?{_DOT}[\s_]?\w")]

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    """The digits of any script, as ASCII."""
    return "".join(str(unicodedata.digit(c)) for c in s if c.isdigit())


def _parts_fit(s: str) -> bool:
    parts = s.split(".")
    if len(parts) != 4 or not all(p.isdigit() for p in parts):
        return False
    return all(len(p) <= 3 and int(p or "0") <= 255 for p in (_digits(p).lstrip("0") for p in parts))


def _address(s: str) -> bool:
    """The parts of an address, one behind the other: the first match of each is enough, which is linear."""
    end = 0
    for part in _ADDRESS:
        m = part.search(s, end)
        if not m:
            return False
        end = m.end()
    return True


def valid(kind: str, s: str) -> bool:
    if kind == "email":
        return _address(s)
    if kind == "ip":
        return _parts_fit(s)
    n = sum(c.isdigit() for c in s)
    return 14 <= n <= 19 and luhn(_digits(s)) if kind == "card" else 10 <= n <= 15


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches, from one at sign to the next: linear also in long runs without any."""
    end = 0
    for sign in re.finditer("@", text):
        at = sign.start()
        before = text[end:at]
        run = len(before) - len(before.rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if run else None
        if m:
            yield at - run, m.end()
        end = m.end() if m else at + 1


def base_spans(text: str) -> list[Span]:
    """The matches of the base patterns as (start, end, kind), by start, then kind as listed."""
    found = [(a, b, "email") for a, b in _emails(text)]
    for kind, pattern in (("ip", _IP), ("card", _CARD), ("phone", _PHONE)):
        found += [(m.start(), m.end(), kind) for m in pattern.finditer(text) if (kind != "ip" or m.end(1) > 0) and valid(kind, m.group())]
    return in_order(found)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


_CHARS = {c: i for i, c in enumerate("abcdefghijklmnopqrstuvwxyz0@.-+()[] _%\n\t,:;/\"'=#*", 3)}


def char_classes(text: Iterable[str]) -> np.ndarray:
    """Class of each character: letters without case, all digits one, some signs, other letters (1), the rest (2);
    0 is padding."""
    return np.array([_CHARS.get("0" if c.isdigit() else c.lower(), 1 if c.isalpha() else 2) for c in text], np.int64)


@cache
def _class_table() -> np.ndarray:
    """``char_classes`` of every code point, 0 until a text of this process has it or one of the 255 beside it."""
    return np.zeros(0x110000, np.int8)


def _classes(text: str) -> np.ndarray:
    """``char_classes`` by the table."""
    table, codes = _class_table(), np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    c = table[codes]
    if np.count_nonzero(c) < len(c):
        for page in np.unique(codes[c == 0] >> 8).tolist():
            table[page << 8 : (page + 1) << 8] = char_classes(map(chr, range(page << 8, (page + 1) << 8)))
        c = table[codes]
    return c


class BiLstmCrf:
    """Parameters, loss with gradients, and decoding."""

    def __init__(self, seed: int = 5, embed: int = EMBED, hidden: int = HIDDEN, dtype=np.float32):
        rng, self.dtype = np.random.default_rng(seed), dtype
        h, n = hidden, max(_CHARS.values()) + 1
        draw = lambda a, b: rng.normal(0, 1 / np.sqrt(a), (a, b))
        self.h = h
        self.p = {"embed": rng.normal(0, 0.5, (n, embed)), "out": draw(2 * h, TAGS), "out_b": np.zeros(TAGS), "next": np.zeros((TAGS, TAGS)), "first": np.zeros(TAGS)}
        for d in "fb":
            self.p |= {f"x{d}": draw(embed, 4 * h), f"h{d}": draw(h, 4 * h), f"b{d}": np.r_[np.zeros(h), np.ones(h), np.zeros(2 * h)]}
        # inside follows only begin or inside of its kind
        self.banned = np.zeros((TAGS, TAGS))
        for k in range(len(KINDS)):
            self.banned[:, 2 + 2 * k] = -1e4
            self.banned[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = 0
        self.banned_first = np.array([0.0] + [0.0, -1e4] * len(KINDS))
        self.p = {k: v.astype(dtype) for k, v in self.p.items()}
        self.banned, self.banned_first = self.banned.astype(dtype), self.banned_first.astype(dtype)

    def _weights(self) -> np.ndarray:
        """For both directions the rows of all gates over (state, input, one); half of it for sigmoids, which are read off hyperbolic tangents."""
        half = np.r_[np.full(3 * self.h, 0.5), np.ones(self.h)].astype(self.dtype)
        return np.stack([(np.concatenate([self.p[f"h{d}"], self.p[f"x{d}"], self.p[f"b{d}"][None]]) * half).T for d in "fb"])

    def _read(self, x: np.ndarray) -> dict[str, np.ndarray]:
        """Both directions, each in its reading order, as (direction, place, unit, window): ``rows`` has the state before a place, its input
        and a one."""
        p, h, d = self.p, self.h, self.dtype
        n, steps = x.shape
        at = np.stack([x.T, x.T[::-1]])
        rows = np.ones((2, steps + 1, h + p["embed"].shape[1] + 1, n), d)
        rows[:, 0, :h] = 0
        rows[:, :-1, h:-1] = p["embed"].T.take(at, 1).transpose(1, 2, 0, 3)
        weight, gates = self._weights(), np.empty((2, steps, 4 * h, n), d)
        cells, bent = np.zeros((2, steps + 1, h, n), d), np.empty((2, steps, h, n), d)
        for t in range(steps):
            g = gates[:, t]
            np.matmul(weight, rows[:, t], out=g)
            np.tanh(g, out=g)
            g[:, : 3 * h] += 1
            g[:, : 3 * h] *= 0.5
            np.multiply(g[:, h : 2 * h], cells[:, t], out=cells[:, t + 1])
            cells[:, t + 1] += g[:, :h] * g[:, 3 * h :]
            np.tanh(cells[:, t + 1], out=bent[:, t])
            np.multiply(g[:, 2 * h : 3 * h], bent[:, t], out=rows[:, t + 1, :h])
        return {"at": at, "rows": rows, "gates": gates, "cells": cells, "bent": bent}

    def _back(self, kept: dict[str, np.ndarray], dout: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of both directions from those of the states."""
        p, h = self.p, self.h
        _, steps, _, n = dout.shape
        i, f, o, new = (kept["gates"][:, :, k * h : (k + 1) * h] for k in range(4))
        # what a gate's input changes: the cell through the first two and the last, the state through the third
        change = np.concatenate([new * i * (1 - i), kept["cells"][:, :-1] * f * (1 - f), kept["bent"] * o * (1 - o), i * (1 - new * new)], 2)
        bend = o * (1 - kept["bent"] * kept["bent"])
        weight = np.stack([p["hf"], p["hb"]])
        ds, dc = np.zeros((2, h, n), self.dtype), np.zeros((2, h, n), self.dtype)
        for t in reversed(range(steps)):
            ds = ds + dout[:, t]
            dc += ds * bend[:, t]
            row = change[:, t]
            row[:, : 2 * h].reshape(2, 2, h, n)[:] *= dc[:, None]
            row[:, 2 * h : 3 * h] *= ds
            row[:, 3 * h :] *= dc
            ds = weight @ row
            dc *= f[:, t]
        grown = (change @ kept["rows"][:, :-1].transpose(0, 1, 3, 2)).sum(1).transpose(0, 2, 1)
        de = np.stack([p["xf"], p["xb"]])[:, None] @ change
        at = kept["at"].ravel()
        out = {"embed": np.stack([np.bincount(at, de[:, :, k].ravel(), len(p["embed"])) for k in range(de.shape[2])], 1).astype(self.dtype)}
        for k, d in enumerate("fb"):
            out |= {f"h{d}": grown[k, :h], f"x{d}": grown[k, h:-1], f"b{d}": grown[k, -1]}
        return out

    def emissions(self, x: np.ndarray):
        kept = self._read(x)
        f, b = kept["rows"][:, 1:, : self.h]
        both = np.concatenate([f, b[::-1]], 1).transpose(2, 0, 1)
        return both @ self.p["out"] + self.p["out_b"], (kept, both)

    def marginals(self, em: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log normalizer, tag probabilities of each place, and expected transitions, all places valid: forward and backward sums,
        scaled to one at every place."""
        n, steps, k = em.shape
        trans = np.exp(self.p["next"].astype(np.float64) + self.banned)
        high = em.max(2, keepdims=True)
        e = np.exp(em.astype(np.float64) - high)
        a, b, norm = np.empty_like(e), np.ones_like(e), np.empty((n, steps))
        for t in range(steps):
            now = e[:, t] * (a[:, t - 1] @ trans if t else np.exp(self.p["first"].astype(np.float64) + self.banned_first))
            norm[:, t] = now.sum(1)
            a[:, t] = now / norm[:, t, None]
        pair = np.zeros((k, k))
        for t in range(steps - 1, 0, -1):
            later = e[:, t] * b[:, t] / norm[:, t, None]
            b[:, t - 1] = later @ trans.T
            pair += a[:, t - 1].T @ later
        return np.log(norm).sum(1) + high[:, :, 0].sum(1), a * b, pair * trans

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        n, steps = x.shape
        em, (kept, both) = self.emissions(x)
        z, prob, pair = self.marginals(em)
        rows = np.arange(n)
        gold = np.take_along_axis(em, y[:, :, None], 2)[:, :, 0].sum(1) + self.p["first"][y[:, 0]] + self.p["next"][y[:, :-1], y[:, 1:]].sum(1)
        dem = prob
        dem[rows[:, None], np.arange(steps)[None], y] -= 1
        dem = (dem / n).astype(self.dtype)
        seen = np.bincount((y[:, :-1] * TAGS + y[:, 1:]).ravel(), minlength=TAGS * TAGS).reshape(TAGS, TAGS)
        flat = dem.reshape(n * steps, TAGS)
        g = {"next": (pair - seen) / n, "first": dem[:, 0].sum(0), "out": both.reshape(n * steps, -1).T @ flat, "out_b": flat.sum(0)}
        dboth = (dem @ self.p["out"].T).transpose(1, 2, 0)
        g |= self._back(kept, np.stack([dboth[:, : self.h], dboth[::-1, self.h :]]))
        return float((z - gold).mean()), g

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 4, batch: int = 32, rate: float = 0.03, seed: int = 5) -> BiLstmCrf:
        rng, adam = np.random.default_rng(seed), Adam(self.p, rate)
        for e in range(epochs):
            adam.rate = rate * (1 - 0.9 * e / epochs)
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                own = order[i : i + batch]
                g = self.gradients(x[own], y[own])[1]
                norm = np.sqrt(sum((v * v).sum() for v in g.values()))
                adam.step({k: v * min(1.0, 5 / (norm + 1e-9)) for k, v in g.items()})
        return self

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best tags of every window and the probability of each of them."""
        em = self.emissions(x)[0]
        tags = self.best_tags(em)
        return tags, np.take_along_axis(self.marginals(em)[1], tags[:, :, None], 2)[:, :, 0]

    def best_tags(self, em: np.ndarray) -> np.ndarray:
        """Viterbi: the path of the greatest score for every window, all windows at once. The tag before one is looked for on the way
        back, for the tags of the path only."""
        em = np.ascontiguousarray(em.transpose(1, 2, 0))
        trans = self.p["next"] + self.banned
        steps, n = len(em), em.shape[2]
        best = np.empty_like(em)
        best[0] = em[0] + (self.p["first"] + self.banned_first)[:, None]
        for t in range(1, steps):
            np.add(em[t], (best[t - 1][:, None] + trans[:, :, None]).max(0), out=best[t])
        tags = np.empty((steps, n), np.int64)
        tags[-1] = best[-1].argmax(0)
        for t in range(steps - 1, 0, -1):
            tags[t - 1] = (best[t - 1] + trans.take(tags[t], 1)).argmax(0)
        return tags.T

    def quick_emissions(self, x: np.ndarray) -> np.ndarray:
        """``emissions`` for inference, as (block, place, tag, lane): both directions of all blocks at once, sigmoids by hyperbolic tangents,
        states kept twice too large, the input as further rows of the state, and the tags of one place as further rows of the next one's gates."""
        p, h, d = self.p, self.h, self.dtype
        n, steps = x.shape
        blocks, width, top = -(-n // LANES), p["embed"].shape[1], 4 * self.h
        x = np.concatenate([x, np.zeros((blocks * LANES - n, steps), x.dtype)])
        x = np.ascontiguousarray(x.T, np.intp).reshape(steps, blocks, LANES)
        weight = np.zeros((2, 1, top + TAGS, h + width + 1), d)
        weight[:, 0, :top] = self._weights()
        weight[:, 0, top:, :h] = p["out"][:h].T, p["out"][h:].T
        weight[:, :, :, :h] /= 2
        weight[0, 0, top:, -1] = p["out_b"]
        embed = np.ascontiguousarray(p["embed"].T)
        rows = np.zeros((2, blocks, h + width + 1, LANES), d)
        rows[:, :, -1] = 1
        state, (ahead, behind) = rows[:, :, :h], rows[:, :, h:-1].transpose(0, 2, 1, 3)
        # a place is looked up once, when the first direction gets there, and kept for the other
        inputs = np.empty((steps, width, blocks, LANES), d)
        cell, out = np.zeros((2, blocks, h, LANES), d), np.empty((2, blocks, top + TAGS, LANES), d)
        added = np.empty_like(cell)  # a product of parts of one array written into one of them would copy the other first
        g = out[:, :, :top]
        bent, add, forget, show, new = g[:, :, : 3 * h], g[:, :, :h], g[:, :, h : 2 * h], g[:, :, 2 * h : 3 * h], g[:, :, 3 * h :]
        em, shares = np.empty((steps, TAGS, blocks, LANES), d), out[:, :, top:].transpose(0, 2, 1, 3)
        for t in range(steps + 1):
            if t < steps:
                last = steps - 1 - t
                if t <= last:
                    embed.take(x[t], 1, inputs[t], "clip")
                if t < last:
                    embed.take(x[last], 1, inputs[last], "clip")
                ahead[:], behind[:] = inputs[t], inputs[last]
            np.matmul(weight, rows, out=out)
            if t:
                # the first direction at a place writes, the other adds
                for place, share, fresh in ((t - 1, shares[0], 2 * t <= steps + 1), (steps - t, shares[1], 2 * t <= steps)):
                    if fresh:
                        em[place] = share
                    else:
                        em[place] += share
            if t < steps:
                np.tanh(g, out=g)
                bent += 1
                cell *= forget
                np.multiply(add, new, out=added)
                cell += added
                cell *= 0.5
                np.tanh(cell, out=state)
                state *= show
        return em.transpose(2, 0, 1, 3)

    def may_hold(self, em: np.ndarray) -> np.ndarray:
        """For (block, place, tag, lane) whether the best path of a lane can have a span.

        A path with spans gains over the path without what its runs of spans one right behind the other gain, each from where it begins to where it
        ends. The greatest gain of a run is found in one pass over the tags it can end with; from one span right to the next counts as much as where it
        counts most. Where no run gains, the path without spans is the best one; elsewhere decoding decides.
        """
        trans = self.p["next"].astype(np.float64) - self.p["next"][0, 0]
        begin, inside = np.arange(1, TAGS, 2), np.arange(2, TAGS, 2)
        follow, stay = trans[1:, begin].max(), trans[inside, inside]
        # what every path to a tag has is added once: to begin tags ``follow``, to inside tags ``stay``
        always = np.ravel([np.full(len(KINDS), follow), stay], "F")
        first, enter = self.p["first"][begin] - self.p["first"][0] - follow, trans[0, begin] - follow
        first, enter, always, grow, leave = (v.astype(self.dtype)[:, None] for v in (first, enter, always, trans[begin, inside] - stay, trans[1:, 0]))
        places = em.transpose(1, 2, 0, 3).reshape(em.shape[1], TAGS, -1)
        gain = np.full((TAGS - 1, places.shape[2]), -np.inf, self.dtype)
        most, (begun, within) = gain.copy(), (gain[::2], gain[1::2])
        either = np.empty_like(begun)
        half, one = np.empty_like(either[:2]), np.empty_like(either[:1])
        for t, now in enumerate(places):
            np.maximum(begun, within, out=either)
            np.maximum(either[:2], either[2:], out=half)
            np.maximum(half[:1], half[1:], out=one)
            np.add(begun, grow, out=either)
            np.maximum(within, either, out=within)
            np.maximum(one, enter if t else first, out=begun)
            gain += now[1:]
            gain -= now[:1]
            gain += always
            np.maximum(most, gain, out=most)
        # of a window's last span no transition out of it counts; rounding must not hide a span
        return (np.maximum((most + leave).max(0), gain.max(0)) > -1e-3).reshape(len(em), -1)

    def spans(self, x: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int, str, float]]]]:
        """The windows that hold spans, and those spans."""
        where, held = [], []
        for k in range(0, len(x), BATCH):
            em = self.quick_emissions(x[k : k + BATCH])
            hold = self.may_hold(em)
            hold.reshape(-1)[len(x) - k :] = False
            block, lane = np.nonzero(hold)
            where += (k + block * LANES + lane).tolist()
            held.append(em[block, :, :, lane])
            if where and (len(where) >= LANES or k + BATCH >= len(x)):  # few windows: they are decoded together
                em = np.concatenate(held)
                tags = self.best_tags(em)
                own = np.flatnonzero(tags.any(1))
                if len(own):
                    prob = np.take_along_axis(self.marginals(em[own])[1], tags[own][:, :, None], 2)[:, :, 0]
                    for i, y, p in zip(own, tags[own], prob, strict=True):
                        yield where[i], tag_spans(y, p)
                where, held = [], []


def window_starts(n: int) -> range:
    """Starts of the windows over all of a text of ``n`` characters."""
    return range(0, max(1, n - OVERLAP), STRIDE)


def text_windows(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The classes of a text's windows: those of full width, and the last one, padded to the next width."""
    c = _classes(text)
    last = window_starts(len(c))[-1]
    full = np.lib.stride_tricks.as_strided(c, (last // STRIDE, WINDOW), (STRIDE, 1), writeable=False)
    rest = np.zeros((1, WIDTHS[bisect_left(WIDTHS, len(c) - last)]), np.int8)
    rest[0, : len(c) - last] = c[last:]
    return full, rest


def _short_window(text: str, start: int) -> np.ndarray:
    c = char_classes(text[start : start + SHORT])
    return np.pad(c, (0, SHORT - len(c)))


def tag_spans(tags: np.ndarray, prob: np.ndarray) -> list[tuple[int, int, str, float]]:
    out, t = [], 0
    while t < len(tags):
        if tags[t] % 2 == 1:
            end = t + 1
            while end < len(tags) and tags[end] == tags[t] + 1:
                end += 1
            out.append((t, end, KINDS[(tags[t] - 1) // 2], float(prob[t:end].mean())))
            t = end
        else:
            t += 1
    return out


def joined(found: list[tuple[int, int, str, float, bool, bool]]) -> list[tuple[int, int, str, float]]:
    """Spans of all windows, with the score and whether the window's border cuts them at the left and the right. Pieces of a kind
    that a border cuts are joined with those that overlap them, into spans of any length. An end at a border that no
    overlapping window carries on is outvoted: that window sees both sides of the border."""
    out = [x[:4] for x in found if not (x[4] or x[5])]
    for kind in KINDS:
        run: list = []  # start, end, cut at the left, cut at the right, sum of scores, weight, pieces
        for a, b, k, score, left, right in [*sorted(x for x in found if x[2] == kind), (0, 0, "", 0.0, False, False)]:
            if run and k == kind and a < run[1] and (run[3] or left):
                if a == run[0]:
                    run[2] = run[2] and left
                if b == run[1]:
                    run[3] = run[3] and right
                elif b > run[1]:
                    run[1], run[3] = b, right
                run[4], run[5], run[6] = run[4] + score * (b - a), run[5] + b - a, run[6] + 1
                continue
            if run and run[6] > 1 and not (run[2] or run[3]):
                out.append((run[0], run[1], kind, run[4] / run[5]))
            run = [a, b, left, right, score * (b - a), b - a, 1]
    return out


def reconcile(found: list[tuple[int, int, str, float]]) -> list[tuple[int, int, str, float]]:
    """Of overlapping spans of all windows those of the greatest total score (weighted interval scheduling)."""
    unique: dict[Span, float] = {}
    for a, b, k, s in found:
        unique[a, b, k] = max(s, unique.get((a, b, k), 0.0))
    items = sorted((*key, s) for key, s in unique.items())
    items.sort(key=lambda x: (x[1], x[0], x[2]))
    ends = [x[1] for x in items]
    total, take = [0.0], []
    for i, (a, b, _, s) in enumerate(items):
        j = bisect_right(ends, a, 0, i)
        with_it = total[j] + s * (b - a)
        take.append(with_it > total[i])
        total.append(max(total[i], with_it))
    out, i = [], len(items)
    while i:
        if take[i - 1]:
            out.append(items[i - 1])
            i = bisect_right(ends, items[i - 1][0], 0, i - 1)
        else:
            i -= 1
    return out[::-1]


# labelled spans for training ------------------------------------------------------------------------------------


def _name(rng: random.Random, words: list[str]) -> str:
    """A word of the corpus, or letters at random."""
    if words and rng.random() < 0.6:
        return rng.choice(words)
    return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))


def _made_up(rng: random.Random, words: list[str]) -> tuple[str, str]:
    """A kind and a made-up instance, in spellings that the base patterns find or miss."""
    num = lambda a, b: str(rng.randint(a, b))
    name = lambda: _name(rng, words)
    kind = rng.choice(["email", *KINDS])  # addresses have the most spellings
    if kind == "email":
        at, dot = rng.choice([("@", "."), ("@", "."), (" [at] ", " [dot] "), ("[at]", "[dot]"), (" (at) ", " (dot) "), (" [at] ", "."), (" at ", " dot "), (" at ", " dot "), (" {at} ", "."), (" <at> ", "."), ("{at}", "{dot}"), ("<at>", " <dot> ")])
        host = dot.join([name() + rng.choice(["", num(1, 9)])] + [name() for _ in range(rng.randint(0, 1))] + [rng.choice(["com", "org", "net", "de", "fr"])])
        return kind, name() + rng.choice(["", "." + num(1, 99), "_" + name()]) + at + host
    if kind == "ip":
        return kind, ".".join(num(0, 255) for _ in range(4))
    if kind == "card":
        while True:
            d = "".join(rng.choice("0123456789") for _ in range(rng.choice([14, 15, 16, 16, 16, 19])))
            if luhn(d):
                break
        sep = rng.choice(["", "", " ", "-", ".", "/"])
        return kind, sep.join(d[i : i + 4] for i in range(0, len(d), 4)) if sep else d
    a, b, c = num(200, 999), num(200, 999), num(1000, 9999)
    return kind, rng.choice([f"+1 ({a}) {b}-{c}", f"+1 {a} {b} {c}", f"+{num(20, 99)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"001 {a} {b} {c}"])


def _decoy(rng: random.Random, words: list[str]) -> str:
    """Digits that are no personal data."""
    hexa = "".join(rng.choice("0123456789abcdef") for _ in range(rng.randint(8, 40)))
    name = lambda: _name(rng, words)
    return rng.choice([f"{name()} at {name()} {name()}", f"{name()} {name()} at {name()}.", f'token = "{hexa}"', f"password={hexa}", "AKIA" + "".join(rng.choice("ABCDEFGHIJ234567KLMNOP") for _ in range(16)), f"version {rng.randint(1, 9)}.{rng.randint(0, 9)}", f"CC BY-NC {rng.randint(1, 4)}.0", str(rng.randint(0, 99999)), f"{rng.randint(1900, 2099)}-{rng.randint(1, 12)}-{rng.randint(1, 28)}", f"#{rng.randint(1, 999)}", hexa])


def _tags(length: int, spans: list[Span]) -> np.ndarray:
    y = np.zeros(length, np.int64)
    for a, b, k in spans:
        if b <= length:
            y[a:b] = 2 + 2 * KINDS.index(k)
            y[a] -= 1
    return y


def training_windows(texts: list[str], made_up: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Windows with tags: of the whole of ``texts`` by the base patterns (of windows without anything an eighth), and ``made_up`` ones with
    inserted instances or decoys."""
    rng, xs, ys = random.Random(seed), [], []
    for text in texts:
        spans = base_spans(text)
        for i, s in enumerate(range(0, max(1, len(text) - SHORT + SHORT_STRIDE), SHORT_STRIDE)):
            if i % 8 and not _TRIGGER.search(text, s, s + SHORT):
                continue
            own = [(a - s, b - s, k) for a, b, k in spans if a >= s and b <= s + SHORT]
            cut = any(a < s + SHORT and b > s and not (a >= s and b <= s + SHORT) for a, b, _ in spans)
            if not cut:
                xs.append(_short_window(text, s))
                ys.append(_tags(SHORT, own))
    carriers = texts or ["lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor"]
    words = sorted({w for t in carriers for w in t.lower().split() if w.isalpha() and len(w) < 12})
    for _ in range(made_up):
        text = rng.choice(carriers)
        at = rng.randrange(max(1, len(text) - SHORT))
        line = _TRIGGER.sub("", text[at : at + SHORT])
        put = rng.randrange(0, 60)
        head = line[:put].rpartition(" ")[0]
        head = head + " " if head else ""
        if rng.random() < 0.65:
            kind, what = _made_up(rng, words)
            spans = [(len(head), len(head) + len(what), kind)]
        else:
            what, spans = _decoy(rng, words), []
        end = SHORT if rng.random() < 0.5 else rng.randint(0, 40)  # a short text is a window that ends early
        whole = (head + what + rng.choice([" ", ". ", ", ", "\n"]) + line[put : put + end])[:SHORT]
        if all(b <= len(whole) for _, b, _ in spans):
            xs.append(_short_window(whole, 0))
            ys.append(_tags(SHORT, spans))
    return np.array(xs).reshape(-1, SHORT), np.array(ys).reshape(-1, SHORT)


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample_rows: int = 400, made_up: int = 2_500) -> BiLstmCrf:
    """Fit on at most ``sample_rows`` whole texts with a trigger (smallest hashed ids), labelled by the base patterns, and
    ``made_up`` made-up windows."""
    every = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t"))
    part = bounded_sample(every, "doc_id", sample_rows, over=16, where=F.col("t").rlike(TRIGGER))
    texts = sorted(r.t for r in part.collect())
    return BiLstmCrf().fit(*training_windows(texts, made_up), epochs=10)


def added_spans(texts: list[str], bases: list[list[Span]], model: BiLstmCrf, least: float) -> list[list[Span]]:
    """What the network adds to the base spans of each text."""
    found: list[list[tuple[int, int, str, float, bool, bool]]] = [[] for _ in texts]
    held: dict[int, tuple[list, list, list]] = {}  # width: windows, and for each its text and its start

    def run() -> None:
        for xs, owner, starts in held.values():
            for j, spans in model.spans(np.concatenate(xs)):
                i, s = owner[j], starts[j]
                n = len(texts[i])
                for a, b, kind, score in spans:
                    if s + a < n:
                        b = min(b, n - s)
                        found[i].append((s + a, s + b, kind, score, a == 0 and s > 0, b == WINDOW and s + b < n))
        held.clear()

    waiting = 0
    for i, t in enumerate(texts):
        if t:
            first = 0
            for x in text_windows(t):
                xs, owner, starts = held.setdefault(x.shape[1], ([], [], []))
                xs.append(x)
                owner += [i] * len(x)
                starts += range(first, first + len(x) * STRIDE, STRIDE)
                first += len(x) * STRIDE
                waiting += x.size
            if waiting >= 2 * RUN:
                run()
                waiting = 0
    run()
    out = []
    for text, base, own in zip(texts, bases, found, strict=True):
        taken = merged(base)
        ends = [b for _, b, _ in taken]
        clear = lambda a, b, taken=taken, ends=ends: (i := bisect_right(ends, a)) == len(taken) or taken[i][0] >= b
        free = [x for x in joined(own) if x[3] >= least and clear(x[0], x[1]) and valid(x[2], text[x[0] : x[1]])]
        out.append([(a, b, k) for a, b, k, _ in reconcile(free)])
    return out


def find_pii(docs: DataFrame, model: BiLstmCrf, text: str = "text", least: float = 0.8) -> DataFrame:
    """Append ``base`` and ``added``: arrays of (kind, start, end) with code points, end exclusive, by start, then kind.

    Null and empty texts have no spans. Rows, repeated ones too, and other columns stay; input columns named ``base`` or ``added``
    are replaced. An empty table gives an empty table. The whole of every text is read by the network, of any length: a text is
    held in memory once, its windows in runs of bounded size, and spans that no window holds whole are joined from their pieces.
    """
    kept = [c for c in docs.columns if c not in ("base", "added")]
    given = fresh_name([*kept, "base", "added"])
    packed = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))  # a few thousand numbers
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def rows(spans: list[list[Span]]) -> pa.Array:
        return pa.array([[{"kind": k, "start": a, "end": b} for a, b, k in s] for s in spans], kind)

    def tagged(batches) -> Iterator[pa.RecordBatch]:
        own: BiLstmCrf = pickle.loads(packed.value)
        for batch, texts in text_batches(batches, RUN, given):
            whole = [t or "" for t in texts]
            bases = [base_spans(t) if t else [] for t in whole]
            yield with_columns(batch, [given], base=rows(bases), added=rows(added_spans(whole, bases, own, least)))

    return docs.select(*kept, F.col(text).alias(given)).mapInArrow(tagged, fields(docs.select(*kept)) + "base array<struct<kind:string,start:bigint,end:bigint>>, added array<struct<kind:string,start:bigint,end:bigint>>")


def redact(docs: DataFrame, model: BiLstmCrf, text: str = "text", least: float = 0.8) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in angle brackets; of overlapping spans the
    earliest (then longest) gives the name of the whole run. Null texts stay null; all columns and rows stay, in order."""
    packed = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def clean(batches) -> Iterator[pa.RecordBatch]:
        own: BiLstmCrf = pickle.loads(packed.value)
        for batch, texts in text_batches(batches, RUN, text):
            at = [i for i, t in enumerate(texts) if t]
            whole = [texts[i] for i in at]
            bases = [base_spans(t) for t in whole]
            for i, base, more in zip(at, bases, added_spans(whole, bases, own, least), strict=True):
                texts[i] = replaced(texts[i], [*base, *more])
            columns = [pa.array(texts, pa.string()) if n == text else batch.column(n) for n in batch.schema.names]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(clean, docs.schema)


def merged(spans: list[Span]) -> list[Span]:
    """Runs of overlapping spans, in order; the earliest (then longest) of a run gives its kind."""
    runs: list[Span] = []
    for a, b, k in sorted(spans, key=lambda s: (s[0], -s[1], KINDS.index(s[2]))):
        if runs and a < runs[-1][1]:
            runs[-1] = (runs[-1][0], max(b, runs[-1][1]), runs[-1][2])
        else:
            runs.append((a, b, k))
    return runs


def replaced(text: str, spans: list[Span]) -> str:
    out, end = [], 0
    for a, b, k in merged(spans):
        out += [text[end:a], f"<{k}>"]
        end = b
    return "".join([*out, text[end:]])
