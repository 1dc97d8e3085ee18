"""BPE encoding by forced boundaries, and decoding.

A pair of bytes that stands next to each other inside no vocabulary token can never be bridged by a
merge: between such bytes the text is cut for certain. White space and the borders of the model's
pre-tokens are such cuts, and inside a pre-token every impossible pair is one. The fragments are encoded
independently and the ids put behind each other. Each worker keeps a bounded cache of chunks.

Decoding knows nothing of the text: it looks the ids up in the vocabulary.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fields, fresh_name, resolve_vocabulary, text_batches, with_columns

MODEL = "word_bpe_49k.json"


class Codec:
    """Encoder and decoder of one worker for a BPE vocabulary whose words end with a suffix."""

    def __init__(self, model: str = MODEL, cache: int = 300_000):
        import regex
        from tokenizers import Tokenizer, models

        path = resolve_vocabulary(model)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        bpe = spec["model"]
        self.suffix = bpe["end_of_word_suffix"] or ""
        if bpe["type"] != "BPE" or spec["decoder"] or spec["post_processor"]:
            raise ValueError(f"{model}: only BPE vocabularies without decoder and post-processor")
        library = Tokenizer.from_file(path)
        self.normalize, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in bpe["merges"]]
        # the suffix belongs to a word's end; fragments in front of it are encoded without
        self.last = models.BPE(vocab=bpe["vocab"], merges=merges, end_of_word_suffix=self.suffix)
        self.inner = models.BPE(vocab=bpe["vocab"], merges=merges)
        self.names = {i: t for t, i in bpe["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_re = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        #: Adjacent characters (each one byte in the vocabulary's alphabet) inside some token.
        bodies = [t.removesuffix(self.suffix) for t in bpe["vocab"]]
        self.joined = {p for t in bodies for p in zip(t, t[1:], strict=False)}
        #: Text below U+0250 is its own NFC form: lower case and the model's own pattern do what the library does.
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words_of, self.simple = regex.compile(pattern).findall, re.compile("[\x00-\u024f]*").fullmatch
        self.alphabet = _byte_alphabet()
        self.words, self.chunks, self.most = {}, {}, cache

    def fragments(self, word: str) -> list[str]:
        """``word`` cut at every pair of bytes that no token holds."""
        if self.joined.issuperset(zip(word, word[1:], strict=False)):
            return [word]
        cuts = [i + 1 for i in range(len(word) - 1) if (word[i], word[i + 1]) not in self.joined]
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)], strict=True)]

    def _word(self, word: str) -> bytes:
        """Ids (as bytes of int32) of one pre-token in the vocabulary's alphabet."""
        made = self.words.get(word)
        if made is None:
            *inner, last = self.fragments(word)
            found = [t for f in inner for t in self.inner.tokenize(f)] + self.last.tokenize(last)
            made = array("i", [t.id for t in found]).tobytes()
            if len(word) <= 64:
                if len(self.words) >= self.most:
                    self.words.clear()
                self.words[word] = made
        return made

    def _plain(self, text: str) -> list[bytes]:
        if self.simple(text):
            words = self.words_of(text.lower())
            if not (text.isascii() and text.isprintable()):
                words = [w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(self.alphabet) for w in words]
            return [self._word(w) for w in words]
        return [self._word(w) for w, _ in self.split(self.normalize(text))]

    def chunk(self, chunk: str) -> bytes:
        """Ids of a run without spaces and line feeds."""
        parts: list[bytes] = []
        for part in self.special_re.split(chunk) if self.special_re and "<" in chunk else [chunk]:
            if part in self.special:
                parts.append(array("i", [self.special[part]]).tobytes())
            elif part:
                parts += self._plain(part)
        made = parts[0] if len(parts) == 1 else b"".join(parts)
        if len(chunk) <= 64:
            if len(self.chunks) >= self.most:
                self.chunks.clear()
            self.chunks[chunk] = made
        return made

    def encode(self, text: str) -> bytes:
        """Ids of a text, as bytes of int32."""
        known, parts = self.chunks, []
        for c in text.replace("\n", " ").split(" "):
            if c:
                made = known.get(c)
                parts.append(self.chunk(c) if made is None else made)
        return b"".join(parts)

    def decode(self, ids: Iterable[int]) -> str:
        """As the library decodes a vocabulary without decoder: the tokens, one space between them; ids it does not have are left out."""
        ids = list(ids)
        try:
            return " ".join(map(self.names.__getitem__, ids))
        except KeyError:
            return " ".join([self.names[i] for i in ids if i in self.names])


def _byte_alphabet() -> dict[int, str]:
    """The characters that stand for bytes: printable Latin-1 for itself, all others from U+0100 on, in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def encode_decode(docs: DataFrame, text: str = "text", model: str = MODEL, cache: int = 300_000) -> DataFrame:
    """Append ``ids`` (array<int>) and ``decoded`` (string), which is decoded from the ids alone; ``text`` goes.

    Null and empty texts: no ids and an empty string. Rows, repeated ones too, and other columns stay; input columns named
    ``ids`` or ``decoded`` are replaced. An empty table gives an empty table. Texts of any length are encoded whole; ids and
    tokens of one are held in memory at once.
    """
    kept = [c for c in docs.columns if c not in (text, "ids", "decoded")]
    given = fresh_name([*kept, "ids", "decoded"])

    def coded(batches):
        codec = Codec(model, cache)
        for batch, texts in text_batches(batches, name=given):
            made = [np.frombuffer(codec.encode(t or ""), np.int32) for t in texts]
            offsets = np.zeros(len(made) + 1, np.int32)
            np.cumsum([len(i) for i in made], out=offsets[1:])
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(made)))
            yield with_columns(batch, [given], ids=ids, decoded=pa.array([codec.decode(i.tolist()) for i in made], pa.string()))

    return docs.select(*kept, F.col(text).alias(given)).mapInArrow(coded, fields(docs.select(*kept)) + "ids array<int>, decoded string")
