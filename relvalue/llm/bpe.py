"""Exact byte-pair encoding in linear time, and decoding through an offset table.

The encoder walks a word from left to right. At each place it takes the longest vocabulary entry
found there (Aho-Corasick) that merging would leave standing next to the entry before it; if none
does, it gives up the entry before and tries a shorter one there. Places that were given up are
not tried again, so the walk is linear. Whether two entries stand next to each other is a pure
function of the pair: it replays both entries' merges backwards and looks for a merge across the
border that would have come first. Answers are kept in a compatibility table.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from relvalue.llm.arrow import column, portions, ranges, strings
from relvalue.llm.encoding import BYTE_WORDS, WORDS, Stretches, byte_characters

MOST_PAIRS = 500_000
MOST_WORDS = 200_000


class Bpe:
    """A byte-level vocabulary with its merges, read from a tokenizers file."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        byte_of = byte_characters()
        raw = lambda name: bytes(byte_of[c] for c in name)
        self.tokens = token_bytes(spec)
        self.vocab = {self.tokens[i]: i for i in spec["model"]["vocab"].values()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        n = len(self.tokens)

        self.merge: dict[int, int] = {}
        self.made, self.left, self.right = [-1] * n, [0] * n, [0] * n
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = (self.vocab[raw(x)] for x in (pair if isinstance(pair, list) else pair.split(" ")))
            whole = self.vocab[self.tokens[a] + self.tokens[b]]
            self.merge[a << 32 | b] = rank
            if self.made[whole] < 0:
                self.made[whole], self.left[whole], self.right[whole] = rank, a, b

        self.shorter = [-1] * n  # the longest entry that is a proper start of this one
        finder = ahocorasick.Automaton()
        for text, i in self.vocab.items():
            finder.add_word(text.decode("latin-1"), i)
            self.shorter[i] = next((self.vocab[text[:k]] for k in range(len(text) - 1, 0, -1) if text[:k] in self.vocab), -1)
        finder.make_automaton()
        self.finder, self.sizes = finder, [len(x) for x in self.tokens]
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.split, self.split_ascii = regex.compile(WORDS).findall, re.compile(BYTE_WORDS, re.ASCII).findall
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging leaves ``a`` and ``b`` standing side by side."""
        key = a << 32 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= MOST_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._stand(a, b)
        return known

    def _stand(self, a: int, b: int) -> bool:
        merge, made = self.merge, self.made
        before = 1 << 60  # merges of a rank from here on come too late to matter
        while True:
            if merge.get(a << 32 | b, before) < before:
                return False
            if made[a] > made[b]:
                # the border merge must come before a's own; at the same rank a, further left, goes first
                before, a = made[a], self.right[a]
            elif made[b] >= 0:
                # at the same rank the border, further left, goes first
                before, b = made[b] + 1, self.left[b]
            else:
                return True

    def word(self, text: bytes) -> list[int]:
        """The ids of one word."""
        shown = text.decode("latin-1")
        # entries that cover the word and all stand side by side are its one encoding, however they were found
        out = [i for _, i in self.finder.iter_long(shown)]
        compatible, sizes = self.compatible, self.sizes
        if sum([sizes[i] for i in out]) == len(text) and all(map(compatible, out, out[1:])):
            return out
        return self._walk(text, shown)

    def _walk(self, text: bytes, shown: str) -> list[int]:
        size = len(text)
        longest = [-1] * size
        sizes, shorter, compatible = self.sizes, self.shorter, self.compatible
        for end, i in self.finder.iter(shown):
            longest[end - sizes[i] + 1] = i  # ends come in order, so the longest stays
        open_at = bytearray(b"\x01") * (size + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < size:
            last = out[-1] if out else -1
            while token >= 0 and not (open_at[at + sizes[token]] and (last < 0 or compatible(last, token))):
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += sizes[token]
                token = longest[at] if at < size else -1
            elif out:
                open_at[at] = 0
                last = out.pop()
                at -= sizes[last]
                token = shorter[last]
            else:
                raise ValueError("the vocabulary lacks a byte of this text")
        return out

    def encode(self, text: str) -> bytes:
        """The ids of a text, as little-endian unsigned 32-bit integers."""
        parts = self.at_special.split(text) if self.at_special else [text]
        out = []
        for part in parts:
            if part in self.special:
                out.append(np.array([self.special[part]], "<u4").tobytes())
                continue
            for word in (self.split_ascii if part.isascii() else self.split)(part):
                ids = self.words.get(word)
                if ids is None:
                    if len(self.words) >= MOST_WORDS:
                        self.words.clear()
                    ids = self.words[word] = array("I", self.word(word.encode())).tobytes()
                out.append(ids)
        return b"".join(out)


def token_bytes(spec: dict) -> list[bytes]:
    """The bytes of each id of a tokenizers file."""
    byte_of = byte_characters()
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    out = [b""] * (1 + max([*spec["model"]["vocab"].values(), *special.values()]))
    for name, i in spec["model"]["vocab"].items():
        out[i] = bytes(byte_of[c] for c in name)
    for name, i in special.items():
        out[i] = name.encode()
    return out


@lru_cache(maxsize=2)
def codec_table(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Where each id's bytes start, with the end of the last, and all ids' bytes in a row."""
    with open(path, encoding="utf-8") as file:
        tokens = token_bytes(json.load(file))
    return np.r_[0, np.cumsum([len(x) for x in tokens])], np.frombuffer(b"".join(tokens), np.uint8)


def decode_ids(ids: np.ndarray, offsets: np.ndarray, joined: np.ndarray) -> str:
    """The text of ``ids``; bytes that are no UTF-8 become replacement characters."""
    ids = ids.astype(np.int64)
    starts = offsets[ids]
    lengths = offsets[ids + 1] - starts
    return joined[np.repeat(starts, lengths) + ranges(lengths)].tobytes().decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> tuple[Bpe, Stretches]:
    made = Bpe(path)
    return made, Stretches(lambda x: made.encode(x.decode()), made.encode, most=150_000)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit integers) for each row of ``docs`` (doc_id, text).

    A null or empty text has no ids. Repeated rows and null ids each keep their row; other
    columns are ignored. ``path`` is a byte-level file at the same place on every machine.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, stretches = codec(path)
        for batch in portions(batches, "text"):
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(stretches.ids(strings(column(batch, "text"))), pa.binary())], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary")


def decode(encoded: DataFrame, path: str, describe: Callable[[bytes, str], tuple] | None = None, columns: str = "ids binary, text string") -> DataFrame:
    """doc_id and ``columns`` for each row of ``encoded`` (doc_id, ids): its ids and text, or what ``describe`` makes of them.

    Null ids count as none.
    """
    names = ["doc_id", *(x.split()[0] for x in columns.split(", "))]
    types = [{"binary": pa.binary(), "string": pa.string(), "long": pa.int64()}[x.split()[1]] for x in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        offsets, joined = codec_table(path)
        for batch in portions(batches, "ids"):
            rows = []
            for ids in column(batch, "ids").to_pylist():
                text = decode_ids(np.frombuffer(ids or b"", "<u4"), offsets, joined)
                rows.append(describe(ids or b"", text) if describe else (ids or b"", text))
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), *(pa.array(x, t) for x, t in zip(zip(*rows), types))], names)

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, {columns}")


def digests(ids: bytes, text: str) -> tuple[int, str, str]:
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest()
