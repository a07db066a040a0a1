"""Ids of whole texts with a public tokenizer file, encoding each distinct stretch of text once.

A stretch is a run of ASCII white space with the run of other characters after it. Where a text
has no other white space, both kinds of vocabulary file split at every stretch's start whatever
stands around it: white space before a word never joins the word before, and look-ahead beyond
a run of other characters only sees the white space that follows. So the ids of a text are those
of its stretches, one after the other. A text with any other white space is encoded whole.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterable
from contextlib import suppress
from functools import lru_cache

STRETCH = re.compile(rb"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
#: Characters that are white space but not ASCII, and controls some libraries count as such.
OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")
LATIN = re.compile("[\x00-\u012f\u0131-\u024f]*")
ASCII_CONTROL = re.compile(rb"[\x1c-\x1f]")
#: tiktoken's word pattern keeps a state for each character of a run of white space, and raises on a run of about a million.
LONG_SPACE = 100_000
LONG_RUN = re.compile(rf"(?<!\s)\s{{{LONG_SPACE}}}")


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """The file's tokenizer, without truncation or padding; loaded once a worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


def library_ids(path: str) -> Callable[[list[str]], list[bytes]]:
    """Ids as the library gives them, each text's as little-endian unsigned 32-bit integers."""
    library = tokenizer(path)

    def ids(texts: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in library.encode_batch_fast(texts, add_special_tokens=False)]

    return ids


class Memory(dict):
    """Ids of stretches, made when first asked for.

    There are two generations: a full one becomes the old one, and what is met again moves over,
    so common stretches stay. The size changes the time only.
    """

    def __init__(self, encode: Callable[[bytes], bytes]):
        self.encode, self.old = encode, {}

    def __missing__(self, stretch: bytes) -> bytes:
        ids = self.old.get(stretch)
        if ids is None:
            ids = self.encode(stretch)
        self[stretch] = ids
        return ids


class Stretches:
    """Encode texts through a bounded memory of stretches.

    ``encode`` gives the ids of one stretch, ``whole`` those of a text that may not be split.
    """

    def __init__(self, encode: Callable[[bytes], bytes], whole: Callable[[str], bytes], split: Callable[[bytes], list[bytes]] = STRETCH.findall, most: int = 200_000):
        self.encode, self.whole, self.split, self.most = encode, whole, split, most
        self.known = Memory(encode)

    def ids(self, texts: Iterable[bytes]) -> list[bytes]:
        """The ids of each text given in UTF-8, as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        for text in texts:
            if ASCII_CONTROL.search(text) if text.isascii() else OTHER_SPACE.search(text.decode()):
                out.append(self.whole(text.decode()))
                continue
            if len(self.known) > self.most:
                fresh = Memory(self.encode)
                fresh.old, self.known.old = self.known, {}
                self.known = fresh
            out.append(b"".join(map(self.known.__getitem__, self.split(text))))
        return out


def _one(path: str, pattern: str, lower: bool) -> Callable[[bytes], bytes]:
    """Ids of a stretch: Latin text goes straight to the library's merging model, word by word.

    Up to U+024F there is nothing to compose, and lower case is one character for one (but for
    U+0130, which is left to the library like all characters beyond and special strings).
    """
    import regex

    library = tokenizer(path)
    merge, split, split_latin = library.model.tokenize, re.compile(pattern, re.ASCII).findall, regex.compile(widened(pattern)).findall
    shown = {b: c for c, b in byte_characters().items()}

    def ids(stretch: bytes) -> bytes:
        text = stretch.decode()
        if b"<|" in stretch or not LATIN.fullmatch(text):
            return array("I", library.encode(text, add_special_tokens=False).ids).tobytes()
        if lower:
            text = text.lower()
        if text.isascii():
            return array("I", [t.id for word in split(text) for t in merge(word.translate(shown))]).tobytes()
        return array("I", [t.id for word in split_latin(text) for t in merge("".join([shown[b] for b in word.encode()]))]).tobytes()

    return ids


def widened(pattern: str) -> str:
    """A pattern for ASCII text with its letters and digits widened to all letters and numbers."""
    return pattern.replace("A-Za-z", r"\p{L}").replace("a-z", r"\p{L}").replace("0-9", r"\p{N}")


def byte_characters() -> dict[str, int]:
    """The byte each character of a byte-level vocabulary stands for: printable ones for themselves, the rest counted up from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


#: How the byte-level file splits text into words before any merge, and how the two files split ASCII text.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BYTE_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"
LOWER_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+"


@lru_cache(maxsize=4)
def stretches(path: str) -> Stretches:
    """For a byte-level file, which keeps white space."""
    whole = library_ids(path)
    return Stretches(_one(path, BYTE_WORDS, lower=False), lambda x: whole([x])[0])


@lru_cache(maxsize=4)
def words(path: str) -> Stretches:
    """For a file that lower-cases and drops white space: the stretches are words."""
    whole = library_ids(path)
    return Stretches(_one(path, LOWER_WORDS, lower=True), lambda x: whole([x])[0], bytes.split)


@lru_cache(maxsize=2)
def second_library(path: str):
    """The same byte-level file in the tiktoken library, and a search for characters it may split in another way.

    tiktoken merges by the same ranks, several times as fast; only the Unicode tables behind the
    word pattern could differ. So each character up to U+24FF is tried here in both libraries, beside letters,
    digits, signs and spaces; a text with a character that failed, or one beyond, is left to
    tokenizers.
    """
    import json

    import tiktoken

    library = tokenizer(path)
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    byte_of = byte_characters()
    ranks = {bytes(byte_of[c] for c in name): i for name, i in spec["model"]["vocab"].items()}
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    other = tiktoken.Encoding(path, pat_str=WORDS, mergeable_ranks=ranks, special_tokens=special)
    tried = [chr(c) for c in range(0x2500)]
    trials = [f"a{c}b1{c}2 {c} {c}{c}.{c}, {c}\n{c}" for c in tried]
    alike = [c for c, x, e in zip(tried, trials, library.encode_batch_fast(trials, add_special_tokens=False)) if other.encode(x, allowed_special="all") == e.ids]
    cuts, good = [], set(map(ord, alike))
    for c in sorted(good):
        if c - 1 in good:
            cuts[-1][1] = c
        else:
            cuts.append([c, c])
    unsure = re.compile("[^" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in cuts) + "]")
    return other, unsure


def fast_ids(path: str) -> Callable[[Iterable[bytes]], list[bytes]]:
    """Ids of whole texts as the tokenizers library gives them for a byte-level file, of any length."""
    whole = library_ids(path)
    other, unsure = second_library(path)

    def ids(texts: Iterable[bytes]) -> list[bytes]:
        out = []
        for x in texts:
            text = x.decode()
            found = None
            if not unsure.search(text) and not (len(text) >= LONG_SPACE and LONG_RUN.search(text)):
                with suppress(ValueError):  # what it can't take is left to tokenizers
                    found = other.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False).tobytes()
            out.append(whole([text])[0] if found is None else found)
        return out

    return ids
