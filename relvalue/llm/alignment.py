"""Alignment of the tokens of two tokenizers, by divide and conquer at shared cuts.

A cut is a byte offset where a token of both ends. An interval is divided at a cut near its middle, found by
bisecting the other tokenizer's ends, and both halves likewise; an interval without a cut inside is a
group. All documents of a batch are divided at once, level by level.

How often ids are linked corpus-wide takes two passes. The first writes each document's groups and its linked pairs of
ids; their sums give each pair's count and each id's best count. The second looks the pairs of the documents up
in that table, a bounded part of the table at a time.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from contextlib import suppress
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relvalue.llm.arrow import column, portions, ranges, strings
from relvalue.llm.encoding import LONG_RUN, LONG_SPACE, byte_characters, second_library
from relvalue.llm.scratch import Scratch

SPACE_MARK = "▁"
#: Longer texts are encoded in parts of at least so many characters, each up to a place where both tokenizers end a token.
PART_CHARS = 1 << 16
PART_END = re.compile(r"(?<=[!-~])(?= )")
#: Pairs of ids in a part of the table of counts: 34 MB in a worker.
PART_PAIRS = 2_000_000
_SHIFT = 32  # a pair of ids is A's, shifted, and B's


def cut_groups(ends_a: np.ndarray, ends_b: np.ndarray, from_: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Places in ``ends_a`` (ascending) of all groups' last tokens, ascending.

    Intervals go from ``from_`` to ``to`` (places in ``ends_a``), each ending at a cut. Near the middle means: within
    a reach that doubles until it holds a cut or is the whole interval.
    """

    def is_cut(places: np.ndarray) -> np.ndarray:
        at = np.searchsorted(ends_b, ends_a[places])
        return ends_b[np.minimum(at, len(ends_b) - 1)] == ends_a[places]

    done = [np.zeros(0, np.int64)]
    low, high, reach = from_.astype(np.int64), to.astype(np.int64), np.zeros(len(from_), np.int64)
    while len(low):
        # An interval low..high has its last token at high; a cut inside lies in low..high - 1.
        middle = (low + high - 1) // 2
        left, right = np.maximum(low, middle - reach), np.minimum(high - 1, middle + reach)
        sizes = np.maximum(right - left + 1, 0)
        places = np.repeat(left, sizes) + ranges(sizes)
        owner = np.repeat(np.arange(len(low)), sizes)
        cut = is_cut(places)
        places, owner = places[cut], owner[cut]
        order = np.lexsort((np.abs(places - middle[owner]), owner))
        owner, nearest = np.unique(owner[order], return_index=True)
        cuts = places[order][nearest]
        divided = np.zeros(len(low), bool)
        divided[owner] = True
        whole = ~divided & (left <= low) & (right >= high - 1)
        done.append(high[whole])
        wider = ~divided & ~whole
        low, high, reach = (
            np.concatenate([low[owner], cuts + 1, low[wider]]),
            np.concatenate([cuts, high[owner], high[wider]]),
            np.concatenate([np.zeros(2 * len(owner), np.int64), np.maximum(1, 2 * reach[wider])]),
        )
    return np.sort(np.concatenate(done))


def parts(text: str) -> list[str]:
    """A text in parts of PART_CHARS or a little more, cut where a space follows an ASCII character that is none.

    A never joins white space to what is before it, nor looks beyond a run of other characters; no piece of B holds a space mark
    behind another character (checked when the file is loaded). So the ids of the text are those of its parts.
    """
    out, at = [], 0
    while len(text) - at > PART_CHARS:
        cut = PART_END.search(text, at + PART_CHARS)
        if cut is None:
            break
        out.append(text[at : cut.start()])
        at = cut.start()
    return [*out, text[at:]]


class Encoders:
    """Ids of texts, with a space before, under both files, and the bytes of each id.

    A's ids are those of the tokenizers library; where ``second_library`` found that the same file in the faster library
    splits a text's characters alike, they are made there.
    """

    def __init__(self, byte_file: str, piece_file: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(byte_file)
        self.library.no_truncation()
        self.library.no_padding()
        self.library.encode_special_tokens = True
        self.fast, self.unsure = second_library(byte_file)
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_file)
        byte_of = byte_characters()
        with open(byte_file, encoding="utf-8") as file:
            spec = json.load(file)
        vocabulary = {i: bytes(byte_of[c] for c in name) for name, i in spec["model"]["vocab"].items()}
        self.bytes_a = [vocabulary.get(i, b"") for i in range(self.library.get_vocab_size())]
        names = [self.pieces.id_to_piece(i) for i in range(len(self.pieces))]
        if any(SPACE_MARK in x.lstrip(SPACE_MARK) for x in names):
            raise ValueError("a piece holds a space behind another character")
        self.bytes_b = [bytes([int(x[3:5], 16)]) if self.pieces.is_byte(i) else x.replace(SPACE_MARK, " ").encode() for i, x in enumerate(names)]
        self.lone_space = [self.pieces.piece_to_id(SPACE_MARK)]
        self.lengths_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.lengths_b = np.array([len(x) for x in self.bytes_b], np.int64)

    def _a(self, text: str) -> list[int]:
        if not self.unsure.search(text) and not (len(text) >= LONG_SPACE and LONG_RUN.search(text)):
            with suppress(ValueError):  # what it can't take is left to tokenizers
                return self.fast.encode_ordinary(text)
        return self.library.encode(text, add_special_tokens=False).ids

    def ids(self, text: bytes) -> tuple[list[int], list[int]]:
        """Ids under A and B; none for a text that is empty or that either does not give back."""
        if not text:
            return [], []
        spaced = b" " + text
        some = parts(spaced.decode())
        a = list(chain.from_iterable(map(self._a, some)))
        # B puts a space before what it is given, and nothing before an empty text
        b = list(chain.from_iterable(self.pieces.encode(x[1:]) if len(x) > 1 else self.lone_space for x in some))
        if b"".join(map(self.bytes_a.__getitem__, a)) != spaced or b"".join(map(self.bytes_b.__getitem__, b)) != spaced:
            return [], []
        return a, b


@lru_cache(maxsize=2)
def encoders(byte_file: str, piece_file: str) -> Encoders:
    return Encoders(byte_file, piece_file)


@lru_cache(maxsize=2)
def _decimals(size: int, *ends: bytes) -> np.ndarray:
    """Each id below ``size`` as decimal text with each of the two characters that may follow it."""
    out = np.empty(2 * size, object)
    out[:] = [b"%d%s" % (i, end) for i in range(size) for end in ends]
    return out


def _bounds(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)])


def links(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens (places on either side) that overlap: one pair for each stretch between neighbouring ends of either side."""
    both = np.concatenate([ends_a, ends_b])
    order = np.argsort(both, kind="stable")  # A's end before an equal one of B
    both, of_a = both[order], order < len(ends_a)
    seen_a = np.cumsum(of_a)
    again = np.concatenate([[False], both[1:] == both[:-1]])[: len(both)]
    last = np.concatenate([~again[1:], [True]])[: len(both)]
    at = np.flatnonzero(last)
    # Ends before the one at hand: its own does not count.
    return seen_a[at] - (of_a | again)[at], (at + 1 - seen_a[at]) - ~of_a[at]


def _tallied(owner: np.ndarray, codes: np.ndarray, owners: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct codes of each owner, owner by owner, how often each occurs, and where each owner's begin."""
    order = np.lexsort((codes, owner))
    owner, codes = owner[order], codes[order]
    first = np.flatnonzero(np.concatenate([[True], (codes[1:] != codes[:-1]) | (owner[1:] != owner[:-1])])[: len(codes)])
    return codes[first], np.diff(np.concatenate([first, [len(codes)]])), np.searchsorted(owner[first], np.arange(owners + 1))


def _align(byte_file: str, piece_file: str):
    """Counts and digest of each document's groups, and its linked pairs of ids with how often they are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoders(byte_file, piece_file)
        text_a, text_b = _decimals(len(encode.bytes_a), b",", b"|"), _decimals(len(encode.bytes_b), b",", b";")
        for batch in portions(batches, "text", 1 << 20):
            found = [encode.ids(x) for x in strings(column(batch, "text"))]
            a, b = (np.fromiter(chain.from_iterable(f[i] for f in found), np.int64, sum(len(f[i]) for f in found)) for i in (0, 1))
            docs_a, docs_b = (_bounds(np.array([len(f[i]) for f in found], np.int64)) for i in (0, 1))
            # One axis of byte offsets for the whole batch: documents end at cuts.
            ends_a, ends_b = np.cumsum(encode.lengths_a[a]), np.cumsum(encode.lengths_b[b])
            full = docs_a[1:] > docs_a[:-1]
            last_a = cut_groups(ends_a, ends_b, docs_a[:-1][full], docs_a[1:][full] - 1)
            last_b = np.searchsorted(ends_b, ends_a[last_a])
            docs_g = np.searchsorted(last_a, docs_a)
            links_a, links_b = links(ends_a, ends_b)
            docs_l = np.searchsorted(links_a, docs_a)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(docs_l))
            codes, times, docs_p = _tallied(owner, a[links_a] << _SHIFT | b[links_b], batch.num_rows)
            # Groups as text: A's ids, a bar, B's ids, a semicolon; in that order by group.
            stop_a, stop_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
            stop_a[last_a], stop_b[last_b] = 1, 1
            sizes_a, sizes_b = (np.diff(np.concatenate([[-1], last])) for last in (last_a, last_b))
            shown = np.empty(len(a) + len(b), object)
            shown[np.arange(len(a)) + np.repeat(np.cumsum(sizes_b) - sizes_b, sizes_a)] = text_a[2 * a + stop_a]
            shown[np.arange(len(b)) + np.repeat(np.cumsum(sizes_a), sizes_b)] = text_b[2 * b + stop_b]
            digests = []
            for start, end in zip((docs_a + docs_b).tolist(), (docs_a + docs_b)[1:].tolist()):
                text = b"".join(shown[start:end].tolist())[:-1]
                digests.append(hashlib.sha256(text).hexdigest() if text else "")
            times = times.astype("<u4")
            of_docs = list(zip(docs_p.tolist(), docs_p[1:].tolist()))
            yield pa.RecordBatch.from_arrays(
                [column(batch, "key"), column(batch, "doc_id"), *(pa.array(np.diff(x), pa.int64()) for x in (docs_a, docs_b, docs_g, docs_l)),
                 pa.array(digests, pa.string()), *(pa.array([x[f:t].tobytes() for f, t in of_docs], pa.binary()) for x in (codes, times))],
                ["key", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "counts"],
            )

    return run


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.frombuffer(b"".join(column(batch, c).to_pylist()), kind) for c, kind in (("pairs", "<i8"), ("counts", "<u4")))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with their links, summed over a batch of documents."""
    for batch in portions(batches, "pairs", 16 << 20):
        pairs, n = _unpacked(batch)
        pairs, at = np.unique(pairs, return_inverse=True)
        sums = np.bincount(at, weights=n, minlength=len(pairs)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(sums)], ["pair", "n"])


def _looked_up(pairs: np.ndarray, n: np.ndarray, best: np.ndarray):
    """Each document's share of what a part of the table of counts says of its links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "pairs", 4 << 20):
            mine, links = _unpacked(batch)
            at = np.minimum(np.searchsorted(pairs, mine), max(0, len(pairs) - 1))
            held = np.where(pairs[at] == mine, links, 0).astype(np.int64)
            ends = _bounds(np.array([len(x) // 8 for x in column(batch, "pairs").to_pylist()], np.int64))
            total = lambda x: pa.array(np.diff(_bounds(x)[ends]))
            yield pa.RecordBatch.from_arrays([column(batch, "key"), total(held * best[at]), total(held * n[at])], ["key", "n_best", "count_sum"])

    return run


def align(docs: DataFrame, byte_file: str, piece_file: str, part_pairs: int = PART_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for each row of ``docs`` (doc_id, text; other columns are ignored).

    A and B are the ids of a space and the text under a byte-level tokenizers file and a sentencepiece file with byte fallback,
    strings of special tokens being plain text. Texts that are null, empty or not given back by both have no
    tokens: zeros and an empty digest. Repeated rows and null ids each keep their row and count each time. An empty table gives no rows.
    Both files are at the same place on every machine.
    """
    scratch = Scratch(docs.sparkSession, "alignment")
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("key"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = scratch.keep(rows.mapInArrow(
        _align(byte_file, piece_file),
        f"key long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, counts binary",
    ), "aligned")
    linked = found.where("n_links > 0").select("key", "pairs", "counts")
    totals = scratch.keep(linked.mapInArrow(_sums, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "totals")
    b_of = F.col("pair").bitwiseAND((1 << 32) - 1)
    most = totals.groupBy(b_of.alias("b")).agg(F.max("n").alias("most"))
    table = scratch.keep(totals.join(most, b_of == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pairs")
    parts = max(1, -(-table.count() // part_pairs))
    shares = None
    for part in range(parts):
        # A part is about part_pairs rows whatever the corpus, and pairs come once: no part holds a hot one.
        rows = table.where(F.pmod(F.xxhash64("pair"), F.lit(parts)) == part).toArrow()
        order = np.argsort(rows["pair"].to_numpy())
        held = [rows[c].to_numpy()[order] for c in ("pair", "n", "best")]
        if not len(order):
            held = [np.zeros(1, np.int64) - 1, np.zeros(1, np.int64), np.zeros(1, bool)]
        one = linked.mapInArrow(_looked_up(*held), "key long, n_best long, count_sum long")
        shares = one if shares is None else shares.unionByName(one)
    shares = shares.groupBy("key").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return found.drop("pairs", "counts").join(shares, "key", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")), "groups_sha256")
