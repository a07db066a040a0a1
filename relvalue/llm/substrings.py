"""Removal of passages that occur earlier in the corpus, by fixed-block anchors.

1. Non-overlapping blocks of ``block`` words of every document are the reference index; every
   rolling run of ``block`` words of every document probes it. A window of ``2 * block`` words
   holds a whole block wherever it starts, so of two equal windows one has a block that the
   other's probe hits. Index and probes meet in hash buckets; a bucket keeps its distinct
   blocks in memory and streams the probes past them. Hits are runs whose block occurs again.
2. Hits are extended: each window around a hit is looked up by its full word sequence, and
   all occurrences but the first are repeats. A bucket keeps the first occurrence of each
   sequence and streams the rest past it.
3. Repeated windows of a document, joined, are its maximal repeats; their words go.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from relvalue.llm.arrow import column, portions, strings
from relvalue.llm.hashing import chunks_by, runs, word_hashes
from relvalue.llm.messages import ADDRESSED, addressed, delivered
from relvalue.llm.scratch import Scratch, bucket_count

WINDOW = 20
PENDING = 1 << 20  # entries that a bucket gathers before it sorts them in
OWN = ("repeats", "_row", "_id", "_part", "_kind", "_rows", "_told")
REPEATS = "struct<n_words: long, n_removed: long, spans: array<struct<start: long, end: long>>>"


def _bits(buckets: int) -> int:
    return max(1, (buckets - 1).bit_length())


def _anchors(block: int, bits: int):
    """For each bucket a row of index blocks (kind 0) and a row of probes (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bucket", "kind", "owners", "counts", "keys"]
        for batch in portions(batches, "text"):
            rows = column(batch, "_row").to_numpy()
            each = [runs(word_hashes(text.split()), block) for text in strings(column(batch, "text"))]
            sizes = np.array([len(x) for x in each], np.int64)
            keys = np.concatenate(each) if each else np.zeros(0, np.uint64)
            place = np.concatenate([np.arange(n) for n in sizes]) if len(sizes) else np.zeros(0, np.int64)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            bucket = (keys >> np.uint64(64 - bits)).astype(np.uint32)
            rest = (keys >> np.uint64(32 - bits)).astype(np.uint32)
            order = np.argsort(bucket, kind="stable")
            bucket, rest, doc, place = bucket[order], rest[order], doc[order], place[order]
            out = []
            for b, low, high in chunks_by(bucket):
                inside = chunks_by(doc[low:high])
                own = np.array([rows[d] for d, _, _ in inside], "<i8")
                counts = np.array([e - s for _, s, e in inside], "<u4")
                index = np.unique(rest[low:high][place[low:high] % block == 0])
                if len(index):
                    out.append((b, 0, b"", b"", index.tobytes()))
                out.append((b, 1, own.tobytes(), counts.tobytes(), rest[low:high].tobytes()))
            if out:
                types = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names)

    return run


class Anchors:
    """A bucket's index blocks, and which of them a second probe has met."""

    def __init__(self) -> None:
        self.parts: list[np.ndarray] = []
        self.index = np.zeros(0, np.uint32)
        self.first = np.zeros(0, np.int64)
        self.seen = np.zeros(0, np.uint8)

    def close(self) -> None:
        if self.parts:
            self.index = np.unique(np.concatenate(self.parts))
            self.first, self.seen, self.parts = np.zeros(len(self.index), np.int64), np.zeros(len(self.index), np.uint8), []

    def probe(self, owners: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Owners and blocks of the probes that hit a block met more than once, those met before included."""
        if not len(self.index):
            return owners[:0], keys[:0]
        at = np.minimum(np.searchsorted(self.index, keys), len(self.index) - 1)
        hit = self.index[at] == keys
        at, owners = at[hit], owners[hit]
        met, where, times = np.unique(at, return_index=True, return_counts=True)
        before = self.seen[met]
        again = (before + times) >= 2
        late = met[again & (before == 1)]  # the first probe of these was held back
        new = met[before == 0]
        self.first[new] = owners[where[before == 0]]
        self.seen[met] = np.minimum(before + times, 2)
        keep = self.seen[at] == 2
        return np.r_[self.first[late], owners[keep]], np.r_[self.index[late], self.index[at[keep]]]


class Told:
    """The messages of one part, and what they tell each document."""

    def __init__(self, kind: str):
        self.kind, self.rows, self.values = kind, [], []
        self.sorted = None

    def split(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        """Keep the messages of a batch; return its documents."""
        messages = batch.filter(pc.invert(column(batch, "_kind")))
        for rows, values in zip(column(messages, "_rows").to_pylist(), column(messages, "_told").to_pylist()):
            self.rows.append(np.frombuffer(rows, "<i8"))
            self.values.append(np.frombuffer(values, self.kind))
        return batch.filter(column(batch, "_kind"))

    def of(self, row: int) -> np.ndarray:
        if self.sorted is None:
            rows = np.concatenate([*self.rows, np.zeros(0, np.int64)])
            order = np.argsort(rows, kind="stable")
            self.sorted = rows[order], np.concatenate([*self.values, np.zeros(0, self.kind)])[order]
        rows, values = self.sorted
        return values[slice(*np.searchsorted(rows, [row, row + 1]))] if row < (1 << 63) - 1 else values[np.searchsorted(rows, row) :]


def _hits(bits: int):
    """The blocks that documents hit, addressed to them; a partition is one bucket, index rows first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, current = Anchors(), -1
        owners, blocks, size = [], [], 0
        for batch in batches:
            for b, kind, own, counts, keys in zip(*(c.to_pylist() for c in batch.columns)):
                if b != current:
                    anchors, current = Anchors(), b
                if kind == 0:
                    anchors.parts.append(np.frombuffer(keys, "<u4"))
                    continue
                anchors.close()
                who, what = anchors.probe(np.repeat(np.frombuffer(own, "<i8"), np.frombuffer(counts, "<u4")), np.frombuffer(keys, "<u4"))
                owners.append(who)
                blocks.append(what.astype(np.uint64) | np.uint64(b) << np.uint64(32))
                size += len(who)
                if size >= PENDING:
                    yield addressed(np.concatenate(owners), np.concatenate(blocks), bits)
                    owners, blocks, size = [], [], 0
        if size:
            yield addressed(np.concatenate(owners), np.concatenate(blocks), bits)

    return run


def _windows(block: int, window: int, bits: int):
    """Windows with a hit inside, by bucket of their word sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = Told("<u8")
        for batch in portions(map(told.split, batches), "text"):
            found = []
            for row, doc, text in zip(column(batch, "_row").to_pylist(), column(batch, "_id").to_pylist(), strings(column(batch, "text"))):
                blocks = told.of(row)
                if not len(blocks):
                    continue
                words = word_hashes(text.split())
                n = len(words) - window + 1
                if n <= 0:
                    continue
                hit = np.isin(runs(words, block) >> np.uint64(32 - bits), blocks)
                before = np.r_[0, np.cumsum(hit)]
                starts = np.flatnonzero(before[window - block + 1 :][:n] > before[:n])
                keys, checks = runs(words, window, 1)[starts], runs(words, window, 2)[starts] >> np.uint64(32)
                found.append((np.full(len(starts), row, np.int64), np.full(len(starts), doc, np.int64), starts.astype(np.uint32), keys, checks.astype(np.uint32)))
            if not found:
                continue
            rows, docs, starts, keys, checks = (np.concatenate(x) for x in zip(*found))
            bucket = (keys >> np.uint64(64 - bits)).astype(np.uint32)
            order = np.argsort(bucket, kind="stable")
            bucket, rows, docs, starts, keys, checks = (x[order] for x in (bucket, rows, docs, starts, keys, checks))
            out = []
            for b, low, high in chunks_by(bucket):
                inside = chunks_by(rows[low:high])
                at = [low + s for _, s, _ in inside]
                counts = np.array([e - s for _, s, e in inside], "<u4")
                out.append((b, rows[at].tobytes(), docs[at].tobytes(), counts.tobytes(), starts[low:high].tobytes(), keys[low:high].tobytes(), checks[low:high].tobytes()))
            types = [pa.int32()] + [pa.binary()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], ["bucket", "rows", "docs", "counts", "starts", "keys", "checks"])

    return run


class Occurrences:
    """The first occurrence of each word sequence of a bucket; what comes later is a repeat."""

    def __init__(self) -> None:
        self.first = self.none()
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    @staticmethod
    def none() -> tuple[np.ndarray, ...]:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint32, np.int64, np.int64, np.uint32))

    def add(self, *part: np.ndarray) -> None:
        self.parts.append(part)
        self.size += len(part[0])

    def settle(self) -> tuple[np.ndarray, np.ndarray]:
        """Row and start of the repeats among what was added, and of former firsts that came to be repeats."""
        keys, checks, docs, rows, starts = (np.concatenate(x) for x in zip(self.first, *self.parts))
        self.parts, self.size = [], 0
        order = np.lexsort((starts, rows, docs, checks, keys))
        keys, checks, docs, rows, starts = (x[order] for x in (keys, checks, docs, rows, starts))
        opens = np.r_[True, (keys[1:] != keys[:-1]) | (checks[1:] != checks[:-1])] if len(keys) else np.zeros(0, bool)
        self.first = tuple(x[opens] for x in (keys, checks, docs, rows, starts))
        head = np.maximum.accumulate(np.where(opens, np.arange(len(keys)), 0)) if len(keys) else np.zeros(0, np.int64)
        repeat = ~((rows == rows[head]) & (starts == starts[head]))  # a repeated row is no second document
        return rows[repeat], starts[repeat]


def _repeats(bits: int):
    """The starts of repeated windows, addressed to their documents; a partition is one bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, current = Occurrences(), -1

        def settled() -> Iterator[pa.RecordBatch]:
            if seen.size:
                yield addressed(*seen.settle(), bits)

        for batch in batches:
            for b, *blobs in zip(*(c.to_pylist() for c in batch.columns)):
                if b != current:
                    yield from settled()
                    seen, current = Occurrences(), b
                rows, docs, counts, starts, keys, checks = (np.frombuffer(x, t) for x, t in zip(blobs, ("<i8", "<i8", "<u4", "<u4", "<u8", "<u4")))
                seen.add(keys, checks, np.repeat(docs, counts), np.repeat(rows, counts), starts)
                if seen.size >= PENDING:
                    yield from settled()
        yield from settled()

    return run


def _cut(window: int):
    """Replace each text by its kept words, where any word goes, and say what went."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mail = Told("<u4")
        owners: dict[int, tuple] = {}  # of rows that have mail: two different ones of one key would get each other's
        for batch in portions(map(mail.split, batches), "text"):
            texts, told = [], []
            ids = column(batch, "doc_id").to_pylist()
            for doc, row, text in zip(ids, column(batch, "_row").to_pylist(), column(batch, "text").cast(pa.large_binary()).to_pylist()):
                words = (text or b"").split()
                spans: list[dict] = []
                gone = 0
                begin = mail.of(row).astype(np.int64)
                if len(begin):
                    mine = (doc, xxh3_64_intdigest(text))
                    if owners.setdefault(row, mine) != mine or int(begin.max()) + window > len(words):
                        raise ValueError(f"two different rows share the key {row}")
                    change = np.bincount(begin, minlength=len(words) + 1) - np.bincount(begin + window, minlength=len(words) + 1)
                    kept = np.cumsum(change[: len(words)]) == 0
                    edges = np.flatnonzero(np.diff(np.r_[True, kept, True]))
                    spans = [{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2])]
                    gone = len(words) - int(kept.sum())
                    text = b" ".join(itertools.compress(words, kept.tolist()))
                texts.append(None if text is None else text.decode())
                told.append({"n_words": len(words), "n_removed": gone, "spans": spans})
            kind = pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
            arrays, names = [], []
            for name, values in zip(batch.schema.names, batch.columns):
                if name not in OWN:
                    arrays.append(pa.array(texts, pa.string()) if name == "text" else values)
                    names.append(name)
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(told, kind)], [*names, "repeats"])

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` (doc_id, text and any other columns) without words that occurred in an earlier window.

    A word goes if a window of ``window`` words of its document covers it and the window's
    words, in order, also start earlier: in a document of smaller doc_id or earlier in the same
    document. Windows are those of the input. ``text`` is then the kept words joined by one
    space; texts that lose nothing stay as they are. The column ``repeats`` (n_words, n_removed,
    spans: the maximal repeats by word) is added, or replaced where ``docs`` has one.

    A null text has no words and stays null. Null ids come after all others and count as one id.
    Rows that share an id are ordered by a hash of their text; a repeated row is the same
    document, not a later one. An empty table gives an empty table. A row's key is a hash of 64 bits; should two
    different rows that lose words ever share one, the run fails instead of taking one's words from the other.
    """
    block = window // 2
    scratch = Scratch(docs.sparkSession, "substrings")
    docs = docs.drop(*OWN)
    key = F.xxhash64("doc_id", "text").alias("_row")
    rank = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("_id")
    bits = _bits(bucket_count(docs, 16 << 20))

    met = docs.select(key, "text").mapInArrow(_anchors(block, bits), "bucket int, kind int, owners binary, counts binary, keys binary")
    met = met.repartitionById(1 << bits, F.col("bucket")).sortWithinPartitions("bucket", "kind")
    hits = scratch.keep(met.mapInArrow(_hits(bits), ADDRESSED), "hits")

    around = delivered(docs.select(key, rank, "text"), hits, bits)
    windows = around.mapInArrow(_windows(block, window, bits), "bucket int, rows binary, docs binary, counts binary, starts binary, keys binary, checks binary")
    windows = windows.repartitionById(1 << bits, F.col("bucket")).sortWithinPartitions("bucket")
    repeats = scratch.keep(windows.mapInArrow(_repeats(bits), ADDRESSED), "repeats")
    scratch.drop("hits")

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return delivered(docs.withColumn("_row", F.xxhash64("doc_id", "text")), repeats, bits).mapInArrow(_cut(window), f"{fields}, repeats {REPEATS}")
