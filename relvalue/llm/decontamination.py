"""Benchmark decontamination by a prefix-filtered set join.

A window of a benchmark item is a set of shingles; a document contains the window only if it holds all of them.

1. Shingles of all windows are ordered by rarity: a first pass counts how often each occurs in the corpus.
2. For whole containment the necessary prefix of a window is one shingle, its rarest. A window with a shingle
   that never occurs goes at once.
3. A second pass finds the documents' shingles that are some window's prefix; they join the windows. The
   shingle's place in the window gives the one place where the window could start (positional bound), and
   there it must fit between the document's first and last word (length bound).
4. What is left is verified word by word over exactly the words that the window would cover.

Both passes look a document's shingles up in a bit map of at most 2^MAP_BITS bits, whatever the size of the
benchmark. It only drops shingles that can't join; the join is on whole hashes, the check on the words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relvalue.llm.arrow import column, portions, strings
from relvalue.llm.hashing import runs, word_hashes
from relvalue.llm.scratch import Scratch

WINDOW = 10
SHINGLE = 4
#: Bits of the map of shingles, as powers of two: 128 KB to 16 MB.
LEAST_BITS, MAP_BITS = 20, 27
PIECE = 1 << 20  # bytes of a text that are split into words at a time

#: Lower-cases A-Z and turns every byte that is in no word into a space.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def blocks(text: bytes, reach: int) -> Iterator[tuple[list[bytes], int, int, int]]:
    """The words of a text in blocks: words, the place of the first, and from where to where they are this block's.

    A block also holds the ``reach`` words before and after its own, as far as there are any.
    """
    flat = text.translate(_WORD_BYTES)
    words, first, own, at = [], 0, 0, 0
    while True:
        end = flat.find(b" ", at + PIECE) if len(flat) - at > PIECE else -1
        words = words + flat[at : len(flat) if end < 0 else end].split()
        upto = first + len(words)
        if end < 0:
            yield words, first, own, upto
            return
        upto = max(own, upto - reach)
        yield words, first, own, upto
        keep = max(first, upto - reach)
        words, first, own, at = words[keep - first :], keep, upto, end


def _shingles(words: np.ndarray, length: int) -> np.ndarray:
    """A hash of each run of ``length`` words; lengths don't mix."""
    return runs(words, length, seed=length)


def _windows(window: int):
    """Every window of every item, with the hashes of its shingles in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "text", 1 << 18):
            rows = []
            for item, text in zip(column(batch, "item").to_pylist(), strings(column(batch, "text"))):
                for words, first, own, upto in blocks(text, window - 1):
                    size = min(window, first + len(words))
                    if not size:
                        continue
                    length = min(SHINGLE, size)
                    hashes = _shingles(word_hashes(words), length).view(np.int64)
                    for at in range(own - first, min(upto - first, len(words) - size + 1)):
                        rows.append((item, b" ".join(words[at : at + size]), size, hashes[at : at + size - length + 1]))
            items, texts, sizes, hashes = zip(*rows) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(items, pa.string()), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(sizes, pa.int32()), pa.array(hashes, pa.list_(pa.int64()))],
                ["item", "window", "size", "shingles"],
            )

    return run


def _bit_map(shingles: DataFrame, bits: int) -> np.ndarray:
    """A bit for the first ``bits`` bits of each hash in ``shingles`` (shingle): at most 2^(bits - 15) rows of 4 KB come to the driver."""
    place = F.expr(f"shiftrightunsigned(shingle, {64 - bits}) + 1")  # Spark counts bits from 1
    rows = shingles.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("part")).collect()
    out = np.zeros(max(1, 1 << bits - 15) * 4096, np.uint8)
    for row in rows:
        out[(row["bucket"] - 1) * 4096 : row["bucket"] * 4096] = np.frombuffer(row["part"], np.uint8)
    return out


def _marked(found: np.ndarray, bit_map: np.ndarray, bits: int) -> np.ndarray:
    """Places of the hashes whose bit is set."""
    place = found >> np.uint64(64 - bits)
    return np.flatnonzero(bit_map[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1)


def _frequencies(lengths: list[int], bit_map: np.ndarray, bits: int, reach: int):
    """How often shingles that may be in a window occur: one row for each shingle and portion of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "text"):
            met = [np.zeros(0, np.uint64)]
            for text in strings(column(batch, "text")):
                for words, first, own, upto in blocks(text, reach):
                    hashes = word_hashes(words)
                    for length in lengths:
                        shingles = _shingles(hashes, length)[own - first : upto - first]
                        met.append(shingles[_marked(shingles, bit_map, bits)])
            shingles, n = np.unique(np.concatenate(met), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(shingles.view(np.int64)), pa.array(n.astype(np.int64))], ["shingle", "n"])

    return run


def _probes(lengths: list[int], bit_map: np.ndarray, bits: int, window: int):
    """A row for each document, and one for each of its shingles that may be a prefix, with the words around it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "text"):
            totals, owners, found, places, starts, around = [], [], [], [], [], []
            for i, text in enumerate(strings(column(batch, "text"))):
                for words, first, own, upto in blocks(text, window - 1):
                    hashes = word_hashes(words)
                    for length in lengths:
                        shingles = _shingles(hashes, length)
                        inner = _marked(shingles[own - first : upto - first], bit_map, bits) + (own - first)
                        span = window if length == SHINGLE else length  # a shorter shingle is a whole window
                        for at in inner.tolist():
                            left = max(0, at + length - span)
                            owners.append(i)
                            places.append(first + at)
                            starts.append(first + left)
                            around.append(b" ".join(words[left : at + span]))
                        found.append(shingles[inner])
                totals.append(first + len(words))
            key = column(batch, "key")
            shingles = np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)
            none = lambda n, kind: pa.nulls(n, kind)
            docs, hits = batch.num_rows, len(owners)
            yield pa.RecordBatch.from_arrays([
                pa.concat_arrays([key, key.take(pa.array(owners, pa.int64()))]),
                pa.concat_arrays([column(batch, "doc_id"), none(hits, column(batch, "doc_id").type)]),
                pa.concat_arrays([pa.array(totals, pa.int64()), pa.array([totals[i] for i in owners], pa.int64())]),
                pa.concat_arrays([none(docs, pa.int64()), pa.array(shingles)]),
                pa.concat_arrays([none(docs, pa.int64()), pa.array(places, pa.int64())]),
                pa.concat_arrays([none(docs, pa.int64()), pa.array(starts, pa.int64())]),
                pa.concat_arrays([none(docs, pa.string()), pa.array(around, pa.binary()).cast(pa.string())]),
            ], ["key", "doc_id", "n_words", "shingle", "place", "first", "around"])

    return run


def _index(items: DataFrame, docs: DataFrame, window: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The windows that may occur, each with its prefix shingle, and the items of each class of windows.

    Windows that the very same items have are a class, known by the number of its items and two sums over their hashes.
    """
    met = scratch.keep(items.mapInArrow(_windows(window), "item string, window string, size int, shingles array<long>").distinct(), "item_windows")
    sums = lambda seed: F.sum(F.xxhash64("item", F.lit(seed)).cast("decimal(38,0)")).cast("string")
    windows = met.groupBy("window", "size", "shingles").agg(F.concat_ws(":", F.count(F.lit(1)), sums(1), sums(2)).alias("class"))
    windows = scratch.keep(windows, "windows")
    members = windows.groupBy("class").agg(F.min(F.struct("window", "size"))["window"].alias("window"))
    members = scratch.keep(met.join(members, "window").select("class", "item").distinct(), "classes")

    shingles = windows.select("window", "size", "class", F.posexplode("shingles").alias("offset", "shingle"))
    known = shingles.select("shingle").distinct()
    bits = _bits(known)
    lengths = _lengths(windows)
    corpus = docs.select("text").mapInArrow(_frequencies(lengths, _bit_map(known, bits), bits, window - 1), "shingle long, n long")
    occurring = scratch.keep(corpus.groupBy("shingle").agg(F.sum("n").alias("n")), "frequencies")
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "offset"))
    prefixes = shingles.join(occurring, "shingle", "left").groupBy("window", "size", "class").agg(rarest.alias("prefix"))
    prefixes = prefixes.where("prefix.n > 0").select("window", "size", "class", "prefix.shingle", "prefix.offset")
    return scratch.keep(prefixes, "prefixes"), members


def _bits(shingles: DataFrame) -> int:
    """About 64 bits a shingle, between the bounds."""
    return min(MAP_BITS, max(LEAST_BITS, (64 * shingles.count()).bit_length()))


def _lengths(windows: DataFrame) -> list[int]:
    """Lengths of shingles that occur: SHINGLE, and those of shorter items."""
    return sorted(r[0] for r in windows.select(F.least("size", F.lit(SHINGLE))).distinct().collect())  # four at most


def contamination(docs: DataFrame, benchmark: DataFrame, item: str = "item_id", window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of ``docs`` (doc_id, text; other columns are ignored).

    A null text has no words; a document or item without words hits nothing. An item of fewer than ``window`` words is one
    window. Items of one id are one item; a null id counts as the empty text. Repeated rows and null ids of
    documents each keep their row. Without a benchmark nothing is hit; an empty table gives no rows.
    ``window`` must be SHINGLE words at least.
    """
    if window < SHINGLE:
        raise ValueError(f"a window holds {SHINGLE} words at least")
    scratch = Scratch(docs.sparkSession, "decontamination")
    docs = docs.select("doc_id", "text")
    items = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), "text")
    prefixes, members = _index(items, docs, window, scratch)
    wanted = prefixes.select("shingle").distinct()
    bits = _bits(wanted)
    kind = docs.schema["doc_id"].dataType.simpleString()
    probed = docs.withColumn("key", F.monotonically_increasing_id()).mapInArrow(
        _probes(_lengths(prefixes), _bit_map(wanted, bits), bits, window),
        f"key long, doc_id {kind}, n_words long, shingle long, place long, first long, around string",
    )
    probed = scratch.keep(probed, "probes")

    start = F.col("place") - F.col("offset")
    covered: Column = F.array_join(F.slice(F.split("around", " "), (F.col("start") - F.col("first") + 1).cast("int"), F.col("size")), " ")
    candidates = (
        probed.where("shingle IS NOT NULL").join(prefixes, "shingle").withColumn("start", start)
        .where((F.col("start") >= 0) & (F.col("start") + F.col("size") <= F.col("n_words")))
    )
    hits = scratch.keep(candidates.where(covered == F.col("window")).select("key", "start", "size", "class"), "hits")

    spans = hits.groupBy("key", "start").agg((F.col("start") + F.max("size")).alias("end"))
    before = F.max("end").over(Window.partitionBy("key").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), F.coalesce(before, F.lit(0))))
    n_hit = spans.select("key", fresh.alias("fresh")).groupBy("key").agg(F.sum("fresh").alias("n_hit"))
    of_docs = hits.select("key", "class").distinct().join(members, "class").groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    found = n_hit.join(of_docs, "key")
    return (
        probed.where("shingle IS NULL").select("key", "doc_id", "n_words").join(found, "key", "left")
        .select(
            "doc_id", "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long").alias("n_items"),
            F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
            F.col("n_hit").isNotNull().alias("contaminated"),
        )
    )
