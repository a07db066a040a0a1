"""Token counts of texts of any length, by overlap resynchronisation.

A huge document is cut into overlapping chunks that are encoded apart, with offsets. Inside an
overlap the two encodings are spliced at a common word boundary that is proven stable:

- the pattern that splits words looks at no text before its match, so once both encodings have a
  boundary at the same place they go on alike;
- the earlier chunk is right from its own splice on, up to a margin before its end, where a word,
  its look-ahead or a special string might go on beyond the chunk.

Where an overlap holds no such place (one endless word, a run of white space), the document is
encoded again with wider overlaps, in the end as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relvalue.llm.arrow import column, portions, strings
from relvalue.llm.encoding import stretches, tokenizer
from relvalue.llm.scratch import Scratch

CHUNK_CHARS = 16_384
OVERLAP_CHARS = 512
#: Characters before a chunk's end whose boundaries are not trusted: longer than any special string or look-ahead.
MARGIN_CHARS = 32
WIDEN = 4


def _counts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = stretches(path)
        for batch in portions(batches, "text"):
            ids = encode.ids(strings(column(batch, "text")))
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), column(batch, "n_bytes"), pa.array([len(x) // 4 for x in ids], pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    return run


def boundaries(encoding, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Where words start, and how many tokens come before each; the end of the text counts as a start."""
    words = np.array([-1 if w is None else w for w in encoding.word_ids], dtype=np.int64)
    starts = np.array([a for a, _ in encoding.offsets], dtype=np.int64)
    first = np.flatnonzero(np.r_[True, (words[1:] != words[:-1]) | (words[1:] < 0)]) if len(words) else np.array([], np.int64)
    return np.r_[starts[first], length], np.r_[first, len(words)]


def _seams(path: str, overlap: int):
    """For each chunk its places in the overlap with the chunk before (seam n) and after (seam n + 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = tokenizer(path)
        for batch in portions(batches, "text"):
            rows = []
            for key, n, last, start, text in zip(*(column(batch, c).to_pylist() for c in ("key", "chunk", "last_chunk", "start", "text"))):
                places, before = boundaries(library.encode(text, add_special_tokens=False), len(text))
                if n > 0:
                    head = places <= overlap
                    rows.append((key, n, False, places[head] + start, before[head]))
                if n < last:
                    tail = (places >= len(text) - overlap) & (places < len(text) - MARGIN_CHARS)
                    rows.append((key, n + 1, True, places[tail] + start, before[tail]))
                else:
                    rows.append((key, last + 1, True, [-1], before[-1:]))
                    rows.append((key, last + 1, False, [-1], [0]))
            keys, seams, tails, places, counts = zip(*rows) if rows else ([],) * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(seams, pa.int64()), pa.array(tails, pa.bool_()), pa.array(places, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int64()))],
                ["key", "seam", "tail", "places", "counts"],
            )

    return run


def _spliced(huge: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """key, n_tokens (null where an overlap holds no common place) of ``huge`` (key, text)."""
    step = chunk - overlap
    last = F.greatest(F.lit(0), F.ceil((F.char_length("text") - chunk) / step)).cast("long")
    chunks = huge.select("key", "text", last.alias("last_chunk")).select(
        "key", "last_chunk", "text", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last_chunk"))).alias("chunk"))
    start = F.col("chunk") * step
    chunks = chunks.select("key", "last_chunk", "chunk", start.alias("start"), F.col("text").substr((start + 1).cast("int"), F.lit(chunk)).alias("text"))
    seams = chunks.mapInArrow(_seams(path, overlap), "key long, seam long, tail boolean, places array<long>, counts array<long>")
    side = lambda tail, c: F.first(F.when(F.col("tail") == tail, F.col(c)), ignorenulls=True).alias(f"{c}_{'after' if not tail else 'before'}")
    met = seams.groupBy("key", "seam").agg(*(side(t, c) for t in (True, False) for c in ("places", "counts")))
    place = F.array_min(F.array_intersect("places_before", "places_after"))
    at = lambda which: F.element_at(f"counts_{which}", F.array_position(f"places_{which}", F.col("place")).cast("int"))
    gain = met.withColumn("place", place).select("key", F.when(F.col("place").isNotNull(), at("before") - at("after")).alias("gain"))
    return gain.groupBy("key").agg(F.when(F.count("gain") == F.count(F.lit(1)), F.sum("gain")).alias("n_tokens"))


def count_tokens(docs: DataFrame, path: str, limit: int, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of ``docs`` (doc_id, text; other columns are ignored).

    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows and null ids each keep their
    row. An empty table gives no rows. ``path`` is a tokenizers file at the same place on every
    machine; counts are without added special tokens, and special strings in a text count as the
    library counts them by default.
    """
    if chunk < 2 * overlap + MARGIN_CHARS or overlap <= MARGIN_CHARS:
        raise ValueError("a chunk must hold both its overlaps, and an overlap its margin")
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    size = F.octet_length("text").cast("long").alias("n_bytes")
    long = F.char_length("text") > chunk
    counted = docs.where(~long).select("doc_id", size, "text").mapInArrow(_counts(path), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long")

    scratch = Scratch(spark, "counts")
    huge = scratch.keep(docs.where(long).select(F.monotonically_increasing_id().alias("key"), "doc_id", size, "text"), "huge")
    rounds, open_keys, n = [], huge.select("key", "text"), 0
    longest = huge.agg(F.max(F.char_length("text"))).first()[0] or 0
    while n == 0 or not open_keys.isEmpty():
        done = scratch.keep(_spliced(open_keys, path, chunk, overlap), f"spliced_{n}")
        rounds.append(done.where("n_tokens is not null"))
        if chunk >= longest:
            break
        open_keys = huge.join(done.where("n_tokens is null").select("key"), "key", "left_semi").select("key", "text")
        chunk, overlap, n = chunk * WIDEN, overlap * WIDEN, n + 1
    spliced = rounds[0]
    for more in rounds[1:]:
        spliced = spliced.unionByName(more)
    spliced = huge.select("key", "doc_id", "n_bytes").join(spliced, "key").select("doc_id", "n_bytes", "n_tokens")
    return counted.unionByName(spliced).withColumn("over_limit", F.col("n_tokens") > limit)
