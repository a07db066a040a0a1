"""Pack documents into sequences of fixed capacity by minimum bin slack.

A document longer than the capacity is cut into full pieces and a rest. What is packed is then a
multiset of lengths: how many pieces have each length is all the planner needs, at most one
number for each length up to the capacity, whatever the size of the corpus. The planner opens a
window with the longest piece left and finds, by a subset-sum over bitsets, the multiset of the
other lengths that fills it closest to capacity; counts are traced back through the bitsets. A
filling is repeated as often as the counts allow. Pieces then find their place by their length
and their number among pieces of that length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relvalue.llm.arrow import column, portions, strings
from relvalue.llm.encoding import words
from relvalue.llm.scratch import Scratch

CAPACITY = 2048
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, nth long"


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset from ``counts`` (length: how many are left) with the longest length in it that comes closest to ``capacity``."""
    lengths = sorted((x for x, n in counts.items() if n), reverse=True)
    first = lengths[0]
    room = capacity - first
    sums, steps, limit = 1, [], (1 << room + 1) - 1
    for length in lengths:
        if length > room:
            continue
        steps.append((length, sums))
        left, block = min(counts[length] - (length == first), room // length), 1
        while left > 0:  # 1, 2, 4, ... pieces at a time reach every number of them
            block = min(block, left)
            sums |= sums << block * length & limit
            left, block = left - block, block * 2
        if sums >> room & 1:
            break
    target = sums.bit_length() - 1
    used = {first: 1}
    for length, before in reversed(steps):
        while not before >> target & 1:
            used[length] = used.get(length, 0) + 1
            target -= length
    return used


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Places for all pieces: (length, from nth, to nth, first sequence, pieces a sequence, offset)."""
    left, next_nth, sequence, places = dict(counts), dict.fromkeys(counts, 0), 0, []
    while any(left.values()):
        used = fill(left, capacity)
        times = min(left[x] // k for x, k in used.items())
        offset = 0
        for length, k in sorted(used.items(), reverse=True):
            places.append((length, next_nth[length], next_nth[length] + k * times, sequence, k, offset))
            next_nth[length] += k * times
            left[length] -= k * times
            offset += k * length
        sequence += times
    return places


def _pieces(path: str, end_id: int, capacity: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, met = TaskContext.get().partitionId(), [0] * (capacity + 1)
        encode = words(path)
        for batch in portions(batches, "text"):
            rows = []
            for doc, ids in zip(column(batch, "doc_id").to_pylist(), encode.ids(strings(column(batch, "text")))):
                ids += end
                total = len(ids) // 4
                for start in range(0, total, capacity):
                    length = min(capacity, total - start)
                    digest = zlib.crc32(ids[4 * start : 4 * (start + length)])
                    rows.append((doc, start, length, digest, total, part, met[length]))
                    met[length] += 1
            types = [pa.int64()] * 5 + [pa.int32(), pa.int64()]
            arrays = [pa.array(x, t) for x, t in zip(zip(*rows) if rows else [()] * 7, types)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "nth"])

    return run


def pack(docs: DataFrame, path: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for each piece of ``docs`` (doc_id, text).

    A document is its ids and ``end_id``; a null or empty text is the end id alone. Repeated rows
    and null ids are packed like any other; an empty table gives no pieces. ``path`` is a
    tokenizers file at the same place on every machine.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    pieces = scratch.keep(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_pieces(path, end_id, capacity), PIECES), "pieces")
    # a piece's number among those of its length: its number in its task, and those of earlier tasks
    met = scratch.keep(pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "met")
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = met.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    counts = {r["length"]: r["n"] for r in met.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most one row a length

    places = np.array(sorted(plan(counts, capacity)), dtype=np.int64).reshape(-1, 6)
    key = places[:, 0] << 48 | places[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, nth = (column(batch, c).to_numpy() for c in ("length", "nth"))
            row = np.searchsorted(key, length << 48 | nth, side="right") - 1
            _, low, _, sequence, k, offset = places[row].T
            arrays = [column(batch, c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays(
                [*arrays, pa.array(sequence + (nth - low) // k), pa.array(offset + (nth - low) % k * length)],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    numbered = pieces.join(before, ["length", "part"]).withColumn("nth", F.col("nth") + F.col("before"))
    return numbered.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "nth").mapInArrow(
        place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
