"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding.

An id is replaced by its rank by frequency in the corpus, so common ids take one byte. Of each
four ranks a control byte holds the lengths (two bits each); a document's control bytes lie apart
from its data bytes. Decoding looks control bytes up in a table of lengths and gathers all
values at once.

A file holds documents in ascending doc_id order: a head of five little-endian fields (has an
id, doc_id, start in the file, number of ids, number of data bytes), control bytes, data bytes.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relvalue.llm.arrow import column, portions, strings
from relvalue.llm.encoding import fast_ids
from relvalue.llm.files import create, open_stream
from relvalue.llm.scratch import Scratch, bucket_count

HEAD = struct.Struct("<?qQIQ")
LENGTHS = 1 + (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.int64)
MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], dtype=np.uint32)
FILE_BYTES = 32 << 20


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit ``values``."""
    values = values.astype("<u4", copy=False)
    codes = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    fours = np.zeros(-(-len(codes) // 4) * 4, np.uint8)
    fours[: len(codes)] = codes
    control = fours[0::4] | fours[1::4] << 2 | fours[2::4] << 4 | fours[3::4] << 6
    data = values.view(np.uint8).reshape(-1, 4)[np.arange(4) <= codes[:, None]]
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` values of ``pack``."""
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    at = np.cumsum(lengths) - lengths
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.uint32)
    values = raw[at]
    for k in (1, 2, 3):
        values = values | raw[np.minimum(at + k, len(raw) - 1)] << np.uint32(8 * k)
    return values & MASKS[lengths]


def encode_documents(docs: DataFrame, path: str, end_id: int, kind: str = "<u4") -> DataFrame:
    """doc_id, ids (unsigned integers of ``kind`` in a binary) with ``end_id`` after each text."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = fast_ids(path)
        for batch in portions(batches, "text"):
            ids = [np.frombuffer(x + end, "<u4").astype(kind).tobytes() for x in encode(strings(column(batch, "text")))]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary")


def frequencies(encoded: DataFrame, size: int, kind: str = "<u4") -> np.ndarray:
    """How often each id below ``size`` occurs; the driver gets one number for each id of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(column(batch, "ids").to_pylist()), kind), minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    found = encoded.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(size, np.int64)
    total[found["id"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return total


def write_files(docs: DataFrame, path: str, end_id: int, scratch: Scratch) -> tuple[DataFrame, np.ndarray]:
    """Write all documents; return the table of files (part, uri, base, n_docs, n_tokens) and the ids by rank.

    ``base`` is the number of ids in all files before. A null text counts as empty and has the
    end id only; null ids come first, repeated rows each keep their place.
    """
    from relvalue.llm.encoding import tokenizer

    size = max(tokenizer(path).get_vocab_size(with_added_tokens=True), end_id + 1)
    kind = "<u2" if size <= 1 << 16 else "<u4"
    encoded = scratch.keep(encode_documents(docs, path, end_id, kind), "encoded")
    order = np.argsort(-frequencies(encoded, size, kind), kind="stable").astype(np.uint32)  # ties to the smaller id
    rank = np.empty(size, np.uint32)
    rank[order] = np.arange(size, dtype=np.uint32)
    folder = f"{scratch.path}/files"

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "ids"):
            found = (np.frombuffer(x, kind) for x in column(batch, "ids").to_pylist())
            rows = [(len(x), *pack(rank[x])) for x in found]
            n, control, data = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), pa.array(n, pa.int64()), pa.array(control, pa.binary()), pa.array(data, pa.binary())],
                ["doc_id", "n", "control", "data"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        uri, out, n_docs, n_tokens = None, None, 0, 0
        for batch in batches:
            if out is None and batch.num_rows:
                uri, out = create(folder, ".ids")
            for doc, n, control, data in zip(*(column(batch, c).to_pylist() for c in ("doc_id", "n", "control", "data"))):
                put_document(out, doc, n_tokens, n, control, data)
                n_docs, n_tokens = n_docs + 1, n_tokens + n
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist(
                [{"part": TaskContext.get().partitionId(), "uri": uri, "n_docs": n_docs, "n_tokens": n_tokens}],
                schema=pa.schema([("part", pa.int32()), ("uri", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    ranked = (encoded.mapInArrow(coded, "doc_id long, n long, control binary, data binary")
              .repartitionByRange(bucket_count(docs, FILE_BYTES), "doc_id").sortWithinPartitions("doc_id", "n", "data"))
    files = scratch.keep(ranked.mapInArrow(write, "part int, uri string, n_docs long, n_tokens long"), "manifest")
    scratch.drop("encoded")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    return files.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long")), order


def put_document(out, doc: int | None, start: int, n: int, control: bytes, data: bytes) -> None:
    out.write(HEAD.pack(doc is not None, doc or 0, start, n, len(data)))
    out.write(control)
    out.write(data)


def read_file(uri: str, order: np.ndarray) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """doc_id, start in the file, ids of each document, one document in memory at a time."""
    with open_stream(uri) as stream:
        while head := stream.read(HEAD.size):
            known, doc, start, n, size = HEAD.unpack(head)
            control, data = stream.read(-(-n // 4)), stream.read(size)
            yield doc if known else None, start, order[unpack(control, data, n)].astype("<u4", copy=False)


def read_files(files: DataFrame, order: np.ndarray, describe, columns: dict[str, pa.DataType]) -> DataFrame:
    """A row for each document: doc_id, start, n_tokens, and what ``describe(ids)`` gives for ``columns``."""
    names = ["doc_id", "start", "n_tokens", *columns]
    types = [pa.int64(), pa.int64(), pa.int64(), *columns.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(column(batch, "uri").to_pylist(), column(batch, "base").to_pylist()):
                rows, size = [], 0
                for doc, start, ids in read_file(uri, order):
                    rows.append((doc, base + start, len(ids), *describe(ids)))
                    size += len(ids)
                    if size >= 1 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)

    ddl = ", ".join(f"{n} {_ddl(t)}" for n, t in zip(names, types))
    spread = files.select("uri", "base", "part").repartition(max(1, files.count()), "part")
    return spread.mapInArrow(run, ddl)


def _ddl(kind: pa.DataType) -> str:
    return {pa.int64(): "long", pa.binary(): "binary", pa.string(): "string"}[kind]
