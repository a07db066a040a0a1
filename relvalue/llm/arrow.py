"""Small helpers for functions over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def strings(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each text of a string column; null counts as empty."""
    return (x or b"" for x in column.cast(pa.large_binary()).to_pylist())


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def portions(batches: Iterable[pa.RecordBatch], name: str, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts in column ``name`` come to about ``size`` bytes, one row at least."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(column(batch, name)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            upto = max(at + 1, int(np.searchsorted(ends, done + size, side="right")))
            yield batch.slice(at, upto - at)
            at = upto


def ranges(lengths: np.ndarray) -> np.ndarray:
    """0..n-1 for each n of ``lengths``, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - lengths, lengths)
