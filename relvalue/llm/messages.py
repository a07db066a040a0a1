"""Messages from hash buckets back to documents, many in a row.

A bucket knows something about very many documents. A row for each of them would make as many rows as
there are pairs of buckets and documents, so messages to one part of the documents travel as one
row of arrays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relvalue.llm.hashing import chunks_by


def addressed(rows: np.ndarray, values: np.ndarray, bits: int) -> pa.RecordBatch:
    """One row for each part of the documents: the documents' keys, and what each is told."""
    part = rows & (1 << bits) - 1
    order = np.lexsort((rows, part))
    rows, values, part = rows[order], values[order], part[order]
    out = [(p, rows[a:b].tobytes(), values[a:b].tobytes()) for p, a, b in chunks_by(part)]
    parts, keys, told = zip(*out) if out else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(keys, pa.binary()), pa.array(told, pa.binary())], ["_part", "_rows", "_told"])


ADDRESSED = "_part int, _rows binary, _told binary"


def delivered(docs: DataFrame, messages: DataFrame, bits: int) -> DataFrame:
    """Documents (with ``_row``) and what they are told in one partition for each part, messages first."""
    docs = docs.withColumn("_part", F.col("_row").bitwiseAND((1 << bits) - 1).cast("int"))
    both = docs.unionByName(messages, allowMissingColumns=True).withColumn("_kind", F.col("_rows").isNull())
    return both.repartitionById(1 << bits, F.col("_part")).sortWithinPartitions("_kind")
