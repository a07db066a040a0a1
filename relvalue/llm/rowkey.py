"""A row's key: 128 bits of hashes of its id and text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ROW = ("_row", "_row2")


def row_key() -> list[Column]:
    """Two unlike hashes of doc_id and text; equal rows have equal keys."""
    return [F.xxhash64("doc_id", "text").alias(ROW[0]), F.xxhash64(F.lit("second"), "text", "doc_id").alias(ROW[1])]
