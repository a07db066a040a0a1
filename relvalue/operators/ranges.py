"""Rows dealt to ranges of an order, for ranks that no single task could count.

A table is dealt to ranges once, sorted there and written. A rank is then a row's place in its range and
what the ranges before hold, which is a sum over a table of a row for each range.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relvalue.operators.materialize import materialize

RANGE, PLACE = "_range", "_place"


def dealt(rows: DataFrame, order: Sequence[Column], within: Sequence[Column] = (), label: str = "ranges") -> DataFrame:
    """``rows`` with their range of ``order`` and their place in it (by ``order``, then ``within``), written.

    Rows that are equal by ``order`` are in one range.
    """
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order, *within)
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    return materialize(ranges.withColumns({RANGE: F.spark_partition_id(), PLACE: place}), label)


def before(sizes: DataFrame, size: str, *pool: str, later: bool = False) -> DataFrame:
    """``sizes`` (a row for each range and pool) with ``before``: the sum of ``size`` over the pool's earlier (or ``later``) ranges."""
    order = F.col(RANGE).desc() if later else F.col(RANGE).asc()
    rows = Window.partitionBy(*pool).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("before", F.coalesce(F.sum(size).over(rows), F.lit(0)))
