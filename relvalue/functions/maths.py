"""Null-aware arithmetic."""

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def positive(c: Column) -> Column:
    return F.when(c > 0, c)


def ratio(a: Column, b: Column) -> Column:
    """a / b where both are positive, else null (so the division never raises)."""
    return F.when((a > 0) & (b > 0), a / b)


def clamp(c: Column, low: float, high: float) -> Column:
    """Bound c; null stays null, which bare greatest/least would not give."""
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def change_pct(current: Column, prior: Column) -> Column:
    """Percent change against a positive prior value; a missing current value counts as 0."""
    return F.when(prior > 0, (F.coalesce(current, F.lit(0.0)) - prior) / prior * 100)


def weighted_mean(parts: Sequence[tuple[Column, float]]) -> Column:
    """Mean of the non-null values, weights renormalised over them; null if there are none."""
    total = F.lit(0.0)
    weight = F.lit(0.0)
    for value, w in parts:
        total = total + F.coalesce(value * w, F.lit(0.0))
        weight = weight + F.when(value.isNotNull(), F.lit(w)).otherwise(0.0)
    return F.when(weight > 0, total / weight)


def count_present(columns: Sequence[Column]) -> Column:
    total = F.lit(0)
    for c in columns:
        total = total + c.isNotNull().cast("int")
    return total


# --- sums that are the same in any order, at any size --------------------------------------
#
# Amounts add as decimals of 18 places, each in the range its size falls in, so a sum can neither
# overflow nor lose small amounts beside large ones. Ranges are a grouping key: amounts of usual size
# need one or two, and only odd ones any more. ``joined`` puts the sums of the ranges together once.
#
#   0         below 1e9, as it is
#   1         from 1e9, below 1e19, in units of 1e10
#   100 + b   from 1e19, and what 18 places leave of an amount in range 0, in units of 2^(32 b)

_SMALL, _LARGE = "1e9D", "1e19D"
_OUTER = 100


def outer_part(amount: str) -> str:
    """SQL for the part of a DOUBLE that belongs to an outer range; null or 0 if there is none.

    A DOUBLE has at most 17 digits as decimal text, so 18 places hold all of an amount from 1 on.
    """
    return (
        f"CASE WHEN abs({amount}) >= {_LARGE} THEN {amount} "
        f"WHEN abs({amount}) < 1D THEN {amount} - CAST(CAST({amount} AS DECIMAL(38, 18)) AS DOUBLE) END"
    )


def _outer_range(outer: str) -> str:
    return f"{_OUTER} + CAST(floor(log2(abs({outer})) / 32) AS INT)"


def sum_ranges(amount: str, outer: str) -> str:
    """SQL for the array of ranges that a DOUBLE falls in, given its ``outer_part``; a null falls in range 0."""
    return (
        f"CASE WHEN {outer} <> 0 THEN CASE WHEN abs({amount}) < {_SMALL} THEN array(0, {_outer_range(outer)}) ELSE array({_outer_range(outer)}) END "
        f"WHEN abs({amount}) >= {_SMALL} THEN array(1) ELSE array(0) END"
    )


def _scaled(amount: str, exponent: str) -> str:
    """SQL for amount * 2^exponent; in two steps, since 2^exponent alone may be out of range."""
    return f"{amount} * pow(2D, {exponent} / 2) * pow(2D, {exponent} / 2)"


def in_sum_range(amount: str, outer: str, range_: str) -> str:
    """SQL for the DECIMAL that an amount adds to the sum of one of its ranges."""
    return (
        f"CASE {range_} WHEN 0 THEN CAST({amount} AS DECIMAL(38, 18)) "
        f"WHEN 1 THEN CAST(CAST({amount} AS DECIMAL(27, 8)) * 0.0000000001BD AS DECIMAL(38, 18)) "
        f"ELSE CAST({_scaled(outer, f'(32 * ({_OUTER} - {range_}))')} AS DECIMAL(38, 18)) END"
    )


def range_sums(total: str, range_: str) -> dict[str, str]:
    """SQL aggregates over the totals of one sum's ranges, for ``joined``."""
    outer = _scaled(f"CAST({total} AS DOUBLE)", f"(32 * ({range_} - {_OUTER}))")
    return {
        "small": f"max(CASE WHEN {range_} = 0 THEN {total} END)",
        "large": f"max(CASE WHEN {range_} = 1 THEN {total} END)",
        "outer": f"sum(CASE WHEN {range_} > 1 AND {total} <> 0 THEN {outer} END)",
    }


def joined(name: str) -> str:
    """SQL for the DOUBLE total of what ``range_sums`` gave as ``<name>_small``, ``_large`` and ``_outer``; null if there is no amount."""
    small, large, outer = f"{name}_small", f"{name}_large", f"{name}_outer"
    both = (
        f"coalesce(CAST(try_add(try_cast({large} AS DECIMAL(28, 18)) * 10000000000BD, coalesce({small}, 0BD)) AS DOUBLE), "
        f"CAST({large} AS DOUBLE) * 1e10D + coalesce(CAST({small} AS DOUBLE), 0D))"
    )
    inner = f"CASE WHEN {large} IS NULL THEN CAST({small} AS DOUBLE) ELSE {both} END"
    return f"CASE WHEN {outer} IS NULL THEN {inner} ELSE {outer} + coalesce({inner}, 0D) END"


# --- numbers that order as several values do ------------------------------------------------


def place_key(major: str, minor: str) -> str:
    """SQL for a DECIMAL that orders by an INT, then a BIGINT; null comes first in both."""
    return (
        f"CAST(coalesce({major}, -2147483648) AS DECIMAL(10, 0)) * 18446744073709551616BD "
        f"+ CAST(coalesce({minor}, -9223372036854775808) AS DECIMAL(19, 0))"
    )


def order_key(c: str) -> str:
    """SQL for a BIGINT that orders as a finite, non-null DOUBLE does; equal only for equal values."""
    size = f"abs({c})"
    guess = f"CAST(floor(log2({size})) AS INT)"
    share = f"({size} * pow(2D, -({guess})))"  # in [1, 2), or just beyond where the logarithm was rounded
    normal = (
        f"CASE WHEN {share} >= 2 THEN ({guess} + 1024) * 4503599627370496L + CAST(({share} / 2 - 1) * 4503599627370496D AS BIGINT) "
        f"WHEN {share} < 1 THEN ({guess} + 1022) * 4503599627370496L + CAST(({share} * 2 - 1) * 4503599627370496D AS BIGINT) "
        f"ELSE ({guess} + 1023) * 4503599627370496L + CAST(({share} - 1) * 4503599627370496D AS BIGINT) END"
    )
    # below the least normal number the step between neighbours is 2^-1074
    tiny = f"CAST({size} * pow(2D, 537) * pow(2D, 537) AS BIGINT)"
    return f"(CASE WHEN {c} < 0 THEN -1L ELSE 1L END * CASE WHEN {size} >= 2.2250738585072014E-308D THEN {normal} ELSE {tiny} END)"
