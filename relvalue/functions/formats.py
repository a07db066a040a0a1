"""Display formats."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from relvalue.schemas import MISSING

_PATTERNS = ("0", "0.0", "0.00")


def fixed(c: Column, digits: int) -> Column:
    """Decimal text with up to two places, rounding the exact binary value, halves away from zero.

    ``format_string`` rounds the shortest decimal text instead: it gives 1.01 for 1.005, whose
    binary value lies below 1.005. ``format_number`` looks at the binary value but rounds true
    halves to even; those are the odd multiples of a power of two, and get a nudge upwards.
    """
    size = F.abs(c)
    is_half = F.pmod(size * 2.0 ** (digits + 1), F.lit(2.0)) == 1.0
    nudged = size + F.when(is_half, 2.0**-16).otherwise(0.0)
    text = F.call_function("format_number", nudged, F.lit(_PATTERNS[digits]))
    return F.concat(F.when(c < 0, "-").otherwise(""), text)


def _or_missing(c: Column, text: Column) -> Column:
    usable = c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return F.when(usable, text).otherwise(MISSING)


def usd(c: Column) -> Column:
    """$1.23B style."""
    size = F.abs(c)
    text = (
        F.when(size >= 1e12, F.concat(fixed(c / 1e12, 2), F.lit("T")))
        .when(size >= 1e9, F.concat(fixed(c / 1e9, 2), F.lit("B")))
        .when(size >= 1e6, F.concat(fixed(c / 1e6, 2), F.lit("M")))
        .when(size >= 1e3, F.concat(fixed(c / 1e3, 1), F.lit("K")))
        .otherwise(fixed(c, 0))
    )
    return _or_missing(c, F.concat(F.lit("$"), text))


def multiple(c: Column) -> Column:
    """12.3x style."""
    text = (
        F.when(c >= 1000, F.concat(fixed(c / 1000, 1), F.lit("K")))
        .when(c >= 100, fixed(c, 0))
        .when(c >= 10, fixed(c, 1))
        .otherwise(fixed(c, 2))
    )
    return _or_missing(c, F.concat(text, F.lit("x")))


def percent(c: Column) -> Column:
    """+12.3% style."""
    text = F.concat(F.when(c >= 0, "+").otherwise(""), fixed(c, 1), F.lit("%"))
    return _or_missing(c, text)


def kst_minute(iso: Column) -> Column:
    """ISO instant -> ``yy. M. d. HH:mm KST`` at UTC+9; unreadable text shows as missing."""
    instant = F.try_to_timestamp(iso)
    wall = F.convert_timezone(None, F.lit("+09:00"), instant.cast("timestamp_ntz"))
    return F.coalesce(F.date_format(wall, "yy. M. d. HH:mm 'KST'"), F.lit(MISSING))
