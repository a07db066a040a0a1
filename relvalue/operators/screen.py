"""Screens: filters, presets, search and order over scored rows."""

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relvalue import schemas as S
from relvalue.functions.text import collation_key, haystack
from relvalue.operators.materialize import materialize
from relvalue.operators.ranges import PLACE, RANGE, before, dealt

# The sort keys, each with its column. The two text keys compare by collation, the rest as numbers.
SORT_COLUMNS = {
    "value_score": "value_score",
    "capture_score": "value_capture.score",
    "name": "name",
    "category": "category",
    "ps": "multiples.ps",
    "phr": "multiples.phr",
    "revenue_annual": "revenue_annual",
    "holder_revenue_annual": "holder_revenue_annual",
    "revenue30d": "revenue30d",
    "mcap": "mcap",
    "fdv": "fdv",
    "tvl": "tvl",
    "price_change14d": "price_change14d",
    "price_change30d": "price_change30d",
    "fees_change7d": "fees_change7d",
}
TEXT_KEYS = ("name", "category")

Range = tuple[float, float]
OPEN: Range = (0.0, 0.0)


@dataclass(frozen=True)
class ScreenSpec:
    """One screen; the defaults are the default screen. A bound of 0 or less means no bound."""

    search: str = ""
    sectors: Sequence[str] = ()
    value_score: Range = OPEN
    mcap: Range = OPEN
    tvl: Range = OPEN
    phr: Range = OPEN
    ps: Range = OPEN
    hide_low_activity: bool = True
    holder_revenue_only: bool = False
    exclude_high_dilution: bool = False
    sort_key: str = "value_score"
    descending: bool = True

    def __post_init__(self):
        if self.sort_key not in SORT_COLUMNS:
            raise ValueError(f"unknown sort key {self.sort_key!r}; one of {', '.join(SORT_COLUMNS)}")

    def preset(self, name: str) -> "ScreenSpec":
        """Set the score range and order of a preset; the other filters stay."""
        if name == "undervalued":
            return replace(
                self, value_score=(S.PRESET_UNDERVALUED_MIN, 0.0), sort_key="value_score", descending=True
            )
        if name == "overvalued":
            return replace(
                self, value_score=(0.0, S.PRESET_OVERVALUED_MAX), sort_key="value_score", descending=False
            )
        if name == "all":
            return replace(self, value_score=OPEN, sort_key="value_score", descending=True)
        raise ValueError(f"unknown preset {name!r}; one of undervalued, overvalued, all")

    @property
    def active_preset(self) -> str | None:
        if tuple(self.value_score) == (S.PRESET_UNDERVALUED_MIN, 0.0):
            return "undervalued"
        if tuple(self.value_score) == (0.0, S.PRESET_OVERVALUED_MAX):
            return "overvalued"
        return None

    def select_sort(self, key: str) -> "ScreenSpec":
        """Sort by ``key``; selecting the current key again flips its direction."""
        if key == self.sort_key:
            return replace(self, descending=not self.descending)
        return replace(self, sort_key=key, descending=key not in TEXT_KEYS)

    def reset(self) -> "ScreenSpec":
        return ScreenSpec()


def ranges_of(spec: ScreenSpec) -> list[tuple[str, Range]]:
    """The columns a screen bounds, with their bounds."""
    return [
        ("value_score", spec.value_score), ("mcap", spec.mcap), ("tvl", spec.tvl), ("multiples.phr", spec.phr), ("multiples.ps", spec.ps),
    ]


def in_range(value: Column, limits: Range) -> Column | None:
    """Inclusive range test that null fails, or None when neither bound is set."""
    low, high = limits
    tests = []
    if low > 0:
        tests.append(value >= low)
    if high > 0:
        tests.append(value <= high)
    if not tests:
        return None
    both = tests[0] if len(tests) == 1 else tests[0] & tests[1]
    return F.coalesce(both, F.lit(False))


def passes(spec: ScreenSpec) -> Column:
    """The filters of a screen as one predicate, never null."""
    tests = []
    if spec.hide_low_activity:
        tests.append(~F.col("low_activity"))
    if spec.holder_revenue_only:
        tests.append(F.col("holder_revenue_annual").isNotNull())
    if spec.exclude_high_dilution:
        tests.append(~F.col("high_dilution"))
    if spec.sectors:
        tests.append(F.coalesce(F.col("category").isin(*spec.sectors), F.lit(False)))
    for column, limits in ranges_of(spec):
        test = in_range(F.col(column), limits)
        if test is not None:
            tests.append(test)
    query = spec.search.strip()
    if query:
        tests.append(haystack(F.col("name"), F.col("symbol")).contains(F.lower(F.lit(query))))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def bounds(spec: ScreenSpec) -> Column:
    """The screen's ranges as bare comparisons, which scans can skip row groups by; null where a value is missing."""
    tests = [F.lit(True)]
    for column, (low, high) in ranges_of(spec):
        tests += [F.col(column) >= low] if low > 0 else []
        tests += [F.col(column) <= high] if high > 0 else []
    return reduce(lambda a, b: a & b, tests)


def screen(scored: DataFrame, spec: ScreenSpec = ScreenSpec()) -> DataFrame:
    """The rows that pass the filters of ``spec``, in no particular order."""
    return scored.where(bounds(spec)).where(passes(spec))


def default_order() -> list[Column]:
    """Best score first, unscored rows last, ties in listing order."""
    return [F.col("value_score").desc_nulls_last(), F.col("first_pos").asc()]


def order_by(spec: ScreenSpec) -> list[Column]:
    """Sort columns of a screen: nulls last in both directions, ties in the default order."""
    key = F.col(SORT_COLUMNS[spec.sort_key])
    if spec.sort_key in TEXT_KEYS:
        key = collation_key(key)
    first = key.desc_nulls_last() if spec.descending else key.asc_nulls_last()
    return [first, *default_order()]


def top(rows: DataFrame, spec: ScreenSpec, k: int) -> DataFrame:
    """The first ``k`` rows of a screen with their ``rank``: a top-k, never a full sort in one task."""
    order = order_by(spec)
    head = rows.orderBy(*order).limit(k)
    return head.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def numbered(rows: DataFrame, spec: ScreenSpec) -> DataFrame:
    """All rows of a screen with their ``rank`` in its order, from 1.

    Rows are dealt to ranges of the order and written; a row's rank is its place in its range and the
    sizes of the ranges before. No task sees more than a range. Writes when called.
    """
    placed = dealt(rows, order_by(spec))
    sizes = placed.groupBy(RANGE).agg(F.count(F.lit(1)).alias("_size"))
    ranked = placed.join(F.broadcast(before(sizes, "_size").drop("_size")), RANGE).withColumn("rank", F.col("before") + F.col(PLACE) + 1)
    return ranked.drop(RANGE, PLACE, "before")


def ranks(rows: DataFrame, specs: Sequence[ScreenSpec], *keep: str) -> DataFrame:
    """sort_key, descending, rank and the columns ``keep`` of every row under the order of every screen; filters don't count.

    Keys are written once, a narrow row for each row; from it each row is taken once for each order, with its key as a number
    that sorts ascending, and all orders are dealt to ranges together: one range exchange, two written tables for any number
    of numeric orders, and ``rows`` is computed once. Text keys have no such number. Writes when called.
    """
    text = [s.sort_key for s in specs if s.sort_key in TEXT_KEYS]
    if text:
        raise ValueError(f"{', '.join(text)}: only numeric keys can be ranked together")
    keys = {s.sort_key: f"_key_{s.sort_key}" for s in specs}
    # The ranges are found by a pass over the keys of their own, which would compute everything before them again.
    narrow = materialize(rows.select(
        *keep, F.col("value_score").alias("_score"), F.col("first_pos").alias("_pos"),
        *[F.col(SORT_COLUMNS[key]).cast("double").alias(name) for key, name in keys.items()]), "keys")
    orders = [F.struct(F.lit(i).alias("nth"), (-F.col(keys[s.sort_key]) if s.descending else F.col(keys[s.sort_key])).alias("key")) for i, s in enumerate(specs)]
    long = narrow.select(*keep, "_score", "_pos", F.inline(F.array(*orders)))
    order = [F.col("nth"), F.col("key").asc_nulls_last(), F.col("_score").desc_nulls_last(), F.col("_pos").asc()]
    placed = dealt(long, order, label="orders").select("nth", RANGE, PLACE, *keep)
    sizes = placed.groupBy("nth", RANGE).agg(F.count(F.lit(1)).alias("_size"), F.min(PLACE).alias("_first"))
    names = F.array(*[F.struct(F.lit(s.sort_key).alias("sort_key"), F.lit(s.descending).alias("descending")) for s in specs])
    offsets = before(sizes, "_size", "nth").select("nth", RANGE, (F.col("before") - F.col("_first")).alias("_offset"), F.get(names, F.col("nth")).alias("_order"))
    return placed.join(F.broadcast(offsets), ["nth", RANGE]).select("_order.*", (F.col("_offset") + F.col(PLACE) + 1).alias("rank"), *keep)
