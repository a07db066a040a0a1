"""Feeds -> entities -> scored rows -> the result of one run."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from relvalue import schemas as S
from relvalue.operators.gates import with_gates, with_multiples
from relvalue.operators.materialize import materialize
from relvalue.operators.percentiles import with_percentiles
from relvalue.operators.quotes import heavy_symbols, match_quotes, to_entities
from relvalue.operators.rollup import group_rollup
from relvalue.operators.scores import with_value_capture, with_value_score
from relvalue.operators.screen import ScreenSpec, default_order, passes


@dataclass(frozen=True)
class ScreenerResult:
    """All scored rows, the sector list and the one-row metadata of a run."""

    rows: DataFrame
    categories: DataFrame
    meta: DataFrame


def entities(listing: DataFrame, flow: DataFrame, market: DataFrame) -> DataFrame:
    """One row per parent entity, fundamentals and market fields joined."""
    return to_entities(match_quotes(group_rollup(listing, flow), market, heavy_symbols(listing)))


def gated(rows: DataFrame, tvl_sector: Column | None = None) -> DataFrame:
    return with_gates(with_multiples(rows), tvl_sector)


def ranked(rows: DataFrame, tvl_sector: Column | None = None) -> DataFrame:
    """Entities with multiples, gates and percentiles.

    The percentiles need the pools before any row can be ranked, so the gated rows are
    written once instead of recomputing the roll-up for every reader.
    """
    return with_percentiles(materialize(gated(rows, tvl_sector), "gated"))


def score(rows: DataFrame, tvl_sector: Column | None = None) -> DataFrame:
    """Entities with everything scoring adds."""
    return with_value_capture(with_value_score(ranked(rows, tvl_sector))).drop("insufficient_scale", "tvl_sector")


def sector_list(scored: DataFrame) -> DataFrame:
    """Distinct sectors of all entities, published or not."""
    return scored.where("category IS NOT NULL").select("category").distinct().orderBy("category")


def _publishable() -> Column:
    return F.coalesce(F.col("mcap") >= S.MIN_MCAP_USD, F.lit(False))


def published(scored: DataFrame) -> DataFrame:
    """The rows shown at all: those of at least the minimum market value."""
    return scored.where(_publishable())


def coverage(spec: ScreenSpec) -> list[Column]:
    """Counts over all scored rows: those with a quote, those the screen shows, those published."""
    return [
        F.count("fdv").alias("fdv_coverage"),
        F.count_if(_publishable() & passes(spec)).alias("shown"),
        F.count_if(_publishable()).alias("total"),
    ]


def result_meta(spark: SparkSession, counts: dict[str, int], spec: ScreenSpec = ScreenSpec()) -> DataFrame:
    """One row: the ``coverage`` counts, and the preset of the screen."""
    row = (counts["fdv_coverage"], counts["shown"], counts["total"], spec.active_preset)
    return spark.createDataFrame([row], "fdv_coverage BIGINT, shown BIGINT, total BIGINT, preset STRING")


def build_screener(
    listing: DataFrame,
    flow: DataFrame,
    market: DataFrame,
    tvl_sector: Column | None = None,
    spec: ScreenSpec = ScreenSpec(),
) -> ScreenerResult:
    """Run everything once; the scored rows are written, since three outputs read them, and counted while they are."""
    rows = score(entities(listing, flow, market), tvl_sector)
    counted = Observation()
    scored = materialize(rows.observe(counted, *coverage(spec)), "scored")
    return ScreenerResult(
        rows=scored.orderBy(*default_order()),
        categories=sector_list(scored),
        meta=result_meta(scored.sparkSession, counted.get, spec).withColumn(
            "updated_at", F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()),
                                        "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
        ),
    )
