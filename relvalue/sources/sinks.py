"""Publish a result, whole or not at all."""

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relvalue.operators.materialize import owned
from relvalue.operators.screen import ScreenSpec, numbered
from relvalue.plans.screener import ScreenerResult
from relvalue.sources.pointers import append_pointer, exists, newest_pointer

# Field names of a published row, and the failure message.
ROW_FIELDS = {
    "slug": "slug",
    "name": "name",
    "symbol": "symbol",
    "category": "category",
    "chains": "chains",
    "gecko_id": "geckoId",
    "logo": "logo",
    "mcap": "mcap",
    "tvl": "tvl",
    "change1d": "change1d",
    "change7d": "change7d",
    "price": "price",
    "market_cap_rank": "marketCapRank",
    "total_volume": "totalVolume",
    "price_change7d": "priceChange7d",
    "price_change14d": "priceChange14d",
    "price_change30d": "priceChange30d",
    "fees_annual": "feesAnnual",
    "fees7d": "fees7d",
    "fees30d": "fees30d",
    "fees_change7d": "feesChange7dover7d",
    "fees_change30d": "feesChange30dover30d",
    "revenue_annual": "revenueAnnual",
    "revenue30d": "revenue30d",
    "holder_revenue_annual": "holderRevenueAnnual",
    "holder_revenue30d": "holderRevenue30d",
    "volume_annual": "volumeAnnual",
    "volume30d": "volume30d",
    "fdv": "fdv",
    "circulating_supply": "circulatingSupply",
    "total_supply": "totalSupply",
    "max_supply": "maxSupply",
    "growth_score": "growthScore",
    "value_score": "valueScore",
    "label": "label",
    "confidence": "confidence",
    "low_activity": "lowActivity",
    "high_dilution": "highDilution",
}
FAILURE = "데이터를 불러오지 못했습니다."


def response_rows(rows: DataFrame) -> DataFrame:
    """Scored rows under their published field names, with their ``rank`` in the default order."""
    return numbered(rows, ScreenSpec()).select(
        "rank",
        *[F.col(ours).alias(theirs) for ours, theirs in ROW_FIELDS.items()],
        F.expr(
            "named_struct('pf', multiples.pf, 'ps', multiples.ps, 'phr', multiples.phr, "
            "'mcapTvl', multiples.mcap_tvl, 'fdvTvl', multiples.fdv_tvl, 'dilution', multiples.dilution)"
        ).alias("multiples"),
        F.expr(
            "named_struct('pf', sector_percentiles.pf, 'ps', sector_percentiles.ps, "
            "'phr', sector_percentiles.phr, 'mcapTvl', sector_percentiles.mcap_tvl)"
        ).alias("sectorPercentiles"),
        F.expr(
            "named_struct('score', value_capture.score, 'label', value_capture.label, "
            "'holderRevenueShare', value_capture.holder_revenue_share, "
            "'signals', value_capture.signals, 'risks', value_capture.risks)"
        ).alias("valueCapture"),
    )


def _write(df: DataFrame, folder: str) -> None:
    df.write.option("ignoreNullFields", "false").json(folder)


@dataclass(frozen=True)
class Published:
    """What readers of a run see: rows by score, the sector list, the metadata, and the snapshots it was built from (if known)."""

    run: str
    rows: DataFrame
    categories: DataFrame
    meta: DataFrame
    sources: DataFrame | None


def publish(result: ScreenerResult, folder: str, sources: DataFrame | None = None) -> str:
    """Write a run folder of its own, then point to it; return the run's name.

    Pointers are numbered objects in ``<folder>/current``, the highest whole one holds (``current_run``). None is
    ever overwritten, so readers always find a run, whole, and a run that fails leaves what they saw before.
    ``rows`` is what an endpoint serves; ``rows_by_score`` holds the scored rows in ranges of the score, for
    screens that skip what they don't show; ``sources`` the snapshots the run was built from.
    """
    spark = result.rows.sparkSession
    run = f"run-{uuid.uuid4().hex}"
    _write(response_rows(result.rows), f"{folder}/{run}/rows")
    by_score = [F.col("value_score").asc_nulls_first(), F.col("first_pos").asc()]
    result.rows.repartitionByRange(*by_score).sortWithinPartitions(*by_score).write.parquet(f"{folder}/{run}/rows_by_score")
    _write(result.categories, f"{folder}/{run}/categories")
    if sources is not None:
        _write(sources.coalesce(1), f"{folder}/{run}/sources")
    meta = result.meta.select(
        F.col("updated_at").alias("updatedAt"), F.col("fdv_coverage").alias("fdvCoverage"), "shown", "total", "preset"
    )
    _write(meta.coalesce(1), f"{folder}/{run}/meta")
    append_pointer(spark, f"{folder}/current", {"run": run})
    return run


def current_run(spark: SparkSession, folder: str) -> str | None:
    """The run that readers see, None before the first."""
    pointer = newest_pointer(spark, f"{folder}/current")
    return pointer and pointer["run"]


def open_published(spark: SparkSession, folder: str) -> Published:
    """The current run's tables. Screens over its rows read only row groups that their ranges can meet."""
    run = current_run(spark, folder)
    if run is None:
        raise FileNotFoundError(f"nothing is published in {folder}")
    here = f"{folder}/{run}"
    sources = spark.read.json(f"{here}/sources") if exists(spark, f"{here}/sources") else None
    return Published(run, spark.read.parquet(f"{here}/rows_by_score"), spark.read.json(f"{here}/categories"), spark.read.json(f"{here}/meta"), sources)


def publish_run(spark: SparkSession, build: Callable[[], ScreenerResult], folder: str, sources: DataFrame | None = None) -> bool:
    """Build and publish; on any failure leave one error object in a folder of its own, and no pointer to it.

    Intermediate tables go when the run ends.
    """
    try:
        with owned(spark):
            publish(build(), folder, sources)
    except Exception as failure:  # whatever stops the run is reported, none of it is shown
        error = spark.createDataFrame([(FAILURE, str(failure))], "error STRING, detail STRING")
        _write(error.coalesce(1), f"{folder}/failed-{uuid.uuid4().hex}")
        return False
    return True
