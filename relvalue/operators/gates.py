"""Valuation multiples and the gates that keep noise out of the pools."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relvalue import schemas as S
from relvalue.functions.maths import ratio


def with_multiples(entities: DataFrame) -> DataFrame:
    mcap, tvl, fdv = F.col("mcap"), F.col("tvl"), F.col("fdv")
    return entities.withColumn(
        "multiples",
        F.struct(
            ratio(mcap, F.col("fees_annual")).alias("pf"),
            ratio(mcap, F.col("revenue_annual")).alias("ps"),
            ratio(mcap, F.col("holder_revenue_annual")).alias("phr"),
            ratio(mcap, tvl).alias("mcap_tvl"),
            ratio(fdv, tvl).alias("fdv_tvl"),
            ratio(fdv, mcap).alias("dilution"),
        ),
    )


def in_tvl_sector() -> Column:
    """Whether locked value counts for this row's sector; a row without a sector never does."""
    return F.col("category").isin(*S.TVL_SECTORS)


def with_gates(df: DataFrame, tvl_sector: Column | None = None) -> DataFrame:
    """Add the gate flags to rows with multiples; ``tvl_sector`` overrides the fixed sector list."""

    def amount(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0.0))

    stale = (amount("fees30d") <= 0) & (amount("revenue30d") <= 0) & (amount("holder_revenue30d") <= 0)
    small = (amount("fees_annual") < S.MIN_ACTIVITY_USD) & (amount("revenue_annual") < S.MIN_ACTIVITY_USD)
    if tvl_sector is None:
        tvl_sector = in_tvl_sector()
    return (
        df.withColumn("low_activity", small | stale)
        .withColumn("insufficient_scale", F.coalesce(F.col("mcap") < S.MIN_MCAP_USD, F.lit(True)))
        .withColumn("high_dilution", F.coalesce(F.col("multiples.dilution") > S.DILUTION_WARN, F.lit(False)))
        .withColumn("tvl_sector", F.coalesce(tvl_sector, F.lit(False)))
    )
