"""Value score, label and confidence; value capture score, label, signals and risks."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relvalue import schemas as S
from relvalue.functions import scoring
from relvalue.functions.maths import clamp, count_present, weighted_mean


def _pct(name: str) -> Column:
    return F.col(f"sector_percentiles.{name}")


def with_value_score(df: DataFrame) -> DataFrame:
    """Add ``growth_score``, ``value_score``, ``label`` and ``confidence`` to rows with percentiles.

    Rows below scale have no percentiles, hence no score and confidence 0.
    """
    scaled = ~F.col("insufficient_scale")
    available = count_present([_pct("pf"), _pct("ps"), _pct("phr"), _pct("mcap_tvl")])
    base = F.when(
        available >= S.MIN_VALUE_MULTIPLES,
        weighted_mean([
            (_pct("phr"), S.WEIGHT_PHR),
            (_pct("ps"), S.WEIGHT_PS),
            (_pct("mcap_tvl"), S.WEIGHT_MCAP_TVL),
            (_pct("pf"), S.WEIGHT_PF),
        ]),
    )
    growth = F.when(scaled, scoring.growth_score(F.col("fees_change30d")))
    dilution = scoring.dilution_score(F.col("multiples.dilution"))
    score = clamp(base + scoring.adjustment(growth) + scoring.adjustment(dilution), 0.0, 100.0)
    confidence = available / 4 * F.when(F.col("low_activity"), 0.5).otherwise(1.0)
    return (
        df.withColumn("growth_score", growth)
        .withColumn("raw_score", score)
        .withColumn("value_score", scoring.whole(F.col("raw_score")))
        .withColumn("label", scoring.value_label(F.col("raw_score")))
        .withColumn("confidence", F.round(confidence, 2))
        .drop("raw_score")
    )


def with_value_capture(df: DataFrame) -> DataFrame:
    """Add ``value_capture``: how far value reaches the holder, beside the value score."""
    fees, revenue = F.col("fees_annual"), F.col("revenue_annual")
    holder = F.col("holder_revenue_annual")
    low, tiny = F.col("low_activity"), F.col("insufficient_scale")

    def at_least(c: Column) -> Column:
        return F.coalesce(c >= S.MIN_ACTIVITY_USD, F.lit(False))

    direct = at_least(holder) & F.coalesce(F.col("holder_revenue30d") > 0, F.lit(False))
    indirect = ~direct & (at_least(revenue) | at_least(fees))
    neither = ~direct & ~indirect

    share = scoring.holder_share(holder, revenue, fees)
    circulating = F.coalesce(scoring.dilution_score(F.col("multiples.dilution")), F.lit(50.0)) / 100
    phr = F.coalesce(_pct("phr"), F.lit(50.0))
    sales = F.coalesce(_pct("ps"), _pct("pf"), F.lit(50.0))
    penalty = F.when(low, 10.0).otherwise(0.0)
    raw = (
        F.when(direct, 35 + share * 35 + phr / 100 * 20 + circulating * 10 - penalty)
        .when(indirect, 20 + sales / 100 * 15 + circulating * 10 - penalty)
    )
    label = (
        F.when(tiny, S.LABEL_HOLD)
        .when(direct & (raw >= 70), S.CAPTURE_STRONG)
        .when(direct, S.CAPTURE_CANDIDATE)
        .when(indirect, S.CAPTURE_INDIRECT)
        .otherwise(S.CAPTURE_UNCLEAR)
    )
    signals = F.array_compact(F.array(
        F.when(direct, S.SIGNAL_DIRECT).when(indirect, S.SIGNAL_INDIRECT),
        F.when(_pct("phr") >= S.PERCENTILE_SIGNAL, S.SIGNAL_PHR),
        F.when(_pct("ps") >= S.PERCENTILE_SIGNAL, S.SIGNAL_PS),
    ))
    risks = F.array_compact(F.array(
        F.when(indirect, S.RISK_NO_HOLDER_REVENUE).when(neither, S.RISK_UNCLEAR),
        F.when(low, S.RISK_LOW_ACTIVITY),
        F.when(F.col("high_dilution"), S.RISK_DILUTION),
    ))
    return df.withColumn(
        "value_capture",
        F.struct(
            F.when(~tiny, scoring.whole(clamp(raw, 0.0, 100.0))).alias("score"),
            label.alias("label"),
            share.alias("holder_revenue_share"),
            F.when(tiny, F.array().cast("array<string>")).otherwise(signals).alias("signals"),
            F.when(tiny, F.array(F.lit(S.RISK_SUB_SCALE))).otherwise(risks).alias("risks"),
        ),
    )
