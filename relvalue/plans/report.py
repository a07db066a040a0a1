"""The report: one formatted row per entity."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relvalue import schemas as S
from relvalue.functions import formats
from relvalue.functions.text import entity_link

# Column headings of the report, in display order.
HEADINGS = {
    "name": "코인",
    "category": "섹터",
    "value_score": "점수",
    "capture_score": "포획",
    "ps": "P/S",
    "phr": "P/HR",
    "revenue_annual": "매출/년",
    "holder_revenue_annual": "홀더수익/년",
    "revenue30d": "매출 30d",
    "mcap": "시총",
    "fdv": "FDV",
    "tvl": "TVL",
    "price_change14d": "가격 14d",
    "price_change30d": "가격 30d",
    "fees_change7d": "수수료Δ",
}


def report(scored: DataFrame) -> DataFrame:
    """Text columns as displayed, keyed by ``slug``; no order is imposed."""
    capture = F.col("value_capture")
    notes = F.concat(capture["signals"], F.transform(capture["risks"], lambda r: F.concat(F.lit(S.RISK_PREFIX), r)))
    has_score = F.col("value_score").isNotNull()
    return scored.select(
        "slug",
        "name",
        "symbol",
        entity_link(F.col("slug"), F.col("gecko_id")).alias("link"),
        F.coalesce("category", F.lit(S.MISSING)).alias("category"),
        F.coalesce(F.col("value_score").cast("string"), F.lit(S.LABEL_HOLD)).alias("value_score"),
        F.when(has_score, F.concat(
            F.col("label"), F.lit(" · 신뢰도 "), F.round(F.col("confidence") * 100).cast("int").cast("string"), F.lit("%")
        )).alias("value_note"),
        (has_score & (F.col("confidence") < S.LOW_CONFIDENCE)).alias("low_confidence"),
        F.coalesce(capture["score"].cast("string"), F.lit(S.MISSING)).alias("capture_score"),
        capture["label"].alias("capture_label"),
        F.coalesce(F.nullif(F.array_join(notes, " · "), F.lit("")), capture["label"]).alias("capture_note"),
        formats.multiple(F.col("multiples.ps")).alias("ps"),
        formats.multiple(F.col("multiples.phr")).alias("phr"),
        formats.usd(F.col("revenue_annual")).alias("revenue_annual"),
        formats.usd(F.col("holder_revenue_annual")).alias("holder_revenue_annual"),
        formats.usd(F.col("revenue30d")).alias("revenue30d"),
        formats.usd(F.col("mcap")).alias("mcap"),
        formats.usd(F.col("fdv")).alias("fdv"),
        F.col("high_dilution").alias("dilution_warning"),
        formats.usd(F.col("tvl")).alias("tvl"),
        formats.percent(F.col("price_change14d")).alias("price_change14d"),
        formats.percent(F.col("price_change30d")).alias("price_change30d"),
        formats.percent(F.col("fees_change7d")).alias("fees_change7d"),
        F.concat(F.lit("30d "), formats.percent(F.col("fees_change30d"))).alias("fees_change30d"),
    )


def headed(rows: DataFrame) -> DataFrame:
    """The columns of a report in display order, under their headings."""
    return rows.select(*[F.col(name).alias(heading) for name, heading in HEADINGS.items()])
