"""Derive the three feeds from the star-schema tables ``part`` and ``lineitem``.

Each part plays one listed entry, its line items are the entry's daily facts. Rules on the
part key and size leave fields out, so that every branch of the analysis has rows.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relvalue import schemas as S
from relvalue.functions.text import PARENT_PREFIX
from relvalue.sources.feeds import Feeds

# Trailing windows, in days before the last day: column -> (from, to).
_WINDOWS = {
    "total7d": (7, 0),
    "total14dto7d": (14, 7),
    "total30d": (30, 0),
    "total60dto30d": (60, 30),
    "total1y": (365, 0),
}

# Metric -> (amount in whole units, units per dollar). Whole numbers add exactly in any order.
_AMOUNTS = {
    "fees": ("cents", 100),
    "revenue": ("cents * (100 - discount) * 4", 100_000),
    "holder_revenue": ("CASE WHEN l_returnflag = 'R' THEN cents * discount * 6 END", 10_000),
    "volume": ("quantity", 100),
}


def tvl_sector() -> Column:
    """Sectors whose locked value counts: all but one."""
    return F.col("category") != "Brand#7"


def _listing(part: DataFrame, lineitem: DataFrame) -> DataFrame:
    locked = (
        lineitem.where("l_linestatus = 'O'")
        .groupBy(F.col("l_partkey").alias("p_partkey"))
        .agg(F.expr("sum(rint(l_quantity * 100)) / 100 AS locked"))
    )
    return part.join(locked, "p_partkey", "left").selectExpr(
        "p_partkey AS pos",
        "concat('part-', p_partkey) AS slug",
        "p_name AS name",
        "CASE WHEN p_partkey % 11 = 0 THEN '-' ELSE upper(replace(p_name, ' ', '')) END AS symbol",
        "CASE WHEN p_size = 1 THEN NULL WHEN p_size = 50 THEN p_name ELSE p_brand END AS category",
        "array(lower(p_type)) AS chains",
        "CASE WHEN p_partkey % 3 = 0 THEN concat('g', p_partkey) END AS gecko_id",
        "CASE WHEN p_size % 4 = 0 THEN concat('logo/', p_partkey) END AS logo",
        "CASE WHEN p_partkey % 5 <> 0 THEN p_retailprice * p_size * 200 END AS mcap",
        "CASE WHEN p_partkey % 7 <> 0 THEN locked * p_retailprice END AS tvl",
        "CAST(p_size AS DOUBLE) / 4 - 3 AS change_1d",
        "CAST(p_size AS DOUBLE) - 25 AS change_7d",
    )


def _flow(part: DataFrame, lineitem: DataFrame) -> DataFrame:
    # Both bounds are scalar subqueries over the date column alone; older rows go before anything is summed.
    year_start = lineitem.selectExpr("max(l_shipdate) - INTERVAL '365' DAY").scalar()
    last_day = lineitem.selectExpr("max(l_shipdate)").scalar()
    recent = (
        lineitem.where(F.col("l_shipdate") > year_start)
        .withColumn("age", last_day - F.col("l_shipdate"))
        .selectExpr(
            "l_partkey AS p_partkey", "l_returnflag", "age",
            "rint(l_extendedprice * 100) AS cents",
            "rint(l_discount * 100) AS discount",
            "rint(l_quantity * 100) AS quantity",
        )
    )
    sums = recent.groupBy("p_partkey").agg(*[
        F.expr(
            f"sum(CASE WHEN age < INTERVAL '{start}' DAY AND age >= INTERVAL '{stop}' DAY THEN {amount} END)"
            f" / {units} AS {metric}_{column}"
        )
        for metric, (amount, units) in _AMOUNTS.items()
        for column, (start, stop) in _WINDOWS.items()
    ])
    # Young entries have no full year yet.
    per_feed = ", ".join(
        # The last feed names another parent for some entries.
        f"struct('{metric}' AS metric, {i} AS list_ord, "
        + ("CASE WHEN p_partkey % 20 = 2 THEN concat(named, '_x') ELSE named END AS parent, " if i == 3 else "named AS parent, ")
        + "".join(f"{metric}_{column} AS {column}, " for column in list(_WINDOWS)[:-1])
        + f"CASE WHEN p_partkey % 13 <> 5 THEN {metric}_total1y END AS total1y)"
        for i, metric in enumerate(S.METRICS)
    )
    return part.join(sums, "p_partkey").selectExpr(
        "p_partkey AS pos",
        "concat('part-', p_partkey) AS slug",
        f"CASE WHEN p_partkey % 10 < 3 THEN concat('{PARENT_PREFIX}', lower(replace(p_brand, '#', '-')), '_', "
        "lower(p_type)) END AS named",
        "*",
    ).selectExpr(
        "pos", "slug",
        f"inline(array({per_feed}))",
    )


def _market(part: DataFrame) -> DataFrame:
    # Three of four quotes bear ids that no listed entry names.
    # One in eight comes again on the second page, with other values.
    return part.selectExpr("*", "explode(CASE WHEN p_partkey % 8 = 0 THEN array(1, 2) ELSE array(1) END) AS page").selectExpr(
        "page",
        "p_partkey AS pos",
        "concat(CASE WHEN p_partkey % 4 = 0 THEN 'g' ELSE 'm' END, p_partkey) AS id",
        "lower(replace(p_name, ' ', '')) AS symbol",
        "p_retailprice * page AS current_price",
        "p_retailprice * p_size * 210 * page AS market_cap",
        "CAST(p_partkey % 997 AS DOUBLE) AS market_cap_rank",
        "p_retailprice * p_size AS total_volume",
        "CAST(p_size AS DOUBLE) * 1000 AS circulating_supply",
        "CAST(p_size AS DOUBLE) * 1500 AS total_supply",
        "CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS DOUBLE) * 2000 END AS max_supply",
        "CASE WHEN p_size % 9 <> 0 THEN p_size * 0.5D - 10 END AS price_change_percentage_7d_in_currency",
        "p_retailprice * p_size * 210 * (1 + (p_partkey % 6) * 0.8D) AS fully_diluted_valuation",
        "CAST(p_size AS DOUBLE) - 20 AS price_change_percentage_14d_in_currency",
        "p_size * 1.5D - 40 AS price_change_percentage_30d_in_currency",
    )


def read_star(spark: SparkSession, folder: str) -> Feeds:
    part = spark.read.parquet(f"{folder}/part.parquet")
    lineitem = spark.read.parquet(f"{folder}/lineitem.parquet")
    return Feeds(_listing(part, lineitem), _flow(part, lineitem), _market(part))
