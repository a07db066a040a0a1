"""Percentile of each multiple within its sector, or within the whole market for small sectors.

A window over the sector (or over nothing, for the market) would sort all rows of the largest
sector in one task. Here values are reduced to distinct values with counts and dealt to ranges of
the value once. Of the pool members above a value,

* those in later ranges are a sum over a small table, a row for each range and pool;
* those in its own range are counted by a window over the range, which holds no more than its share.

One pass gives both the sector's and the market's count. It is exact. All rows of a value are in one range,
so ties never count as above. The sector size decides per metric which pool a row uses.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relvalue import schemas as S
from relvalue.operators.materialize import materialize
from relvalue.operators.ranges import RANGE, before, dealt

CASH_FLOW = ("pf", "ps", "phr")
RANKED = ("pf", "ps", "phr", "mcap_tvl")

# A value is hot if it makes up more than one part in HOT_SHARE of a metric's pool. There can
# be at most HOT_SHARE such values per metric, which bounds what is broadcast.
HOT_SHARE = 1000


def ranked_values(df: DataFrame, *keep: str) -> DataFrame:
    """Long form: one row per entity and metric that gets a percentile.

    ``pooled`` is false for values above the cap, which are ranked but belong to no pool.
    Needs the columns ``with_multiples`` and ``with_gates`` add.
    """
    cash = ", ".join(
        f"struct('{m}' AS metric, CASE WHEN NOT low_activity THEN multiples.{m} END AS value, "
        f"multiples.{m} <= {S.MULTIPLE_CAP} AS pooled)"
        for m in CASH_FLOW
    )
    locked = "struct('mcap_tvl' AS metric, CASE WHEN tvl_sector THEN multiples.mcap_tvl END AS value, true AS pooled)"
    return (
        df.where("NOT insufficient_scale")
        .selectExpr(*keep, f"coalesce(category, '{S.OTHER_SECTOR}') AS sector", f"inline(array({cash}, {locked}))")
        .where("value IS NOT NULL")
    )


def pool_sizes(df: DataFrame) -> DataFrame:
    """Pool members per metric and sector, and per metric overall (sector null)."""
    return (
        ranked_values(df).where("pooled")
        .groupingSets([["metric", "sector"], ["metric"]], "metric", "sector")
        .agg(F.count("*").alias("n"))
        .select(F.col("sector").alias("category"), "metric", "n")
    )


def _lookup(rows: str, table: str, pool: str, spread: str) -> str:
    """Rows with the ``percentile`` of their pool and value; ``table`` is unique on those.

    Hot values come from a bounded broadcast. Rows that are thereby served, or that ask for
    nothing (value null), would pile up on one null key in the second join; they get a
    negative key instead, which no multiple has, drawn from the hash of ``spread``.
    """
    return f"""
      SELECT r.* EXCEPT (cold_value, hot_percentile), coalesce(r.hot_percentile, cold.percentile) AS percentile
      FROM (
        SELECT /*+ BROADCAST(hot) */ r.*, hot.percentile AS hot_percentile,
          CASE WHEN r.value IS NOT NULL AND hot.percentile IS NULL THEN r.value
            ELSE -1D - pmod(xxhash64({spread}), 1048576) END AS cold_value
        FROM {rows} r
        LEFT JOIN (SELECT {pool}, value, percentile FROM {table} WHERE hot) hot USING ({pool}, value)
      ) r
      LEFT JOIN (SELECT {pool}, value AS cold_value, percentile FROM {table}) cold USING ({pool}, cold_value)"""


# The window counts the members from the highest value down to (and without) the row's own.
_PERCENTILE_TABLE = f"""
WITH in_range AS (
  SELECT {RANGE}, metric, sector, value, members,
    sum(members) OVER (PARTITION BY {RANGE}, metric, sector ORDER BY value DESC) - members AS sector_above,
    sum(members) OVER (PARTITION BY {RANGE}, metric ORDER BY value DESC) - sum(members) OVER (PARTITION BY {RANGE}, metric, value) AS market_above
  FROM {{placed}}
)
SELECT metric, sector, value, members * {{hot_share}} > m.n AS hot, m.n AS market_n,
  CASE WHEN s.n >= {S.MIN_SECTOR_SAMPLE} THEN (s.before + sector_above) / (s.n - 1) * 100
    WHEN m.n <= 1 THEN 50D
    ELSE (m.before + market_above) / (m.n - 1) * 100 END AS percentile
FROM in_range JOIN {{sectors}} s USING ({RANGE}, metric, sector) JOIN {{markets}} m USING ({RANGE}, metric)
"""

# A value above the cap has no pool member above it: 0, or 50 in a pool of at most one, which
# a pool of five or more never is, so the market size decides.
_ANSWER = f"""
WITH market_sizes AS (SELECT metric, max(market_n) AS market_n FROM {{table}} GROUP BY metric),
asked AS (
  SELECT slug, metric, sector, pooled, CASE WHEN pooled THEN value END AS value FROM {{ranked}}
),
answered AS (
  SELECT /*+ BROADCAST(market_sizes) */ slug, metric,
    CASE WHEN pooled THEN percentile WHEN coalesce(market_n, 0) <= 1 THEN 50D ELSE 0D END AS percentile
  FROM ({_lookup('asked', '{table}', 'metric, sector', 'r.slug')}) LEFT JOIN market_sizes USING (metric)
),
per_entity AS (
  SELECT slug, struct(
    {', '.join(f"max(CASE WHEN metric = '{m}' THEN percentile END) AS {m}" for m in RANKED)}) AS ranks
  FROM answered GROUP BY slug
)
SELECT g.*, coalesce(p.ranks, struct({', '.join(f"CAST(NULL AS DOUBLE) AS {m}" for m in RANKED)})) AS sector_percentiles
FROM {{gated}} g LEFT JOIN per_entity p ON p.slug = g.slug
"""


def _pool_shares(placed: DataFrame, *pool: str) -> DataFrame:
    """For each range and pool: members of the pool in later ranges (``before``) and in all (``n``)."""
    shares = placed.groupBy(RANGE, *pool).agg(F.sum("members").alias("here"))
    return before(shares, "here", *pool, later=True).withColumn("n", F.sum("here").over(Window.partitionBy(*pool))).drop("here")


def percentile_table(ranked: DataFrame) -> DataFrame:
    """The percentile of every distinct pool value of a metric and sector, written; ``hot`` marks values to broadcast."""
    counts = ranked.where("pooled").groupBy("metric", "sector", "value").agg(F.count(F.lit(1)).alias("members"))
    placed = dealt(counts, [F.col("metric"), F.col("value")], [F.col("sector")], label="values")
    table = placed.sparkSession.sql(
        _PERCENTILE_TABLE, placed=placed.repartition(RANGE, "metric"), hot_share=HOT_SHARE,
        sectors=_pool_shares(placed, "metric", "sector"), markets=_pool_shares(placed, "metric"))
    return materialize(table, "percentiles")


def with_percentiles(df: DataFrame) -> DataFrame:
    """Add ``sector_percentiles``. Reads ``df`` more than once: hand in a written table.

    ``slug`` identifies the rows. The distinct values in their ranges and the lookup table, which are read
    several times as well, are written in turn.
    """
    ranked = ranked_values(df, "slug")
    return df.sparkSession.sql(_ANSWER, ranked=ranked, table=percentile_table(ranked), gated=df)
