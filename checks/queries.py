"""One Spark query per operator, over the feeds derived from the star-schema tables."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relvalue import schemas as S
from relvalue.functions import formats, guards
from relvalue.operators import percentiles, quotes, rollup
from relvalue.operators.materialize import shared_dir
from relvalue.operators.ranges import PLACE, RANGE, before, dealt
from relvalue.operators.screen import SORT_COLUMNS, TEXT_KEYS, ScreenSpec, numbered, ranks, screen, top
from relvalue.plans import screener
from relvalue.plans.report import report as report_rows
from relvalue.sources import sinks, snapshots
from relvalue.sources.feeds import Feeds
from relvalue.sources.star import read_star, tvl_sector

COMBINED = ScreenSpec(
    search=" D ",
    sectors=tuple(f"Brand#{i}" for i in range(1, 16)),
    mcap=(1_200_000.0, 9_000_000.0),
    tvl=(100_000.0, 0.0),
    phr=(1.0, 500.0),
    ps=(0.0, 40.0),
    holder_revenue_only=True,
    exclude_high_dilution=True,
)
# The top-k report shows this many rows.
TOP_ROWS = 50


def _entities(feeds: Feeds) -> DataFrame:
    return screener.entities(feeds.listing, feeds.flow, feeds.market)


def _gated(spark: SparkSession, folder: str) -> DataFrame:
    return screener.gated(_entities(read_star(spark, folder)), tvl_sector())


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    return screener.score(_entities(read_star(spark, folder)), tvl_sector())


def parent_map(spark, folder):
    return rollup.parent_map(read_star(spark, folder).flow)


def flow_rollup(spark, folder):
    return rollup.flow_rollup(read_star(spark, folder).flow)


def group_meta(spark, folder):
    feeds = read_star(spark, folder)
    return rollup.group_rollup(feeds.listing, feeds.flow).select(
        "k", "first_pos", "name", "symbol", "gecko_id", "category",
        F.array_join("chains", ",").alias("chains"), "dl_mcap", "tvl", "change7d",
    )


def _quotes(table: DataFrame) -> DataFrame:
    return table.select(
        "key", "quote.id", "quote.market_cap", F.col("quote.fully_diluted_valuation").alias("fdv")
    )


def market_by_id(spark, folder):
    return _quotes(quotes.market_by_id(quotes.market_rows(read_star(spark, folder).market)))


def market_by_symbol(spark, folder):
    return _quotes(quotes.market_by_symbol(quotes.market_rows(read_star(spark, folder).market)))


def quote_match(spark, folder):
    feeds = read_star(spark, folder)
    matched = quotes.match_quotes(rollup.group_rollup(feeds.listing, feeds.flow), feeds.market, quotes.heavy_symbols(feeds.listing))
    return matched.select(
        "k", "gecko_id", "mcap", F.col("quote.fully_diluted_valuation").alias("fdv"), "match_kind"
    )


def entities(spark, folder):
    return _entities(read_star(spark, folder)).select(
        F.col("slug").alias("k"), "name", "symbol", "category", "gecko_id", "mcap", "tvl", "change7d",
        "price", "price_change7d", "price_change14d", "price_change30d",
        "fees_annual", "fees7d", "fees30d", "revenue_annual", "revenue30d",
        "holder_revenue_annual", "holder_revenue30d", "volume_annual", "volume30d", "fdv",
        "logo", "change1d", "market_cap_rank", "total_volume", "circulating_supply", "total_supply", "max_supply",
    )


def growth(spark, folder):
    return _entities(read_star(spark, folder)).select(
        F.col("slug").alias("k"), "fees_change7d", "fees_change30d"
    )


def multiples(spark, folder):
    return _gated(spark, folder).select(F.col("slug").alias("k"), "multiples.*")


def gates(spark, folder):
    return _gated(spark, folder).select(
        F.col("slug").alias("k"), "low_activity", "insufficient_scale", "high_dilution", "tvl_sector"
    )


def pool_sizes(spark, folder):
    return percentiles.pool_sizes(_gated(spark, folder))


def sector_percentiles(spark, folder):
    return screener.ranked(_entities(read_star(spark, folder)), tvl_sector()).select(
        F.col("slug").alias("k"), "sector_percentiles.*"
    )


def value_scores(spark, folder):
    return _scored(spark, folder).select(
        F.col("slug").alias("k"), "growth_score", "value_score", "label", "confidence"
    )


def value_capture(spark, folder):
    return _scored(spark, folder).select(
        F.col("slug").alias("k"),
        "value_capture.score",
        "value_capture.label",
        F.col("value_capture.holder_revenue_share").alias("share"),
        F.array_join("value_capture.signals", "|").alias("signals"),
        F.array_join("value_capture.risks", "|").alias("risks"),
    )


def _screen(spark, folder, spec: ScreenSpec) -> DataFrame:
    shown = screen(screener.published(_scored(spark, folder)), spec)
    return shown.select(F.col("slug").alias("k"), "value_score")


def screen_default(spark, folder):
    return _screen(spark, folder, ScreenSpec())


def screen_undervalued(spark, folder):
    return _screen(spark, folder, ScreenSpec().preset("undervalued"))


def screen_overvalued(spark, folder):
    return _screen(spark, folder, ScreenSpec().preset("overvalued"))


def screen_combined(spark, folder):
    return _screen(spark, folder, COMBINED)


def ranked_top(spark, folder):
    rows = screen(screener.published(_scored(spark, folder)), ScreenSpec())
    return top(rows, ScreenSpec(), TOP_ROWS).select("rank", F.col("slug").alias("k"), "value_score")


def _ranked(spark, folder, spec: ScreenSpec) -> DataFrame:
    rows = screen(screener.published(_scored(spark, folder)), spec)
    return numbered(rows, spec).select("rank", F.col("slug").alias("k"), "value_score")


def ranked_all(spark, folder):
    return _ranked(spark, folder, ScreenSpec())


def ranked_by_name(spark, folder):
    return _ranked(spark, folder, ScreenSpec(hide_low_activity=False).select_sort("name"))


def ranked_by_category(spark, folder):
    """Rows without a sector come first: their key is the empty text."""
    return _ranked(spark, folder, ScreenSpec(hide_low_activity=False).select_sort("category"))


def ranked_by_phr(spark, folder):
    """Ascending: the second selection of the same key flips its direction."""
    return _ranked(spark, folder, ScreenSpec().select_sort("phr").select_sort("phr"))


def sort_ranks(spark, folder):
    """Every row's rank under each numeric sort key, both directions."""
    specs = [ScreenSpec(sort_key=key, descending=down) for key in SORT_COLUMNS if key not in TEXT_KEYS for down in (True, False)]
    return ranks(screener.published(_scored(spark, folder)).withColumnRenamed("slug", "k"), specs, "k")


def sector_list(spark, folder):
    return screener.sector_list(_entities(read_star(spark, folder)))


def result_meta(spark, folder):
    feeds = read_star(spark, folder)
    last = F.max("l_shipdate")
    as_of = (
        spark.read.parquet(f"{folder}/lineitem.parquet")
        .select(formats.kst_minute(F.concat(F.date_format(last, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))))
        .scalar()
    )
    result = screener.build_screener(feeds.listing, feeds.flow, feeds.market, tvl_sector(), ScreenSpec().preset("undervalued"))
    return result.meta.drop("updated_at").withColumn("as_of", as_of)


def response_rows(spark, folder):
    """The published rows as readers get them, nested values as columns of their own."""
    rows = sinks.response_rows(screener.published(_scored(spark, folder)))
    nested = {"multiples": "multiple_", "sectorPercentiles": "percentile_", "valueCapture": "capture_"}
    flat = [F.col(f"{c}.{f}").alias(f"{prefix}{f}") for c, prefix in nested.items() for f in rows.schema[c].dataType.names]
    lists = ("chains", "capture_signals", "capture_risks")
    return rows.select("*", *flat).drop(*nested).withColumns({c: F.array_join(c, "|") for c in lists})


def tvl_sectors(spark, folder):
    """The fixed list of sectors whose locked value counts: brands stand for its names, the last one for a sector beyond it."""
    names = F.array(*map(F.lit, S.TVL_SECTORS))
    brand = F.substring("category", 7, 2).cast("int")
    sector = F.when(F.col("category").startswith("Brand#"), F.coalesce(F.get(names, brand - 1), F.lit("Bridge")))
    rows = _entities(read_star(spark, folder)).withColumn("category", sector)
    return screener.gated(rows).select(F.col("slug").alias("k"), "category", "tvl_sector")


def freshness_report(spark, folder):
    """The newest snapshot of each source and its age, every line item standing for one that landed on its ship date."""
    source = F.get(F.array(*map(F.lit, snapshots.SOURCES)), F.col("l_linenumber") % len(snapshots.SOURCES))
    items = spark.read.parquet(f"{folder}/lineitem.parquet")
    now = items.select(F.max("l_shipdate") + F.expr("INTERVAL '3' HOUR")).scalar()
    return snapshots.freshness_of(items.select(source.alias("source"), F.date_format("l_shipdate", "yyyy-MM-dd'T'HH-mm-ss").alias("snapshot_ts")), now)


def landed_lines(spark, folder):
    """The market feed landed as lines, read back, in its order: each row's number among all and its values."""
    market = read_star(spark, folder).market.withColumn("page", F.col("page").cast("int"))
    order = [F.col("page"), F.col("pos")]
    fields = [c for c in market.columns if c not in ("page", "pos")]
    landed = f"{shared_dir(spark).rstrip('/')}/landed-{uuid.uuid4().hex}"
    text = market.repartitionByRange(*order).sortWithinPartitions(*order).select("page", F.to_json(F.struct(*fields)).alias("value"))
    text.write.partitionBy("page").text(landed)
    rows = snapshots.read_market(spark, landed)
    placed = dealt(rows, order)
    sizes = placed.groupBy(RANGE).agg(F.count(F.lit(1)).alias("n"))
    return placed.join(before(sizes, "n"), RANGE).select(
        (F.col("before") + F.col(PLACE) + 1).alias("nth"), "page", "id", "symbol", "market_cap", F.col("fully_diluted_valuation").alias("fdv"), "max_supply")


def report(spark, folder):
    return report_rows(screener.published(_scored(spark, folder))).withColumnRenamed("slug", "k")


def type_guards(spark, folder):
    """Listing fields of every part as JSON text with values of wrong types, read back."""
    text = F.expr("""concat('{"slug": ', CASE p_partkey % 5 WHEN 0 THEN CAST(p_partkey AS STRING) WHEN 1 THEN '""' ELSE concat('"s', p_partkey, '"') END,
        ', "mcap": ', CASE p_partkey % 4 WHEN 0 THEN '"12"' WHEN 1 THEN '1e400' WHEN 2 THEN 'null' ELSE CAST(p_retailprice AS STRING) END,
        CASE p_partkey % 3 WHEN 0 THEN ', "chains": "x"' WHEN 1 THEN ', "chains": ["a", "b"]' ELSE '' END, '}')""")
    v = F.parse_json(text)
    return spark.read.parquet(f"{folder}/part.parquet").select(
        F.col("p_partkey").alias("k"), guards.variant_string(v, "slug").alias("slug"), guards.variant_number(v, "mcap").alias("mcap"),
        F.array_join(guards.variant_strings(v, "chains"), ",").alias("chains"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        parent_map, flow_rollup, group_meta, market_by_id, market_by_symbol, quote_match, entities, growth,
        multiples, gates, pool_sizes, sector_percentiles, value_scores, value_capture,
        screen_default, screen_undervalued, screen_overvalued, screen_combined,
        ranked_top, ranked_all, ranked_by_name, ranked_by_category, ranked_by_phr, sort_ranks, sector_list, result_meta, report, type_guards,
        response_rows, tvl_sectors, freshness_report, landed_lines,
    )
}
