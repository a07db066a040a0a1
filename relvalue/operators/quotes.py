"""Match each group to at most one market quote."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relvalue import schemas as S
from relvalue.functions.guards import conform
from relvalue.functions.maths import change_pct, place_key

# A symbol may be shared by a large part of all groups. One that more than one in HEAVY_SHARE listing rows bear is heavy:
# its groups are dealt over so many copies of its quote. A sketch that tracks so many symbols finds them.
SYMBOL_SALTS = 16
HEAVY_SHARE = 256
TRACKED_SYMBOLS = 4096

_QUOTE = ("id", *[name for name, kind in S.MARKET.items() if kind == "DOUBLE"])


def market_rows(market: DataFrame) -> DataFrame:
    """All quotes of the feed, guarded."""
    return conform(market, S.MARKET)


def market_by_id(market: DataFrame) -> DataFrame:
    """key = id; the last row of an id wins. Its place is found first, then its quote is fetched.

    ``page`` and ``pos`` identify a row.
    """
    rows = market.where("id IS NOT NULL").withColumn("turn", F.expr(place_key("page", "pos")))
    last = rows.groupBy("id").agg(F.max("turn").alias("turn"))
    return rows.join(last, ["id", "turn"]).select(F.col("id").alias("key"), F.struct(*_QUOTE).alias("quote"))


def market_by_symbol(market: DataFrame) -> DataFrame:
    """key = lower-cased symbol; the largest market value wins, the first row on ties."""
    rank = (-F.coalesce("market_cap", F.lit(0.0))).alias("rank")
    best = F.min(F.struct(rank, "page", "pos", F.struct(*_QUOTE).alias("quote")))["quote"]
    return market.where("symbol IS NOT NULL").groupBy(F.lower("symbol").alias("key")).agg(best.alias("quote"))


def heavy_symbols(listing: DataFrame) -> Column:
    """The heavy symbols of a listing, lower-cased: an array of HEAVY_SHARE at most, as a scalar subquery over the symbols alone.

    A count that the sketch gets wrong makes a symbol too many or too few heavy, which costs time only.
    """
    symbols = conform(listing, {"symbol": "STRING"}).where("symbol <> '-'").select(F.lower("symbol").alias("symbol"))
    return symbols.agg(
        F.expr(f"approx_top_k(symbol, {HEAVY_SHARE}, {TRACKED_SYMBOLS})").alias("top"), F.count(F.lit(1)).alias("n")
    ).select(F.expr(f"transform(filter(top, x -> x.count * {HEAVY_SHARE} > n), x -> x.item)")).scalar()


def match_quotes(groups: DataFrame, market: DataFrame, heavy: Column | None = None) -> DataFrame:
    """Add ``quote`` and ``match_kind``, settle ``mcap`` and the id, drop groups with neither value nor lock-up.

    A group with an id is looked up by that id alone. One without an id is looked up by its
    symbol, and only if it has cash flow. Either way a group has one key, so one join serves both.
    All quotes take part and Spark picks the join from measured sizes. Groups that share a ``heavy`` symbol (an
    array of them) are dealt out over ``SYMBOL_SALTS`` copies of its quote.
    """
    quotes = market_rows(market)

    def salted(symbol: str) -> Column:
        return F.lit(False) if heavy is None else F.coalesce(F.array_contains(heavy, F.col(symbol)), F.lit(False))

    salts = F.when(salted("key"), F.sequence(F.lit(0), F.lit(SYMBOL_SALTS - 1))).otherwise(F.array(F.lit(0)))
    lookup = (
        market_by_id(quotes).withColumns({"match_kind": F.lit("id"), "salt": F.lit(0)})
        .unionByName(market_by_symbol(quotes).withColumns({"match_kind": F.lit("symbol"), "salt": F.explode(salts)}))
    )

    annuals = [F.col(f"{m}_annual") for m in ("fees", "revenue", "holder_revenue")]
    has_cashflow = F.coalesce(F.greatest(*annuals), F.lit(0.0)) > 0
    by_id = F.col("gecko_id").isNotNull()
    by_symbol = ~by_id & has_cashflow & F.col("symbol").isNotNull()
    want_kind = F.when(by_id, "id").when(by_symbol, "symbol")
    # A group without a lookup has no kind, so its key matches nothing; as its own name it spreads evenly.
    want_key = F.when(by_id, F.col("gecko_id")).when(by_symbol, F.lower("symbol")).otherwise(F.col("k"))

    probe = groups.withColumns({"want_kind": want_kind, "want_key": want_key})
    deals = (F.col("want_kind") == "symbol") & salted("want_key")
    probe = probe.withColumn("want_salt", F.when(deals, F.pmod(F.xxhash64("k"), F.lit(SYMBOL_SALTS)).cast("int")).otherwise(0))
    matched = probe.join(
        lookup,
        (probe.want_kind == lookup.match_kind) & (probe.want_key == lookup.key) & (probe.want_salt == lookup.salt),
        "left",
    ).drop("want_kind", "want_key", "want_salt", "key", "salt")
    return (
        matched
        .withColumn("mcap", F.coalesce("dl_mcap", "quote.market_cap"))
        .withColumn("gecko_id", F.coalesce("gecko_id", "quote.id"))
        .where("mcap IS NOT NULL OR tvl IS NOT NULL")
    )


def to_entities(matched: DataFrame) -> DataFrame:
    """The entity row: market fields only where a quote matched, growth from summed flows."""
    quote = F.col("quote")
    # A matched quote without a 7-day change gives null; only unmatched groups use their own.
    price_change7d = F.when(
        F.col("match_kind").isNotNull(), quote["price_change_percentage_7d_in_currency"]
    ).otherwise(F.col("change7d"))
    return matched.select(
        F.col("k").alias("slug"), "name", "symbol", "category", "chains", "gecko_id", "logo",
        "mcap", "tvl", "change1d", "change7d",
        quote["current_price"].alias("price"),
        quote["market_cap_rank"].alias("market_cap_rank"),
        quote["total_volume"].alias("total_volume"),
        price_change7d.alias("price_change7d"),
        quote["price_change_percentage_14d_in_currency"].alias("price_change14d"),
        quote["price_change_percentage_30d_in_currency"].alias("price_change30d"),
        "fees_annual",
        F.col("fees_d7").alias("fees7d"),
        F.col("fees_d30").alias("fees30d"),
        change_pct(F.col("fees_d7"), F.col("fees_prev7")).alias("fees_change7d"),
        change_pct(F.col("fees_d30"), F.col("fees_prev30")).alias("fees_change30d"),
        "revenue_annual",
        F.col("revenue_d30").alias("revenue30d"),
        "holder_revenue_annual",
        F.col("holder_revenue_d30").alias("holder_revenue30d"),
        "volume_annual",
        F.col("volume_d30").alias("volume30d"),
        quote["fully_diluted_valuation"].alias("fdv"),
        quote["circulating_supply"].alias("circulating_supply"),
        quote["total_supply"].alias("total_supply"),
        quote["max_supply"].alias("max_supply"),
        "first_pos",
    )
