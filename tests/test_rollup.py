import re

import pytest
from pyspark.sql import functions as F

from relvalue import schemas as S
from relvalue.operators.quotes import heavy_symbols, market_by_id, market_by_symbol, market_rows, match_quotes, to_entities
from relvalue.operators.rollup import flow_rollup, group_rollup, parent_map
from rows import flow, listing, market

P = "parent#big-name_v2"


def by_key(df):
    return {r.k: r for r in df.collect()}


def test_children_roll_up_to_their_parent(spark):
    groups = by_key(group_rollup(
        listing(
            spark,
            dict(slug="a", name="A", mcap=5.0, tvl=10.0), dict(slug="b", name="B", tvl=-3.0), dict(slug="c", name="C"),
            dict(slug=None, name="nobody", tvl=1.0),
        ),
        flow(
            spark,
            dict(metric="fees", slug="a", parent=P, total1y=100.0, total30d=9.0),
            dict(metric="fees", slug="b", parent=P, total30d=30.0, total60dto30d=-5.0),
            dict(metric="volume", slug="b", parent=P, total30d=-5.0),
            dict(metric="fees", slug="elsewhere", total1y=7.0),
            dict(metric="fees", slug="", total1y=7.0),
        ),
    ))
    assert set(groups) == {P, "c"}
    big = groups[P]
    assert big.name == "Big Name V2" and big.first_pos == 0
    assert big.dl_mcap == 5.0 and big.tvl == 7.0
    assert big.fees_annual == 100 + 30 * 365 / 30 and big.fees_d30 == 39.0
    assert big.fees_prev30 is None and big.volume_annual is None and big.volume_d30 is None
    assert groups["c"].name == "C" and groups["c"].tvl is None


def test_flow_only_groups_stay_in_the_flow_rollup(spark):
    rows = flow_rollup(flow(
        spark, dict(metric="fees", slug="a", parent=P, total7d=1.0), dict(metric="revenue", slug="a", total7d=-1.0),
    )).collect()
    assert {(r.k, r.metric, r.d7) for r in rows} == {(P, "fees", 1.0), (P, "revenue", None)}


def test_last_feed_names_the_parent(spark):
    rows = flow(
        spark,
        dict(metric="volume", slug="a", parent="parent#four", pos=0),
        dict(metric="fees", slug="a", parent="parent#one", pos=9),
        dict(metric="holder_revenue", slug="a", parent="", pos=3),
        dict(metric="revenue", slug="b", parent="parent#x", pos=1),
        dict(metric="revenue", slug="b", parent="parent#y", pos=2),
    )
    assert {r.slug: r.parent for r in parent_map(rows).collect()} == {"a": "parent#four", "b": "parent#y"}


def test_duplicate_listing_rows_add_up(spark):
    groups = by_key(group_rollup(listing(spark, dict(slug="a", tvl=2.0), dict(slug="a", tvl=3.0)), flow(spark, dict(metric="fees", slug="z"))))
    assert groups["a"].tvl == 5.0


@pytest.mark.parametrize(
    "members, expected",
    [
        ([dict(mcap=9.0, tvl=9.0), dict(gecko_id="g1"), dict(gecko_id="g2")], "m1"),
        ([dict(tvl=9.0), dict(mcap=1.0), dict(mcap=5.0)], "m1"),
        ([dict(tvl=1.0), dict(tvl=7.0), dict(tvl=7.0)], "m1"),
        ([dict(), dict(tvl=-1.0)], "m0"),
    ],
)
def test_representative(spark, members, expected):
    rows = [dict(slug=f"m{i}", category=f"m{i}") | m for i, m in enumerate(members)]
    flows = [dict(metric="fees", slug=r["slug"], parent=P) for r in rows]
    group = by_key(group_rollup(listing(spark, *rows), flow(spark, *flows)))[P]
    assert group.category == expected


def test_first_usable_symbol_and_id(spark):
    rows = [dict(slug="a", symbol="-"), dict(slug="b", symbol="BB", gecko_id="gb"), dict(slug="c", symbol="CC", gecko_id="gc")]
    flows = [dict(metric="fees", slug=r["slug"], parent=P) for r in rows]
    group = by_key(group_rollup(listing(spark, *rows), flow(spark, *flows)))[P]
    assert (group.symbol, group.gecko_id) == ("BB", "gb")


def test_unusable_numbers_are_ignored(spark):
    nan, inf = float("nan"), float("inf")
    groups = by_key(group_rollup(
        listing(spark, dict(slug="a", tvl=nan, mcap=inf), dict(slug="b", tvl=1.0, mcap=-2.0)),
        flow(spark, dict(metric="fees", slug="b", total1y=nan, total30d=inf, total7d=2.0)),
    ))
    assert groups["a"].tvl is None and groups["a"].dl_mcap is None
    assert groups["b"].dl_mcap is None and groups["b"].fees_annual is None and groups["b"].fees_d7 == 2.0


QUOTES = [
    dict(id="big", symbol="sym", market_cap=100.0, fully_diluted_valuation=300.0, current_price=2.0),
    dict(id="small", symbol="SYM", market_cap=10.0),
    dict(id="twin", symbol="twin", market_cap=5.0, current_price=1.0),
    dict(id="twin2", symbol="twin", market_cap=5.0, current_price=9.0),
    dict(id="zero", symbol="zero", market_cap=0.0),
]


def test_quote_match(spark):
    entries = [
        dict(slug="has-id", gecko_id="big", symbol="zzz", mcap=7.0, change_7d=4.0),
        dict(slug="id-missing", gecko_id="unknown", symbol="SYM", tvl=1.0, change_7d=4.0),
        dict(slug="by-symbol", symbol="Sym", tvl=1.0),
        dict(slug="no-cash", symbol="SYM", tvl=1.0),
        dict(slug="tie", symbol="TWIN", tvl=1.0),
        dict(slug="zero-cap", gecko_id="zero"),
        dict(slug="nothing", symbol="none"),
    ]
    cash = [dict(metric="holder_revenue", slug=s, total30d=1.0) for s in ("by-symbol", "id-missing", "tie", "nothing")]
    cash.append(dict(metric="volume", slug="no-cash", total1y=5.0))
    matched = match_quotes(group_rollup(listing(spark, *entries), flow(spark, *cash)), market(spark, *QUOTES))
    kinds = {r.k: (r.match_kind, r.gecko_id, r.mcap) for r in matched.collect()}
    assert kinds == {
        "has-id": ("id", "big", 7.0),
        "id-missing": (None, "unknown", None),
        "by-symbol": ("symbol", "big", 100.0),
        "no-cash": (None, None, None),
        "tie": ("symbol", "twin", 5.0),
        "zero-cap": ("id", "zero", 0.0),
    }
    assert to_entities(matched).columns == list(S.ENTITY)
    rows = {r.slug: r for r in to_entities(matched).collect()}
    assert rows["has-id"].price == 2.0 and rows["has-id"].fdv == 300.0
    assert rows["has-id"].price_change7d is None, "a match without a value does not fall back"
    assert rows["id-missing"].price_change7d == 4.0 and rows["id-missing"].price is None


def test_growth(spark):
    entries = listing(spark, dict(slug="a", tvl=1.0), dict(slug="b", tvl=1.0))
    flows = flow(
        spark,
        dict(metric="fees", slug="a", total7d=15.0, total14dto7d=10.0, total60dto30d=4.0),
        dict(metric="fees", slug="b", total7d=15.0),
        dict(metric="revenue", slug="b", total7d=15.0, total14dto7d=1.0),
    )
    rows = {r.slug: r for r in to_entities(match_quotes(group_rollup(entries, flows), market(spark, *QUOTES))).collect()}
    assert rows["a"].fees_change7d == 50.0 and rows["a"].fees_change30d == -100.0
    assert rows["b"].fees_change7d is None and rows["b"].fees_change30d is None


def test_market_lookups(spark):
    quotes = market(spark, *QUOTES, dict(id="big", symbol="other", market_cap=1.0, page=2))
    ids = {r.key: r.quote.market_cap for r in market_by_id(quotes).collect()}
    assert ids["big"] == 1.0, "the last row of an id wins"
    symbols = {r.key: r.quote.id for r in market_by_symbol(quotes).collect()}
    assert symbols["sym"] == "big" and symbols["twin"] == "twin"
    assert market_rows(quotes).count() == 6


def test_every_quote_is_found(spark):
    """No limit on the feed, and a symbol that most groups share."""
    n = 3000
    entries = [dict(slug=f"i{i}", gecko_id=f"q{i}", tvl=1.0) for i in range(n)] + [dict(slug=f"s{i}", symbol="HOT", tvl=1.0) for i in range(n)]
    flows = [dict(metric="fees", slug=f"s{i}", total1y=5.0) for i in range(n)]
    quotes = market(spark, *[dict(id=f"q{i}", symbol=f"x{i}", market_cap=1.0 + i) for i in range(n)], dict(id="hot", symbol="hot", market_cap=0.5))
    rows = match_quotes(group_rollup(listing(spark, *entries), flow(spark, *flows)), quotes).groupBy("match_kind").count().collect()
    assert {r.match_kind: r["count"] for r in rows} == {"id": n, "symbol": n}


@pytest.mark.parametrize("amounts, total", [([4e-7], 4e-7), ([1.23456789], 1.23456789), ([4.5e9 + 0.1, 4.5e9 + 0.2], 9000000000.3), ([9.1e9, 0.1, 1e15, 0.7, 3.3e-9], 1000009100000000.8)])
def test_sums_are_exact_in_any_order(spark, amounts, total):
    flows = [dict(metric="fees", slug=f"s{i}", parent=P, total1y=x) for i, x in enumerate(amounts)]
    for order in (flows, flows[::-1]):
        rows = flow_rollup(flow(spark, *order).repartition(3)).collect()
        assert [r.annual for r in rows] == [total]


def test_order_of_rows_does_not_matter(spark):
    entries = [dict(slug=f"s{i}", symbol=f"S{i}", tvl=0.1 * i, mcap=1.0 + i) for i in range(50)]
    flows = [dict(metric="fees", slug=f"s{i}", parent=P, total1y=0.1 * i, total30d=0.7) for i in range(50)]
    a = group_rollup(listing(spark, *entries).coalesce(1), flow(spark, *flows).coalesce(1)).collect()
    b = group_rollup(listing(spark, *entries).repartition(9), flow(spark, *flows).repartition(7)).collect()
    assert a == b


@pytest.mark.parametrize("amounts, want", [([1e25, 1.0, -1e25], 1.0), ([5e-30], 5e-30), ([3e21, 1e25, 2.0, -1e25], 3e21), ([1e30, 1e9, 0.125, -1e30, -1e9], 0.125)])
def test_locked_value_of_any_size(spark, amounts, want):
    """Nothing is lost beside large amounts, nor in a sum that cancels them."""
    for order in (amounts, amounts[::-1], sorted(amounts)):
        entries = [dict(slug=f"s{i}", tvl=x) for i, x in enumerate(order)]
        flows = [dict(metric="fees", slug=f"s{i}", parent=P) for i in range(len(order))]
        groups = by_key(group_rollup(listing(spark, *entries).repartition(3), flow(spark, *flows)))
        assert groups[P].tvl == want


def test_flows_of_any_size(spark):
    flows = [dict(metric="fees", slug=f"s{i}", parent=P, total1y=x, total7d=y) for i, (x, y) in enumerate([(1e25, 5e-30), (2e19, None), (4.0, None)])]
    row = flow_rollup(flow(spark, *flows)).first()
    assert row.annual == pytest.approx(1e25 + 2e19, rel=1e-15) and row.d7 == 5e-30


def test_members_that_lend_fields(spark):
    """Id, symbol and the rest from three members, beside a group whose members are one."""
    rows = [
        dict(slug="a", symbol="-", tvl=3.0, name="A"), dict(slug="b", symbol="BB", name="B"), dict(slug="c", symbol="CC", gecko_id="gc", name="C", chains=["x"], logo="l", change_1d=1.0),
        dict(slug="alone", tvl=-0.0, name="Alone"), dict(slug="p1", tvl=1e-320, category="p1"), dict(slug="p2", tvl=2e-320, category="p2"), dict(slug="p3", tvl=-5.0, category="p3"),
    ]
    flows = [dict(metric="fees", slug=s, parent=P) for s in "abc"] + [dict(metric="fees", slug=s, parent=P + "2") for s in ("p1", "p2", "p3")]
    groups = by_key(group_rollup(listing(spark, *rows), flow(spark, *flows)))
    assert set(groups) == {P, P + "2", "alone"}
    assert (groups[P].gecko_id, groups[P].symbol, groups[P].chains, groups[P].logo, groups[P].change1d, groups[P].first_pos) == ("gc", "BB", ["x"], "l", 1.0, 0)
    assert groups[P + "2"].category == "p2" and groups["alone"].name == "Alone" and groups["alone"].symbol is None


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def sorted_before_shuffle(plan):
    """Whether a branch of a plan sorts before its first exchange: below a Sort no Exchange on the way to a leaf."""
    lines = [re.sub(r"^[\s:+\-*]*(\(\d+\))?\s*", lambda m: " " * len(m.group(0)), x) for x in plan.splitlines()]
    depth = [len(x) - len(x.lstrip()) for x in lines]
    for i, line in enumerate(lines):
        if re.match(r"\s*Sort \[", line):
            below = []
            for j in range(i + 1, len(lines)):
                if depth[j] <= depth[i]:
                    break
                below.append(lines[j])
            if not any("Exchange" in x for x in below):
                return True
    return False


@pytest.mark.parametrize("name", ["parent_map", "flow_rollup", "group_meta", "market_by_id"])
def test_aggregates_hash(spark, name):
    from checks.queries import QUERIES

    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for large tables
    try:
        plan = plan_of(QUERIES[name](spark, "/root/testdata/sf0.001"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    assert "SortAggregate" not in plan and "HashAggregate" in plan
    assert not sorted_before_shuffle(plan)


def test_only_heavy_symbols_are_dealt_out(spark):
    """A third of the groups bear one symbol: they go to eight tasks at least, and no other quote is copied."""
    n = 1200
    symbols = ["HOT" if i % 3 == 0 else f"x{i}" for i in range(n)]
    entries = listing(spark, *[dict(slug=f"s{i}", symbol=x, tvl=1.0) for i, x in enumerate(symbols)])
    flows = flow(spark, *[dict(metric="fees", slug=f"s{i}", total1y=5.0) for i in range(n)])
    quotes = market(spark, *[dict(id=x, symbol=x, market_cap=1.0) for x in sorted(set(symbols))])
    heavy = heavy_symbols(entries)
    assert [r.h for r in spark.range(1).select(heavy.alias("h")).collect()] == [["hot"]]
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "48"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        matched = match_quotes(group_rollup(entries, flows), quotes, heavy).withColumn("task", F.spark_partition_id())
        rows = matched.select("k", "symbol", "match_kind", "task").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(rows) == n and {r.match_kind for r in rows} == {"symbol"}
    assert len({r.task for r in rows if r.symbol == "HOT"}) >= 8


def test_heavy_symbols_of_nothing(spark):
    entries = listing(spark, dict(slug="a"), dict(slug="b", symbol="-"))
    assert spark.range(1).select(heavy_symbols(entries).alias("h")).first().h == []
    matched = match_quotes(group_rollup(entries, flow(spark, dict(metric="fees", slug="a", total1y=1.0))), market(spark), heavy_symbols(entries))
    assert matched.count() == 0
