import random

import pytest
from pyspark.sql import functions as F

from relvalue import schemas as S
from relvalue.operators import ranges
from relvalue.operators.materialize import materialize
from relvalue.operators.screen import SORT_COLUMNS, ScreenSpec, in_range, numbered, order_by, ranks, screen, top
from relvalue.plans.screener import coverage, published, result_meta, sector_list

DDL = """
    slug STRING, name STRING, symbol STRING, category STRING, first_pos BIGINT, value_score INT,
    mcap DOUBLE, fdv DOUBLE, tvl DOUBLE, revenue_annual DOUBLE, revenue30d DOUBLE, holder_revenue_annual DOUBLE,
    price_change14d DOUBLE, price_change30d DOUBLE, fees_change7d DOUBLE,
    multiples STRUCT<ps: DOUBLE, phr: DOUBLE>, value_capture STRUCT<score: INT>,
    low_activity BOOLEAN, high_dilution BOOLEAN
"""


def frame(spark, rows):
    names = [c.strip().split()[0].rstrip(":") for c in DDL.replace("<ps: DOUBLE, phr: DOUBLE>", "").replace("<score: INT>", "").split(",")]
    values = []
    for i, row in enumerate(rows):
        full = dict.fromkeys(names) | dict(
            slug=f"r{i}", name=f"r{i}", first_pos=i, multiples=(None, None), value_capture=(None,),
            low_activity=False, high_dilution=False, mcap=2e6,
        ) | row
        values.append(tuple(full[n] for n in names))
    return spark.createDataFrame(values, DDL)


def slugs(df):
    return {r.slug for r in df.collect()}


@pytest.mark.parametrize(
    "value, low, high, passes",
    [
        (None, 80, 0, False), (85.0, 80, 0, True), (21.0, 0, 20, False), (80.0, 80, 0, True), (20.0, 0, 20, True),
        (15.0, 10, 20, True), (None, 0, 0, True), (-5.0, -1, 0, True), (None, -1, -2, True), (None, 0, 20, False),
    ],
)
def test_range(spark, value, low, high, passes):
    test = in_range(F.col("v"), (low, high))
    rows = spark.createDataFrame([(value,)], "v DOUBLE")
    assert (rows if test is None else rows.where(test)).count() == int(passes)


def test_presets():
    spec = ScreenSpec(search="x", holder_revenue_only=True)
    under, over = spec.preset("undervalued"), spec.preset("overvalued")
    assert under.value_score == (80, 0) and under.descending and under.active_preset == "undervalued"
    assert over.value_score == (0, 20) and not over.descending and over.active_preset == "overvalued"
    assert under.search == "x" and under.holder_revenue_only
    assert over.preset("all").value_score == (0, 0) and over.preset("all").descending
    assert spec.active_preset is None and under.reset() == ScreenSpec()
    with pytest.raises(ValueError):
        spec.preset("other")
    with pytest.raises(ValueError):
        ScreenSpec(sort_key="other")


def test_sort_selection():
    spec = ScreenSpec()
    assert spec.select_sort("name").descending is False
    assert spec.select_sort("category").descending is False
    assert spec.select_sort("mcap").descending is True
    assert spec.select_sort("mcap").select_sort("mcap").descending is False
    assert len(SORT_COLUMNS) == 15


def test_filters(spark):
    rows = frame(spark, [
        dict(low_activity=True),
        dict(holder_revenue_annual=5.0, category="Dexs", value_score=90, multiples=(3.0, 4.0), tvl=7.0),
        dict(high_dilution=True, category="Dexs", value_score=10),
        dict(category=None),
        dict(category="Farm", mcap=9e6),
    ])
    assert slugs(screen(rows)) == {"r1", "r2", "r3", "r4"}
    assert len(slugs(screen(rows, ScreenSpec(hide_low_activity=False)))) == 5
    assert slugs(screen(rows, ScreenSpec(holder_revenue_only=True))) == {"r1"}
    assert slugs(screen(rows, ScreenSpec(exclude_high_dilution=True))) == {"r1", "r3", "r4"}
    assert slugs(screen(rows, ScreenSpec(sectors=("Dexs",)))) == {"r1", "r2"}
    assert slugs(screen(rows, ScreenSpec().preset("undervalued"))) == {"r1"}
    assert slugs(screen(rows, ScreenSpec().preset("overvalued"))) == {"r2"}
    assert slugs(screen(rows, ScreenSpec(mcap=(3e6, 0)))) == {"r4"}
    assert slugs(screen(rows, ScreenSpec(tvl=(0, 7), ps=(3, 3), phr=(0, 4)))) == {"r1"}


def test_search_is_literal(spark):
    rows = frame(spark, [dict(name="100% Pure", symbol="PURE"), dict(name="100 Pure"), dict(name="A_b", symbol=None)])
    assert slugs(screen(rows, ScreenSpec(search="0%"))) == {"r0"}
    assert slugs(screen(rows, ScreenSpec(search="\t PURE pure \n"))) == {"r0"}
    assert slugs(screen(rows, ScreenSpec(search="a_B"))) == {"r2"}
    assert slugs(screen(rows, ScreenSpec(search="  "))) == {"r0", "r1", "r2"}


def test_order(spark):
    rows = frame(spark, [
        dict(value_score=50, mcap=1.0, name="beta", category="b"),
        dict(value_score=None, mcap=None, name="Alpha", category=None),
        dict(value_score=70, mcap=3.0, name="älpha", category="B"),
        dict(value_score=50, mcap=3.0, name="alpha", category="a"),
        dict(value_score=60, mcap=None, name="Zed", category="a"),
    ])

    def order(spec):
        return [r.slug for r in rows.orderBy(*order_by(spec)).collect()]

    assert order(ScreenSpec()) == ["r2", "r4", "r0", "r3", "r1"]
    assert order(ScreenSpec(descending=False)) == ["r0", "r3", "r4", "r2", "r1"]
    assert order(ScreenSpec(sort_key="mcap")) == ["r2", "r3", "r0", "r4", "r1"]
    assert order(ScreenSpec(sort_key="mcap", descending=False)) == ["r0", "r2", "r3", "r4", "r1"]
    assert order(ScreenSpec().select_sort("name")) == ["r3", "r1", "r2", "r0", "r4"]
    # a missing sector sorts as an empty name; case does not count
    assert order(ScreenSpec().select_sort("category")) == ["r1", "r4", "r3", "r2", "r0"]
    assert [(r.rank, r.slug) for r in top(rows, ScreenSpec(), 2).collect()] == [(1, "r2"), (2, "r4")]
    for key in SORT_COLUMNS:
        spec = ScreenSpec(sort_key=key)
        want = [r.slug for r in rows.orderBy(*order_by(spec)).collect()]
        assert [r.slug for r in sorted(numbered(rows.repartition(4), spec).collect(), key=lambda r: r.rank)] == want
    assert numbered(rows.limit(0), ScreenSpec()).collect() == []


def test_every_sort_key(spark):
    rows = frame(spark, [dict(), dict()])
    for key in SORT_COLUMNS:
        assert len(top(rows, ScreenSpec(sort_key=key), 5).collect()) == 2


def test_universes_of_the_metadata(spark):
    rows = frame(spark, [
        dict(category="b", fdv=1.0, mcap=10.0), dict(category="a", mcap=S.MIN_MCAP_USD), dict(category=None, mcap=None),
        dict(category="a", low_activity=True),
    ])
    assert [r.category for r in sector_list(rows).collect()] == ["a", "b"]
    assert slugs(published(rows)) == {"r1", "r3"}
    spec = ScreenSpec().preset("overvalued")
    meta = result_meta(spark, rows.agg(*coverage(spec)).first().asDict(), spec).first()
    assert (meta.fdv_coverage, meta.total, meta.shown, meta.preset) == (1, 2, 0, "overvalued")
    assert rows.agg(*coverage(ScreenSpec())).first().shown == 1


def test_all_orders_in_one_exchange(spark, monkeypatch):
    """Every row's rank under many orders, ties, nulls and both signs among them, over many ranges."""
    rng = random.Random(6)
    pick = lambda *x: rng.choice([None, 0.0, -0.0, 1.0, *x])
    rows = frame(spark, [dict(value_score=rng.choice([None, 0, 50, 99]), mcap=pick(5.0), tvl=pick(-3.0, 1e300), price_change14d=pick(-7.5)) for _ in range(120)]).repartition(3)
    keys = ("value_score", "mcap", "tvl", "price_change14d", "fdv")
    specs = [ScreenSpec(sort_key=key, descending=down) for key in keys for down in (True, False)]
    plans = []

    def noted(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return materialize(df, label)

    monkeypatch.setattr(ranges, "materialize", noted)
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")
    try:
        got = ranks(rows, specs, "slug").collect()
    finally:
        spark.conf.unset(coalesce)
    assert len(plans) == 1 and plans[0].count("rangepartitioning") == 1
    for spec in specs:
        want = [r.slug for r in rows.orderBy(*order_by(spec)).collect()]
        mine = [r for r in got if (r.sort_key, r.descending) == (spec.sort_key, spec.descending)]
        assert [(r.rank, r.slug) for r in sorted(mine, key=lambda r: r.rank)] == list(enumerate(want, 1))
    assert ranks(rows.limit(0), specs, "slug").collect() == []
    with pytest.raises(ValueError):
        ranks(rows, [ScreenSpec(sort_key="name")])


def test_ranks_compute_their_rows_once(spark):
    """Finding the ranges of the orders reads the written keys, not what they were computed from; offsets reach the rows without a shuffle of the rows."""
    seen = spark.sparkContext.accumulator(0)

    def note(x):
        seen.add(1)
        return x

    rows = frame(spark, [dict(mcap=float(i % 7), value_score=i) for i in range(40)]).withColumn("mcap", F.udf(note, "double")("mcap"))
    got = ranks(rows, [ScreenSpec(sort_key="mcap", descending=down) for down in (True, False)], "slug")
    assert got.count() == 80 and seen.value == 40
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
