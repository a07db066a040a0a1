"""Percentiles against counting by hand, with hot values, tiny sectors and skew."""

import random

import pytest

from relvalue import schemas as S
from relvalue.operators import percentiles
from relvalue.plans.screener import gated, ranked
from rows import entity_frame


def brute_force(rows):
    pools, market = {}, {}
    asked = []
    for r in rows:
        if r.insufficient_scale:
            continue
        sector = r.category or S.OTHER_SECTOR
        for m in percentiles.RANKED:
            v = r.multiples[m]
            cash = m in percentiles.CASH_FLOW
            if v is None or (r.low_activity if cash else not r.tvl_sector):
                continue
            asked.append((r.slug, sector, m, v))
            if not cash or v <= S.MULTIPLE_CAP:
                pools.setdefault((sector, m), []).append(v)
                market.setdefault(m, []).append(v)
    result = {}
    for slug, sector, m, v in asked:
        pool = pools.get((sector, m), [])
        if len(pool) < S.MIN_SECTOR_SAMPLE:
            pool = market.get(m, [])
        above = sum(x > v for x in pool)
        result[slug, m] = 50.0 if len(pool) <= 1 else above / (len(pool) - 1) * 100
    return result


def check(spark, rows):
    frame = entity_frame(spark, rows)
    want = brute_force(gated(frame).collect())
    got = {
        (r.slug, m): r.sector_percentiles[m]
        for r in ranked(frame).collect() for m in percentiles.RANKED if r.sector_percentiles[m] is not None
    }
    assert got == want


def make(rng, n, sectors, values):
    rows = []
    for i in range(n):
        rows.append(dict(
            slug=f"e{i}", category=rng.choice(sectors), mcap=rng.choice([5e5, 1e6, 3e6, 1e9, None]),
            fees_annual=values(rng), fees30d=rng.choice([None, 1.0]), revenue_annual=values(rng),
            holder_revenue_annual=values(rng), tvl=values(rng),
        ))
    return rows


def test_skewed_sector_and_copies(spark):
    """A third of all rows in one sector, many of them with the same multiples."""
    rng = random.Random(7)
    sectors = ["Dexs"] * 5 + ["Lending", "Bridge", None, S.OTHER_SECTOR] + [f"tiny-{i}" for i in range(6)]
    check(spark, make(rng, 400, sectors, lambda r: r.choice([None, 1.0, 2e5, 2e5, 2e5, 3e5, r.uniform(1e5, 1e8)])))


@pytest.mark.parametrize("seed", range(3))
def test_distinct_values(spark, seed):
    rng = random.Random(seed)
    sectors = ["Dexs", "Yield", "Farm"] + [f"tiny-{i}" for i in range(40)]
    check(spark, make(rng, 150, sectors, lambda r: 10 ** r.uniform(2, 12)))


def test_nothing_is_hot(spark, monkeypatch):
    """With no value hot, every row goes through the second lookup."""
    rng = random.Random(5)
    monkeypatch.setattr(percentiles, "HOT_SHARE", 0)
    check(spark, make(rng, 150, ["Dexs", "Yield", "tiny-1", "tiny-2"], lambda r: 10 ** r.uniform(4, 9)))


def test_close_values(spark):
    rows = [
        dict(slug=f"e{i}", category="Dexs", mcap=1e9, fees_annual=1e8 + i * 1e-3, fees30d=1.0, tvl=5e8 + i)
        for i in range(40)
    ]
    check(spark, rows)


def test_neighbouring_doubles(spark):
    rows = [
        dict(slug=f"e{i}", category="Dexs", mcap=1e9, fees_annual=1e8 - i * 2.0**-26, fees30d=1.0, tvl=5e8)
        for i in range(30)
    ]
    multiples = {r.multiples.pf for r in gated(entity_frame(spark, rows)).collect()}
    assert len(multiples) > 1 and max(multiples) - min(multiples) < 1e-12
    check(spark, rows)


def test_partitioning_does_not_matter(spark):
    rng = random.Random(3)
    rows = make(rng, 120, ["Dexs", "Yield", "tiny"], lambda r: r.uniform(1e5, 1e7))
    frame = entity_frame(spark, rows)
    one = {r.slug: r.sector_percentiles for r in ranked(frame.coalesce(1)).collect()}
    many = {r.slug: r.sector_percentiles for r in ranked(frame.repartition(13)).collect()}
    assert one == many


def test_pools_without_members(spark):
    check(spark, [dict(slug="only", category="Dexs", mcap=1e9, fees_annual=2e5, fees30d=1.0, tvl=None)])


@pytest.fixture
def eight_ranges(spark):
    """Small tables in as many ranges as large ones."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.unset(key)


@pytest.mark.parametrize("seed", range(3))
def test_many_ranges(spark, eight_ranges, seed):
    """Ties, pools that lie in all ranges, and pools that lie in one."""
    rng = random.Random(seed)
    sectors = ["Dexs"] * 3 + ["Lending", None] + [f"tiny-{i}" for i in range(9)]
    rows = make(rng, 250, sectors, lambda r: r.choice([None, 2e5, 2e5, 7e6, r.uniform(1e5, 1e8)]))
    check(spark, rows)


def test_exchanges(spark, monkeypatch):
    """Twelve at most over the tables and the answer, none of them into a single task but for the metrics' own few rows."""
    from relvalue.operators import materialize, ranges

    plans = []

    def noted(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return materialize.materialize(df, label)

    monkeypatch.setattr(ranges, "materialize", noted)
    monkeypatch.setattr(percentiles, "materialize", noted)
    frame = materialize.materialize(gated(entity_frame(spark, make(random.Random(1), 60, ["Dexs", "a"], lambda r: r.uniform(1e5, 1e8)))), "gated")
    plans.append(percentiles.with_percentiles(frame)._jdf.queryExecution().executedPlan().toString())
    assert len(plans) == 3
    assert sum(p.count("Exchange ") - p.count("BroadcastExchange ") - p.count("ReusedExchange ") for p in plans) <= 12
    assert not any("SinglePartition" in p for p in plans)
