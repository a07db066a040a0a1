import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from relvalue.functions import formats, maths, scoring, text

NAN, INF = float("nan"), float("inf")


def evaluate(spark, build, values, kind="DOUBLE"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i INT, v {kind}")
    return [r.x for r in rows.select("i", build(F.col("v")).alias("x")).orderBy("i").collect()]


@pytest.mark.parametrize("build, cases", [
    (formats.usd, {
        None: "–", 0.0: "$0", 999.4: "$999", 1234.0: "$1.2K", -1234.0: "$-1.2K", 1e6: "$1.00M", 1.005e9: "$1.00B",
        2.5e12: "$2.50T", 999_999.0: "$1000.0K", 0.5: "$1", 1250.0: "$1.3K", 1.125e6: "$1.13M", INF: "–", NAN: "–",
    }),
    (formats.multiple, {
        None: "–", 0.005: "0.01x", 0.015: "0.01x", 1.005: "1.00x", 9.999: "10.00x", 12.25: "12.3x", 12.35: "12.3x",
        99.96: "100.0x", 100.5: "101x", 999.5: "1000x", 1000.0: "1.0Kx", 12345.0: "12.3Kx",
    }),
    (formats.percent, {
        None: "–", 0.0: "+0.0%", 12.34: "+12.3%", -0.25: "-0.3%", -0.04: "-0.0%", 0.25: "+0.3%", 1234.56: "+1234.6%",
    }),
])
def test_formats(spark, build, cases):
    assert dict(zip(cases, evaluate(spark, build, list(cases)))) == cases


def test_kst(spark):
    values = ["2026-07-15T20:05:09.123Z", "2026-01-01T00:00:00Z", "2025-12-31T14:59:59Z", "not a time", None]
    assert evaluate(spark, formats.kst_minute, values, "STRING") == [
        "26. 7. 16. 05:05 KST", "26. 1. 1. 09:00 KST", "25. 12. 31. 23:59 KST", "–", "–"
    ]
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert evaluate(spark, formats.kst_minute, values[:1], "STRING") == ["26. 7. 16. 05:05 KST"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_pretty_parent(spark):
    names = ["parent#alpha-beta_v2", "parent#uniSwap", "parent#a--b", "parent#x-parent#y"]
    assert evaluate(spark, text.pretty_parent, names, "STRING") == ["Alpha Beta V2", "UniSwap", "A  B", "X Parent#y"]


def test_links(spark):
    rows = spark.createDataFrame([("parent#a", None), ("parent#a", "coin")], "slug STRING, gecko_id STRING")
    links = [r.x for r in rows.select(text.entity_link(F.col("slug"), F.col("gecko_id")).alias("x")).collect()]
    assert links[0].endswith("/protocol/a") and links[1].endswith("/coins/coin")


def test_clamp_and_rounding(spark):
    assert evaluate(spark, lambda c: maths.clamp(c, 0.0, 100.0), [None, -1.0, 50.0, 101.0]) == [None, 0.0, 50.0, 100.0]
    assert evaluate(spark, scoring.whole, [62.5, 2.4999999999999996, 0.5, 99.5, None]) == [63, 2, 1, 100, None]


def test_scores(spark):
    assert evaluate(spark, scoring.growth_score, [None, 0.0, 100.0, -300.0]) == [None, 50.0, 100.0, 0.0]
    assert evaluate(spark, scoring.dilution_score, [None, 0.0, -1.0, 1.0, 2.5, 99.0]) == [
        None, None, None, 100.0, pytest.approx(50.05), 0.0
    ]
    assert evaluate(spark, scoring.adjustment, [None, 50.0, 100.0, 0.0]) == [0.0, 0.0, 5.0, -5.0]
    labels = evaluate(spark, scoring.value_label, [80.0, 79.99, 60.0, 40.0, 20.0, 19.9, None])
    assert labels == ["저평가", "다소 저평가", "다소 저평가", "적정", "다소 고평가", "고평가", "판단보류"]


def test_weighted_mean(spark):
    rows = spark.createDataFrame([(1.0, None), (None, None), (1.0, 3.0)], "a DOUBLE, b DOUBLE")
    mean = maths.weighted_mean([(F.col("a"), 0.25), (F.col("b"), 0.75)])
    assert [r.x for r in rows.select(mean.alias("x")).collect()] == [1.0, None, 2.5]


def total(rows):
    """The sum of column a, by ranges."""
    parts = rows.withColumn("o", F.expr(maths.outer_part("a"))).withColumn("range", F.explode(F.expr(maths.sum_ranges("a", "o"))))
    parts = parts.withColumn("a", F.expr(maths.in_sum_range("a", "o", "range")))
    sums = parts.groupBy("range").agg(F.sum("a").alias("a"))
    named = sums.agg(*[F.expr(f"{sql} AS a_{name}") for name, sql in maths.range_sums("a", "range").items()])
    return named.select(F.expr(maths.joined("a"))).first()[0]


@pytest.mark.parametrize("amounts, want", [
    ([0.1, 0.2, None, -1e15], -999999999999999.7),
    ([1e25, 1.0, -1e25], 1.0),
    ([1e300, 1e300, -1e300, 0.25, -1e300], 0.25),
    ([5e-30], 5e-30),
    ([5e-30, 1e9, -1e9], 5e-30),
    ([1e19, 1e19, 1e19, 1e19, 1e19, 1e19, 1e19, 1e19, 1e19, 1e19, 1e19], 1.1e20),
    ([9.9e18] * 20, 1.98e20),
    ([1e308, -1e308, 5e-324], 5e-324),
    ([4.9e-324, 2.5e-310], 2.5e-310 + 4.9e-324),
    ([1e18, 0.3, 1e9], 1000000001000000000.3),
    ([-1e25, -2.5], -1e25 - 2.5),
    ([0.0, -0.0], 0.0),
    ([None, None], None),
    ([], None),
])
def test_sums_of_any_size_in_any_order(spark, amounts, want):
    for seed in range(3):
        random.Random(seed).shuffle(amounts)
        assert total(spark.createDataFrame([(a,) for a in amounts], "a DOUBLE").repartition(1 + seed)) == want


def test_sums_against_fractions(spark):
    """Amounts of all sizes; a total is off by a last bit or two at most."""
    rng = random.Random(4)
    for low, high in ((-300, 300), (-20, 25), (8, 20), (-12, 3)):
        amounts = [rng.choice([-1, 1]) * rng.uniform(1, 10) * 10.0 ** rng.randint(low, high) for _ in range(200)]
        want = float(sum(map(Fraction, amounts)))
        assert total(spark.createDataFrame([(a,) for a in amounts], "a DOUBLE").repartition(3)) == pytest.approx(want, rel=1e-15)


def test_order_key(spark):
    rng = random.Random(2)
    values = [0.0, 1.0, 2.0, 0.5, 5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, 3.0]
    values += [math.nextafter(2.0**e, up) for e in range(-1022, 1024, 31) for up in (0.0, math.inf)] + [2.0**e for e in range(-1022, 1024, 31)]
    values += [rng.uniform(0, 1) * 10.0 ** rng.randint(-300, 300) for _ in range(300)]
    values = sorted({v for x in values for v in (x, -x)})
    rows = spark.createDataFrame([(v,) for v in values], "a DOUBLE").select("a", F.expr(maths.order_key("a")).alias("key")).collect()
    keys = [r.key for r in sorted(rows, key=lambda r: r.a)]
    assert all(a < b for a, b in zip(keys, keys[1:])) and len(keys) == len(values)


def test_place_key(spark):
    rows = [(None, 5), (1, None), (1, -3), (1, 1 << 60), (2, -(1 << 63)), (2, 0), (2147483647, (1 << 63) - 1)]
    got = spark.createDataFrame(rows, "a INT, b BIGINT").select("a", "b", F.expr(maths.place_key("a", "b")).alias("key")).collect()
    assert [(r.a, r.b) for r in sorted(got, key=lambda r: r.key)] == rows
