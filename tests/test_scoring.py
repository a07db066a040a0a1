"""Scoring scenarios with worked-out values (percentiles in the order phr, ps, mcap_tvl, pf)."""

import pytest

from relvalue import schemas as S
from relvalue.plans.screener import score
from rows import entity_frame, peers

M = 1e6
DEXS = peers("Dexs")
CASH = dict(fees_annual=300 * M, fees30d=20 * M, revenue_annual=100 * M, revenue30d=8 * M)
HOLDER = dict(holder_revenue_annual=50 * M, holder_revenue30d=4 * M)
THIN = dict(fees_annual=50 * M, fees30d=1 * M)


def dex(slug, **values):
    return dict(slug=slug, category="Dexs", mcap=1000 * M) | values


HR_PEERS = [
    dex(f"hr-peer-{i}", holder_revenue_annual=100 * M / (5 + i), holder_revenue30d=1 * M, **THIN) for i in range(6)
]

U, MU, FAIR, MO, O, HOLD = (
    S.LABEL_UNDERVALUED, S.LABEL_MILDLY_UNDERVALUED, S.LABEL_FAIR,
    S.LABEL_MILDLY_OVERVALUED, S.LABEL_OVERVALUED, S.LABEL_HOLD,
)
STRONG, CANDIDATE, INDIRECT, UNCLEAR = (
    S.CAPTURE_STRONG, S.CAPTURE_CANDIDATE, S.CAPTURE_INDIRECT, S.CAPTURE_UNCLEAR,
)

# name -> (rows, {slug: (percentiles, score, label, confidence, low activity, high dilution, share, capture, capture label)})
SCENARIOS = {
    "cheaper fees multiple scores higher": (
        [dex("cheap", fees_annual=500 * M, fees30d=1 * M, tvl=500 * M),
         dex("pricey", fees_annual=10 * M, fees30d=1 * M, tvl=500 * M), *DEXS],
        {
            "cheap": ((None, None, 0, 100), 43, FAIR, 0.5, False, False, None, 40, INDIRECT),
            "pricey": ((None, None, 0, 0), 0, O, 0.5, False, False, None, 25, INDIRECT),
            "Dexs-peer-0": ((None, None, 0, 85.7143), 37, MO, 0.5, False, False, None, 38, INDIRECT),
        },
    ),
    "below the activity threshold": (
        [dex("zombie", fees_annual=99_999, fees30d=99_999 * 30 / 365, tvl=50 * M), *DEXS],
        {"zombie": ((None, None, 0, None), None, HOLD, 0.13, True, False, None, None, UNCLEAR)},
    ),
    "no multiple at all": (
        [dict(slug="ghost", mcap=5 * M)],
        {"ghost": ((None, None, None, None), None, HOLD, 0.0, True, False, None, None, UNCLEAR)},
    ),
    "a single multiple is not enough": (
        [dex("single", fees_annual=200 * M, fees30d=1 * M), *DEXS],
        {"single": ((None, None, None, 100), None, HOLD, 0.25, False, False, None, 40, INDIRECT)},
    ),
    "locked value does not count for every sector": (
        [dict(slug="bridge", category="Bridge", mcap=1000 * M, tvl=500 * M, fees_annual=100 * M, fees30d=1 * M,
              revenue_annual=50 * M, revenue30d=0.5 * M), *peers("Bridge")],
        {"bridge": ((None, 50, None, 83.3333), 63, MU, 0.5, False, False, None, 33, INDIRECT)},
    ),
    "no flow within 30 days": (
        [dex("stale", fees_annual=500 * M, tvl=500 * M), *DEXS],
        {"stale": ((None, None, 0, None), None, HOLD, 0.13, True, False, None, 23, INDIRECT)},
    ),
    "over-cap multiple is ranked last but pooled nowhere": (
        [dex("glitch", holder_revenue_annual=1, holder_revenue30d=1, **THIN),
         dex("normal-hr", holder_revenue_annual=100 * M, holder_revenue30d=1 * M, **THIN), *HR_PEERS, *DEXS],
        {
            "glitch": ((0, None, None, 0), 0, O, 0.5, False, False, 2e-8, 25, INDIRECT),
            "normal-hr": ((100, None, None, 0), 73, MU, 0.5, False, False, 1, 95, STRONG),
        },
    ),
    "high dilution": (
        [dex("diluted", mcap=100 * M, fdv=1000 * M, tvl=50 * M, fees_annual=20 * M, fees30d=1 * M), *DEXS],
        {"diluted": ((None, None, 0, 100), 38, MO, 0.5, False, True, None, 35, INDIRECT)},
    ),
    "fully circulating": (
        [dex("full", fdv=1000 * M, tvl=500 * M, **THIN), *DEXS],
        {"full": ((None, None, 0, 0), 5, O, 0.5, False, False, None, 30, INDIRECT)},
    ),
    "holder revenue multiple orders rows": (
        [dex("cheap-hr", holder_revenue_annual=200 * M, holder_revenue30d=1 * M, **THIN),
         dex("pricey-hr", holder_revenue_annual=5 * M, holder_revenue30d=100_000, **THIN), *DEXS],
        {
            "cheap-hr": ((100, None, None, 0), 73, MU, 0.5, False, False, 1, 95, STRONG),
            "pricey-hr": ((0, None, None, 0), 0, O, 0.5, False, False, 0.1, 44, CANDIDATE),
        },
    ),
    "small sector falls back to the market": (
        [dict(slug="lonely", category="VeryRareCategory", mcap=1000 * M, fees_annual=200 * M, fees30d=1 * M,
              revenue_annual=100 * M, revenue30d=0.5 * M), *DEXS],
        {"lonely": ((None, 50, None, 100), 69, MU, 0.5, False, False, None, 33, INDIRECT)},
    ),
    "direct and indirect capture": (
        [dex("direct", fdv=1000 * M, tvl=500 * M, **CASH, **HOLDER), dex("indirect", fdv=1000 * M, tvl=500 * M, **CASH),
         *DEXS],
        {
            "direct": ((50, 0, 0, 85.7143), 38, MO, 1.0, False, False, 0.5, 73, STRONG),
            "indirect": ((None, 0, 0, 85.7143), 26, MO, 0.75, False, False, None, 30, INDIRECT),
        },
    ),
    "holder share is bounded": (
        [dex("over", tvl=500 * M, holder_revenue_annual=150 * M, holder_revenue30d=12 * M, **CASH), *DEXS],
        {"over": ((50, 50, 0, 100), 48, FAIR, 1.0, False, False, 1, 85, STRONG)},
    ),
    "dilution lowers capture": (
        [dex("full-float", fdv=1000 * M, tvl=500 * M, **CASH, **HOLDER),
         dex("diluted-capture", fdv=10_000 * M, tvl=500 * M, **CASH, **HOLDER), *DEXS],
        {
            "full-float": ((0, 0, 0, 85.7143), 18, O, 1.0, False, False, 0.5, 63, CANDIDATE),
            "diluted-capture": ((0, 0, 0, 85.7143), 8, O, 1.0, False, True, 0.5, 53, CANDIDATE),
        },
    ),
}


@pytest.mark.parametrize("name", SCENARIOS)
def test_scenario(spark, name):
    rows, expected = SCENARIOS[name]
    scored = {r.slug: r for r in score(entity_frame(spark, rows)).collect()}
    assert len(scored) == len(rows)
    for slug, (pcts, value, label, confidence, low, diluted, share, capture, capture_label) in expected.items():
        r = scored[slug]
        p = r.sector_percentiles
        assert [p.phr, p.ps, p.mcap_tvl, p.pf] == [None if x is None else pytest.approx(x, abs=1e-4) for x in pcts]
        assert (r.value_score, r.label, r.confidence, r.low_activity, r.high_dilution) == (
            value, label, confidence, low, diluted
        )
        c = r.value_capture
        assert c.holder_revenue_share == (None if share is None else pytest.approx(share))
        assert (c.score, c.label) == (capture, capture_label)


def test_capture_tags(spark):
    rows = [
        dex("direct", fdv=1000 * M, tvl=500 * M, **CASH, **HOLDER),
        dex("indirect", fdv=10_000 * M, tvl=500 * M, **CASH),
        dict(slug="tiny", category="Dexs", mcap=10.0, **CASH),
        dict(slug="quiet", category="Dexs", mcap=5 * M),
        *DEXS,
    ]
    tags = {r.slug: r.value_capture for r in score(entity_frame(spark, rows)).collect()}
    assert tags["direct"].signals[0] == S.SIGNAL_DIRECT and tags["direct"].risks == []
    assert tags["indirect"].signals[0] == S.SIGNAL_INDIRECT
    assert tags["indirect"].risks == [S.RISK_NO_HOLDER_REVENUE, S.RISK_DILUTION]
    assert tags["tiny"].signals == [] and tags["tiny"].risks == [S.RISK_SUB_SCALE]
    assert tags["tiny"].label == S.LABEL_HOLD and tags["tiny"].score is None
    assert tags["quiet"].risks == [S.RISK_UNCLEAR, S.RISK_LOW_ACTIVITY]


def test_growth_moves_the_score(spark):
    flat = [dex(f"flat-{i}", tvl=500 * M + i, fees_annual=(20 + i) * M, fees30d=1 * M) for i in range(6)]
    up = [r | dict(fees_change30d=100.0) for r in flat]
    down = [r | dict(fees_change30d=-400.0) for r in flat]
    base = {r.slug: r for r in score(entity_frame(spark, flat)).collect()}
    high = {r.slug: r for r in score(entity_frame(spark, up)).collect()}
    low = {r.slug: r for r in score(entity_frame(spark, down)).collect()}
    assert base["flat-3"].growth_score is None
    assert high["flat-3"].growth_score == 100 and low["flat-3"].growth_score == 0
    assert high["flat-3"].value_score == base["flat-3"].value_score + 5
    assert low["flat-3"].value_score == base["flat-3"].value_score - 5
    assert all((r.value_score is None) == (r.label == HOLD) for r in base.values())
