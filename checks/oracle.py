"""SQL for the registered queries, written independently of the Spark plans.

Percentiles count the greater values row by row, sums are decimals, picks use row numbers.
"""

_WINDOWS = {
    "total7d": (7, 0),
    "total14dto7d": (14, 7),
    "total30d": (30, 0),
    "total60dto30d": (60, 30),
    "total1y": (365, 0),
}
_PRICE = "CAST(l_extendedprice AS DECIMAL(12,2))"
_DISCOUNT = "CAST(l_discount AS DECIMAL(4,2))"
_AMOUNTS = {
    "fees": _PRICE,
    "revenue": f"CAST(0.4 AS DECIMAL(2,1)) * {_PRICE} * (1 - {_DISCOUNT})",
    "holder_revenue": f"CASE WHEN l_returnflag = 'R' THEN 6 * {_PRICE} * {_DISCOUNT} END",
    "volume": "CAST(l_quantity AS DECIMAL(12,2))",
}


def _trailing(amount: str, days: int, until: int) -> str:
    return (
        f"CAST(SUM(CASE WHEN l_shipdate > d - INTERVAL {days} DAY AND l_shipdate <= d - INTERVAL {until} DAY "
        f"THEN {amount} END) AS DOUBLE)"
    )


_SUMS = ",\n    ".join(
    f"{_trailing(amount, *span)} AS {metric}_{window}"
    for metric, amount in _AMOUNTS.items()
    for window, span in _WINDOWS.items()
)
_FLOW = "\n  UNION ALL\n  ".join(
    f"SELECT '{metric}' AS metric, {i} AS list_ord, p_partkey AS pos, slug, "
    + ("CASE WHEN p_partkey % 20 = 2 THEN parent || '_x' ELSE parent END AS parent, " if i == 3 else "parent, ")
    + ", ".join(f"{metric}_{w} AS {w}" for w in list(_WINDOWS)[:4])
    + f", CASE WHEN p_partkey % 13 <> 5 THEN {metric}_total1y END AS total1y FROM entry_sums"
    for i, metric in enumerate(_AMOUNTS)
)
_WIDE = ",\n    ".join(
    f"MAX(CASE WHEN metric = '{m}' THEN {w} END) AS {m}_{w}"
    for m in _AMOUNTS
    for w in ("annual", "d7", "prev7", "d30", "prev30")
)

_FEEDS = f"""
last_day AS (SELECT MAX(l_shipdate) AS d FROM lineitem),
sums AS (
  SELECT l_partkey AS p_partkey,
    {_SUMS}
  FROM lineitem, last_day WHERE l_shipdate > d - INTERVAL 365 DAY GROUP BY l_partkey
),
entry_sums AS (
  SELECT s.*, 'part-' || p.p_partkey AS slug,
    CASE WHEN p.p_partkey % 10 < 3
      THEN 'parent#' || lower(replace(p_brand, '#', '-')) || '_' || lower(p_type) END AS parent
  FROM sums s JOIN part p ON p.p_partkey = s.p_partkey
),
flow AS (
  {_FLOW}
),
locked AS (
  SELECT l_partkey AS p_partkey, CAST(SUM(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE) AS locked
  FROM lineitem WHERE l_linestatus = 'O' GROUP BY l_partkey
),
listing AS (
  SELECT p.p_partkey AS pos, 'part-' || p.p_partkey AS slug, p_name AS name,
    CASE WHEN p.p_partkey % 11 = 0 THEN '-' ELSE upper(replace(p_name, ' ', '')) END AS symbol,
    CASE WHEN p_size = 1 THEN NULL WHEN p_size = 50 THEN p_name ELSE p_brand END AS category,
    lower(p_type) AS chains,
    CASE WHEN p.p_partkey % 3 = 0 THEN 'g' || p.p_partkey END AS gecko_id,
    CASE WHEN p.p_partkey % 5 <> 0 THEN p_retailprice * p_size * 200 END AS mcap,
    CASE WHEN p.p_partkey % 7 <> 0 THEN locked * p_retailprice END AS tvl,
    CAST(p_size AS DOUBLE) - 25 AS change_7d, CAST(p_size AS DOUBLE) / 4 - 3 AS change_1d,
    CASE WHEN p_size % 4 = 0 THEN 'logo/' || p.p_partkey END AS logo
  FROM part p LEFT JOIN locked l ON l.p_partkey = p.p_partkey
),
market AS (
  SELECT page, p_partkey AS pos, CASE WHEN p_partkey % 4 = 0 THEN 'g' ELSE 'm' END || p_partkey AS id, lower(replace(p_name, ' ', '')) AS symbol,
    p_retailprice * page AS current_price, p_retailprice * p_size * 210 * page AS market_cap,
    CAST(p_partkey % 997 AS DOUBLE) AS market_cap_rank, p_retailprice * p_size AS total_volume,
    CAST(p_size AS DOUBLE) * 1000 AS circulating_supply, CAST(p_size AS DOUBLE) * 1500 AS total_supply,
    CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS DOUBLE) * 2000 END AS max_supply,
    CASE WHEN p_size % 9 <> 0 THEN p_size * CAST(0.5 AS DOUBLE) - 10 END AS price_change7d,
    p_retailprice * p_size * 210 * (1 + (p_partkey % 6) * CAST(0.8 AS DOUBLE)) AS fdv,
    CAST(p_size AS DOUBLE) - 20 AS price_change14d, p_size * CAST(1.5 AS DOUBLE) - 40 AS price_change30d
  FROM (SELECT *, unnest(CASE WHEN p_partkey % 8 = 0 THEN [1, 2] ELSE [1] END) AS page FROM part)
)"""


def _exact(x: str) -> str:
    """The sum of the shortest decimals of DOUBLEs, as the DOUBLE nearest to it."""
    return f"CAST(CAST(SUM(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38, 18))) AS VARCHAR) AS DOUBLE)"


_GROUPS = f"""
parent_map AS (
  SELECT slug, parent FROM (
    SELECT slug, parent, row_number() OVER (PARTITION BY slug ORDER BY list_ord DESC, pos DESC) AS rn
    FROM flow WHERE parent IS NOT NULL
  ) WHERE rn = 1
),
flow_rows AS (
  SELECT COALESCE(parent_map.parent, flow.slug) AS k, metric,
    CASE WHEN total1y > 0 THEN total1y WHEN total30d > 0 THEN total30d * 365 / 30 END AS annual,
    CASE WHEN total7d > 0 THEN total7d END AS d7,
    CASE WHEN total14dto7d > 0 THEN total14dto7d END AS prev7,
    CASE WHEN total30d > 0 THEN total30d END AS d30,
    CASE WHEN total60dto30d > 0 THEN total60dto30d END AS prev30
  FROM flow LEFT JOIN parent_map ON parent_map.slug = flow.slug
),
flow_rollup AS (
  SELECT k, metric,
    {_exact('annual')} AS annual, {_exact('d7')} AS d7, {_exact('prev7')} AS prev7,
    {_exact('d30')} AS d30, {_exact('prev30')} AS prev30
  FROM flow_rows GROUP BY k, metric
),
flow_wide AS (
  SELECT k,
    {_WIDE}
  FROM flow_rollup GROUP BY k
),
members AS (
  SELECT COALESCE(parent, listing.slug) AS k, listing.*
  FROM listing LEFT JOIN parent_map ON parent_map.slug = listing.slug
),
representative AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY k ORDER BY
      CASE WHEN gecko_id IS NOT NULL THEN 0 WHEN mcap > 0 THEN 1 ELSE 2 END,
      CASE WHEN gecko_id IS NULL AND NOT COALESCE(mcap > 0, FALSE) THEN -COALESCE(tvl, 0) ELSE 0 END, pos) AS rn
    FROM members
  ) WHERE rn = 1
),
totals AS (
  SELECT k, MIN(pos) AS first_pos, MAX(CASE WHEN mcap > 0 THEN mcap END) AS dl_mcap,
    {_exact('tvl')} AS tvl,
    arg_min(gecko_id, pos) FILTER (WHERE gecko_id IS NOT NULL) AS gecko_id,
    arg_min(symbol, pos) FILTER (WHERE symbol <> '-') AS symbol
  FROM members GROUP BY k
),
groups AS (
  SELECT t.*, r.category, r.chains, r.change_7d AS change7d, r.change_1d AS change1d, r.logo,
    CASE WHEN t.k LIKE 'parent#%' THEN
      array_to_string(list_transform(string_split_regex(substr(t.k, 8), '[-_]'),
        lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ')
      ELSE COALESCE(r.name, t.k) END AS name
  FROM totals t JOIN representative r ON r.k = t.k
)"""

_ENTITIES = """
by_id AS (
  SELECT id AS key, * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY page DESC, pos DESC) AS rn FROM market)
  WHERE rn = 1
),
by_symbol AS (
  SELECT lower(symbol) AS key, * FROM (
    SELECT *, row_number() OVER (
      PARTITION BY lower(symbol) ORDER BY COALESCE(market_cap, 0) DESC, page, pos) AS rn FROM market)
  WHERE rn = 1
),
entity AS (
  SELECT g.k, g.first_pos, g.name, g.symbol, g.category, g.chains, g.change7d, g.change1d, g.logo, f.* EXCLUDE (k), g.tvl,
    COALESCE(i.market_cap_rank, s.market_cap_rank) AS market_cap_rank, COALESCE(i.total_volume, s.total_volume) AS total_volume,
    COALESCE(i.circulating_supply, s.circulating_supply) AS circulating_supply,
    COALESCE(i.total_supply, s.total_supply) AS total_supply, COALESCE(i.max_supply, s.max_supply) AS max_supply,
    COALESCE(g.gecko_id, i.id, s.id) AS gecko_id,
    COALESCE(g.dl_mcap, i.market_cap, s.market_cap) AS mcap,
    COALESCE(i.fdv, s.fdv) AS fdv,
    CASE WHEN i.id IS NOT NULL THEN 'id' WHEN s.id IS NOT NULL THEN 'symbol' END AS match_kind,
    COALESCE(i.current_price, s.current_price) AS price,
    CASE WHEN COALESCE(i.id, s.id) IS NULL THEN g.change7d ELSE COALESCE(i.price_change7d, s.price_change7d) END AS price_change7d,
    COALESCE(i.price_change14d, s.price_change14d) AS price_change14d,
    COALESCE(i.price_change30d, s.price_change30d) AS price_change30d
  FROM groups g
  LEFT JOIN flow_wide f ON f.k = g.k
  LEFT JOIN by_id i ON g.gecko_id = i.key
  LEFT JOIN by_symbol s ON g.gecko_id IS NULL AND lower(g.symbol) = s.key
    AND (f.fees_annual > 0 OR f.revenue_annual > 0 OR f.holder_revenue_annual > 0)
  WHERE COALESCE(g.dl_mcap, i.market_cap, s.market_cap) IS NOT NULL OR g.tvl IS NOT NULL
),
clean AS (
  SELECT * REPLACE (
    CASE WHEN fees_annual > 0 THEN fees_annual END AS fees_annual,
    CASE WHEN revenue_annual > 0 THEN revenue_annual END AS revenue_annual,
    CASE WHEN holder_revenue_annual > 0 THEN holder_revenue_annual END AS holder_revenue_annual),
    CASE WHEN fees_prev7 > 0 THEN (COALESCE(fees_d7, 0) - fees_prev7) / fees_prev7 * 100 END AS fees_change7d,
    CASE WHEN fees_prev30 > 0 THEN (COALESCE(fees_d30, 0) - fees_prev30) / fees_prev30 * 100 END AS fees_change30d
  FROM entity
),
gated AS (
  SELECT *,
    CASE WHEN mcap > 0 AND fees_annual > 0 THEN mcap / fees_annual END AS pf,
    CASE WHEN mcap > 0 AND revenue_annual > 0 THEN mcap / revenue_annual END AS ps,
    CASE WHEN mcap > 0 AND holder_revenue_annual > 0 THEN mcap / holder_revenue_annual END AS phr,
    CASE WHEN mcap > 0 AND tvl > 0 THEN mcap / tvl END AS mcap_tvl,
    CASE WHEN fdv > 0 AND tvl > 0 THEN fdv / tvl END AS fdv_tvl,
    CASE WHEN fdv > 0 AND mcap > 0 THEN fdv / mcap END AS dilution,
    (COALESCE(fees_annual, 0) < 100000 AND COALESCE(revenue_annual, 0) < 100000)
      OR (COALESCE(fees_d30, 0) <= 0 AND COALESCE(revenue_d30, 0) <= 0 AND COALESCE(holder_revenue_d30, 0) <= 0)
      AS low_activity,
    mcap IS NULL OR mcap < 1000000 AS insufficient_scale,
    COALESCE(category <> 'Brand#7', FALSE) AS tvl_sector,
    COALESCE(fdv > 0 AND mcap > 0 AND fdv / mcap > 1 / CAST(0.3 AS DOUBLE), FALSE) AS high_dilution
  FROM clean
)"""

_RANKS = """
ranked AS (
  SELECT k, COALESCE(category, '기타') AS sector, metric, v, pooled FROM (
    SELECT k, category, 'pf' AS metric, pf AS v, pf <= 1000 AS pooled FROM gated
      WHERE NOT insufficient_scale AND NOT low_activity
    UNION ALL
    SELECT k, category, 'ps', ps, ps <= 1000 FROM gated WHERE NOT insufficient_scale AND NOT low_activity
    UNION ALL
    SELECT k, category, 'phr', phr, phr <= 1000 FROM gated WHERE NOT insufficient_scale AND NOT low_activity
    UNION ALL
    SELECT k, category, 'mcap_tvl', mcap_tvl, TRUE FROM gated WHERE NOT insufficient_scale AND tvl_sector
  ) WHERE v IS NOT NULL
),
pool AS (SELECT * FROM ranked WHERE pooled),
counted AS (
  SELECT r.k, r.metric,
    (SELECT COUNT(*) FROM pool p WHERE p.metric = r.metric AND p.sector = r.sector) AS sector_n,
    (SELECT COUNT(*) FROM pool p WHERE p.metric = r.metric) AS market_n,
    (SELECT COUNT(*) FROM pool p WHERE p.metric = r.metric AND p.sector = r.sector AND p.v > r.v) AS sector_above,
    (SELECT COUNT(*) FROM pool p WHERE p.metric = r.metric AND p.v > r.v) AS market_above
  FROM ranked r
),
percentile AS (
  SELECT k, metric,
    CASE WHEN sector_n >= 5 THEN CAST(sector_above AS DOUBLE) / (sector_n - 1) * 100
      WHEN market_n <= 1 THEN 50.0
      ELSE CAST(market_above AS DOUBLE) / (market_n - 1) * 100 END AS pct
  FROM counted
),
percentiles AS (
  SELECT g.k,
    MAX(CASE WHEN metric = 'pf' THEN pct END) AS pf, MAX(CASE WHEN metric = 'ps' THEN pct END) AS ps,
    MAX(CASE WHEN metric = 'phr' THEN pct END) AS phr,
    MAX(CASE WHEN metric = 'mcap_tvl' THEN pct END) AS mcap_tvl
  FROM gated g LEFT JOIN percentile p ON p.k = g.k GROUP BY g.k
)"""

_SCORES = """
base AS (
  SELECT g.*, p.pf AS pct_pf, p.ps AS pct_ps, p.phr AS pct_phr, p.mcap_tvl AS pct_mt,
    (p.pf IS NOT NULL)::INT + (p.ps IS NOT NULL)::INT + (p.phr IS NOT NULL)::INT + (p.mcap_tvl IS NOT NULL)::INT AS cnt,
    CASE WHEN NOT insufficient_scale AND fees_change30d IS NOT NULL
      THEN greatest(0, least(100, 50 + fees_change30d * CAST(0.5 AS DOUBLE))) END AS growth_score,
    CASE WHEN dilution > 0 THEN greatest(0, least(100, 100 - (dilution - 1) * CAST(33.3 AS DOUBLE))) END AS dil
  FROM gated g JOIN percentiles p ON p.k = g.k
),
raw AS (
  SELECT *,
    CASE WHEN cnt >= 2 THEN greatest(0, least(100,
      (COALESCE(pct_phr * CAST(0.4 AS DOUBLE), 0) + COALESCE(pct_ps * CAST(0.25 AS DOUBLE), 0)
        + COALESCE(pct_mt * CAST(0.2 AS DOUBLE), 0) + COALESCE(pct_pf * CAST(0.15 AS DOUBLE), 0))
      / (CASE WHEN pct_phr IS NULL THEN 0 ELSE CAST(0.4 AS DOUBLE) END
        + CASE WHEN pct_ps IS NULL THEN 0 ELSE CAST(0.25 AS DOUBLE) END
        + CASE WHEN pct_mt IS NULL THEN 0 ELSE CAST(0.2 AS DOUBLE) END
        + CASE WHEN pct_pf IS NULL THEN 0 ELSE CAST(0.15 AS DOUBLE) END)
      + COALESCE((growth_score - 50) / 50 * 5, 0) + COALESCE((dil - 50) / 50 * 5, 0))) END AS raw_score,
    CASE WHEN holder_revenue_annual > 0 THEN
      CASE WHEN revenue_annual > 0 THEN least(1, holder_revenue_annual / revenue_annual)
        WHEN fees_annual > 0 THEN least(1, holder_revenue_annual / fees_annual) ELSE 1.0 END END AS share,
    COALESCE(holder_revenue_annual >= 100000 AND holder_revenue_d30 > 0, FALSE) AS direct,
    COALESCE(revenue_annual >= 100000, FALSE) OR COALESCE(fees_annual >= 100000, FALSE) AS earns
  FROM base
),
scored AS (
  SELECT *,
    CAST(round(raw_score) AS INT) AS value_score,
    CASE WHEN raw_score IS NULL THEN '판단보류' WHEN raw_score >= 80 THEN '저평가' WHEN raw_score >= 60 THEN '다소 저평가'
      WHEN raw_score >= 40 THEN '적정' WHEN raw_score >= 20 THEN '다소 고평가' ELSE '고평가' END AS label,
    round(CAST(cnt AS DOUBLE) / 4 * CASE WHEN low_activity THEN CAST(0.5 AS DOUBLE) ELSE 1 END, 2) AS confidence,
    CASE WHEN direct THEN CAST(35 AS DOUBLE) + share * 35 + COALESCE(pct_phr, 50) / 100 * 20 + COALESCE(dil, 50) / 100 * 10
        - CASE WHEN low_activity THEN 10 ELSE 0 END
      WHEN earns THEN CAST(20 AS DOUBLE) + COALESCE(pct_ps, pct_pf, 50) / 100 * 15 + COALESCE(dil, 50) / 100 * 10
        - CASE WHEN low_activity THEN 10 ELSE 0 END END AS raw_capture
  FROM raw
),
captured AS (
  SELECT *,
    CASE WHEN NOT insufficient_scale AND raw_capture IS NOT NULL
      THEN CAST(round(greatest(0, least(100, raw_capture))) AS INT) END AS capture_score,
    CASE WHEN insufficient_scale THEN '판단보류' WHEN direct AND raw_capture >= 70 THEN '강한 가치포획'
      WHEN direct THEN '가치포획 후보' WHEN earns THEN '간접 포획' ELSE '포획 불명확' END AS capture_label,
    CASE WHEN insufficient_scale THEN [] ELSE list_filter([
      CASE WHEN direct THEN 'holder revenue 실측' WHEN earns THEN '매출/수수료 실측' END,
      CASE WHEN pct_phr >= 70 THEN 'P/HR 섹터 상위' END,
      CASE WHEN pct_ps >= 70 THEN 'P/S 섹터 상위' END], lambda x: x IS NOT NULL) END AS signals,
    CASE WHEN insufficient_scale THEN ['시총/토큰 데이터 부족'] ELSE list_filter([
      CASE WHEN direct THEN NULL WHEN earns THEN 'holder revenue 없음' ELSE '현금흐름 불명확' END,
      CASE WHEN low_activity THEN '저활동/신선도 낮음' END,
      CASE WHEN high_dilution THEN '고희석' END], lambda x: x IS NOT NULL) END AS risks
  FROM scored
),
published AS (SELECT * FROM captured WHERE mcap >= 1000000)"""


def _with(select: str, *blocks: str) -> str:
    return "WITH " + ",".join(blocks) + "\n" + select


def _feeds(select: str) -> str:
    return _with(select, _FEEDS)


def _groups(select: str) -> str:
    return _with(select, _FEEDS, _GROUPS)


def _entities(select: str) -> str:
    return _with(select, _FEEDS, _GROUPS, _ENTITIES)


def _ranks(select: str) -> str:
    return _with(select, _FEEDS, _GROUPS, _ENTITIES, _RANKS)


def _scores(select: str) -> str:
    return _with(select, _FEEDS, _GROUPS, _ENTITIES, _RANKS, _SCORES)


def _ranked(where: str, order: str, kind: str = "BIGINT", limit: str = "") -> str:
    return _scores(
        f"SELECT CAST(row_number() OVER (ORDER BY {order}) AS {kind}) AS rank, k, value_score "
        f"FROM published WHERE {where} ORDER BY rank {limit}"
    )


_SORT_KEYS = {
    "value_score": "value_score", "capture_score": "capture_score", "ps": "ps", "phr": "phr", "revenue_annual": "revenue_annual",
    "holder_revenue_annual": "holder_revenue_annual", "revenue30d": "revenue_d30", "mcap": "mcap", "fdv": "fdv", "tvl": "tvl",
    "price_change14d": "price_change14d", "price_change30d": "price_change30d", "fees_change7d": "fees_change7d",
}


def _fixed(x: str, digits: int) -> str:
    """Text with fixed places; true halves, which the C library rounds to even, go up."""
    half = f"abs({x}) * {2 ** (digits + 1)} % 2 = 1"
    return f"printf('%.{digits}f', CASE WHEN {half} THEN {x} + sign({x}) * 1e-6 ELSE {x} END)"


def _usd(x: str) -> str:
    return (
        f"CASE WHEN {x} IS NULL THEN '–' WHEN abs({x}) >= 1e12 THEN '$' || {_fixed(f'({x} / 1e12)', 2)} || 'T' "
        f"WHEN abs({x}) >= 1e9 THEN '$' || {_fixed(f'({x} / 1e9)', 2)} || 'B' "
        f"WHEN abs({x}) >= 1e6 THEN '$' || {_fixed(f'({x} / 1e6)', 2)} || 'M' "
        f"WHEN abs({x}) >= 1e3 THEN '$' || {_fixed(f'({x} / 1e3)', 1)} || 'K' "
        f"ELSE '$' || {_fixed(x, 0)} END"
    )


def _mult(x: str) -> str:
    return (
        f"CASE WHEN {x} IS NULL THEN '–' WHEN {x} >= 1000 THEN {_fixed(f'({x} / 1000)', 1)} || 'Kx' "
        f"WHEN {x} >= 100 THEN {_fixed(x, 0)} || 'x' WHEN {x} >= 10 THEN {_fixed(x, 1)} || 'x' "
        f"ELSE {_fixed(x, 2)} || 'x' END"
    )


def _pct(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN '–' ELSE CASE WHEN {x} >= 0 THEN '+' ELSE '' END || {_fixed(x, 1)} || '%' END"


_DEFAULT_ORDER = "value_score DESC NULLS LAST, first_pos"

# The sectors whose locked value counts.
_TVL_SECTORS = (
    "'Dexs', 'Lending', 'Yield', 'Derivatives', 'Liquid Staking', 'Farm', 'CDP', 'Yield Aggregator', 'Algo-Stables', 'Staking Pool', "
    "'Liquidity Manager', 'Synthetics', 'Options', 'Options Vault', 'Leveraged Farming', 'Liquid Restaking', 'Restaking', 'Insurance', "
    "'NFT Lending', 'RWA Lending', 'Basis Trading', 'Reserve Currency', 'Risk Curators', 'Uncollateralized Lending'"
)

_SECTORS = ", ".join(f"'Brand#{i}'" for i in range(1, 16))

ORACLE = {
    "type_guards": (
        "SELECT p_partkey AS k, CASE WHEN p_partkey % 5 > 1 THEN 's' || p_partkey END AS slug, "
        "CASE WHEN p_partkey % 4 = 3 THEN p_retailprice END AS mcap, "
        "CASE WHEN p_partkey % 3 = 1 THEN 'a,b' ELSE '' END AS chains FROM part"
    ),
    "parent_map": _groups("SELECT slug, parent FROM parent_map"),
    "flow_rollup": _groups("SELECT * FROM flow_rollup"),
    "group_meta": _groups(
        "SELECT k, first_pos, name, symbol, gecko_id, category, chains, dl_mcap, tvl, change7d FROM groups"
    ),
    "market_by_id": _entities("SELECT key, id, market_cap, fdv FROM by_id"),
    "market_by_symbol": _entities("SELECT key, id, market_cap, fdv FROM by_symbol"),
    "quote_match": _entities("SELECT k, gecko_id, mcap, fdv, match_kind FROM entity"),
    "entities": _entities(
        "SELECT k, name, symbol, category, gecko_id, mcap, tvl, change7d, price, "
        "price_change7d, price_change14d, price_change30d, fees_annual, fees_d7 AS fees7d, fees_d30 AS fees30d, "
        "revenue_annual, revenue_d30 AS revenue30d, holder_revenue_annual, holder_revenue_d30 AS holder_revenue30d, "
        "volume_annual, volume_d30 AS volume30d, fdv, logo, change1d, market_cap_rank, total_volume, "
        "circulating_supply, total_supply, max_supply FROM clean"
    ),
    "growth": _entities("SELECT k, fees_change7d, fees_change30d FROM clean"),
    "multiples": _entities("SELECT k, pf, ps, phr, mcap_tvl, fdv_tvl, dilution FROM gated"),
    "gates": _entities("SELECT k, low_activity, insufficient_scale, high_dilution, tvl_sector FROM gated"),
    "pool_sizes": _ranks(
        "SELECT sector AS category, metric, COUNT(*) AS n FROM pool GROUP BY sector, metric "
        "UNION ALL SELECT NULL, metric, COUNT(*) FROM pool GROUP BY metric"
    ),
    "sector_percentiles": _ranks("SELECT k, pf, ps, phr, mcap_tvl FROM percentiles"),
    "value_scores": _scores("SELECT k, growth_score, value_score, label, confidence FROM captured"),
    "value_capture": _scores(
        "SELECT k, capture_score AS score, capture_label AS label, CAST(share AS DOUBLE) AS share, "
        "array_to_string(signals, '|') AS signals, array_to_string(risks, '|') AS risks FROM captured"
    ),
    "screen_default": _scores("SELECT k, value_score FROM published WHERE NOT low_activity"),
    "screen_undervalued": _scores("SELECT k, value_score FROM published WHERE NOT low_activity AND value_score >= 80"),
    "screen_overvalued": _scores("SELECT k, value_score FROM published WHERE NOT low_activity AND value_score <= 20"),
    "screen_combined": _scores(
        "SELECT k, value_score FROM published WHERE NOT low_activity AND holder_revenue_annual IS NOT NULL "
        f"AND NOT high_dilution AND category IN ({_SECTORS}) AND mcap BETWEEN 1200000 AND 9000000 "
        "AND tvl >= 100000 AND phr BETWEEN 1 AND 500 AND ps <= 40 "
        "AND contains(lower(name || ' ' || COALESCE(symbol, '')), 'd')"
    ),
    "ranked_top": _ranked("NOT low_activity", _DEFAULT_ORDER, "INT", "LIMIT 50"),
    "ranked_all": _ranked("NOT low_activity", _DEFAULT_ORDER),
    "ranked_by_category": _ranked("TRUE", f"lower(COALESCE(category, '')), {_DEFAULT_ORDER}"),
    "sort_ranks": _scores(" UNION ALL ".join(
        f"SELECT '{key}' AS sort_key, {way == 'DESC'} AS descending, "
        f"row_number() OVER (ORDER BY {column} {way} NULLS LAST, {_DEFAULT_ORDER}) AS rank, k FROM published"
        for key, column in _SORT_KEYS.items() for way in ("DESC", "ASC")
    )),
    "ranked_by_name": _ranked("TRUE", f"lower(name), {_DEFAULT_ORDER}"),
    "ranked_by_phr": _ranked("NOT low_activity", f"phr ASC NULLS LAST, {_DEFAULT_ORDER}"),
    "sector_list": _entities("SELECT DISTINCT category FROM entity WHERE category IS NOT NULL"),
    "result_meta": _scores(
        "SELECT (SELECT COUNT(fdv) FROM captured) AS fdv_coverage, "
        "(SELECT COUNT(*) FROM published WHERE NOT low_activity AND value_score >= 80) AS shown, "
        "(SELECT COUNT(*) FROM published) AS total, 'undervalued' AS preset, "
        "strftime(d + INTERVAL 9 HOUR, '%y. %-m. %-d. %H:%M KST') AS as_of FROM last_day"
    ),
    "response_rows": _scores(
        f"SELECT row_number() OVER (ORDER BY {_DEFAULT_ORDER}) AS rank, k AS slug, name, symbol, category, chains, gecko_id AS \"geckoId\", logo, "
        "mcap, tvl, change1d, change7d, price, market_cap_rank AS \"marketCapRank\", total_volume AS \"totalVolume\", "
        "price_change7d AS \"priceChange7d\", price_change14d AS \"priceChange14d\", price_change30d AS \"priceChange30d\", "
        "fees_annual AS \"feesAnnual\", fees_d7 AS fees7d, fees_d30 AS fees30d, fees_change7d AS \"feesChange7dover7d\", "
        "fees_change30d AS \"feesChange30dover30d\", revenue_annual AS \"revenueAnnual\", revenue_d30 AS revenue30d, "
        "holder_revenue_annual AS \"holderRevenueAnnual\", holder_revenue_d30 AS \"holderRevenue30d\", volume_annual AS \"volumeAnnual\", "
        "volume_d30 AS volume30d, fdv, circulating_supply AS \"circulatingSupply\", total_supply AS \"totalSupply\", max_supply AS \"maxSupply\", "
        "growth_score AS \"growthScore\", value_score AS \"valueScore\", label, confidence, low_activity AS \"lowActivity\", high_dilution AS \"highDilution\", "
        "pf AS multiple_pf, ps AS multiple_ps, phr AS multiple_phr, mcap_tvl AS \"multiple_mcapTvl\", fdv_tvl AS \"multiple_fdvTvl\", dilution AS multiple_dilution, "
        "pct_pf AS percentile_pf, pct_ps AS percentile_ps, pct_phr AS percentile_phr, pct_mt AS \"percentile_mcapTvl\", "
        "capture_score, capture_label, CAST(share AS DOUBLE) AS \"capture_holderRevenueShare\", "
        "array_to_string(signals, '|') AS capture_signals, array_to_string(risks, '|') AS capture_risks FROM published"
    ),
    "tvl_sectors": _entities(
        "SELECT k, sector AS category, COALESCE(sector <> 'Bridge', FALSE) AS tvl_sector FROM (SELECT k, CASE WHEN category LIKE 'Brand#%' THEN "
        f"COALESCE([{_TVL_SECTORS}][CAST(substr(category, 7) AS INT)], 'Bridge') END AS sector FROM clean)"
    ),
    "freshness_report": (
        "WITH last AS (SELECT MAX(l_shipdate) + INTERVAL 3 HOUR AS now FROM lineitem), newest AS ("
        "SELECT ['listing', 'fees', 'revenue', 'holder_revenue', 'volume', 'market'][l_linenumber % 6 + 1] AS source, MAX(l_shipdate) AS taken FROM lineitem GROUP BY 1) "
        "SELECT source, strftime(taken, '%Y-%m-%dT%H-%M-%S') AS snapshot_ts, date_diff('second', taken, now) AS age_seconds, "
        "CASE WHEN source = 'market' THEN 21600 ELSE 1800 END AS ttl_seconds, "
        "date_diff('second', taken, now) > CASE WHEN source = 'market' THEN 21600 ELSE 1800 END AS is_expired FROM newest, last"
    ),
    "landed_lines": _feeds("SELECT row_number() OVER (ORDER BY page, pos) AS nth, page, id, symbol, market_cap, fdv, max_supply FROM market"),
    "report": _scores(
        "SELECT k, name, symbol, "
        "CASE WHEN gecko_id IS NOT NULL THEN 'https://www.coingecko.com/en/coins/' || gecko_id "
        "ELSE 'https://defillama.com/protocol/' || regexp_replace(k, '^parent#', '') END AS link, "
        "COALESCE(category, '–') AS category, COALESCE(CAST(value_score AS VARCHAR), '판단보류') AS value_score, "
        "CASE WHEN value_score IS NOT NULL THEN label || ' · 신뢰도 ' || CAST(round(confidence * 100) AS INT) || '%' END "
        "AS value_note, value_score IS NOT NULL AND confidence < 0.4 AS low_confidence, "
        "COALESCE(CAST(capture_score AS VARCHAR), '–') AS capture_score, capture_label, "
        "COALESCE(NULLIF(array_to_string(list_concat(signals, list_transform(risks, lambda r: '위험: ' || r)), ' · '), ''), "
        "capture_label) AS capture_note, "
        f"{_mult('ps')} AS ps, {_mult('phr')} AS phr, {_usd('revenue_annual')} AS revenue_annual, "
        f"{_usd('holder_revenue_annual')} AS holder_revenue_annual, {_usd('revenue_d30')} AS revenue30d, "
        f"{_usd('mcap')} AS mcap, {_usd('fdv')} AS fdv, high_dilution AS dilution_warning, {_usd('tvl')} AS tvl, "
        f"{_pct('price_change14d')} AS price_change14d, {_pct('price_change30d')} AS price_change30d, "
        f"{_pct('fees_change7d')} AS fees_change7d, '30d ' || {_pct('fees_change30d')} AS fees_change30d "
        "FROM published"
    ),
}
