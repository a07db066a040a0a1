"""Feed schemas and the fixed values every stage shares."""

# --- feeds: column -> SQL type ---------------------------------------------

LISTING = {
    "pos": "BIGINT",
    "slug": "STRING",
    "name": "STRING",
    "symbol": "STRING",
    "category": "STRING",
    "chains": "ARRAY<STRING>",
    "gecko_id": "STRING",
    "logo": "STRING",
    "mcap": "DOUBLE",
    "tvl": "DOUBLE",
    "change_1d": "DOUBLE",
    "change_7d": "DOUBLE",
}

FLOW = {
    "metric": "STRING",
    "list_ord": "INT",
    "pos": "BIGINT",
    "slug": "STRING",
    "parent": "STRING",
    "total7d": "DOUBLE",
    "total14dto7d": "DOUBLE",
    "total30d": "DOUBLE",
    "total60dto30d": "DOUBLE",
    "total1y": "DOUBLE",
}

MARKET = {
    "page": "INT",
    "pos": "BIGINT",
    "id": "STRING",
    "symbol": "STRING",
    "current_price": "DOUBLE",
    "market_cap": "DOUBLE",
    "market_cap_rank": "DOUBLE",
    "total_volume": "DOUBLE",
    "price_change_percentage_7d_in_currency": "DOUBLE",
    "price_change_percentage_14d_in_currency": "DOUBLE",
    "price_change_percentage_30d_in_currency": "DOUBLE",
    "fully_diluted_valuation": "DOUBLE",
    "circulating_supply": "DOUBLE",
    "total_supply": "DOUBLE",
    "max_supply": "DOUBLE",
}

# Columns of the joined entity, in output order, after which scoring appends its own.
ENTITY = {
    "slug": "STRING",
    "name": "STRING",
    "symbol": "STRING",
    "category": "STRING",
    "chains": "ARRAY<STRING>",
    "gecko_id": "STRING",
    "logo": "STRING",
    "mcap": "DOUBLE",
    "tvl": "DOUBLE",
    "change1d": "DOUBLE",
    "change7d": "DOUBLE",
    "price": "DOUBLE",
    "market_cap_rank": "DOUBLE",
    "total_volume": "DOUBLE",
    "price_change7d": "DOUBLE",
    "price_change14d": "DOUBLE",
    "price_change30d": "DOUBLE",
    "fees_annual": "DOUBLE",
    "fees7d": "DOUBLE",
    "fees30d": "DOUBLE",
    "fees_change7d": "DOUBLE",
    "fees_change30d": "DOUBLE",
    "revenue_annual": "DOUBLE",
    "revenue30d": "DOUBLE",
    "holder_revenue_annual": "DOUBLE",
    "holder_revenue30d": "DOUBLE",
    "volume_annual": "DOUBLE",
    "volume30d": "DOUBLE",
    "fdv": "DOUBLE",
    "circulating_supply": "DOUBLE",
    "total_supply": "DOUBLE",
    "max_supply": "DOUBLE",
    "first_pos": "BIGINT",
}



def ddl(columns: dict[str, str]) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in columns.items())


# Flow feeds in precedence order: on a conflict the later feed names the parent.
METRICS = ("fees", "revenue", "holder_revenue", "volume")

# --- fixed values ------------------------------------------------------------
# Everything below must hold exactly these values for results to be right.

MIN_ACTIVITY_USD = 100_000.0
MIN_MCAP_USD = 1_000_000.0
MIN_SECTOR_SAMPLE = 5
MIN_VALUE_MULTIPLES = 2
MULTIPLE_CAP = 1000.0
DILUTION_WARN = 1 / 0.3
MAX_ADJUSTMENT = 5.0
LOW_CONFIDENCE = 0.4

WEIGHT_PHR = 0.4
WEIGHT_PS = 0.25
WEIGHT_MCAP_TVL = 0.2
WEIGHT_PF = 0.15


# Seconds after which a landed snapshot counts as expired.
TTL_SECONDS = {
    "listing": 1800,
    "fees": 1800,
    "revenue": 1800,
    "holder_revenue": 1800,
    "volume": 1800,
    "market": 21600,
}

# Sectors whose locked value says something about value.
TVL_SECTORS = (
    "Dexs",
    "Lending",
    "Yield",
    "Derivatives",
    "Liquid Staking",
    "Farm",
    "CDP",
    "Yield Aggregator",
    "Algo-Stables",
    "Staking Pool",
    "Liquidity Manager",
    "Synthetics",
    "Options",
    "Options Vault",
    "Leveraged Farming",
    "Liquid Restaking",
    "Restaking",
    "Insurance",
    "NFT Lending",
    "RWA Lending",
    "Basis Trading",
    "Reserve Currency",
    "Risk Curators",
    "Uncollateralized Lending",
)

# Sector name under which rows without a sector are pooled.
OTHER_SECTOR = "기타"

LABEL_UNDERVALUED = "저평가"
LABEL_MILDLY_UNDERVALUED = "다소 저평가"
LABEL_FAIR = "적정"
LABEL_MILDLY_OVERVALUED = "다소 고평가"
LABEL_OVERVALUED = "고평가"
LABEL_HOLD = "판단보류"

CAPTURE_STRONG = "강한 가치포획"
CAPTURE_CANDIDATE = "가치포획 후보"
CAPTURE_INDIRECT = "간접 포획"
CAPTURE_UNCLEAR = "포획 불명확"

SIGNAL_DIRECT = "holder revenue 실측"
SIGNAL_INDIRECT = "매출/수수료 실측"
SIGNAL_PHR = "P/HR 섹터 상위"
SIGNAL_PS = "P/S 섹터 상위"

RISK_SUB_SCALE = "시총/토큰 데이터 부족"
RISK_NO_HOLDER_REVENUE = "holder revenue 없음"
RISK_UNCLEAR = "현금흐름 불명확"
RISK_LOW_ACTIVITY = "저활동/신선도 낮음"
RISK_DILUTION = "고희석"
RISK_PREFIX = "위험: "

PERCENTILE_SIGNAL = 70.0
SCORE_BANDS = (80.0, 60.0, 40.0, 20.0)
PRESET_UNDERVALUED_MIN = 80.0
PRESET_OVERVALUED_MAX = 20.0

QUOTE_LINK = "https://www.coingecko.com/en/coins/"
LISTING_LINK = "https://defillama.com/protocol/"

MISSING = "–"
