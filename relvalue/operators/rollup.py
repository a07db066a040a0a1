"""Roll listing and flow rows up to their parent entity.

Aggregates hash: they hold numbers only, and text that must come along is a grouping key or is
fetched afterwards.

1. Both feeds are stacked into rows of one amount each: a slug, the parent it names, what the amount is (a metric's
   window, or locked value) and its range (see ``maths.sum_ranges``), and reduced by these. That combines
   before the shuffle, so a slug that holds a large share of all rows arrives as a few rows per map task.
2. A window over the reduced rows of a slug finds its parent: the row that ranks highest names it.
3. The rows are reduced again per group (parent, or the slug itself). What is left of a group, a row for each amount and range, then
   meets in one task, where ranges are joined and amounts put side by side.
4. The members that lend a group its descriptive fields are known by position; one join on the
   position fetches the fields.

``pos`` identifies a listing row and lies in [0, 2^61).
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relvalue import schemas as S
from relvalue.functions.guards import conform
from relvalue.functions.maths import in_sum_range, joined, order_key, outer_part, place_key, positive, range_sums, sum_ranges
from relvalue.functions.text import PARENT_PREFIX, pretty_parent

WINDOWS = ("annual", "d7", "prev7", "d30", "prev30")
_FLOWS = tuple(f"{m}_{w}" for m in S.METRICS for w in WINDOWS)

# What a stacked row's amount is: the place of a metric's window among all, or this for the locked value of a listing row.
_LOCKED = len(_FLOWS)
_POS_LIMIT = 1 << 61
# What listing rows add beside amounts, and the aggregate that reduces each.
_MEMBER = {"first_pos": "min", "dl_mcap": "max", "id_pos": "min", "symbol_pos": "min", "rep_0": "min", "rep_1": "min", "rep_2": "min"}
# Fields that a group takes from a member.
_LENT = ("gecko_id", "symbol", "name", "category", "chains", "logo", "change_1d", "change_7d")


def _strongest(rows: DataFrame) -> DataFrame:
    """``parent``: the one that the slug's highest claim names. The rows are reduced by slug and parent."""
    return rows.withColumn("parent", F.max_by("parent", "claim").over(Window.partitionBy("slug")))


def parent_map(flow: DataFrame) -> DataFrame:
    """slug -> parent; the last feed (then the last row) that names a parent wins."""
    rows = conform(flow, S.FLOW).where("slug IS NOT NULL AND parent IS NOT NULL")
    claims = rows.groupBy("slug", "parent").agg(F.max(F.expr(place_key("list_ord", "pos"))).alias("claim"))
    highest = F.max("claim").over(Window.partitionBy("slug"))
    return claims.withColumn("highest", highest).where("claim = highest").select("slug", "parent")


def _ranged(rows: DataFrame, *keep: str) -> DataFrame:
    """A row for each range that a row's amount falls in (null amounts stay), with what it adds to it."""
    spread = rows.withColumn("outer_part", F.expr(outer_part("amount"))).withColumn("range", F.explode(F.expr(sum_ranges("amount", "outer_part"))))
    return spread.selectExpr(*keep, "what", "range", f"{in_sum_range('amount', 'outer_part', 'range')} AS amount")


def _flow_rows(flow: DataFrame) -> DataFrame:
    """Positive amounts only; the first window's row stays in any case. A year's total stands as it is, else 30 days are scaled to a year."""
    kind = " ".join(f"WHEN '{m}' THEN {i * len(WINDOWS)}" for i, m in enumerate(S.METRICS))
    amounts = {
        "annual": "CASE WHEN total1y > 0 THEN total1y WHEN total30d > 0 THEN total30d * 365 / 30 END",
        "d7": "CASE WHEN total7d > 0 THEN total7d END",
        "prev7": "CASE WHEN total14dto7d > 0 THEN total14dto7d END",
        "d30": "CASE WHEN total30d > 0 THEN total30d END",
        "prev30": "CASE WHEN total60dto30d > 0 THEN total60dto30d END",
    }
    each = ", ".join(f"struct({i} AS window, {amounts[w]} AS amount)" for i, w in enumerate(WINDOWS))
    rows = conform(flow, S.FLOW).where("slug IS NOT NULL").selectExpr(
        "slug", "parent",
        f"CASE WHEN parent IS NOT NULL THEN {place_key('list_ord', 'pos')} END AS claim",
        f"CASE metric {kind} ELSE {_LOCKED + 1} END AS kind",
        f"inline(array({each}))",
    )
    rows = rows.where("amount IS NOT NULL OR window = 0").withColumn("what", F.expr("kind + window"))
    return _ranged(rows, "slug", "parent", "claim")


def _listing_rows(listing: DataFrame) -> DataFrame:
    """``rep_0`` to ``rep_2`` order the members of a tier by who lends the descriptive fields.

    Tiers: those with an id, with a market value, the rest by locked value; then by position.
    """
    by_tvl = f"CAST(-{order_key('coalesce(tvl, 0D)')} AS DECIMAL(19, 0)) * {_POS_LIMIT}BD + CAST(pos AS DECIMAL(19, 0))"
    rows = (
        conform(listing, S.LISTING)
        .where("slug IS NOT NULL")
        .selectExpr(
            "slug",
            f"{_LOCKED} AS what",
            "tvl AS amount",
            "pos AS first_pos",
            "CASE WHEN mcap > 0 THEN mcap END AS dl_mcap",
            "CASE WHEN gecko_id IS NOT NULL THEN pos END AS id_pos",
            "CASE WHEN symbol <> '-' THEN pos END AS symbol_pos",
            "CASE WHEN gecko_id IS NOT NULL THEN pos END AS rep_0",
            "CASE WHEN gecko_id IS NULL AND mcap > 0 THEN pos END AS rep_1",
            f"CASE WHEN gecko_id IS NULL AND NOT coalesce(mcap > 0, false) THEN {by_tvl} END AS rep_2",
        )
    )
    return _ranged(rows, "slug", *_MEMBER)


def _reduced(rows: DataFrame, *keys: str) -> DataFrame:
    """Sums of the amounts by ``keys``, and the members' numbers where the rows have them."""
    columns = set(rows.columns)
    aggregates = ["sum(amount) AS amount"]
    aggregates += [f"max({c}) AS {c}" for c in ("claim",) if c in columns]
    aggregates += [f"{reduce}({c}) AS {c}" for c, reduce in _MEMBER.items() if c in columns]
    return rows.groupBy(*keys).agg(*map(F.expr, aggregates))


def _totals(rows: DataFrame) -> DataFrame:
    """Stacked rows reduced per slug, then per group key ``k``: a row for each of the group's amounts, as ``total``."""
    per_slug = _strongest(_reduced(rows, "slug", "parent", "what", "range"))
    ranges = _reduced(per_slug.withColumn("k", F.coalesce("parent", "slug")).drop("claim"), "k", "what", "range")
    ranges = ranges.repartition("k")  # serves the groupings by k that follow, too
    members = [f"{reduce}({c}) AS {c}" for c, reduce in _MEMBER.items() if c in ranges.columns]
    sums = [f"{sql} AS amount_{name}" for name, sql in range_sums("amount", "range").items()]
    whole = ranges.groupBy("k", "what").agg(*map(F.expr, [*sums, *members]))
    return whole.withColumn("total", F.expr(joined("amount"))).drop(*(f"amount_{name}" for name in range_sums("", "")))


def _pick(what: str, name: str) -> Column:
    return F.expr(f"max(CASE WHEN {what} THEN total END) AS {name}")


def flow_rollup(flow: DataFrame) -> DataFrame:
    """Positive flows summed per group and metric, groups without a listing row included."""
    names, n = F.array(*map(F.lit, S.METRICS)), len(WINDOWS)
    return (
        _totals(_flow_rows(flow)).where(f"what < {_LOCKED}")
        .groupBy("k", F.expr(f"what div {n}").cast("int").alias("kind")).agg(*[_pick(f"what % {n} = {i}", w) for i, w in enumerate(WINDOWS)])
        .select("k", names[F.col("kind")].alias("metric"), *[positive(F.col(w)).alias(w) for w in WINDOWS])
    )


def _with_lent(groups: DataFrame, listing: DataFrame) -> DataFrame:
    """Groups with the fields of the members at ``id_pos``, ``symbol_pos`` and ``rep_pos``.

    A group goes along with its representative only. A group needs three members at most.
    """
    numbers = [c for c in groups.columns if c != "k"]
    wanted = groups.select(
        "k", F.struct(*numbers).alias("g"), F.explode(F.array_distinct(F.array_compact(F.array("rep_pos", "id_pos", "symbol_pos")))).alias("pos")
    ).withColumn("g", F.when(F.col("pos") == F.col("g.rep_pos"), F.col("g")))
    members = conform(listing, S.LISTING).where("slug IS NOT NULL").select("pos", F.struct(*_LENT).alias("member"))
    found = wanted.join(members, "pos").groupBy("k").agg(F.collect_list(F.struct("pos", "g", "member")).alias("found"))
    rep = found.withColumn("rep", F.filter("found", lambda x: x["g"].isNotNull())[0])

    def lent(pos: str, field: str):
        return F.filter("found", lambda x: x["pos"] == F.col(f"rep.g.{pos}"))

    one = {field: F.get(lent(pos, field), F.lit(0))["member"][field].alias(field) for field, pos in (("gecko_id", "id_pos"), ("symbol", "symbol_pos"))}
    return rep.select("k", "rep.g.*", *one.values(), *[F.col(f"rep.member.{c}").alias(c) for c in _LENT if c not in one])


def group_rollup(listing: DataFrame, flow: DataFrame) -> DataFrame:
    """One row per listed group: descriptive fields, market value, locked value and its flows.

    Groups known from flows only have no listing row and drop out.
    """
    rows = _flow_rows(flow).unionByName(_listing_rows(listing), allowMissingColumns=True)
    amounts = [_pick(f"what = {i}", c) for i, c in enumerate((*_FLOWS, "tvl"))]
    groups = (
        _totals(rows)
        .groupBy("k").agg(*amounts, *[F.expr(f"{reduce}({c}) AS {c}") for c, reduce in _MEMBER.items()])
        .where("first_pos IS NOT NULL")
        .selectExpr(
            "k", "first_pos", "dl_mcap", "id_pos", "symbol_pos",
            f"coalesce(rep_0, rep_1, CAST(pmod(rep_2, {_POS_LIMIT}BD) AS BIGINT)) AS rep_pos", *_FLOWS, "tvl",
        )
    )
    is_parent = F.col("k").startswith(PARENT_PREFIX)
    return _with_lent(groups, listing).select(
        "k",
        "first_pos",
        F.when(is_parent, pretty_parent(F.col("k"))).otherwise(F.coalesce("name", "k")).alias("name"),
        "symbol",
        "gecko_id",
        "category",
        "chains",
        "logo",
        F.col("change_1d").alias("change1d"),
        F.col("change_7d").alias("change7d"),
        "dl_mcap",
        "tvl",
        *[positive(F.col(c)).alias(c) for c in _FLOWS],
    )
