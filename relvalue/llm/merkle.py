"""Merkle manifest of documents; proofs of all leaves by pointer jumping.

A leaf is the digest of a document's fields. The leaves of a source, in order of doc_id, are hashed in
runs of three, level by level, to the source's subroot; the subroots, in order of source, likewise
to the root.

1. Leaves are numbered within their source by a range exchange: a source that holds most rows is many ranges.
2. A level of all trees is one grouping by run; its result is the next level's input. Levels shrink by three.
3. Each inner node holds the segment of siblings from itself to its ancestor, at first its parent. A self-join
   gives it the ancestor's ancestor and the two segments one after the other, so distances double and a
   logarithmic number of joins brings every inner node to the root.
4. The last join hands each run of leaves what its parent holds. A leaf's proof is its siblings and that segment.

At distance d at most 3^d nodes share an ancestor, and nodes that have reached the root join no more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relvalue.llm.scratch import Scratch

RUN = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TOP = -1  # the tree of the subroots

_RUN_HASH = "sha2(array_join(transform(children, x -> lower(hex(x.hash))), ''), 256)"
_SEGMENT = "array(struct({0} AS left, {1} AS right))"
_BEFORE = "unhex(array_join(transform(slice(children, 1, pos), x -> hex(x.hash)), ''))"
_AFTER = "unhex(array_join(transform(slice(children, pos + 2, 3), x -> hex(x.hash)), ''))"


def leaf_hash(docs: DataFrame, text: Column) -> Column:
    """Hex digest of the fields, ``text`` in place of the text: size in bytes, colon, value; a dash for null."""
    values = [text if name == "text" else F.col(name).cast("string") for name in FIELDS]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values)), 256)


def _ranged(rows: DataFrame, scratch: Scratch, name: str, *order: str) -> DataFrame:
    """``rows`` dealt to ranges of ``order`` and sorted there, with their range and place in it, written."""
    ranged = rows.repartitionByRange(*map(F.col, order)).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    return scratch.keep(ranged.withColumns({"_range": F.spark_partition_id(), "_place": place}), name)


def _numbered_leaves(digests: DataFrame, scratch: Scratch) -> DataFrame:
    """Leaves with their tree (the place of their source), ``idx`` in it and its size ``n``."""
    placed = _ranged(digests, scratch, "placed", "key", "doc_id", "hash", "_row")
    # A row for each range and source in it, so at most as many as there are ranges and sources together.
    shares = scratch.keep(placed.groupBy("_range", "key").agg(F.count(F.lit(1)).alias("here"), F.min("_place").alias("first")), "shares")
    keys = _ranged(shares.groupBy("key").agg(F.sum("here").alias("n")), scratch, "keys", "key")
    sizes = keys.groupBy("_range").agg(F.count(F.lit(1)).alias("size"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    before = sizes.select("_range", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("trees_before"))
    trees = keys.join(before, "_range").select("key", "n", (F.col("trees_before") + F.col("_place")).alias("tree"))
    earlier = Window.partitionBy("key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = shares.join(trees, "key").withColumn("start", F.coalesce(F.sum("here").over(earlier), F.lit(0)) - F.col("first")).select("_range", "key", "tree", "n", "start")
    return placed.join(starts, ["_range", "key"]).select("tree", (F.col("start") + F.col("_place")).alias("idx"), "n", "hash", "doc_id", "altered")


def _runs(nodes: DataFrame, *carried: str) -> DataFrame:
    """(tree, run, n, children): the nodes of a level (tree, idx, n, hash) in runs of three."""
    members = F.sort_array(F.collect_list(F.struct("idx", "hash", *carried)))
    return nodes.groupBy("tree", F.expr(f"idx div {RUN}").alias("run"), "n").agg(members.alias("children"))


def _parents(runs: DataFrame) -> DataFrame:
    return runs.selectExpr("tree", "run AS idx", f"(n + {RUN - 1}) div {RUN} AS n", f"unhex({_RUN_HASH}) AS hash")


def _levels(first: DataFrame, size: int, scratch: Scratch, name: str) -> list[DataFrame]:
    """The runs of every level above ``first`` (runs of level 0 of trees of up to ``size`` nodes)."""
    levels = [first]
    while (size := -(-size // RUN)) > 1:
        levels.append(scratch.keep(_runs(_parents(levels[-1].where("n > 1")).where("n > 1")), f"{name}_{len(levels)}"))
    return levels


def _address(level: int) -> str:
    """SQL for the address of a run's parent; a source's subroot is a leaf of the top tree."""
    return (
        f"CASE WHEN tree <> {TOP} AND n <= {RUN} THEN struct({TOP}L AS tree, 0 AS level, tree AS idx) "
        f"ELSE struct(tree, {level + 1} AS level, run AS idx) END"
    )


def _states(runs: DataFrame, level: int) -> DataFrame:
    """The nodes of a level with their parent as ancestor and their siblings as segment.

    ``subroot`` is known once the way to the ancestor holds the source's subroot.
    """
    return (
        runs.where("n > 1")
        .selectExpr("*", f"{_address(level)} AS ancestor", f"CASE WHEN tree <> {TOP} AND n <= {RUN} THEN {_RUN_HASH} END AS subroot", "posexplode(children)")
        .selectExpr(
            f"struct(tree, {level} AS level, col.idx AS idx) AS node", "ancestor",
            f"{_SEGMENT.format(_BEFORE, _AFTER)} AS segment", "subroot",
        )
    )


def _jumped(states: DataFrame, root: Column, distance: int) -> DataFrame:
    """Every node's ancestor replaced by that one's ancestor; nodes at the root stay as they are."""
    at_root = F.col("ancestor") == root
    # an ancestor this far from an inner node is as many levels up in its tree, or in the top tree
    far = states.where(F.expr(f"node.tree = {TOP} OR node.level > {distance}")).select(
        F.col("node").alias("via"), F.col("ancestor").alias("next"), F.col("segment").alias("more"), F.col("subroot").alias("found"))
    moved = states.where(~at_root).join(far, F.col("ancestor") == F.col("via")).select(
        "node", F.col("next").alias("ancestor"), F.concat("segment", "more").alias("segment"), F.coalesce("subroot", "found").alias("subroot"))
    return states.where(at_root).unionByName(moved)


def _nothing(spark: SparkSession, docs: DataFrame) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    return spark.createDataFrame([], f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def verified_manifest(docs: DataFrame, altered_text: Column, altered: Column) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for each row of ``docs``.

    ``altered`` says which rows are folded from the leaf that ``altered_text`` gives, beside the siblings of the
    untouched documents; a null counts as not altered. Needs the columns of FIELDS and uses no other.
    A null field is a dash in its leaf; null sources are a source of their own, before all others; a null doc_id
    comes before all others of its source. Rows of one id are ordered by their leaves, repeated rows are
    leaves of their own. A lone leaf is its source's subroot, a lone subroot the root, and the proof of both is the
    digest of nothing. An empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "merkle")
    leaf = leaf_hash(docs, F.col("text"))
    digests = scratch.keep(docs.select(
        "doc_id",
        F.when(F.col("source").isNull(), "0").otherwise(F.concat(F.lit("1"), "source")).alias("key"),
        F.unhex(leaf).alias("hash"),
        F.when(altered, F.unhex(leaf_hash(docs, altered_text))).alias("altered"),
        F.monotonically_increasing_id().alias("_row"),
    ), "digests")
    first = scratch.keep(_runs(_numbered_leaves(digests, scratch), "doc_id", "altered"), "level_0")
    scratch.drop("digests", "placed")
    largest = first.agg(F.max("n")).first()[0]
    if largest is None:
        return _nothing(spark, docs)

    levels = _levels(first, largest, scratch, "level")
    lone = first.where("n = 1").selectExpr("tree AS idx", "children[0].hash AS hash")
    for runs in levels:
        lone = lone.unionByName(runs.where(f"n BETWEEN 2 AND {RUN}").selectExpr("tree AS idx", f"unhex({_RUN_HASH}) AS hash"))
    subroots = scratch.keep(lone, "subroots")
    sources = subroots.count()
    top = _levels(scratch.keep(_runs(subroots.selectExpr(f"{TOP}L AS tree", "idx", f"{sources}L AS n", "hash")), "top_0"), sources, scratch, "top")
    root = (subroots.select(F.lower(F.hex("hash"))) if sources == 1 else top[-1].selectExpr(_RUN_HASH)).first()[0]
    summit = F.struct(F.lit(TOP).cast("long").alias("tree"), F.lit(len(top) if sources > 1 else 0).alias("level"), F.lit(0).cast("long").alias("idx"))

    states = None
    for tree in (levels, top):
        for level, runs in enumerate(tree):
            if tree is levels and level == 0:
                continue  # the leaves wait for the last join
            one = _states(runs, level)
            states = one if states is None else states.unionByName(one)
    states = scratch.keep(states, "states_1")
    distance, depth = 1, len(levels) + len(top)
    while distance < depth:
        states = scratch.keep(_jumped(states, summit, distance), f"states_{2 * distance}")
        scratch.drop(f"states_{distance}")
        distance *= 2

    # A lone leaf stands for its own parent, which is a leaf of the top tree.
    of_run = first.selectExpr("*", f"{_address(0)} AS parent").join(
        states.select(F.col("node").alias("parent"), F.col("segment").alias("rest"), F.col("subroot").alias("found")), "parent", "left")
    own = f"CASE WHEN n > 1 THEN {_SEGMENT.format(_BEFORE, _AFTER)} END"
    leaves = of_run.selectExpr(
        "n", "rest", f"CASE WHEN n <= {RUN} AND n > 1 THEN {_RUN_HASH} ELSE found END AS found", "children", "posexplode(children)"
    ).selectExpr(
        "col.doc_id AS doc_id", "lower(hex(col.hash)) AS leaf", "lower(hex(coalesce(col.altered, col.hash))) AS start",
        "CASE WHEN n = 1 THEN lower(hex(col.hash)) ELSE found END AS subroot",
        f"concat(coalesce({own}, array()), coalesce(rest, array())) AS segment",
    )
    return leaves.select(
        "doc_id", "leaf", "subroot", F.lit(root).alias("root"),
        F.expr("sha2(array_join(transform(segment, s -> lower(concat(hex(s.left), hex(s.right)))), ''), 256)").alias("proof_sha256"),
        F.expr("aggregate(segment, start, (now, s) -> sha2(concat(lower(hex(s.left)), now, lower(hex(s.right))), 256))").alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
