"""Near-duplicate documents: an exact Jaccard join on word n-grams under several token orders.

The tokens are n-grams of words. Under any order of all tokens, two sets of Jaccard similarity t
share a token among the first ``n - ceil(t * n) + 1`` of each set. Three orders are used; in each
of them tokens that many documents share come last, by how often they were met, and the others
in a scrambled order of its own.

1. Every document becomes a set; equal sets are one set from here on. All tokens meet in hash
   buckets, and each set learns how many of its tokens others have too. One with fewer than
   ``t * n`` of them can't link: under an order that puts rare tokens first, its prefix meets nobody.
2. Prefix tokens of the other sets under the first order meet in hash buckets; those of two sets or more are kept.
3. Each set is tried against one pivot, the set that heads most of its prefix tokens: the one with
   the least of its own. What links is joined into components; that takes a group of near copies in
   as many pairs as it has sets.
4. Pairs that share a prefix token and are still in different components are the rest of the
   candidates, if both share enough tokens with others, inside and outside a pivot they have in
   common, for a link of sets of their sizes, and the token is early enough in both prefixes for the
   number of tokens these must share. Where one component holds most sets of a token, only
   the others are paired up.
5. Candidates must share prefix tokens under the other orders too. What is left is verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relvalue.llm.arrow import column, portions, strings
from relvalue.llm.components import components
from relvalue.llm.hashing import chunks_by, mix, runs, word_hashes
from relvalue.llm.messages import ADDRESSED, addressed
from relvalue.llm.rowkey import ROW, row_key
from relvalue.llm.scratch import Scratch, bucket_count

WORDS = 5
PERCENT = 80
ORDERS = 3
#: At most so many tokens are put last in the orders: those met most often. Results don't depend on it.
MOST_COMMON = 1 << 20
PENDING = 1 << 20


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """The distinct n-grams of a text, as sorted 64-bit hashes; a text of fewer words is one n-gram."""
    hashes = word_hashes(text.lower().split())  # of bytes: A-Z and ASCII white space
    if 0 < len(hashes) < words:
        return runs(hashes, len(hashes), 100 + len(hashes))
    return np.unique(runs(hashes, words))


def identity(tokens: np.ndarray) -> tuple[int, int]:
    """Two 64-bit halves of a 128-bit digest of a set."""
    high, low = divmod(xxhash.xxh3_128_intdigest(tokens.tobytes()), 1 << 64)
    return int(np.uint64(low).astype(np.int64)), int(np.uint64(high).astype(np.int64))


def prefix_size(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def prefix(tokens: np.ndarray, order: int, common: np.ndarray, times: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The first tokens of a set under an order: uncommon ones first, then by how often they were met."""
    size = prefix_size(len(tokens), percent)
    scrambled = mix(tokens, 10 + order)
    if not len(common):
        return tokens[np.argpartition(scrambled, size - 1)[:size]]
    at = np.minimum(np.searchsorted(common, tokens), len(common) - 1)
    often = np.where(common[at] == tokens, times[at], 0)
    return tokens[np.lexsort((scrambled, often))[:size]]


def _sets(words: int):
    """Row key, doc_id, n_shingles, set_id, check of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "text"):
            n, ids, checks = [], [], []
            for text in strings(column(batch, "text")):
                tokens = shingles(text, words)
                one, two = identity(tokens)
                n.append(len(tokens))
                ids.append(one if len(tokens) else None)
                checks.append(two)
            yield pa.RecordBatch.from_arrays(
                [*(column(batch, c) for c in ROW), column(batch, "doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.int64()), pa.array(checks, pa.int64())],
                [*ROW, "doc_id", "n_shingles", "set_id", "check"])

    return run


def dealt(tokens: np.ndarray, owner: np.ndarray, ids: np.ndarray, bits: int, kind: str) -> pa.RecordBatch:
    """Tokens by bucket, in each bucket by the set that owns them; ``kind`` u4 keeps 32 bits beside the bucket's."""
    bucket = (tokens >> np.uint64(64 - bits)).astype(np.uint32)
    order = np.argsort(bucket, kind="stable")
    bucket, tokens, owner = bucket[order], tokens[order], owner[order]
    if kind == "<u4":
        tokens = tokens >> np.uint64(32 - bits)
    out = []
    for b, low, high in chunks_by(bucket):
        inside = chunks_by(owner[low:high])
        own = np.array([o for o, _, _ in inside])
        counts = np.array([e - s for _, s, e in inside], "<u4")
        out.append((b, ids[own].tobytes(), counts.tobytes(), tokens[low:high].astype(kind).tobytes()))
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), [pa.int32()] + [pa.binary()] * 3)], ["bucket", "ids", "counts", "tokens"])


DEALT = "bucket int, ids binary, counts binary, tokens binary"


def _all_tokens(words: int, bits: int):
    """The tokens of all sets, by bucket; a batch's equal sets count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "text"):
            distinct = {}
            for text in strings(column(batch, "text")):
                tokens = shingles(text, words)
                if len(tokens):
                    distinct.setdefault(identity(tokens)[0], tokens)
            if distinct:
                owner = np.repeat(np.arange(len(distinct)), [len(x) for x in distinct.values()])
                yield dealt(np.concatenate(list(distinct.values())), owner, np.array(list(distinct), "<i8"), bits, "<u4")

    return run


def _repeated(bits: int):
    """How many tokens of a bucket each set shares with others, addressed to the sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, current = Recurring(), -1

        def settled() -> Iterator[pa.RecordBatch]:
            if seen.size:
                ids, times = np.unique(seen.settle()[1], return_counts=True)
                yield addressed(ids, times.astype("<u4"), bits)

        for batch in batches:
            for b, *blobs in zip(*(c.to_pylist() for c in batch.columns)):
                if b != current:
                    yield from settled()
                    seen, current = Recurring(), b
                ids, counts, tokens = (np.frombuffer(x, t) for x, t in zip(blobs, ("<i8", "<u4", "<u4")))
                seen.add(tokens, np.repeat(ids, counts))
                if seen.size >= PENDING:
                    yield from settled()
        yield from settled()

    return run


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of what each set of a part was told."""
    rows, told = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
    for batch in batches:
        rows += [np.frombuffer(x, "<i8") for x in column(batch, "_rows").to_pylist()]
        told += [np.frombuffer(x, "<u4") for x in column(batch, "_told").to_pylist()]
        if sum(map(len, rows[1:])) >= PENDING:
            rows, told = ([x] for x in _summed(rows, told))
    ids, total = _summed(rows, told)
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total, pa.int64())], ["set_id", "total"])


def _summed(rows: list[np.ndarray], told: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    ids, which = np.unique(np.concatenate(rows), return_inverse=True)
    return ids, np.bincount(which, np.concatenate(told), len(ids)).astype(np.int64)


def _batch_tokens(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u8") for x in column(batch, "tokens").to_pylist()]


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens that a batch holds more than once, and how often."""
    for batch in portions(batches, "tokens"):
        tokens, times = np.unique(np.concatenate(_batch_tokens(batch)), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(tokens[times > 1].view(np.int64)), pa.array(times[times > 1].astype(np.int64))], ["token", "times"])


def common_tokens(vectors: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``most`` tokens, sorted, and how often they were met more than once within a batch.

    The bound holds because of the threshold: no more than ``most`` tokens can each have a
    ``most``-th part of the sum.
    """
    met = vectors.select("tokens").mapInArrow(_met, "token long, times long").groupBy("token").agg(F.sum("times").alias("times"))
    total = met.agg(F.sum("times")).first()[0] or 0
    found = met.where(F.col("times") >= max(2, -(-total // most))).toPandas()
    tokens, times = found["token"].to_numpy(np.int64).view(np.uint64), found["times"].to_numpy(np.int64)
    order = np.argsort(tokens)
    return tokens[order], times[order]


def _prefixes(percent: int, bits: int, common):
    """Prefix tokens under the first order, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "tokens"):
            first = [prefix(x, 0, *common.value, percent) for x in _batch_tokens(batch)]
            owner = np.repeat(np.arange(len(first)), [len(x) for x in first])
            yield dealt(np.concatenate(first), owner, column(batch, "set_id").to_numpy(), bits, "<u8")

    return run


class Recurring:
    """A bucket's tokens; those of a second set are given out with both sets, and with every later one."""

    def __init__(self) -> None:
        self.held: tuple[np.ndarray, ...] | None = None  # each token once, with a set of it, and whether that is given out
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, tokens: np.ndarray, ids: np.ndarray) -> None:
        self.parts.append((tokens, ids, np.zeros(len(tokens), np.bool_)))
        self.size += len(tokens)

    def settle(self) -> tuple[np.ndarray, np.ndarray]:
        """Tokens and sets to give out now."""
        tokens, ids, out = (np.concatenate(x) for x in zip(*([self.held] if self.held else []), *self.parts))
        self.parts, self.size = [], 0
        order = np.lexsort((~out, ids, tokens))
        tokens, ids, out = (x[order] for x in (tokens, ids, out))
        fresh = np.r_[True, (tokens[1:] != tokens[:-1]) | (ids[1:] != ids[:-1])]  # a set counts once
        tokens, ids, out = (x[fresh] for x in (tokens, ids, out))
        starts = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
        sizes = np.diff(np.r_[starts, len(tokens)])
        give = np.repeat(sizes > 1, sizes) & ~out
        self.held = (tokens[starts], ids[starts], (sizes > 1) | np.logical_or.reduceat(out, starts))
        return tokens[give], ids[give]


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens that more than one set has in its prefix, with each of those sets; a partition is one bucket."""
    seen, current = Recurring(), -1

    def settled() -> Iterator[pa.RecordBatch]:
        if seen.size:
            tokens, ids = seen.settle()
            yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(ids)], ["token", "set_id"])

    for batch in batches:
        for b, *blobs in zip(*(c.to_pylist() for c in batch.columns)):
            if b != current:
                yield from settled()
                seen, current = Recurring(), b
            ids, counts, tokens = (np.frombuffer(x, t) for x, t in zip(blobs, ("<i8", "<u4", "<u8")))
            seen.add(tokens, np.repeat(ids, counts))
            if seen.size >= PENDING:
                yield from settled()
    yield from settled()


def _short(tokens: np.ndarray) -> np.ndarray:
    """Tokens cut to 32 bits, sorted: enough for a filter, since equal tokens stay equal."""
    return np.unique((tokens >> np.uint64(16)).astype(np.uint32))


def _vectors(words: int):
    """set_id, its size, its tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "text"):
            tokens = [shingles(text, words) for text in strings(column(batch, "text"))]
            yield pa.RecordBatch.from_arrays(
                [column(batch, "set_id"), pa.array(map(len, tokens), pa.int64()), pa.array([x.astype("<u8").tobytes() for x in tokens], pa.binary())], ["set_id", "n", "tokens"])

    return run


def _filters(percent: int, orders: int, common):
    """set_id, its size, its prefixes under the other orders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "tokens"):
            filters = [[_short(prefix(x, k, *common.value, percent)).tobytes() for k in range(1, orders)] for x in _batch_tokens(batch)]
            yield pa.RecordBatch.from_arrays([column(batch, "set_id"), column(batch, "n"), pa.array(filters, pa.list_(pa.binary()))], ["set_id", "n", "filters"])

    return run


def common_count(one: np.ndarray, two: np.ndarray) -> int:
    """How many values two arrays of distinct sorted values share."""
    if not len(one) or not len(two):
        return 0
    at = np.searchsorted(two, one)
    return int((two[np.minimum(at, len(two) - 1)] == one).sum())


def _filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [all(common_count(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")) for x, y in zip(f, g)) for f, g in zip(column(batch, "filters_a").to_pylist(), column(batch, "filters_b").to_pylist())]
        yield pa.RecordBatch.from_arrays([column(batch, "a"), column(batch, "b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _verified(percent: int):
    """Each pair with the size of its intersection, and whether it links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared, linked = [], []
            for x, y in zip(column(batch, "tokens_a").to_pylist(), column(batch, "tokens_b").to_pylist()):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                both = common_count(x, y)
                shared.append(both)
                linked.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([column(batch, "a"), column(batch, "b"), pa.array(shared, pa.int64()), pa.array(linked, pa.bool_())], ["a", "b", "shared", "linked"])

    return run


def _links(pairs: DataFrame, vectors: DataFrame, filters: DataFrame, percent: int, scratch: Scratch, name: str) -> DataFrame:
    """The pairs (a, b) that pass the filters of all orders together, with the exact ``shared`` and ``linked``."""
    side = lambda table, s, *columns: table.select(F.col("set_id").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in columns))
    low = lambda one, two: F.lit(100) * F.col(one) >= F.lit(percent) * F.col(two)
    sized = pairs.join(side(filters, "a", "n", "filters"), "a").join(side(filters, "b", "n", "filters"), "b").where(low("n_a", "n_b") & low("n_b", "n_a"))
    candidates = scratch.keep(sized.select("a", "b", "filters_a", "filters_b").mapInArrow(_filtered, "a long, b long"), f"{name}_candidates")
    full = candidates.join(side(vectors, "a", "tokens"), "a").join(side(vectors, "b", "tokens"), "b").select("a", "b", "tokens_a", "tokens_b")
    return scratch.keep(full.mapInArrow(_verified(percent), "a long, b long, shared long, linked boolean"), f"{name}_links")


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, orders: int = ORDERS, most_common: int = MOST_COMMON) -> DataFrame:
    """doc_id, n_shingles, component_id, component, _row, _row2 for each row of ``docs`` (doc_id, text; other columns are ignored).

    Two documents link when 100 * intersection >= ``percent`` * union of their distinct n-grams;
    component_id is the smallest doc_id reachable by links, itself included. A text without
    words (null, empty) has no n-grams, links with nothing and is its own component. Null ids
    take part, but no component is named by one unless it holds no other (then null).
    Repeated rows each keep their row. An empty table gives no rows. ``_row`` and ``_row2`` are the row's key
    (128 bits of hashes of id and text), ``component`` tells components apart (null without words).

    A set's identity is 64 bits of a digest; the other 64 bits are compared, and should two
    different sets ever agree in the first half the run fails instead of joining them.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "jaccard")
    docs = docs.select(*row_key(), F.col("doc_id").cast("long").alias("doc_id"), "text")
    bits = max(1, (bucket_count(docs, 16 << 20) - 1).bit_length())
    sets = scratch.keep(docs.mapInArrow(_sets(words), "_row long, _row2 long, doc_id long, n_shingles long, set_id long, check long"), "sets")
    distinct = scratch.keep(
        sets.where("set_id is not null").groupBy("set_id").agg(
            F.min("doc_id").alias("doc_id"), F.min(F.struct(*ROW)).alias("row"), F.max("n_shingles").alias("n"), F.min("check").alias("one"), F.max("check").alias("two")).select("*", "row.*").drop("row"), "distinct")
    if not distinct.where("one <> two").isEmpty():
        raise ValueError("two different sets share the first half of their digest")

    met = docs.select("text").mapInArrow(_all_tokens(words, bits), DEALT).repartitionById(1 << bits, F.col("bucket"))
    repeated = scratch.keep(met.mapInArrow(_repeated(bits), ADDRESSED), "repeated")
    totals = repeated.repartitionById(1 << bits, F.col("_part")).mapInArrow(_totals, "set_id long, total long")
    wanted = distinct.join(totals, "set_id").where(F.lit(100) * F.col("total") >= F.lit(percent) * F.col("n")).select("set_id", *ROW, F.least("total", "n").alias("total"))
    wanted = scratch.keep(wanted, "wanted")
    # what is wanted grows with the corpus, so it is never broadcast: one plan at every size
    texts = docs.select(*ROW, "text").join(wanted.select("set_id", *ROW).hint("merge"), list(ROW)).groupBy("set_id").agg(F.first("text").alias("text"))
    vectors = scratch.keep(texts.mapInArrow(_vectors(words), "set_id long, n long, tokens binary"), "vectors")
    scratch.drop("repeated")

    common = spark.sparkContext.broadcast(common_tokens(vectors, most_common))
    filters = scratch.keep(vectors.mapInArrow(_filters(percent, orders, common), "set_id long, n long, filters array<binary>"), "filters")
    met = vectors.select("set_id", "tokens").mapInArrow(_prefixes(percent, bits, common), DEALT).repartitionById(1 << bits, F.col("bucket"))
    postings = scratch.keep(met.mapInArrow(_postings, "token long, set_id long"), "postings")

    postings = postings.distinct().join(filters.select("set_id", "n"), "set_id").join(wanted.select("set_id", "total"), "set_id")
    heads = postings.groupBy("token").agg(F.max_by("set_id", F.col("total") / F.col("n")).alias("head"), F.count(F.lit(1)).alias("times"))
    own = Window.partitionBy("set_id")  # a set's prefix
    postings = postings.join(heads, "token").withColumns(
        {"rank": F.row_number().over(own.orderBy("times", "token")), "last": F.count(F.lit(1)).over(own)})
    postings = scratch.keep(postings, "sized")
    tried = postings.where("set_id <> head").groupBy("set_id", "head").agg(F.count(F.lit(1)).alias("shared"))
    tried = scratch.keep(tried.groupBy("set_id").agg(F.max_by("head", F.struct("shared", "head")).alias("b")).select(F.col("set_id").alias("a"), "b"), "pivots")
    checked = _links(tried, vectors, filters, percent, scratch, "pivots")
    links = checked.where("linked").select("a", "b")
    joined = components(links, scratch, "near")

    label = joined.select(F.col("node").alias("set_id"), F.col("component"))
    pivots = checked.select(F.col("a").alias("set_id"), F.col("b").alias("pivot"), F.col("shared").alias("within"))
    labelled = scratch.keep(postings.join(label, "set_id", "left").join(pivots, "set_id", "left").withColumn("component", F.coalesce("component", "set_id")), "labelled")
    mixed = labelled.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("token")
    open_ = scratch.keep(labelled.join(mixed, "token", "left_semi"), "open")
    main = open_.groupBy("token", "component").agg(F.count(F.lit(1)).alias("size")).groupBy("token").agg(F.max_by("component", F.struct("size", "component")).alias("main"))
    with_main = open_.join(main, "token")
    left = with_main.where("component <> main").select("token", F.col("set_id").alias("x"), F.col("n").alias("n_x"), F.col("total").alias("t_x"), F.col("component").alias("c_x"), F.col("pivot").alias("p_x"), F.col("within").alias("w_x"), (F.col("last") - F.col("rank")).alias("r_x"))
    right = with_main.select("token", F.col("set_id").alias("y"), F.col("n").alias("n_y"), F.col("total").alias("t_y"), F.col("component").alias("c_y"), F.col("pivot").alias("p_y"), F.col("within").alias("w_y"), (F.col("last") - F.col("rank")).alias("r_y"), "main")
    near = (F.lit(100) * F.col("n_x") >= F.lit(percent) * F.col("n_y")) & (F.lit(100) * F.col("n_y") >= F.lit(percent) * F.col("n_x"))
    enough = F.lit(100 + percent) * F.least("t_x", "t_y") >= F.lit(percent) * (F.col("n_x") + F.col("n_y"))  # of tokens that others have at all
    # Of two sets tried against the same pivot: inside it they share no more than the lesser part, outside it only what others have too.
    most = F.least("w_x", "w_y") + F.least(F.col("t_x") - F.col("w_x"), F.col("t_y") - F.col("w_y"))
    apart = (F.col("p_x") == F.col("p_y")) & (F.lit(100 + percent) * most < F.lit(percent) * (F.col("n_x") + F.col("n_y")))
    # Prefixes of a linked pair share so many tokens at least; so the rarest that they share has as many less one behind it in both.
    least = F.ceil(F.lit(percent) * (F.col("n_x") + F.col("n_y")) / (100 + percent)) - F.ceil(F.lit(percent) * F.greatest("n_x", "n_y") / 100) + 1
    enough = enough & ~F.coalesce(apart, F.lit(False)) & (F.least("r_x", "r_y") >= least - 1)
    rest = left.join(right, "token").where(near & enough & (F.col("c_x") != F.col("c_y")) & ((F.col("c_y") == F.col("main")) | (F.col("x") < F.col("y"))))
    rest = rest.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()
    rest = rest.join(tried.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), ["a", "b"], "left_anti")
    more = _links(scratch.keep(rest, "rest"), vectors, filters, percent, scratch, "rest")
    links = links.unionByName(more.where("linked").select("a", "b"))
    joined = scratch.keep(components(links, scratch, "all"), "components")
    scratch.drop("postings", "sized", "wanted", "vectors", "filters", "labelled", "open", "rest", "pivots")

    placed = distinct.select("set_id", "doc_id").join(joined.select(F.col("node").alias("set_id"), "component"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    names = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = placed.join(names, "component").select("set_id", "component_id", "component")
    out = sets.select("doc_id", "n_shingles", "set_id", *ROW).join(named, "set_id", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "component", *ROW)
