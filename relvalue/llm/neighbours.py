"""Approximate nearest neighbours by a robust-pruned directed graph for each shard.

Equal vectors are one node. Nodes are dealt to shards of bounded size by a hash; in a shard a node is
put in by a greedy search from nodes that lie far apart: what the search visits are its possible neighbours,
and relaxed distance pruning keeps those not much closer to a neighbour already chosen than to
the node, so long edges in other directions stay. Queries run a beam search on every shard; what
they find is scored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relvalue.llm.arrow import column
from relvalue.llm.scratch import Scratch

SHARD_ROWS = 8192
DEGREE = 32
RELAX = 1.2
BUILD_BEAM = 48
SEARCH_BEAM = 160
BATCH = 256
PART = 2048  # rows or pairs that are handled at a time
ENTRIES = 64  # nodes a search may start from
STARTS = 4  # and does start from


class Graph:
    """A directed graph over unit vectors (rows of doubles).

    All distances come from differences of vectors: near-equal ones would drown in the rounding of a dot product. Searches
    start at the ``ENTRIES`` nodes that lie farthest apart, so tight groups far from each other each have one near by,
    and every node can be reached from them.
    """

    def __init__(self, vectors: np.ndarray, degree: int = DEGREE, relax: float = RELAX, beam: int = BUILD_BEAM, seed: int = 0):
        self.x, self.degree, self.relax = vectors, degree, relax
        n = len(vectors)
        self.edges = np.full((n, degree), -1, np.int32)
        self.entries = self._spread(min(n, ENTRIES))
        order = np.random.default_rng(seed).permutation(n)
        order = np.concatenate([self.entries, order[~np.isin(order, self.entries)]])
        at = 0
        while at < len(order):
            some = order[at : at + max(1, min(BATCH, at))]
            if at:
                visited = self.search(vectors[some], beam, visits=True)
                self.edges[some] = self.prune(some, visited)
                self._back(some)
            at += len(some)
        self._link()

    def _spread(self, many: int) -> np.ndarray:
        """Nodes that lie far apart: the most central one, then always the one farthest from all so far."""
        x = self.x
        chosen = [int(np.argmax(x @ x.mean(axis=0)))]
        far = self._gaps(np.array(chosen), np.arange(len(x))[None])[0]
        while len(chosen) < many:
            chosen.append(int(np.argmax(far)))
            far = np.minimum(far, self._gaps(np.array(chosen[-1:]), np.arange(len(x))[None])[0])
        return np.unique(chosen).astype(np.int32)

    def _gaps(self, nodes: np.ndarray, others: np.ndarray) -> np.ndarray:
        apart = self.x[others] - self.x[nodes][:, None]
        return np.einsum("bcd,bcd->bc", apart, apart)

    def search(self, queries: np.ndarray, beam: int, visits: bool = False) -> np.ndarray:
        """For each query the ``beam`` nearest nodes met, nearest first (-1 where there are fewer), or all nodes it went through."""
        q, n, first = len(queries), len(self.x), len(self.entries)
        apart = self.x[self.entries][None] - queries[:, None]
        far = np.einsum("qed,qed->qe", apart, apart)
        best = np.argsort(far, axis=1, kind="stable")[:, :beam]
        ids = np.full((q, beam), -1, np.int32)
        gaps = np.full((q, beam), np.inf)
        done = np.ones((q, beam), bool)
        ids[:, : best.shape[1]], gaps[:, : best.shape[1]] = self.entries[best], np.take_along_axis(far, best, 1)
        done[:, : min(STARTS, first)] = False  # the nearest entries; the others are only results
        seen = np.zeros((q, n + 1), bool)  # the last column stands for -1
        seen[:, -1] = True
        seen[:, self.entries] = True
        through: list[np.ndarray] = []
        active = np.arange(q)
        while len(active):
            pick = np.argmin(np.where(done[active], np.inf, gaps[active]), axis=1)
            node = ids[active, pick]
            done[active, pick] = True
            if visits:
                went = np.full(q, -1, np.int32)
                went[active] = node
                through.append(went)
            near = self.edges[node]
            new = ~seen[active[:, None], near]
            seen[active[:, None], near] = True
            row, place = np.nonzero(new)
            apart = self.x[near[row, place]] - queries[active[row]]
            gap = np.full(near.shape, np.inf)
            gap[row, place] = np.einsum("nd,nd->n", apart, apart)
            both_gaps = np.concatenate([gaps[active], gap], axis=1)
            both_ids = np.concatenate([ids[active], np.where(new, near, -1)], axis=1)
            both_done = np.concatenate([done[active], ~new], axis=1)
            best = np.argsort(both_gaps, axis=1, kind="stable")[:, :beam]
            gaps[active], ids[active] = np.take_along_axis(both_gaps, best, 1), np.take_along_axis(both_ids, best, 1)
            done[active] = np.take_along_axis(both_done, best, 1)
            active = active[~done[active].all(axis=1)]
        return np.stack(through, axis=1) if visits else np.where(np.isfinite(gaps), ids, -1)

    def prune(self, nodes: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        """The edges of ``nodes`` among ``candidates`` (-1 for none): nearest first, without what a chosen one covers."""
        gap = np.where((candidates < 0) | (candidates == nodes[:, None]), np.inf, self._gaps(nodes, candidates))
        order = np.argsort(gap, axis=1, kind="stable")[:, : 4 * self.degree]
        gap, candidates = np.take_along_axis(gap, order, 1), np.take_along_axis(candidates, order, 1)
        again = np.zeros(candidates.shape, bool)
        ranked = np.argsort(candidates, axis=1, kind="stable")
        values = np.take_along_axis(candidates, ranked, 1)
        np.put_along_axis(again, ranked[:, 1:], values[:, 1:] == values[:, :-1], 1)
        gap[again] = np.inf
        # Between candidates, seen from the node: so near, products of differences lose nothing.
        apart = self.x[candidates] - self.x[nodes][:, None]
        size = np.einsum("bcd,bcd->bc", apart, apart)
        between = size[:, :, None] + size[:, None] - 2 * (apart @ apart.transpose(0, 2, 1))
        out = np.full((len(nodes), self.degree), -1, np.int32)
        rows = np.arange(len(nodes))
        for k in range(self.degree):
            pick = np.argmin(gap, axis=1)
            open_ = np.isfinite(gap[rows, pick])
            if not open_.any():
                break
            out[open_, k] = candidates[rows, pick][open_]
            gap[self.relax * between[rows, pick] <= gap] = np.inf
            gap[rows, pick] = np.inf
        return out

    def reached(self) -> np.ndarray:
        """Whether each node can be reached from the entries."""
        out = np.zeros(len(self.x) + 1, bool)  # the last stands for -1
        out[-1] = True
        front = self.entries
        while len(front):
            out[front] = True
            front = np.unique(self.edges[front])
            front = front[~out[front]]
        return out[:-1]

    def _link(self) -> None:
        """An edge to each node that can't be reached, from the nearest node found that can and has room; else room is made."""
        while len(lost := np.flatnonzero(~self.reached())):
            lost = lost[:BATCH]
            for node, found in zip(lost.tolist(), self.search(self.x[lost], BUILD_BEAM)):
                found = found[found >= 0]
                roomy = found[(self.edges[found] < 0).any(axis=1)]
                if not len(roomy):
                    self.edges = np.concatenate([self.edges, np.full((len(self.x), 1), -1, np.int32)], axis=1)
                    roomy = found
                self.edges[roomy[0], np.argmax(self.edges[roomy[0]] < 0)] = node

    def _back(self, some: np.ndarray) -> None:
        """Edges back to ``some`` from what they point to, pruned where there is no room."""
        target = self.edges[some]
        source = np.repeat(some, self.degree)[target.reshape(-1) >= 0]
        target = target.reshape(-1)[target.reshape(-1) >= 0]
        order = np.argsort(target, kind="stable")
        target, source = target[order], source[order].astype(np.int32)
        nodes, starts, counts = np.unique(target, return_index=True, return_counts=True)
        held = (self.edges[nodes] >= 0).sum(axis=1)
        roomy = held + counts <= self.degree
        within = np.arange(len(target)) - np.repeat(starts, counts)
        fits = np.repeat(roomy, counts)
        place = np.repeat(held, counts) + within
        self.edges[target[fits], place[fits]] = source[fits]
        if (~roomy).any():
            full = np.flatnonzero(~roomy)
            for at in range(0, len(full), BATCH):
                part = full[at : at + BATCH]
                more = np.full((len(part), counts[part].max()), -1, np.int32)
                for i, p in enumerate(part):
                    more[i, : counts[p]] = source[starts[p] : starts[p] + counts[p]]
                self.edges[nodes[part]] = self.prune(nodes[part], np.concatenate([self.edges[nodes[part]], more], axis=1))


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors that take part, as the bytes of doubles."""
    for batch in batches:
        lists = column(batch, "embedding")
        ids = column(batch, "vec_id")
        values = lists.values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
        starts, sizes = lists.offsets.to_numpy()[:-1], pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        taken = ids.is_valid().to_numpy(zero_copy_only=False) & (sizes > 0)
        for size in np.unique(sizes[taken]).tolist():
            rows = np.flatnonzero(taken & (sizes == size))
            for at in range(0, len(rows), PART):
                some = rows[at : at + PART]
                x = values[starts[some][:, None] + np.arange(size)] + 0.0  # no negative zeros
                sound = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(some[sound])), pa.array([v.tobytes() for v in x[sound]], pa.binary()), pa.array([size] * int(sound.sum()), pa.int32())],
                    ["vec_id", "vec", "dim"])


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows times a power of two, which brings their largest component near 1: exact, and no product over- or underflows that counts."""
    _, exponent = np.frexp(np.abs(vectors).max(axis=1, keepdims=True))
    return np.ldexp(np.ldexp(vectors, -(exponent // 2)), -(exponent - exponent // 2))


def _search(k: int, beam: int):
    """For each query of a shard the nearest of all nodes its beam holds, by exact scores; nodes come first.

    ``k + 1`` nodes are enough, ties going to the smaller first id: each brings a row of its own, but for
    the query's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, keys, firsts, vectors, graph, exact, norms = None, [], [], [], None, None, None
        for batch in batches:
            for (one, query), group in _groups(batch):
                if one != shard:
                    shard, keys, firsts, vectors, graph = one, [], [], [], None
                if not query:
                    keys += column(group, "key").to_pylist()
                    firsts += column(group, "id").to_pylist()
                    vectors += column(group, "vec").to_pylist()
                    continue
                if not vectors:
                    continue
                if graph is None:
                    exact = scaled(np.frombuffer(b"".join(vectors), np.float64).reshape(len(vectors), -1))
                    norms = np.linalg.norm(exact, axis=1)
                    graph = Graph(exact / norms[:, None])
                ids = column(group, "id").to_numpy()
                asked = scaled(np.frombuffer(b"".join(column(group, "vec").to_pylist()), np.float64).reshape(len(ids), -1))
                for at in range(0, len(ids), BATCH):
                    q, who = asked[at : at + BATCH], ids[at : at + BATCH]
                    size = np.linalg.norm(q, axis=1)
                    found = graph.search(q / size[:, None], min(beam, max(2, len(vectors))))
                    i, j = np.nonzero(found >= 0)
                    node = found[i, j]
                    scores = np.concatenate([np.einsum("nd,nd->n", q[i[a : a + PART]], exact[node[a : a + PART]]) for a in range(0, len(i), PART)]) / (size[i] * norms[node])
                    order = np.lexsort((np.array(firsts)[node], -scores, i))
                    i, node, scores = i[order], node[order], scores[order]
                    near = np.arange(len(i)) - np.searchsorted(i, i) <= k
                    i, node, scores = i[near], node[near], scores[near]
                    yield pa.RecordBatch.from_arrays([pa.array(who[i]), pa.array([keys[n] for n in node], pa.string()), pa.array(scores)], ["query_id", "key", "score"])

    return run


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    shard, query = column(batch, "shard").to_numpy(), column(batch, "query").to_numpy(zero_copy_only=False)
    cuts = [0, *(np.flatnonzero((shard[1:] != shard[:-1]) | (query[1:] != query[:-1])) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield (int(shard[a]), bool(query[a])), batch.slice(a, b - a)


def nearest(table: DataFrame, every: int, k: int, shard_rows: int = SHARD_ROWS, beam: int = SEARCH_BEAM) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found for each row of ``table`` (vec_id, embedding) whose vec_id is divisible by ``every``.

    Nearest by cosine in double precision, ties to the smaller vec_id, never the query's own row. Null ids, and vectors
    that are null, empty, zero or hold a null or non-finite component, take no part; vectors of
    different length are never compared. Equal vectors are one node of the graph, of which the
    first ``k + 1`` ids can be in a result. A row repeated with its id is one row.
    """
    scratch = Scratch(table.sparkSession, "neighbours")
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(_vectors, "vec_id long, vec binary, dim int")
    rows = scratch.keep(rows.withColumn("key", F.md5("vec")).dropDuplicates(["vec_id", "key"]), "vectors")
    first = Window.partitionBy("key").orderBy("vec_id")
    members = scratch.keep(rows.select("vec_id", "vec", "dim", "key", F.row_number().over(first).alias("nth")).where(F.col("nth") <= k + 1), "members")
    shards = {r["dim"]: max(1, -(-r["n"] // shard_rows)) for r in members.where("nth = 1").groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each length of vector
    if not shards:
        return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    before = dict(zip(shards, np.cumsum([0, *shards.values()]).tolist()))
    total = sum(shards.values())
    pick = lambda what: F.element_at(F.create_map(*(F.lit(x) for d in shards for x in (d, what[d]))), F.col("dim"))
    nodes = members.where("nth = 1").select(
        (pick(before) + F.pmod(F.xxhash64("key"), pick(shards))).cast("int").alias("shard"), F.lit(False).alias("query"), F.col("vec_id").alias("id"), "key", "vec")
    queries = rows.where(F.col("vec_id") % every == 0).select(
        F.explode(F.sequence(pick(before), pick(before) + pick(shards) - 1)).alias("shard"), F.lit(True).alias("query"), F.col("vec_id").alias("id"), "key", "vec")
    dealt = nodes.unionByName(queries.withColumn("shard", F.col("shard").cast("int"))).repartitionById(total, F.col("shard")).sortWithinPartitions("shard", "query", "id")
    found = scratch.keep(dealt.mapInArrow(_search(k, beam), "query_id long, key string, score double"), "found")
    spread = found.join(members.select("key", "vec_id"), "key").where("vec_id <> query_id").select("query_id", "vec_id", "score")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return spread.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
