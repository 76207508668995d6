"""Approximate nearest neighbours by robust-pruned directed graphs, one for each shard.

Vectors are dealt into shards of nearly ``SHARD`` rows by hash. In each shard a task builds a graph: a greedy
search from the entry point proposes neighbours for each vector, and robust pruning keeps the diverse ones: a
candidate goes if ``ALPHA`` times its distance to one that was kept is not above its distance to the vector. Kept edges
are entered in the other direction too, and full lists are pruned again. Rows are inserted in batches
whose searches run together in numpy. A shard's graph is built once and is a row of a table in the shared folder.

Queries go to every shard, each with a beam search of width ``BEAM``; the best of all shards are ranked by exact inner
products in double precision. A task of the search has one graph and a stream of at most about ``QUERIES`` queries, of which it
holds a batch at a time; beyond that the queries are cut into more slices, each a task of its own with a copy of the
graph. So what a task holds does not grow with the table, and what it does is bounded.

Largest inner product is not a distance. Vectors are so extended by one coordinate,
``sqrt(M**2 - |v|**2)`` with M the largest norm, where Euclidean nearness to a query with 0 there is the order of
inner products.

Rows without id, null vectors, zero vectors and those with a null or non-finite component, or of another length than most, take no part. Equal
vectors are different candidates; a shard holds them as one node with several members.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowloom.llm import tables

SHARD = 4096
QUERIES = 1 << 16
DEGREE = 32
ALPHA = 1.2
BEAM = 64
BUILD_BEAM = 48
BATCH = 512


def _distances(points: np.ndarray, norms: np.ndarray, queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Squared distances (less the query's own norm) of each query to its own row of candidates."""
    return norms[rows] - 2 * np.einsum("qd,qrd->qr", queries, points[rows])


def beam_search(points: np.ndarray, norms: np.ndarray, edges: np.ndarray, entry: int, queries: np.ndarray, width: int, steps: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Greedy search of many queries together. ``edges``: neighbours of each node, -1 where there is none.

    Returns the ``width`` nearest nodes found (-1 where there are fewer) and their distances, nearest first.
    """
    n, q = len(points), len(queries)
    found = np.full((q, width), -1)
    found[:, 0] = entry
    far = np.full((q, width), np.inf)
    far[:, 0] = _distances(points, norms, queries, found[:, :1])[:, 0]
    done = np.zeros((q, width), bool)
    seen = np.zeros((q, n), bool)
    seen[:, entry] = True
    active = np.arange(q)
    for _ in range(max(steps, 4 * width)):
        open_ = ~done[active] & (found[active] >= 0)
        some = open_.any(axis=1)
        active, open_ = active[some], open_[some]
        if len(active) == 0:
            break
        at = open_.argmax(axis=1)
        done[active, at] = True
        near = edges[found[active, at]]
        fresh = (near >= 0) & ~seen[active[:, None], near]
        safe = np.where(near >= 0, near, 0)
        seen[active[:, None], safe] |= near >= 0
        d = np.where(fresh, _distances(points, norms, queries[active], safe), np.inf)
        ids = np.concatenate([found[active], np.where(fresh, near, -1)], axis=1)
        dist = np.concatenate([far[active], d], axis=1)
        was = np.concatenate([done[active], np.zeros_like(fresh)], axis=1)
        order = np.argsort(dist, axis=1, kind="stable")[:, :width]
        found[active] = np.take_along_axis(ids, order, axis=1)
        far[active] = np.take_along_axis(dist, order, axis=1)
        done[active] = np.take_along_axis(was, order, axis=1)
    return found, far


def robust_prune(points: np.ndarray, node: int, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Up to ``degree`` of the candidates, each not much nearer to one kept before it than to the node."""
    candidates = np.unique(candidates[(candidates >= 0) & (candidates != node)])
    if len(candidates) == 0:
        return candidates
    x = points[candidates]
    to_node = np.square(x - points[node]).sum(axis=1)
    order = np.argsort(to_node, kind="stable")
    candidates, x, to_node = candidates[order], x[order], to_node[order]
    between = np.square(x).sum(axis=1)
    between = np.maximum(between[:, None] + between[None, :] - 2 * x @ x.T, 0)
    alive = np.ones(len(candidates), bool)
    kept = []
    for i in range(len(candidates)):
        if alive[i]:
            kept.append(i)
            if len(kept) == degree:
                break
            alive &= alpha * alpha * between[i] > to_node
    return candidates[kept]


def build(points: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA, width: int = BUILD_BEAM) -> tuple[np.ndarray, int]:
    """Neighbours of each node (-1 where there is none) and the entry point."""
    n = len(points)
    norms = np.square(points).sum(axis=1)
    edges = np.full((n, degree), -1)
    entry = int(np.square(points - points.mean(axis=0)).sum(axis=1).argmin())
    order = np.random.default_rng(7).permutation(n)
    order = np.concatenate([[entry], order[order != entry]])
    at = 1
    while at < n:
        # batches grow with the graph, so that each is searched for in a graph that is not smaller
        batch = order[at : at + min(BATCH, at)]
        found, _ = beam_search(points, norms, edges, entry, points[batch], width)
        back: dict[int, list[int]] = {}
        for node, near in zip(batch, found, strict=True):
            kept = robust_prune(points, node, near, degree, alpha)
            edges[node, : len(kept)] = kept
            for other in kept:
                back.setdefault(int(other), []).append(int(node))
        for other, new in back.items():
            own = edges[other][edges[other] >= 0]
            both = np.concatenate([own, new])
            if len(both) > degree:
                both = robust_prune(points, other, both, degree, alpha)
            edges[other] = -1
            edges[other, : len(both)] = both
        at += len(batch)
    return edges, entry


def _floats(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1).astype(np.float64)


def graph_of(ids: np.ndarray, exact: np.ndarray, largest: float) -> dict[str, np.ndarray]:
    """The graph of a shard: equal vectors are one node, whose members are in order of id."""
    order = np.argsort(ids, kind="stable")
    ids, exact = ids[order], exact[order]
    kinds, members = np.unique(exact, axis=0, return_inverse=True)
    members = members.reshape(-1)
    extra = np.sqrt(np.maximum(largest * largest - np.square(kinds).sum(axis=1), 0))
    points = np.concatenate([kinds, extra[:, None]], axis=1).astype(np.float32)
    edges, entry = build(points)
    by_kind = np.argsort(members, kind="stable")
    begin = np.searchsorted(members[by_kind], np.arange(len(kinds) + 1))
    return {"kinds": kinds, "points": points, "edges": edges.astype(np.int32), "entry": np.array(entry), "begin": begin, "ids": ids[by_kind]}


def search(graph: dict[str, np.ndarray], own: np.ndarray, asked: np.ndarray, k: int) -> pd.DataFrame:
    """The k best of a shard for each query, the query's own row excepted."""
    out = []
    points, kinds, begin, edges = graph["points"], graph["kinds"], graph["begin"], graph["edges"].astype(np.int64)
    norms = np.square(points).sum(axis=1)
    for lo in range(0, len(asked), BATCH):
        q, ids = asked[lo : lo + BATCH], own[lo : lo + BATCH]
        found, _ = beam_search(points, norms, edges, int(graph["entry"]), np.concatenate([q, np.zeros((len(q), 1))], axis=1).astype(np.float32), max(BEAM, 2 * k))
        row, place = np.nonzero(found >= 0)
        kind = found[row, place]
        score = np.einsum("nd,nd->n", q[row], kinds[kind])
        # of one node's members the smallest ids come first; more than k + 1 cannot be wanted
        many = np.minimum(begin[kind + 1] - begin[kind], k + 1)
        rows, scores = np.repeat(row, many), np.repeat(score, many)
        member = np.arange(len(rows)) - np.repeat(np.cumsum(many) - many - begin[kind], many)
        table = pd.DataFrame({"query": rows, "query_id": ids[rows], "vec_id": graph["ids"][member], "score": scores})
        table = table[table["query_id"] != table["vec_id"]].sort_values(["query", "score", "vec_id"], ascending=[True, False, True])
        out.append(table.groupby("query", sort=False).head(k).drop(columns="query"))
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})


def _building(largest: float):
    def run(shard: pa.Table) -> pa.Table:
        graph = graph_of(shard.column("vec_id").to_numpy(), _floats(shard.column("embedding")), largest)
        packed = io.BytesIO()
        np.savez(packed, **graph)
        return pa.table({"shard": shard.column("shard").slice(0, 1), "graph": pa.array([packed.getvalue()], pa.binary())})

    return run


def _searching(k: int):
    """Rows in order of (shard, slice): the graph, then its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, own = None, None
        for batch in batches:
            place = batch.column("place").to_numpy()
            new = np.flatnonzero(batch.column("graph").is_valid().to_numpy(zero_copy_only=False))
            cuts = np.unique(np.concatenate([[0], new, np.flatnonzero(np.diff(place)) + 1, [len(place)]]))
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if batch.column("graph")[lo].is_valid:
                    with np.load(io.BytesIO(batch.column("graph")[lo].as_py())) as packed:
                        graph, own = {n: packed[n] for n in packed.files}, place[lo]
                    lo += 1
                if lo < hi and own == place[lo]:  # a shard that the hash left empty has no graph
                    some = batch.slice(lo, hi - lo)
                    found = search(graph, some.column("query_id").to_numpy(), _floats(some.column("vector")), k)
                    yield pa.RecordBatch.from_pandas(found, preserve_index=False)

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """Rows whose vector takes part, as arrays of doubles."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    fine = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine)
    return rows.select("vec_id", x.alias("embedding")).filter(F.exists("embedding", lambda v: v != 0))


def nearest(vectors: DataFrame, is_query, k: int = 20) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of the k nearest rows of each query row, itself excepted."""
    rows = tables.kept(usable(vectors).withColumn("size", F.size("embedding")), "vectors")
    common = rows.groupBy("size").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    rows = rows.filter(F.col("size") == (common["size"] if common else 0)).drop("size")
    norm = F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v * v)
    n, largest = rows.agg(F.count("*"), F.sqrt(F.max(norm))).first()
    shards = tables.parts_for(n, SHARD)
    # a partition for each shard, however many there are: a hash would put two into one
    placed = rows.withColumn("shard", tables.spread("vec_id", parts=shards, seed="shard")).repartitionById(shards, F.col("shard"))
    graphs = placed.groupBy("shard").applyInArrow(_building(float(largest or 0.0)), "shard int, graph binary")
    graphs = tables.kept(graphs, "graphs")
    asked = tables.kept(rows.filter(is_query).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), "queries")
    slices = tables.parts_for(asked.count(), QUERIES)
    every = F.sequence(F.lit(0), F.lit(slices - 1))
    held = graphs.withColumn("slice", F.explode(every)).select("shard", "slice", "graph")
    sent = asked.withColumn("slice", tables.spread("query_id", parts=slices, seed="slice"))
    sent = sent.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    both = held.unionByName(sent, allowMissingColumns=True).withColumn("place", F.col("shard") * slices + F.col("slice"))
    dealt = both.repartitionById(shards * slices, F.col("place")).sortWithinPartitions("place", F.col("graph").isNull(), "query_id")
    walked = dealt.select("place", "graph", "query_id", "vector").mapInArrow(_searching(k), "query_id long, vec_id long, score double")
    found = tables.kept(walked, "found")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
