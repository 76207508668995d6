"""Merkle manifest of a table by time-forward processing.

Every row is a leaf, the sha256 of its columns. Per tree (a value of one column) leaves stand in order, every two
neighbours become their digest, level by level, until one is left; these form a last tree over all of them.

*Time-forward processing*: nodes are labelled in an order in which parents come after their children, here
(last leaf below the node, level). A node is worked on when its label comes up: it takes the digests sent to it from a
priority queue ordered by label and sends its own to its parent. A second sweep in falling order of labels sends every
node's proof, the neighbours on the way up, on to its children.

The external part of the queue is Spark's shuffle. Leaves are cut into blocks of ``2**HEIGHT`` neighbours, which are
whole subtrees; a heap serves the labels inside a block, and holds a message per level at most. Digests that leave a
block are rows of a table written to the shared folder, delivered to the next block up by a sorted shuffle; so ten
levels cost one pass, whatever the number of leaves, and no task holds more than a block. The sweep back goes through
the same blocks from the top, each joined with the proof of its own top node.

Defined cases: a null is written ``-``, so null, empty and the text ``-`` differ. A null tree is a tree of its own, the
first. Leaves with equal or null order (nulls first) stand in order of their digests, so repeated rows have equal
digests in neighbouring places. A lone node on a level becomes the digest of itself alone; the only leaf of a tree is
its top. An empty table gives no row. Columns of other names are not read. Very long texts are hashed in the JVM.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.llm import tables

HEIGHT = 10
#: Rows for each part of the order, at most and (unless that makes more parts than the cluster shuffles into) at least; a part is one task's sort.
PART, LEAST_PART = 200_000, 2_000
_PROOF = "array<struct<before:string,after:string>>"
_PROOF_ARROW = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_digest(columns: Sequence[Column]) -> Column:
    """sha256 over the columns, each as its UTF-8 byte count, a colon and its text, or ``-`` if null."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat(*parts), 256)


def forward(leaves: Sequence[str], height: int) -> list[list[str]]:
    """Digests of all levels of a subtree, from its leaves up to the one node ``height`` levels above."""
    levels: list[list[str]] = [[] for _ in range(height + 1)]
    queue: list[tuple[int, int, int, str]] = []
    last = len(leaves) - 1

    def send(level: int, place: int, value: str) -> None:
        levels[level].append(value)
        if level < height:
            parent = place >> 1
            label = min(((parent + 1) << (level + 1)) - 1, last), level + 1
            heapq.heappush(queue, (*label, place, value))

    for i, leaf in enumerate(leaves):
        send(0, i, leaf)
        while queue and queue[0][0] == i:
            label = queue[0][:2]
            place, text = queue[0][2], ""
            while queue and queue[0][:2] == label:
                text += heapq.heappop(queue)[3]
            send(label[1], place >> 1, digest(text))
    return levels


def backward(levels: list[list[str]], top: tuple | None, leaf: Callable[[int, tuple | None], None]) -> None:
    """Hands every leaf its proof as a linked list (before, after, rest), from the highest label to the lowest."""
    height, last = len(levels) - 1, len(levels[0]) - 1
    queue: list[tuple[int, int, int, tuple | None]] = [(-last, -height, 0, top)]
    while queue:
        _, level, place, proof = heapq.heappop(queue)
        level = -level
        if level == 0:
            leaf(place, proof)
            continue
        below = levels[level - 1]
        for child in (2 * place, 2 * place + 1):
            if child < len(below):
                other = child ^ 1
                near = below[other] if other < len(below) else ""
                step = (near, "", proof) if child & 1 else ("", near, proof)
                label = min(((child + 1) << (level - 1)) - 1, last)
                heapq.heappush(queue, (-label, 1 - level, child, step))


def _height(rows: int) -> int:
    """Levels that a block of a tree with so many nodes goes up."""
    return min(HEIGHT, (rows - 1).bit_length())


def _up(block: pa.Table) -> pa.Table:
    block = block.sort_by("at")
    rows = block.column("rows")[0].as_py()
    top = forward(block.column("digest").to_pylist(), _height(rows))[-1][0]
    number = block.column("block")[0].as_py()
    return pa.table({"tree": [block.column("tree")[0].as_py()], "at": pa.array([number], pa.int64()), "digest": [top], "rows": pa.array([-(-rows >> HEIGHT) if rows > 1 << HEIGHT else 1], pa.int64())})


def _down(block: pa.Table, above: pa.Table) -> pa.Table:
    block = block.sort_by("at")
    levels = forward(block.column("digest").to_pylist(), _height(block.column("rows")[0].as_py()))
    top = None
    if above.num_rows:
        for step in reversed(above.column("proof")[0].as_py()):
            top = (step["before"], step["after"], top)
    before, after, ends = [], [], [0] * (block.num_rows + 1)
    found: list[tuple | None] = [None] * block.num_rows
    backward(levels, top, found.__setitem__)
    for i, proof in enumerate(found):
        while proof is not None:
            before.append(proof[0])
            after.append(proof[1])
            proof = proof[2]
        ends[i + 1] = len(before)
    steps = pa.StructArray.from_arrays([pa.array(before, pa.string()), pa.array(after, pa.string())], fields=list(_PROOF_ARROW.value_type))
    proofs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), steps).cast(_PROOF_ARROW)
    return block.drop_columns(["rows", "block"]).append_column("proof", proofs)


def _placed(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` (tree, order columns ``o``, digest) with ``at``, the place in its tree, and ``rows``, the tree's number of them; written."""
    n = rows.count()
    parts = max(tables.parts_for(n, PART), min(tables.parts_for(n, LEAST_PART), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    rows = rows.withColumn("__twin", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange(parts, "tree", F.col("o").asc_nulls_first(), "digest", "__twin") if parts > 1 else rows.coalesce(1)
    dealt = tables.kept(dealt.withColumn("part", F.spark_partition_id()), f"{name}-dealt")
    # parts follow the order of (tree, o, digest), so a tree's parts are neighbours and only its own rows count
    placed = tables.running_total(dealt, ["tree"], "part", [F.col("o").asc_nulls_first(), "digest", "__twin"], F.lit(1).cast("long"), "at")
    sizes = dealt.groupBy("tree").agg(F.count("*").alias("rows"))
    return tables.kept(placed.join(sizes, "tree").drop("part", "__twin"), f"{name}-placed")


def _blocked(level: DataFrame) -> DataFrame:
    return level.withColumn("block", F.shiftright("at", HEIGHT))


def _tops(placed: DataFrame, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The levels at which blocks begin, from the leaves up, and the top of every tree."""
    levels, level = [], placed
    most = placed.agg(F.max("rows")).first()[0] or 0
    while most > 1:
        levels.append(level)
        up = _blocked(level.select("tree", "at", "digest", "rows")).groupBy("tree", "block").applyInArrow(_up, "tree string, at long, digest string, rows long")
        level, most = tables.kept(up, f"{name}-up"), -(-most >> HEIGHT) if most > 1 << HEIGHT else 1
    return levels, level.select("tree", "digest")


def _proofs(levels: list[DataFrame], lowest: DataFrame, tops: DataFrame, name: str) -> DataFrame:
    """The rows of ``lowest``, where the first of ``levels`` begins, each with its proof; ``tops``: tree and the proof of each tree's top."""
    above = tops.select("tree", F.lit(0).cast("long").alias("block"), "proof")
    for i, level in reversed(list(enumerate(levels))):
        level = _blocked(lowest if i == 0 else level)
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in level.drop("rows", "block").schema.fields)
        found = level.groupBy("tree", "block").cogroup(above.groupBy("tree", "block")).applyInArrow(_down, f"{kinds}, proof {_PROOF}")
        if i == 0:
            return found
        above = tables.kept(found.select("tree", "at", "proof"), f"{name}-down").withColumnRenamed("at", "block")
    return lowest.drop("rows").join(above.drop("block"), "tree")


def manifest(rows: DataFrame, leaf: Column, tree: Column, order: Column, keep: dict[str, Column]) -> DataFrame:
    """The columns ``keep`` of each row, and ``leaf``, ``subroot``, ``root`` and ``proof``.

    ``leaf`` and ``tree`` are text columns, ``order`` sorts the leaves of a tree. ``proof`` lists the steps from the
    leaf to the root: a node is the sha256 of ``before``, the node below and ``after``; on a level where it stood
    alone both are empty.
    """
    kept = F.struct(*(c.alias(f"c{i}") for i, c in enumerate(keep.values())), F.lit(0).alias("none"))
    # '' and '=...' keep null apart from the empty text, and the order of UTF-8 bytes with null first
    flat = rows.select(F.coalesce(F.concat(F.lit("="), tree), F.lit("")).alias("tree"), order.alias("o"), leaf.alias("digest"), kept.alias("kept"))
    placed = _placed(tables.kept(flat, "merkle-leaves"), "merkle")
    levels, tops = _tops(placed, "merkle")
    tops = tables.kept(tops.withColumnRenamed("digest", "subroot"), "merkle-subroots")
    over = _placed(tops.select(F.lit("").alias("tree"), F.col("tree").alias("o"), F.col("subroot").alias("digest")), "merkle-top")
    over_levels, root = _tops(over, "merkle-top")
    root = root.select(F.col("digest").alias("root"))
    no_steps = F.array().cast(_PROOF)
    upper = _proofs(over_levels, over, root.select(F.lit("").alias("tree"), no_steps.alias("proof")), "merkle-top")
    tops = tables.kept(upper.select(F.col("o").alias("tree"), F.col("digest").alias("subroot"), "proof"), "merkle-tops")
    proofs = _proofs(levels, placed.select("tree", "at", "digest", "rows", "kept"), tops, "merkle")
    found = proofs.join(tables.hinted(tops.select("tree", "subroot")), "tree").crossJoin(F.broadcast(root))
    return found.select(*(F.col(f"kept.c{i}").alias(n) for i, n in enumerate(keep)), F.col("digest").alias("leaf"), "subroot", "root", "proof")


def folded(start: Column, proof: Column) -> Column:
    """The root that follows from a leaf and a proof."""
    return F.aggregate(proof, start, lambda node, step: F.sha2(F.concat(step["before"], node, step["after"]), 256))


def proof_digest(proof: Column) -> Column:
    """sha256 over the neighbours of a proof, from the leaf to the root."""
    return F.sha2(F.array_join(F.transform(proof, lambda step: F.concat(step["before"], step["after"])), ""), 256)
