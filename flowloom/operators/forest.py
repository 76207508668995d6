"""A random forest over cells: rows of one class that no split candidate tells apart are one cell with a number of rows.

It is the forest of ``RandomForestClassifier``: bootstrap by Poisson(1) a row, the root of the features at each node, up to
``BINS - 1`` split candidates a feature at weighted quantiles, Gini impurity under class weights, a least number of drawn rows in a
leaf, sibling leaves of one prediction merged. Spark's learner keeps a count for each row and tree and passes over all rows once or
more a level. Here n equal rows are drawn Poisson(n) times at once, each task takes the cells once and grows whole trees from them.
The cells are at most the rows, and with few features at most 2 * BINS ^ features, whatever the number of rows.
"""

from __future__ import annotations

import math
import tempfile
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.session import scratch_dir

BINS = 32
# Ranks at which the values of a class are taken for split candidates.
POINTS = 500
# Bytes of rows that a task puts together before it hands on their cells or ranks, and cells of a stored block.
HELD_BYTES, BLOCK_CELLS = 32_000_000, 65_536
# Nodes whose histograms are worked out at once.
NODES = 2_048
TASKS = 8


def _candidates(values: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """Middles between neighbouring values: all where they are few, otherwise those nearest to equal shares of the mass."""
    found, where = np.unique(values, return_inverse=True)
    middles = (found[:-1] + found[1:]) / 2
    if len(middles) < BINS:
        return np.unique(middles)
    total = np.cumsum(np.bincount(where, mass))
    kept, target = [], total[-1] / BINS
    for before, after, middle in zip(total[:-1], total[1:], middles, strict=True):
        if abs(before - target) < abs(after - target):
            kept.append(middle)
            target += total[-1] / BINS
    return np.unique(kept[: BINS - 1])


def _points(n_features: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Feature columns and a class to values at equal ranks of each feature and class, of many rows at a time, with the rows that each stands for."""
    ranks = np.linspace(0, 1, POINTS + 1)

    def ranked(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        y, found = table.column(n_features).to_numpy(), []
        of_class = [(int(c), np.flatnonzero(y == c)) for c in np.unique(y)]
        for i in range(n_features):
            values = table.column(i).to_numpy()
            if np.isnan(values).any():
                raise ValueError(f"feature {i} has missing values")
            for c, rows in of_class:
                at = np.sort(values[rows])[np.rint(ranks * (len(rows) - 1)).astype(np.int64)]
                found.append((i, c, at, len(rows) / len(at)))
        columns = [pa.array(x, t) for x, t in zip(zip(*found, strict=True), (pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.float64()), strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=["feature", "class", "at", "n"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows * 8 * (n_features + 1)
            if size >= HELD_BYTES:
                yield ranked(held)
                held, size = [], 0
        if held:
            yield ranked(held)

    return run


def split_candidates(df: DataFrame, columns: Sequence[str], label: str, weights: Sequence[float]) -> list[np.ndarray]:
    """Per column the rising split candidates, from the distribution of all rows under the weights of their classes."""

    def candidates(table: pa.Table) -> pa.Table:
        mass = [np.full(len(at), n * weights[c]) for c, at, n in zip(table["class"].to_pylist(), table["at"].to_pylist(), table["n"].to_pylist(), strict=True)]
        found = _candidates(table["at"].combine_chunks().flatten().to_numpy(), np.concatenate(mass))
        return pa.table({"feature": table["feature"][:1], "splits": pa.array([found], pa.list_(pa.float64()))})

    rows = df.select(*columns, F.col(label).cast("int"))
    points = rows.mapInArrow(_points(len(columns)), "feature int, class int, at array<double>, n double")
    found = {r.feature: r.splits for r in points.groupBy("feature").applyInArrow(candidates, "feature int, splits array<double>").collect()}
    return [np.asarray(found[i], float) for i in range(len(columns))]


def _binned(splits: list[np.ndarray]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Feature columns and a class to distinct keys, a byte for each bin and one for the class, with their number of rows."""
    width = len(splits) + 1

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        keys = np.concatenate(held)
        column = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(keys), [None, pa.py_buffer(keys)])
        found = pa.table({"key": column}).group_by("key").aggregate([([], "count_all")])
        arrays = [found["key"].combine_chunks().cast(pa.binary()), found["count_all"].combine_chunks()]
        return pa.RecordBatch.from_arrays(arrays, names=["key", "n"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            keys = np.empty((batch.num_rows, width), np.uint8)
            for i, points in enumerate(splits):
                values = batch.column(i).to_numpy(zero_copy_only=False)
                if np.isnan(values).any():
                    raise ValueError(f"feature {i} has missing values")
                keys[:, i] = np.searchsorted(points, values)
            keys[:, -1] = batch.column(width - 1).to_numpy()
            held.append(keys)
            size += keys.nbytes
            if size >= HELD_BYTES:
                yield counted(held)
                held, size = [], 0
        if held:
            yield counted(held)

    return run


def _block(table: pa.Table) -> pa.Table:
    """The cells of a block in the order of their keys, so that draws follow from the seed alone."""
    table = table.sort_by("key")
    keys, counts = b"".join(table["key"].to_pylist()), table["n"].to_numpy().astype("<i8").tobytes()
    return pa.table({"block": table["block"][:1], "keys": pa.array([keys], pa.binary()), "counts": pa.array([counts], pa.binary())})


def cell_blocks(df: DataFrame, columns: Sequence[str], label: str, splits: list[np.ndarray]) -> DataFrame:
    """The cells of the rows, packed into blocks: ``block``, ``keys``, ``counts``. Written once."""
    spark = df.sparkSession
    rows = df.select(*columns, F.col(label).cast("int"))
    path = scratch_dir(spark, "cells")
    rows.mapInArrow(_binned(splits), "key binary, n bigint").groupBy("key").agg(F.sum("n").alias("n")).write.parquet(path)
    cells = spark.read.parquet(path)
    n_blocks = math.ceil(cells.count() / BLOCK_CELLS)
    blocked = cells.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(n_blocks)).cast("int")).groupBy("block")
    path = scratch_dir(spark, "blocks-of-cells")
    blocked.applyInArrow(_block, "block int, keys binary, counts binary").write.parquet(path)
    return spark.read.parquet(path)


def _best_splits(hist: np.ndarray, total: np.ndarray, weights: np.ndarray, min_leaf: int):
    """Per node the best place (position in its features, bin), the gain and the class counts on the left."""
    left = hist.cumsum(axis=2)[:, :, :-1]
    right = total[:, None, None, :] - left
    fits = (left.sum(-1) >= min_leaf) & (right.sum(-1) >= min_leaf)

    def impurity(counts):
        each = counts * weights
        size = each.sum(-1)
        with np.errstate(divide="ignore", invalid="ignore"):
            return size, 1 - ((each / size[..., None]) ** 2).sum(-1)

    (n, whole), (n_left, of_left), (n_right, of_right) = impurity(total), impurity(left), impurity(right)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = whole[:, None, None] - (n_left * of_left + n_right * of_right) / n[:, None, None]
    gain = np.where(fits, gain, -1.0).reshape(len(total), -1)
    best = gain.argmax(axis=1)
    place, split = np.divmod(best, BINS - 1)
    nodes = np.arange(len(total))
    return place, split, gain[nodes, best], left[nodes, place, split]


def grow(matrix: np.ndarray, draws: np.ndarray, weights: np.ndarray, depth: int, min_leaf: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    """A tree over drawn cells. matrix: a row of bins and the class for each cell; draws: how often each cell is drawn.

    Returns per node the class counts, feature, bin (up to it goes left), gain and left child (the right one follows it; -1: leaf).
    """
    width, flat = matrix.shape[1], matrix.reshape(-1)
    n_features = width - 1
    taken = math.ceil(math.sqrt(n_features))
    rows = np.flatnonzero(draws)
    w, y = draws[rows].astype(float), flat.take(rows * width + n_features).astype(np.int64)
    slot = np.zeros(len(rows), np.int64)
    total = np.bincount(y, w, 2).reshape(1, 2)
    levels = []
    known, at = 1, np.zeros(1, np.int64)  # nodes so far; the numbers of this level's open nodes
    counts, feature, cut, gains, child = [total], {}, {}, {}, {}
    for level in range(depth):
        if not len(at):
            break
        # Drawn in the order of the nodes, so that they follow from the tree's generator alone.
        features = np.argsort(rng.random((len(at), n_features)), axis=1)[:, :taken]
        if len(at) > NODES:
            order = np.argsort(slot, kind="stable")
            rows, w, y, slot = rows[order], w[order], y[order], slot[order]
        edges = np.searchsorted(slot, np.arange(0, len(at) + NODES, NODES)) if len(at) > NODES else np.array([0, len(rows)])
        found = []
        for part in range(len(edges) - 1):
            first, nodes = part * NODES, min(NODES, len(at) - part * NODES)
            hist = np.zeros(nodes * taken * BINS * 2)
            step = max(1 << 16, nodes * BINS)
            for a in range(edges[part], edges[part + 1], step):
                b = min(a + step, edges[part + 1])
                bins = flat.take((rows[a:b] * width)[:, None] + features.take(slot[a:b], axis=0))
                key = ((slot[a:b] - first)[:, None] * taken + np.arange(taken)) * (2 * BINS) + 2 * bins + y[a:b, None]
                hist += np.bincount(key.ravel(), np.repeat(w[a:b], taken), len(hist))
            of_part = slice(first, first + nodes)
            found.append(_best_splits(hist.reshape(nodes, taken, BINS, 2), total[of_part], weights, min_leaf))
        place, split, gain, left = (np.concatenate(f) for f in zip(*found, strict=True))
        chosen = features[np.arange(len(at)), place]
        goes_on = gain > 0
        n_split = int(goes_on.sum())
        children = np.full(len(at), -1, np.int64)
        children[goes_on] = known + 2 * np.arange(n_split)
        levels.append((at, chosen, split, gain, children))
        below = np.stack([left[goes_on], (total - left)[goes_on]], axis=1).reshape(-1, 2)
        counts.append(below)
        is_open = (below > 0).all(axis=1) & (below.sum(axis=1) >= 2 * min_leaf) & (level + 1 < depth)
        slot_of_child = np.where(is_open, np.cumsum(is_open) - 1, -1)
        # rows to their children; those of finished nodes leave
        base = np.where(goes_on, children - known, -1)
        side = flat.take(rows * width + chosen[slot]) > split[slot]
        target = np.where(base[slot] >= 0, slot_of_child[np.maximum(base[slot], 0) + side] if n_split else -1, -1)
        stay = target >= 0
        rows, w, y, slot = rows[stay], w[stay], y[stay], target[stay]
        at, total = known + np.flatnonzero(is_open), below[is_open]
        known += 2 * n_split
    tree = {"counts": np.concatenate(counts), "feature": np.full(known, -1), "cut": np.full(known, -1), "gain": np.full(known, -1.0), "child": np.full(known, -1)}
    for at, chosen, split, gain, children in levels:
        for name, values in (("feature", chosen), ("cut", split), ("gain", gain), ("child", children)):
            tree[name][at[children >= 0]] = values[children >= 0]
    return tree


def node_rows(tree: dict[str, np.ndarray], weights: np.ndarray, splits: list[np.ndarray]) -> list[tuple]:
    """The nodes as Spark stores them, in preorder; two leaves below a node that predict the same are merged into it."""
    stats = tree["counts"] * weights
    size = np.maximum(stats.sum(axis=1, keepdims=True), np.finfo(float).tiny)
    impurity, predicted = 1 - ((stats / size) ** 2).sum(axis=1), stats.argmax(axis=1)
    child = tree["child"].copy()
    for node in np.flatnonzero(child >= 0)[::-1]:
        a = child[node]
        if child[a] < 0 and child[a + 1] < 0 and predicted[a] == predicted[a + 1]:
            child[node] = -1
    order, waiting = [], [0]
    while waiting:
        node = waiting.pop()
        order.append(node)
        if child[node] >= 0:
            waiting += [child[node] + 1, child[node]]
    number = {node: i for i, node in enumerate(order)}
    found = []
    for node in order:
        here = (number[node], float(predicted[node]), float(impurity[node]), stats[node].tolist(), int(tree["counts"][node].sum()))
        if child[node] < 0:
            found.append((*here, -1.0, -1, -1, (-1, [], -1)))
        else:
            f = int(tree["feature"][node])
            split = (f, [float(splits[f][tree["cut"][node]])], -1)
            found.append((*here, float(tree["gain"][node]), number[child[node]], number[child[node] + 1], split))
    return found


def _grown(splits: list[np.ndarray], weights: np.ndarray, trees: int, tasks: int, depth: int, min_leaf: int, seed: int) -> Callable[[Iterator], Iterator]:
    """A task's trees, from all blocks. The bins lie in a temporary file that is mapped, not in memory."""

    def run(blocks: Iterator) -> Iterator[tuple]:
        with tempfile.TemporaryFile() as file:
            sizes, counts, group = [], [], None
            for row in blocks:
                group = row.task
                file.write(row["keys"])
                counts.append(np.frombuffer(row["counts"], "<i8"))
                sizes.append((row.block, len(counts[-1])))
            if group is None:
                return
            file.flush()
            matrix = np.memmap(file, np.uint8, "r").reshape(-1, len(splits) + 1)
            for tree in range(group, trees, tasks):
                drawn = [np.random.default_rng([seed, tree, block]).poisson(n) for (block, _), n in zip(sizes, counts, strict=True)]
                rng = np.random.default_rng([seed, tree])
                grown = grow(np.asarray(matrix), np.concatenate(drawn), weights, depth, min_leaf, rng)
                yield from ((tree, node) for node in node_rows(grown, weights, splits))

    return run


def fitted_forest(df: DataFrame, columns: Sequence[str], learner: RandomForestClassifier, classes: dict[int, float]) -> RandomForestClassificationModel:
    """The forest that ``learner`` describes. classes: the weight of each class (0, 1).

    Its nodes are written in the form in which Spark stores forests, into the stored form of one that Spark fitted to two rows.
    """
    spark, label = df.sparkSession, learner.getLabelCol()
    weights = np.array([classes.get(y, 1.0) for y in (0, 1)])
    splits = split_candidates(df, columns, label, weights.tolist())
    trees = learner.getNumTrees()
    tasks = min(trees, max(TASKS, spark.sparkContext.defaultParallelism))
    dealt = cell_blocks(df, columns, label, splits).withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))
    grown = _grown(splits, weights, trees, tasks, learner.getMaxDepth(), learner.getMinInstancesPerNode(), learner.getSeed())

    folder = scratch_dir(spark, "forest")
    zeros = Vectors.dense([0.0] * len(columns))
    two = spark.createDataFrame([(zeros, float(y), 1.0) for y in (0, 1)], [learner.getFeaturesCol(), label, learner.getWeightCol()])
    learner.fit(two).write().save(f"{folder}/two-rows")
    for part in ("metadata", "treesMetadata"):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/two-rows/{part}")
        files, conf = path.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jsc.hadoopConfiguration()
        spark._jvm.org.apache.hadoop.fs.FileUtil.copy(files, path, files, spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/model/{part}"), False, conf)
    schema = spark.read.parquet(f"{folder}/two-rows/data").schema
    nodes = dealt.repartitionById(tasks, "task").rdd.mapPartitions(grown)
    spark.createDataFrame(nodes, schema, verifySchema=False).write.parquet(f"{folder}/model/data")
    return RandomForestClassificationModel.load(f"{folder}/model")
