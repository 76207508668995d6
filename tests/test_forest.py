"""The forest grown from cells against a plain tree and against Spark's learner, and the looked-up scores against the walked ones."""

import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from flowloom.functions import numeric
from flowloom.operators import clean, forest, sampling, training

LABEL = clean.LABEL_BINARY
NAMES = ["a", "b", "c", "same"]
SMALL = training.ForestConfig(trees=25, depth=8)


def plain_tree(bins, y, draws, weights, depth, min_leaf):
    """One feature: the class counts of every node, parents first, level by level, with the bin of its split."""
    found, level = [], [(np.ones(len(y), bool), 0)]
    while level:
        below = []
        for inside, deep in level:
            counts = np.array([draws[inside & (y == c)].sum() for c in (0, 1)])
            best = (0.0, -1)
            for cut in range(forest.BINS - 1):
                sides = [inside & (bins <= cut), inside & (bins > cut)]
                if deep == depth or min(draws[s].sum() for s in sides) < min_leaf:
                    continue
                each = [np.array([draws[s & (y == c)].sum() for c in (0, 1)]) * weights for s in sides]
                whole = counts * weights
                loss = sum(e.sum() * (1 - ((e / e.sum()) ** 2).sum()) for e in each) / whole.sum()
                gain = 1 - ((whole / whole.sum()) ** 2).sum() - loss
                if gain > best[0] + 1e-12:
                    best = (gain, cut)
            found.append((counts.tolist(), best[1]))
            if best[1] >= 0:
                below += [(inside & (bins <= best[1]), deep + 1), (inside & (bins > best[1]), deep + 1)]
        level = below
    return found


@pytest.mark.parametrize("nodes", [forest.NODES, 2])
def test_tree_equals_a_plain_one(monkeypatch, nodes):
    monkeypatch.setattr(forest, "NODES", nodes)
    rng = np.random.default_rng(3)
    bins = rng.integers(0, forest.BINS, 400).astype(np.uint8)
    y = (rng.random(400) < np.where(bins % 7 < 3, 0.8, 0.1)).astype(np.uint8)
    draws = rng.poisson(2, 400)
    weights = np.array([0.6, 3.0])
    tree = forest.grow(np.stack([bins, y], axis=1), draws, weights, 5, 3, np.random.default_rng(1))
    got = [(c.astype(int).tolist(), int(cut)) for c, cut in zip(tree["counts"], tree["cut"], strict=True)]
    assert sorted(got) == sorted(plain_tree(bins, y, draws, weights, 5, 3)) and len(got) > 10
    for node in np.flatnonzero(tree["child"] >= 0):
        assert (tree["counts"][tree["child"][node] : tree["child"][node] + 2].sum(axis=0) == tree["counts"][node]).all()


def test_candidates_are_middles_of_few_values_and_shares_of_many():
    assert forest._candidates(np.array([3.0, 1, 1, 7]), np.ones(4)).tolist() == [2.0, 5.0]
    assert forest._candidates(np.zeros(5), np.ones(5)).tolist() == []
    many = forest._candidates(np.arange(1000.0), np.ones(1000))
    assert len(many) == forest.BINS - 1 and np.abs(np.diff(many) - 1000 / forest.BINS).max() < 2


@pytest.fixture(scope="module")
def rows(spark):
    random = [F.rand(i).alias(n) for i, n in enumerate("abc")]
    drawn = spark.range(0, 6000, 1, 3).select("id", *random, F.lit(4.0).alias("same"))
    folder = training.forest.scratch_dir(spark, "forest-rows")
    drawn.withColumn(LABEL, ((F.col("a") > 0.7) & (F.round(F.col("b"), 1) < 0.6) | (F.rand(9) < 0.02)).cast("int")).write.parquet(folder)
    return spark.read.parquet(folder)


@pytest.fixture(scope="module")
def both(rows):
    """The forest by Spark's learner, and the one from cells with the numbers of rows that its learner was given."""
    given, fit, limit = [], training.RandomForestClassifier.fit, training.COUNTS_BY_ROW
    by_rows = training.train_forest(rows, NAMES, SMALL)
    training.COUNTS_BY_ROW = 0
    training.RandomForestClassifier.fit = lambda self, df: given.append(df.count()) or fit(self, df)
    try:
        return by_rows, training.train_forest(rows, NAMES, SMALL), training.train_forest(rows.repartition(5, "b"), NAMES, SMALL), given
    finally:
        training.COUNTS_BY_ROW, training.RandomForestClassifier.fit = limit, fit


def test_learner_never_sees_the_rows_of_a_large_table(both):
    assert both[3] == [2, 2]


def test_forest_from_cells_is_like_that_of_the_learner(rows, both):
    by_rows, by_cells, _, _ = both
    scored = by_rows.score(by_cells.score(rows, ["id", LABEL, *NAMES]).withColumnRenamed("score", "x").drop("predicted"), ["id", LABEL, "x"])
    gap = scored.agg(F.avg(F.abs(F.col("x") - F.col("score"))), F.corr("x", "score")).first()
    assert gap[0] < 0.04 and gap[1] > 0.98
    auc = [BinaryClassificationEvaluator(rawPredictionCol=c, labelCol=LABEL).evaluate(scored) for c in ("x", "score")]
    assert auc[0] == pytest.approx(auc[1], abs=0.02) and auc[0] > 0.9
    trees = [m.pipeline.stages[-1] for m in (by_rows, by_cells)]
    assert trees[0].getNumTrees == trees[1].getNumTrees == 25 and trees[1].numFeatures == 4
    assert max(t.depth for t in trees[1].trees) <= 8 and 0.5 < trees[1].totalNumNodes / trees[0].totalNumNodes < 2
    assert np.abs(trees[0].featureImportances.toArray() - trees[1].featureImportances.toArray()).max() < 0.1


def test_forest_is_alike_however_rows_lie(rows, both):
    """Repartitioned rows give other candidates within the error of the ranks, and so other draws: a forest like the first."""
    a, b = (m.score(rows, ["id"]).toPandas().sort_values("id").score.to_numpy() for m in both[1:3])
    assert np.abs(a - b).mean() < 0.04 and np.corrcoef(a, b)[0, 1] > 0.98


def test_cells_hold_every_row(rows):
    splits = [np.array([0.25, 0.5]), np.array([0.1]), np.array([]), np.array([])]
    blocks = forest.cell_blocks(rows, NAMES, LABEL, splits).collect()
    keys = np.concatenate([np.frombuffer(r["keys"], np.uint8).reshape(-1, 5) for r in blocks])
    counts = np.concatenate([np.frombuffer(r["counts"], "<i8") for r in blocks])
    assert len(keys) == len({k.tobytes() for k in keys}) <= 12 and counts.sum() == 6000
    got = {tuple(k): n for k, n in zip(keys.tolist(), counts.tolist(), strict=True)}
    table = rows.toPandas()
    where = (np.searchsorted(splits[0], table.a), np.searchsorted(splits[1], table.b), table[LABEL])
    assert got == {(a, b, 0, 0, y): int(((where[0] == a) & (where[1] == b) & (where[2] == y)).sum()) for a, b, _, _, y in got}


def test_missing_numbers_are_an_error(spark, rows, both):
    bad = rows.withColumn("a", F.when(F.col("id") == 5, None).otherwise(F.col("a")))
    with pytest.raises(Exception, match="(?i)null|missing"):
        both[1].score(bad, ["id"]).collect()
    with pytest.raises(Exception, match="missing values"):
        forest.cell_blocks(bad, NAMES, LABEL, [np.array([0.5])] * 4)


def test_scores_looked_up_are_those_walked(monkeypatch, spark, rows, both):
    """Also of rows that lie on thresholds or beyond all values seen."""
    scaling = spark.createDataFrame([(-1e300, 2.0, 0.0, 0.0), (1e300, -5.0, -0.0, 4.0), (0.0, -0.0, 1e-300, 9.0)], NAMES)
    for model in both[:2]:
        trees = model.pipeline.stages[-1]
        limits = training.thresholds(trees, 4)
        assert limits[3] == [] and all(limits[:3])
        ids = ["a", "b", "c"]
        looked = [model.score(df, ids).collect() for df in (rows, scaling)]
        on_limits = spark.createDataFrame([(x, y, limits[2][0], 0.0) for x in limits[0] for y in limits[1]], [training._scaled_name(i) for i in range(4)])
        walked = training.PipelineModel(model.pipeline.stages[1:]).transform(on_limits).select("probability", "prediction").collect()
        assert training._looked_up(on_limits, limits, *model.pipeline.stages[1:]).select("probability", "prediction").collect() == walked
        with monkeypatch.context() as m:
            m.setattr(training, "LOOKED_UP_FEATURES", 3)
            assert training.thresholds(trees, 4) is None
            assert [model.score(df, ids).collect() for df in (rows, scaling)] == looked


def test_samples_by_a_stored_hash_order(rows):
    ids = ["id"]
    ordered = rows.withColumn("_kept", numeric.hash_order(F.col("id")))
    for plain, with_order in (
        (sampling.undersample_benign(rows, ids, ratio=1), sampling.undersample_benign(ordered, ids, ratio=1, order="_kept")),
        (sampling.split_stratified(rows, ids), sampling.split_stratified(ordered, ids, order="_kept")),
    ):
        assert "_kept" in with_order.columns
        assert with_order.drop("_kept").columns == plain.columns
        assert sorted(map(repr, with_order.drop("_kept").collect())) == sorted(map(repr, plain.collect()))
