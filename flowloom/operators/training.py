"""Scaling, the random forest, scoring, saved models."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import Bucketizer, SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowloom.constants import SEED
from flowloom.operators import clean, forest, metrics


# Counts of the bootstrap samples, one for each row and tree, that a part of the training rows may have (4 bytes each).
COUNTS_IN_PART = 16_000_000
# Counts up to which Spark's learner fits the forest; beyond, it is grown from cells of equal rows.
COUNTS_BY_ROW = 64_000_000
# Models of few features are looked up: as many features, and combinations of intervals between their thresholds, at most.
LOOKED_UP_FEATURES, LOOKED_UP_CELLS = 8, 131_072


@dataclass(frozen=True)
class ForestConfig:
    trees: int = 300
    depth: int = 20
    min_leaf: int = 5
    seed: int = SEED
    label: str = clean.LABEL_BINARY


def scaler_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean and population deviation per column, one row each; no deviation counts as 1.

    Fit it on the training rows only; fitting on all rows before the split leaks.
    """
    lines = [
        F.struct(
            F.lit(c).alias("feature"),
            F.lit(i).alias("pos"),
            F.avg(clean.quoted(c)).alias("mean"),
            F.stddev_pop(clean.quoted(c)).alias("std"),
        )
        for i, c in enumerate(columns)
    ]
    stats = df.agg(F.array(*lines).alias("lines")).select(F.inline("lines"))
    return stats.withColumn("std", F.when(F.col("std") == 0, 1.0).otherwise(F.col("std")))


def _collected(stats: DataFrame) -> dict[str, tuple[float, float]]:
    """As many rows as there are columns to scale."""
    return {r.feature: (r.mean, r.std) for r in stats.collect()}


def scale(df: DataFrame, stats: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - mean) / std as plain column arithmetic."""
    known = _collected(stats)
    return df.withColumns({c: (clean.quoted(c) - F.lit(known[c][0])) / F.lit(known[c][1]) for c in columns})


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights n / (2 n_class), one row per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_class"))
    total = F.sum("n_class").over(Window.partitionBy())  # two rows
    return counts.withColumn("class_weight", total / (F.lit(2) * F.col("n_class")))


def _scaled_name(position: int) -> str:
    return f"scaled_{position}"


def _scaling_stage(features: Sequence[str], stats: dict[str, tuple[float, float]]) -> SQLTransformer:
    """Scaling as a pipeline stage, so that a saved pipeline carries its means and deviations."""
    terms = [
        f"(`{c.replace('`', '``')}` - double('{stats[c][0]!r}')) / double('{stats[c][1]!r}') AS {_scaled_name(i)}"
        for i, c in enumerate(features)
    ]
    return SQLTransformer(statement=f"SELECT *, {', '.join(terms)} FROM __THIS__")


@dataclass
class FlowModel:
    """A fitted pipeline with its feature contract (ordered column names)."""

    pipeline: PipelineModel
    features: list[str] = field(default_factory=list)

    def save(self, spark: SparkSession, folder: str) -> None:
        self.pipeline.write().overwrite().save(f"{folder}/pipeline")
        rows = list(enumerate(self.features))
        spark.createDataFrame(rows, "pos int, feature string").write.mode("overwrite").parquet(f"{folder}/features")

    @staticmethod
    def load(spark: SparkSession, folder: str) -> FlowModel:
        rows = spark.read.parquet(f"{folder}/features").orderBy("pos").collect()
        return FlowModel(PipelineModel.load(f"{folder}/pipeline"), [r.feature for r in rows])

    def score(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """``keep`` columns plus ``score`` (probability of attack) and ``predicted``.

        Rows are aligned to the contract first. Works on streams as well: the forest is
        applied to whole batches inside the JVM.
        """
        named = {k: f"_keep_{i}" for i, k in enumerate(keep)}
        held = df.withColumns({new: clean.quoted(k) for k, new in named.items()}) if named else df
        aligned = clean.align_features(held, self.features, keep=list(named.values()))
        scaling, assembler, trees = self.pipeline.stages
        limits = thresholds(trees, len(self.features))
        if limits is None:
            scored = self.pipeline.transform(aligned)
        else:
            scored = _looked_up(scaling.transform(aligned), limits, assembler, trees)
        return scored.select(
            *[F.col(new).alias(k) for k, new in named.items()],
            attack_probability(F.col("probability")).alias("score"),
            F.col("prediction").cast("int").alias("predicted"),
        )


def thresholds(trees: RandomForestClassificationModel, n_features: int) -> list[list[float]] | None:
    """Per feature the rising thresholds of all trees; none where there are many features or combinations."""
    if n_features > LOOKED_UP_FEATURES:
        return None
    found: list[set[float]] = [set() for _ in range(n_features)]
    for feature, limit in set(re.findall(r"If \(feature (\d+) <= ([^)]+)\)", trees.toDebugString)):
        found[int(feature)].add(float(limit))
    return [sorted(f) for f in found] if math.prod(len(f) + 1 for f in found) <= LOOKED_UP_CELLS else None


def _looked_up(scaled: DataFrame, limits: list[list[float]], assembler: VectorAssembler, trees: RandomForestClassificationModel) -> DataFrame:
    """Trees only tell apart on which side of their thresholds a row lies: they are walked once per combination of
    intervals, and every row takes the result of its own."""
    placed = assembler.transform(scaled).withColumn("_values", vector_to_array("features")).withColumn("_cell", F.lit(0))
    inside, size = {}, 1
    for i, of_column in enumerate(limits):
        n = len(of_column)
        if n:
            # Limits below the value, as a tree sends equal values to the left: signs are turned, as a bucket begins with its limit.
            ends = [-math.inf, *[0.0 - x for x in reversed(of_column)], math.inf]
            turned = placed.withColumn("_turned", F.lit(0.0) - F.get("_values", F.lit(i)))
            found = Bucketizer(splits=ends, inputCol="_turned", outputCol="_bucket").transform(turned)
            placed = found.withColumn("_cell", F.col("_cell") + F.lit(size) * (F.lit(n) - F.col("_bucket").cast("int"))).drop("_turned", "_bucket")
        # the upper ends of the intervals, and a value above the last limit
        values = F.array(*[F.lit(x) for x in [*of_column, math.inf if n else 0.0]])
        inside[_scaled_name(i)] = F.get(values, F.floor(F.col("_cell") / size).cast("int") % (n + 1))
        size *= n + 1
    cells = scaled.sparkSession.range(size).select(F.col("id").cast("int").alias("_cell")).withColumns(inside)
    walked = trees.transform(assembler.transform(cells)).select("_cell", "probability", "prediction")
    # each cell is there; an inner join would ask first whether the number is null, and work it out twice
    return placed.join(F.broadcast(walked), "_cell", "left")


def attack_probability(probability: Column) -> Column:
    return vector_to_array(probability)[1]


def in_parts(df: DataFrame, rows: int, trees: int) -> DataFrame:
    """Training rows in parts small enough to be cached one by one.

    Spark keeps with each row how often each tree draws it, some 1.3 KB for 300 trees. A part is put into memory or, where
    that is full, on disk as a whole, so a few large parts leave no memory to work in. Rows that lie in enough parts stay there.
    """
    wanted = math.ceil(rows * trees / COUNTS_IN_PART)
    return df.repartition(wanted) if wanted > df.rdd.getNumPartitions() else df


def train_forest(df: DataFrame, features: Sequence[str], config: ForestConfig = ForestConfig()) -> FlowModel:
    """Fit scaling and a class-weighted random forest on numeric feature columns.

    ``df`` is read several times (class counts, column statistics, bins, the forest's own
    cached copy); write or persist it first when it comes from raw files.
    """
    classes = class_weights(df, config.label).collect()
    weights = {r[config.label]: r.class_weight for r in classes}
    n_rows = sum(r.n_class for r in classes)
    weight = F.lit(float(weights.get(0, 1.0)))
    weight = F.when(F.col(config.label) == 1, float(weights.get(1, 1.0))).otherwise(weight)
    needed = df.select(*[clean.quoted(c) for c in features], clean.quoted(config.label), weight.alias("_weight"))
    scaling = _scaling_stage(features, _collected(scaler_stats(df, features)))
    scaled_names = [_scaled_name(i) for i in range(len(features))]
    assembler = VectorAssembler(inputCols=scaled_names, outputCol="features")
    learner = RandomForestClassifier(
        numTrees=config.trees,
        maxDepth=config.depth,
        minInstancesPerNode=config.min_leaf,
        seed=config.seed,
        labelCol=config.label,
        weightCol="_weight",
    )
    if n_rows * config.trees > COUNTS_BY_ROW and set(weights) <= {0, 1}:
        grown = forest.fitted_forest(scaling.transform(needed), scaled_names, learner, weights)
        fitted = PipelineModel([scaling, assembler, grown])
    else:
        fitted = Pipeline(stages=[scaling, assembler, learner]).fit(in_parts(needed, n_rows, config.trees))
    return FlowModel(fitted, list(features))


def evaluate(scored: DataFrame, label: str, threshold: float = 0.5) -> DataFrame:
    """Accuracy, the class report and the matrix as one table."""
    matrix = metrics.confusion_matrix(scored, threshold, y=label)
    report = metrics.classification_report(matrix)
    return report.join(F.broadcast(metrics.accuracy(matrix).join(matrix, F.lit(True))), F.lit(True))


def contract_check(model: FlowModel, df: DataFrame) -> DataFrame:
    """What a table lacks or has too much of, against the model's features, and a zero row's score."""
    spark = df.sparkSession
    zero = spark.range(1).select(*[F.lit(0.0).alias(c) for c in model.features])
    have, want = F.array(*[F.lit(c) for c in df.columns]), F.array(*[F.lit(c) for c in model.features])
    return model.score(zero).select(
        F.size(want).alias("n_features"),
        F.array_join(F.array_except(want, have), ",").alias("missing"),
        F.array_join(F.array_except(have, want), ",").alias("unused"),
        F.col("score").between(0, 1).alias("zero_row_scored"),
        F.col("score").alias("zero_row_score"),
    )
