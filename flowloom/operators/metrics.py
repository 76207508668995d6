"""Evaluation of scored rows: confusion matrix, report, threshold sweep.

Everything comes from one map-side-combined pass over (label, score).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.constants import SWEEP_THRESHOLDS
from flowloom.functions.numeric import safe_ratio


def _counts(y: Column, hit: Column) -> dict[str, Column]:
    return {
        "tn": F.count_if((y == 0) & ~hit),
        "fp": F.count_if((y == 0) & hit),
        "fn": F.count_if((y == 1) & ~hit),
        "tp": F.count_if((y == 1) & hit),
    }


def confusion_matrix(scored: DataFrame, threshold: float = 0.5, y: str = "y", score: str = "score") -> DataFrame:
    counts = _counts(F.col(y), F.col(score) >= threshold)
    return scored.agg(*[c.alias(n) for n, c in counts.items()])


def accuracy(matrix: DataFrame) -> DataFrame:
    right = F.col("tn") + F.col("tp")
    return matrix.select(safe_ratio(right, right + F.col("fn") + F.col("fp")).alias("accuracy"))


def _class_line(name: str, hit: Column, claimed: Column, support: Column) -> Column:
    return F.struct(
        F.lit(name).alias("class"),
        safe_ratio(hit, claimed).alias("precision"),
        safe_ratio(hit, support).alias("recall"),
        safe_ratio(hit * 2, claimed + support).alias("f1"),
        support.alias("support"),
    )


def classification_report(matrix: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, their mean and their weighted mean."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    benign = _class_line("BENIGN", tn, tn + fn, tn + fp)
    attack = _class_line("ATTACK", tp, tp + fp, fn + tp)
    lines = matrix.select(benign.alias("b"), attack.alias("a"))
    total = F.col("b.support") + F.col("a.support")

    def mean(name: str, weigh) -> Column:
        return F.struct(
            F.lit(name).alias("class"),
            *[weigh(F.col(f"b.{m}"), F.col(f"a.{m}")).alias(m) for m in ("precision", "recall", "f1")],
            total.alias("support"),
        )

    macro = mean("macro avg", lambda b, a: (b + a) / 2)
    weighted = mean(
        "weighted avg", lambda b, a: safe_ratio(b * F.col("b.support") + a * F.col("a.support"), total)
    )
    return lines.select(F.inline(F.array(F.col("b"), F.col("a"), macro, weighted)))


def detection_false_alarm(matrix: DataFrame) -> DataFrame:
    return matrix.select(
        (safe_ratio(F.col("tp"), F.col("tp") + F.col("fn")) * 100).alias("detection_pct"),
        (safe_ratio(F.col("fp"), F.col("fp") + F.col("tn")) * 100).alias("false_alarm_pct"),
    )


def threshold_sweep(
    scored: DataFrame, thresholds: Sequence[float] = SWEEP_THRESHOLDS, y: str = "y", score: str = "score"
) -> DataFrame:
    """One row per threshold, from a single pass that counts all thresholds at once."""
    counts = [
        F.struct(F.lit(i).alias("pos"), F.lit(float(t)).alias("threshold"), *[c.alias(n) for n, c in _counts(F.col(y), F.col(score) >= t).items()])
        for i, t in enumerate(thresholds)
    ]
    rows = scored.agg(F.array(*counts).alias("rows")).select(F.inline("rows"))
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    rows = rows.withColumns(
        {
            "detection": safe_ratio(tp, fn + tp) * 100,
            "false_alarm": safe_ratio(fp, tn + fp) * 100,
            "precision": safe_ratio(tp, tp + fp) * 100,
        }
    )
    both = F.col("precision") + F.col("detection")
    return rows.withColumn("f1", safe_ratio(F.col("precision") * F.col("detection") * 2, both))


def running_best(sweep: DataFrame) -> DataFrame:
    """Mark each row whose F1 beats all rows before it; the bar starts at 0. A handful of rows."""
    before = Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    bar = F.greatest(F.coalesce(F.max("f1").over(before), F.lit(0.0)), F.lit(0.0))
    return sweep.withColumn("is_best_so_far", F.col("f1") > bar)


def best_threshold(sweep: DataFrame, default: float = 0.5) -> DataFrame:
    """The first threshold with the highest F1; the default when no F1 is above 0."""
    best = F.max_by("threshold", F.struct("f1", -F.col("pos")))
    top = F.max("f1")
    return sweep.agg(
        F.when(top > 0, best).otherwise(F.lit(default)).alias("best_threshold"),
        F.greatest(top, F.lit(0.0)).alias("best_f1"),
    )


def label_counts(df: DataFrame, by: Sequence[str] = (), label: str = "Label_Binary") -> DataFrame:
    return df.groupBy(*by).agg(
        F.count_if(F.col(label) == 0).alias("benign"), F.count_if(F.col(label) == 1).alias("attack")
    )
