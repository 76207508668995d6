"""Exact-size samples and splits in hash order, without sorting a group in one task.

"The n smallest by hash" is found in two steps. A histogram of the ordering value (map-side
combined, a bounded number of buckets per group) tells the bucket the n-th row falls into;
rows of lower buckets are kept as they are and only the rows of that one bucket are ranked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.constants import BENIGN_PER_ATTACK, SAMPLE_PER_FILE, SEED, TEST_SHARE
from flowloom.functions.numeric import hash_order

HASH_RANGE = 2**32


def keep_smallest(
    df: DataFrame, groups: Sequence[str], order: str, tie: Sequence[str], bucket: Column, wanted: DataFrame
) -> DataFrame:
    """Rows whose rank by (order, tie) within their group is at most the group's ``n_wanted``.

    bucket: a rising function of ``order`` with few values. wanted: groups + n_wanted; groups
    it does not name are dropped.
    """
    return with_smallest_flag(df, groups, order, tie, bucket, wanted).where("is_smallest").drop("is_smallest")


def with_smallest_flag(
    df: DataFrame, groups: Sequence[str], order: str, tie: Sequence[str], bucket: Column, wanted: DataFrame
) -> DataFrame:
    bucketed = df.withColumn("_bucket", bucket.cast("bigint"))
    groups = list(groups)
    # Rows of the histogram are buckets, not data: the running sum below is small.
    running = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    histogram = (
        bucketed.groupBy(*groups, "_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(running), F.lit(0)))
    )
    # One row per group: the bucket of the last wanted row and how many of it are wanted.
    cuts = (
        _with_group(histogram, wanted, groups)
        .where(F.col("_before") < F.col("n_wanted"))
        .groupBy(*groups)
        .agg(
            F.max("_bucket").alias("_last"),
            F.max_by(F.col("n_wanted") - F.col("_before"), "_bucket").alias("_left"),
        )
    )
    marked = _with_group(bucketed, cuts, groups, "left")
    last = F.coalesce(F.col("_last"), F.lit(-(2**63)))
    in_last = F.col("_bucket") == last
    whole = marked.where(~in_last).withColumn("is_smallest", F.col("_bucket") < last)
    place = Window.partitionBy(*groups, "_bucket").orderBy(order, *tie)
    ranked = marked.where(in_last).withColumn("is_smallest", F.row_number().over(place) <= F.col("_left"))
    return whole.unionByName(ranked).drop("_bucket", "_last", "_left")


def _with_group(df: DataFrame, per_group: DataFrame, groups: list[str], how: str = "inner") -> DataFrame:
    """Join values that exist once per group; without groups there is a single row of them.

    They are broadcast: a join that deals rows by group would sort the rows of a large one in a single task.
    """
    return df.join(F.broadcast(per_group), groups if groups else F.lit(True), how)


def class_frequency(df: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows of each class, rows in all, and the share. One row per class, pre-aggregated."""
    counts = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n_class"))
    total = F.sum("n_class").over(Window.partitionBy(*by))  # over classes, not rows
    return counts.withColumn("n_all", total).withColumn("share", F.col("n_class") / F.col("n_all"))


def sample_cap(
    df: DataFrame,
    ids: Sequence[str],
    label: str = "Label",
    by: str = "source_file",
    cap: int = SAMPLE_PER_FILE,
    seed: int = SEED,
    weighted: bool = True,
) -> DataFrame:
    """At most ``cap`` rows per file, drawn without replacement with weight 1 / class share.

    Weighted order: rows are ranked by -ln(u) / weight with u from a hash of the row id, so
    the same rows come out on every run. ``weighted=False`` is the plain fallback.
    """
    shares = class_frequency(df, label, [by])
    u = (hash_order(*[F.col(c) for c in ids], seed=seed) + F.lit(0.5)) / F.lit(float(HASH_RANGE))
    score = -F.log(u) * (F.col("share") if weighted else F.lit(1.0))
    scored = _with_group(df, shares.select(by, label, "share", "n_all"), [by, label]).withColumn("_score", score)
    limits = shares.groupBy(by).agg(F.max("n_all").alias("n_all")).select(by, F.least("n_all", F.lit(cap)).alias("n_wanted"))
    # Buckets 1/64 wide on a log scale: the bucket that is ranked holds about cap / 64 rows.
    kept = keep_smallest(scored, [by], "_score", ids, F.floor(F.log("_score") * 64), limits)
    return kept.drop("_score", "share", "n_all")


def _hash_bucket(order: str, bits: int = 20) -> Column:
    return F.shiftrightunsigned(F.col(order), 32 - bits)


def _ordered(df: DataFrame, ids: Sequence[str], seed: int, order: str | None) -> tuple[DataFrame, str, list[str]]:
    """Rows, the column of their hash order, and what to drop of it: a column that ``order`` names is taken as it is and kept."""
    if order:
        return df, order, []
    return df.withColumn("_order", hash_order(*[F.col(c) for c in ids], seed=seed)), "_order", ["_order"]


def undersample_benign(
    df: DataFrame, ids: Sequence[str], label: str = "Label_Binary", ratio: int = BENIGN_PER_ATTACK, seed: int = SEED, order: str | None = None
) -> DataFrame:
    """All attack rows and at most ``ratio`` times as many benign rows."""
    ordered, by, own = _ordered(df, ids, seed, order)
    wanted = df.agg((F.count_if(F.col(label) == 1) * ratio).alias("n_wanted"))
    benign = keep_smallest(ordered.where(F.col(label) == 0), [], by, ids, _hash_bucket(by), wanted)
    return union_classes(benign, ordered.where(F.col(label) == 1)).drop(*own)


def union_classes(benign: DataFrame, attack: DataFrame) -> DataFrame:
    return benign.unionByName(attack)


def split_stratified(
    df: DataFrame, ids: Sequence[str], label: str = "Label_Binary", test_share: float = TEST_SHARE, seed: int = SEED, order: str | None = None
) -> DataFrame:
    """Add ``is_test``: in each class the ceil(share * n) rows first in hash order."""
    ordered, by, own = _ordered(df, ids, seed, order)
    sizes = df.groupBy(label).agg(F.ceil(F.count(F.lit(1)) * F.lit(test_share)).alias("n_wanted"))
    flagged = with_smallest_flag(ordered, [label], by, ids, _hash_bucket(by), sizes)
    return flagged.withColumnRenamed("is_smallest", "is_test").drop(*own)


def shuffle_rows(df: DataFrame, ids: Sequence[str], seed: int = SEED) -> DataFrame:
    """Rows in hash order (a range-partitioned sort)."""
    return df.orderBy(hash_order(*[F.col(c) for c in ids], seed=seed), *ids)


def newest(df: DataFrame, ts: str, tie: str, size: int) -> DataFrame:
    """The ``size`` newest entries of a name cache, found per partition and merged."""
    return df.orderBy(F.col(ts).desc(), F.col(tie).desc()).limit(size)
