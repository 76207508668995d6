"""Small helpers on DataFrames: tables kept in the shared folder, running totals, row numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowloom.session import scratch_dir


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once below ``spark.checkpoint.dir`` and read again: later steps, and tasks that
    run again after an executor is lost, read the files instead of working it out anew."""
    path = scratch_dir(df.sparkSession, f"llm-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept_in_small_batches(df: DataFrame, name: str, rows: int = 256) -> DataFrame:
    """:func:`kept` with Arrow batches of at most ``rows`` rows, for Python steps whose rows hold whole texts or sets."""
    conf, setting = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(setting)
    conf.set(setting, str(rows))
    try:
        return kept(df, name)
    finally:
        conf.set(setting, before)


def hinted(stored: DataFrame, most_rows: int = 100_000) -> DataFrame:
    """A stored table, marked for broadcasting if it is counted to be small; else Spark joins it as it sees fit."""
    return F.broadcast(stored) if stored.count() <= most_rows else stored


def parts_for(rows: int, each: int) -> int:
    """Into how many parts ``rows`` go if each holds about ``each``."""
    return max(1, -(-rows // each))


def spread(*columns: str | Column, parts: int, seed: str = "") -> Column:
    """An even number from 0 to ``parts - 1`` that follows from the columns alone."""
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(parts)).cast("int")


def running_total(df: DataFrame, keys: Sequence[str], part: str, order: Sequence[str | Column], value: Column, into: str) -> DataFrame:
    """Adds ``into``: the sum of ``value`` over all rows of the same ``keys`` before this one.

    Rows are ordered by ``part``, then ``order``. Only the sums of the parts meet per key; rows are
    sorted per (key, part), so a key with a third of all rows is spread over its parts. Keys may be null.
    """
    step, base = f"__step_{into}", f"__base_{into}"
    df = df.withColumn(step, value)
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*keys, part).agg(F.sum(step).alias(base))
    sums = sums.select(*(F.col(k).alias(f"__rt_{k}") for k in keys), F.col(part).alias("__rt_part"), F.coalesce(F.sum(base).over(before), F.lit(0)).alias(base))
    on = F.col(part) == F.col("__rt_part")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__rt_{k}"))
    inside = Window.partitionBy(*keys, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = df.join(sums, on).withColumn(into, F.col(base) + F.coalesce(F.sum(step).over(inside), F.lit(0)))
    return joined.drop(step, base, "__rt_part", *(f"__rt_{k}" for k in keys))
