"""Expressions for cleaning numbers and for hash order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowloom.constants import CLIP_LIMIT, SEED

_INF = float("inf")


def is_infinite(x: Column) -> Column:
    return x.isin(_INF, -_INF)


def inf_to_null(x: Column) -> Column:
    """Infinite and not-a-number values become null; Spark keeps NaN apart from null."""
    return F.when(is_infinite(x) | F.isnan(x), None).otherwise(x)


def inf_to_zero(x: Column) -> Column:
    return F.when(is_infinite(x), 0.0).otherwise(x)


def clip(x: Column, limit: float = CLIP_LIMIT) -> Column:
    """Clip to +-limit. ``least`` and ``greatest`` skip nulls, so nulls are kept apart."""
    return F.when(x.isNotNull() & ~F.isnan(x), F.greatest(F.least(x, F.lit(limit)), F.lit(-limit))).otherwise(x)


def to_number(x: Column) -> Column:
    """Text to double; text that does not parse becomes null."""
    return x.try_cast("double")


def fill_zero(x: Column) -> Column:
    return F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0))


def safe_ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def hash_order(*parts: Column, seed: int = SEED) -> Column:
    """A repeatable pseudo-random integer in [0, 2^32) from an id and a seed."""
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(F.concat(text, F.lit(f"#{seed}"))), 1, 8), 16, 10).cast("bigint")


def binary_label(label: Column) -> Column:
    return F.when(F.upper(label) == "BENIGN", 0).otherwise(1)


def verdict(prob: Column, threshold: float = 0.40) -> Column:
    return F.when(prob > threshold, "ATTACK").otherwise("BENIGN")


def verdict_three(prob: Column) -> Column:
    return F.when(prob > 0.90, "ATTACK").when(prob > 0.60, "SUSPICIOUS").otherwise("BENIGN")


def probability_band(prob: Column) -> Column:
    return (
        F.when(prob < 0.10, "very likely benign")
        .when(prob < 0.40, "probably benign")
        .when(prob < 0.70, "suspicious")
        .when(prob < 0.90, "likely attack")
        .otherwise("high-confidence attack")
    )
