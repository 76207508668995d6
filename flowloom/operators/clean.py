"""Cleaning of labelled flow tables: names, identifiers, bad numbers, labels, alignment."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.constants import CIC_2017_TO_2018, IDENTIFIER_COLUMNS
from flowloom.functions import numeric

LABEL = "Label"
LABEL_BINARY = "Label_Binary"


def quoted(name: str) -> Column:
    return F.col(f"`{name.replace('`', '``')}`")


def strip_column_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def renamed_first(columns: Sequence[str], names: Mapping[str, str]) -> list[tuple[int, str]]:
    """(position, new name) of the columns to keep: each new name once, the first wins."""
    kept: dict[str, int] = {}
    for position, column in enumerate(columns):
        kept.setdefault(names.get(column, column), position)
    return [(position, name) for name, position in kept.items()]


def normalize_columns(df: DataFrame, names: Mapping[str, str] = CIC_2017_TO_2018) -> DataFrame:
    """Trim the names, rename 2017 to 2018 names, keep the first of columns named alike."""
    numbered = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    kept = renamed_first([c.strip() for c in df.columns], names)
    return numbered.select(*[F.col(f"c{position}").alias(name) for position, name in kept])


def drop_identifiers(df: DataFrame, columns: Iterable[str] = IDENTIFIER_COLUMNS) -> DataFrame:
    return df.drop(*columns)


def feature_list(df: DataFrame, labels: Iterable[str] = (LABEL, LABEL_BINARY)) -> list[str]:
    """Ordered names of the feature columns."""
    skip = set(labels)
    return [c for c in df.columns if c not in skip]


_INFINITE_TEXT = ("inf", "+inf", "-inf", "infinity", "+infinity", "-infinity")
# Words that count as missing, in lower case.
_MISSING_TEXT = ("", "#n/a", "#n/a n/a", "#na", "-1.#ind", "-1.#qnan", "-nan", "1.#ind", "1.#qnan", "<na>", "n/a", "na", "nan", "none", "null")


def _number_column(text: Column) -> Column:
    """Infinite becomes null; text that is no number stays text, as it would in a text column."""
    low = F.lower(F.trim(text))
    return F.when(low.isin(*_INFINITE_TEXT, *_MISSING_TEXT), None).otherwise(text)


def inf_to_null(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Infinite cells to null, in text columns as read from CSV or in numeric columns."""
    kinds = dict(df.dtypes)
    return df.withColumns(
        {c: _number_column(quoted(c)) if kinds[c] == "string" else numeric.inf_to_null(quoted(c)) for c in columns}
    )


def drop_incomplete_rows(df: DataFrame) -> DataFrame:
    return df.na.drop("any")


def clean_rows(df: DataFrame) -> DataFrame:
    """Normalised names, no identifiers, no row with a missing or infinite cell."""
    cleaned = drop_identifiers(normalize_columns(df))
    if LABEL in cleaned.columns:
        cleaned = cleaned.withColumn(LABEL, F.when(~F.lower(F.trim(quoted(LABEL))).isin(*_MISSING_TEXT), quoted(LABEL)))
    return drop_incomplete_rows(inf_to_null(cleaned, feature_list(cleaned)))


def with_binary_label(df: DataFrame, label: str = LABEL) -> DataFrame:
    return df.withColumn(LABEL_BINARY, numeric.binary_label(quoted(label)))


def drop_header_rows(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Header lines repeated inside a file carry the label text 'Label'."""
    return df.where(F.coalesce(quoted(label) != label, F.lit(True)))


def numeric_matrix(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Feature cells as finite doubles: unparsable -> missing, infinite -> 0, clip, missing -> 0."""
    return df.withColumns(
        {c: numeric.fill_zero(numeric.clip(numeric.inf_to_zero(numeric.to_number(quoted(c))))) for c in columns}
    )


def align_features(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The trained columns in trained order: missing ones are 0.0, others are dropped."""
    have = set(df.columns)
    aligned = [(quoted(c).cast("double") if c in have else F.lit(0.0)).alias(c) for c in features]
    return df.select(*[quoted(k) for k in keep], *aligned)
