"""From raw documents to packed training sequences, in five stages.

Every stage takes what its predecessor kept, written as Parquet and read again. All but the last
return the columns of ``documents``; the last returns one row for each piece of a packed sequence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowloom.llm import line_dedup, mixing, near_dedup, packing, quality, tables


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail fixed limits or are outliers of their language and source go."""
    return quality.filtered(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat or nearly repeat an earlier one go; documents of which nothing is left go too."""
    return line_dedup.deduplicated(docs, words=line_dedup.EVERY)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every class of near-duplicates (five words, 80 %) the document with the smallest id stays."""
    return near_dedup.deduplicated(docs, words_each=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: documents are left out, cut once per source, or repeated once."""
    return mixing.applied(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens in sequences of at most 1024."""
    return packing.packed(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Robust estimates, edit joins and tokenisation are beyond SQL; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = tables.kept(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
