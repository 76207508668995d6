"""Folders of labelled flow CSV files.

Files of one folder may have different headers (2017 and 2018 names, repeated columns).
They are grouped by header line and each group is one distributed scan, so the number of
scans is the number of header forms, not of files. All cells are read as text.

A file that cannot be read, or a row with more or fewer cells than the header, is an error. With
``skip_unreadable`` files whose header cannot be read are left out, and :func:`unreadable_csv` lists them.
"""

from __future__ import annotations

import csv
from collections import defaultdict
from collections.abc import Collection
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.constants import CIC_2017_TO_2018, PREFERRED_CSV
from flowloom.operators.clean import renamed_first

Headers = dict[str, tuple[str, ...] | str]


def list_csv(spark: SparkSession, folder: str) -> list[str]:
    """Paths of the CSV files of a folder in name order; file contents are not read."""
    listing = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder).select("path")
    return sorted((r.path for r in listing.collect()), key=lambda p: p.rsplit("/", 1)[-1])


def file_name(path: str) -> str:
    return path.rsplit("/", 1)[-1]


def _headers(spark: SparkSession, paths: list[str]) -> Headers:
    """Header cells of each file, or why it has none: its first line that is not blank, read from the file system."""
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()

    def first_line(path: str) -> tuple[str, ...] | str:
        try:
            where = jvm.org.apache.hadoop.fs.Path(path)
            stream = where.getFileSystem(conf).open(where)
        except Py4JJavaError as error:
            return str(error.java_exception)
        try:
            reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8"))
            line = reader.readLine()
            while line is not None and not line.strip("\ufeff \t\r"):
                line = reader.readLine()
        except Py4JJavaError as error:
            return str(error.java_exception)
        finally:
            stream.close()
        return "no header" if line is None else tuple(next(csv.reader([line.lstrip("\ufeff")])))

    with ThreadPoolExecutor(8) as pool:  # a listing of headers, as a listing of files is
        return dict(zip(paths, pool.map(first_line, paths)))


def unreadable_csv(spark: SparkSession, folder: str) -> DataFrame:
    """``source_file`` and ``reason`` of the CSV files that ``skip_unreadable`` leaves out."""
    rows = [(file_name(p), h) for p, h in _headers(spark, list_csv(spark, folder)).items() if isinstance(h, str)]
    return spark.createDataFrame(rows, "source_file string, reason string")


def read_csv_files(spark: SparkSession, paths: list[str], names: dict[str, str] | None = None, trim: bool = True, skip_unreadable: bool = False) -> DataFrame:
    """Rows of the files stacked by column name, with ``source_file``; absent columns are null.

    names: renaming of header names; columns that end up named alike keep the first.
    trim: strip blanks around header names.
    """
    groups: dict[tuple[str, ...], list[str]] = defaultdict(list)
    for path, header in _headers(spark, paths).items():
        if not isinstance(header, str):
            groups[header].append(path)
        elif not skip_unreadable:
            raise ValueError(f"{path}: {header}")
    if not groups:
        raise FileNotFoundError("no readable CSV file")

    def scan(header: tuple[str, ...], files: list[str]) -> DataFrame:
        schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(header))])
        raw = spark.read.schema(schema).options(header=True, mode="FAILFAST").csv(files)
        kept = renamed_first([h.strip() if trim else h for h in header], names or {})
        return raw.select(*[F.col(f"c{i}").alias(n) for i, n in kept], F.col("_metadata.file_name").alias("source_file"))

    return reduce(union_outer_columns, (scan(h, f) for h, f in groups.items()))


def union_outer_columns(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b, allowMissingColumns=True)


def scan_flow_csv_dir(spark: SparkSession, folder: str, skip_unreadable: bool = False) -> DataFrame:
    """Every CSV of a folder under 2018 names."""
    return read_csv_files(spark, list_csv(spark, folder), CIC_2017_TO_2018, skip_unreadable=skip_unreadable)


def scan_preferred_csv(spark: SparkSession, folder: str, preferred: str = PREFERRED_CSV) -> DataFrame:
    """The preferred file, else the first by name, else an error."""
    paths = list_csv(spark, folder)
    if not paths:
        raise FileNotFoundError(f"no CSV file in {folder}")
    chosen = next((p for p in paths if file_name(p) == preferred), paths[0])
    return read_csv_files(spark, [chosen], CIC_2017_TO_2018)


def scan_csv_exclude(spark: SparkSession, folder: str, outputs: Collection[str] = ("final_dataset.csv",)) -> DataFrame:
    """All CSVs of a folder but those named exactly as the outputs, under their own names."""
    return read_csv_files(spark, [p for p in list_csv(spark, folder) if file_name(p) not in outputs], trim=False)


def write_flow_csv(df: DataFrame, folder: str, single_file: bool = False) -> None:
    """Rows to CSV with header. One file only on request: it passes all rows through one task."""
    (df.coalesce(1) if single_file else df).write.mode("overwrite").option("header", True).csv(folder)
