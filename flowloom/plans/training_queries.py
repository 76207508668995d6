"""Queries over labelled flow tables: CSV folders, cleaning, sampling, scaling, metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.constants import SWEEP_THRESHOLDS
from flowloom.functions import numeric
from flowloom.operators import clean, metrics, sampling, training
from flowloom.plans.catalog import query
from flowloom.plans.derived import derive, with_views
from flowloom.plans.flow_queries import rounded
from flowloom.session import scratch_dir
from flowloom.sources import flow_csv

IDS = ["l_orderkey", "l_linenumber"]
FEATURES = ["tot_fwd_pkts", "flow_byts_s", "syn_flag_cnt", "bulk_zero"]


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, "dirty_flows")


def on_dirty(body: str) -> str:
    return with_views("dirty_flows", body)


# ---------------------------------------------------------------- CSV folders

# The same rows under 2017 and 2018 names. Header lines of the 2017 files carry blanks and a repeated name.
_FORMS = {
    "Friday-2017.csv": (
        ("Order", "l_orderkey"), ("Line", "l_linenumber"), (" Total Fwd Packets", "tot_fwd_pkts"),
        (" Fwd Header Length", "syn_flag_cnt"), ("Fwd Header Length", "bulk_zero"), ("Flow Bytes/s", "flow_byts_s"), (" Label", "Label"),
    ),
    "Thursday-2018.csv": (
        ("Order", "l_orderkey"), ("Line", "l_linenumber"), ("Tot Fwd Pkts", "tot_fwd_pkts"), ("Flow Byts/s", "flow_byts_s"), ("Label", "Label"),
    ),
    "final_dataset.csv": (("Order", "l_orderkey"), ("Label", "Label")),
}
_SHARE = "CASE WHEN l_orderkey % 3 = 0 THEN 'Friday-2017.csv' WHEN l_orderkey % 3 = 1 THEN 'Thursday-2018.csv' ELSE 'final_dataset.csv' END"


def csv_folder(spark: SparkSession, sf_dir: str) -> str:
    """Write the rows of ``dirty_flows`` as a folder of CSV parts, each with its own header.

    Spark writes folders of part files; parts of one form are named after the form.
    """
    base = scratch_dir(spark, "flow-csv")
    rows = dirty(spark, sf_dir).withColumn("part", F.expr(_SHARE))
    for form, columns in _FORMS.items():
        cells = [F.col(c).alias(name) for name, c in columns]
        part = rows.where(F.col("part") == form).repartition(8, *IDS).select(*cells)
        part.write.options(header=True, ignoreLeadingWhiteSpace=False).csv(f"{base}/parts/form={form}")
    return _named_files(spark, base)


def _named_files(spark: SparkSession, base: str) -> str:
    """Give the part files their CSV names (renames in the file system, no data is read)."""
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    target = jvm.org.apache.hadoop.fs.Path(f"{base}/csv")
    fs = target.getFileSystem(conf)
    fs.mkdirs(target)
    for form in _FORMS:
        parts = [s.getPath() for s in fs.listStatus(jvm.org.apache.hadoop.fs.Path(f"{base}/parts/form={form}"))]
        parts = sorted((p for p in parts if p.getName().startswith("part-")), key=lambda p: p.getName())
        for i, part in enumerate(parts):
            fs.rename(part, jvm.org.apache.hadoop.fs.Path(target, f"{i}-{form}"))
    return f"{base}/csv"


_CSV_2017 = """SELECT CAST(l_orderkey AS VARCHAR) AS "Order", CAST(l_linenumber AS VARCHAR) AS "Line", tot_fwd_pkts AS "Tot Fwd Pkts",
 syn_flag_cnt AS "Fwd Header Len", flow_byts_s AS "Flow Byts/s", Label AS "Label" FROM dirty_flows WHERE l_orderkey % 3 = 0"""
_CSV_2018 = """SELECT CAST(l_orderkey AS VARCHAR) AS "Order", CAST(l_linenumber AS VARCHAR) AS "Line", tot_fwd_pkts AS "Tot Fwd Pkts",
 NULL AS "Fwd Header Len", flow_byts_s AS "Flow Byts/s", Label AS "Label" FROM dirty_flows WHERE l_orderkey % 3 = 1"""
_CSV_FINAL = """SELECT CAST(l_orderkey AS VARCHAR) AS "Order", NULL AS "Line", NULL AS "Tot Fwd Pkts",
 NULL AS "Fwd Header Len", NULL AS "Flow Byts/s", Label AS "Label" FROM dirty_flows WHERE l_orderkey % 3 = 2"""
_CSV_COLUMNS = ["Order", "Line", "Tot Fwd Pkts", "Fwd Header Len", "Flow Byts/s", "Label"]


@query("scan_flow_csv_dir", on_dirty(f"{_CSV_2017} UNION ALL {_CSV_2018} UNION ALL {_CSV_FINAL}"))
def scan_flow_csv_dir(spark, sf_dir):
    return flow_csv.scan_flow_csv_dir(spark, csv_folder(spark, sf_dir)).select(*[clean.quoted(c) for c in _CSV_COLUMNS])


@query("scan_preferred_csv", on_dirty('SELECT CAST(l_orderkey AS VARCHAR) AS "Order", Label AS "Label" FROM dirty_flows WHERE l_orderkey % 3 = 2'))
def scan_preferred_csv(spark, sf_dir):
    """Ask for each part of the third form by name; together they are the whole form."""
    folder = csv_folder(spark, sf_dir)
    names = [flow_csv.file_name(p) for p in flow_csv.list_csv(spark, folder) if p.endswith("final_dataset.csv")]
    parts = [flow_csv.scan_preferred_csv(spark, folder, preferred=n) for n in names]
    return reduce(DataFrame.unionByName, parts).select("Order", "Label")


@query(
    "scan_csv_exclude",
    on_dirty(
        'SELECT l_orderkey::VARCHAR AS "Order", l_linenumber::VARCHAR AS "Line", Label AS "Label" FROM dirty_flows WHERE l_orderkey % 3 <> 2'
    ),
)
def scan_csv_exclude(spark, sf_dir):
    folder = csv_folder(spark, sf_dir)
    outputs = {flow_csv.file_name(p) for p in flow_csv.list_csv(spark, folder) if p.endswith("-final_dataset.csv")}  # its parts
    rows = flow_csv.scan_csv_exclude(spark, folder, outputs)
    return rows.select("Order", "Line", F.coalesce(clean.quoted("Label"), clean.quoted(" Label")).alias("Label"))


@query("union_outer_columns", on_dirty(f"{_CSV_2017} UNION ALL {_CSV_2018} UNION ALL {_CSV_FINAL}"))
def union_outer_columns(spark, sf_dir):
    rows = dirty(spark, sf_dir).withColumn("part", F.expr(_SHARE))
    shared = {"Order": F.col("l_orderkey").cast("string"), "Line": F.col("l_linenumber").cast("string"), "Tot Fwd Pkts": F.col("tot_fwd_pkts"), "Flow Byts/s": F.col("flow_byts_s")}
    cells = [c.alias(n) for n, c in shared.items()]
    old = rows.where(F.col("part") == "Friday-2017.csv").select(*cells, F.col("syn_flag_cnt").alias("Fwd Header Len"), "Label")
    new = rows.where(F.col("part") == "Thursday-2018.csv").select(*cells, "Label")
    final = rows.where(F.col("part") == "final_dataset.csv").select(cells[0], "Label")
    return flow_csv.union_outer_columns(flow_csv.union_outer_columns(old, new), final)


@query("write_flow_csv", on_dirty("SELECT l_orderkey, l_linenumber, tot_fwd_pkts, flow_byts_s, Label AS \"Label\" FROM dirty_flows"))
def write_flow_csv(spark, sf_dir):
    target = scratch_dir(spark, "written-csv")
    flow_csv.write_flow_csv(dirty(spark, sf_dir).drop("syn_flag_cnt", "bulk_zero"), target)
    schema = "l_orderkey bigint, l_linenumber int, tot_fwd_pkts string, flow_byts_s string, Label string"
    return spark.read.schema(schema).option("header", True).csv(target)


# ---------------------------------------------------------------- names and cells

_OLD_HEADER = {
    "l_orderkey": " Flow ID", "l_linenumber": " Timestamp", "tot_fwd_pkts": " Total Fwd Packets",
    "flow_byts_s": "Flow Bytes/s", "syn_flag_cnt": " SYN Flag Count", "bulk_zero": " Fwd Avg Bytes/Bulk",
}


def _with_old_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[_OLD_HEADER.get(c, c) for c in df.columns])


@query("strip_column_names", on_dirty('SELECT l_orderkey AS "Flow ID", l_linenumber AS "Timestamp", tot_fwd_pkts AS "Total Fwd Packets" FROM dirty_flows'))
def strip_column_names(spark, sf_dir):
    return clean.strip_column_names(_with_old_names(dirty(spark, sf_dir))).select("Flow ID", "Timestamp", "Total Fwd Packets")


_NORMAL = """SELECT l_orderkey AS "Flow ID", l_linenumber AS "Timestamp", tot_fwd_pkts AS "Tot Fwd Pkts", flow_byts_s AS "Flow Byts/s",
 syn_flag_cnt AS "SYN Flag Cnt", bulk_zero AS "Fwd Byts/b Avg", Label AS "Label" FROM dirty_flows"""


@query("rename_2017_to_2018", on_dirty(_NORMAL))
def rename_2017_to_2018(spark, sf_dir):
    return clean.normalize_columns(_with_old_names(dirty(spark, sf_dir)))


@query("dedupe_columns_keep_first", on_dirty('SELECT l_orderkey, tot_fwd_pkts AS "Fwd Header Len", bulk_zero AS "Flow Byts/s" FROM dirty_flows'))
def dedupe_columns_keep_first(spark, sf_dir):
    df = dirty(spark, sf_dir).select("l_orderkey", "tot_fwd_pkts", "syn_flag_cnt", "bulk_zero")
    return clean.normalize_columns(df.toDF("l_orderkey", " Fwd Header Length", "Fwd Header Length.1", "Flow Bytes/s"))


@query("drop_identifiers", on_dirty('SELECT tot_fwd_pkts AS "Tot Fwd Pkts", Label AS "Label" FROM dirty_flows'))
def drop_identifiers(spark, sf_dir):
    df = clean.normalize_columns(_with_old_names(dirty(spark, sf_dir)))
    return clean.drop_identifiers(df).select("Tot Fwd Pkts", "Label")


_INF = "CASE WHEN flow_byts_s IN ('Infinity', '-Infinity') THEN NULL ELSE flow_byts_s END"


@query("inf_to_null", on_dirty(f"SELECT l_orderkey, l_linenumber, {_INF} AS flow_byts_s FROM dirty_flows"))
def inf_to_null(spark, sf_dir):
    return clean.inf_to_null(dirty(spark, sf_dir), ["flow_byts_s"]).select(*IDS, "flow_byts_s")


_COMPLETE = f"(SELECT * FROM dirty_flows WHERE {_INF} IS NOT NULL)"


def complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = dirty(spark, sf_dir)
    return clean.drop_incomplete_rows(clean.inf_to_null(df, FEATURES))


@query("drop_incomplete_rows", on_dirty(f"SELECT l_orderkey, l_linenumber, flow_byts_s FROM {_COMPLETE} c"))
def drop_incomplete_rows(spark, sf_dir):
    return complete(spark, sf_dir).select(*IDS, "flow_byts_s")


_Y = "CASE WHEN upper(Label) = 'BENIGN' THEN 0 ELSE 1 END"


@query("label_binary", on_dirty(f'SELECT l_orderkey, l_linenumber, {_Y} AS "Label_Binary" FROM dirty_flows'))
def label_binary(spark, sf_dir):
    return clean.with_binary_label(dirty(spark, sf_dir)).select(*IDS, "Label_Binary")


_NUM = "TRY_CAST(flow_byts_s AS DOUBLE)"


def _finite(value: str) -> str:
    return f"CASE WHEN isinf({value}) THEN 0.0 ELSE {value} END"


@query(
    "to_numeric_coerce",
    on_dirty(f"SELECT l_orderkey, l_linenumber, {_finite(_NUM)} AS finite, coalesce(isinf({_NUM}), FALSE) AS is_inf FROM dirty_flows"),
)
def to_numeric_coerce(spark, sf_dir):
    x = numeric.to_number(F.col("flow_byts_s"))
    return dirty(spark, sf_dir).select(
        *IDS, numeric.inf_to_zero(x).alias("finite"), F.coalesce(numeric.is_infinite(x), F.lit(False)).alias("is_inf")
    )


@query("inf_to_zero", on_dirty(f"SELECT l_orderkey, l_linenumber, {_finite(_NUM)} AS x FROM dirty_flows"))
def inf_to_zero(spark, sf_dir):
    return dirty(spark, sf_dir).select(*IDS, numeric.inf_to_zero(numeric.to_number(F.col("flow_byts_s"))).alias("x"))


def _clipped(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN NULL ELSE greatest(least({value}, 1e10::DOUBLE), -1e10::DOUBLE) END"


@query("clip_range", on_dirty(f"SELECT l_orderkey, l_linenumber, {_clipped(_NUM)} AS x FROM dirty_flows"))
def clip_range(spark, sf_dir):
    return dirty(spark, sf_dir).select(*IDS, numeric.clip(numeric.to_number(F.col("flow_byts_s"))).alias("x"))


@query("fill_zero", on_dirty(f"SELECT l_orderkey, l_linenumber, coalesce({_finite(_NUM)}, 0.0) AS x FROM dirty_flows"))
def fill_zero(spark, sf_dir):
    x = numeric.inf_to_zero(numeric.to_number(F.col("flow_byts_s")))
    return dirty(spark, sf_dir).select(*IDS, numeric.fill_zero(x).alias("x"))


@query("feature_list", on_dirty("SELECT name, CAST(pos AS INTEGER) AS pos, count(*) AS n_rows FROM dirty_flows, (VALUES ('tot_fwd_pkts', 0), ('flow_byts_s', 1), ('syn_flag_cnt', 2), ('bulk_zero', 3)) v(name, pos) GROUP BY name, pos"))
def feature_list(spark, sf_dir):
    df = dirty(spark, sf_dir).drop(*IDS)
    names = F.array(*[F.lit(c) for c in clean.feature_list(df)])
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.posexplode(names).alias("pos", "name"), "n_rows")


@query(
    "align_features",
    on_dirty("SELECT l_orderkey, l_linenumber, CAST(syn_flag_cnt AS DOUBLE) AS syn_flag_cnt, CAST(0 AS DOUBLE) AS idle_max, CAST(tot_fwd_pkts AS DOUBLE) AS tot_fwd_pkts FROM dirty_flows"),
)
def align_features(spark, sf_dir):
    return clean.align_features(dirty(spark, sf_dir), ["syn_flag_cnt", "idle_max", "tot_fwd_pkts"], keep=IDS)


# ---------------------------------------------------------------- sampling and balance

CAP = 2000
_HASH = "CAST('0x' || substr(md5(l_orderkey::VARCHAR || ':' || l_linenumber::VARCHAR || '#42'), 1, 8) AS BIGINT)"
_FILES = "(SELECT *, l_returnflag_file AS source_file FROM (SELECT *, CASE WHEN l_orderkey % 50 = 0 THEN 'small.csv' WHEN l_orderkey % 3 = 0 THEN 'a.csv' ELSE 'b.csv' END AS l_returnflag_file FROM dirty_flows) t)"


def filed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``dirty_flows`` as if read from three files of different size."""
    name = F.when(F.col("l_orderkey") % 50 == 0, "small.csv").when(F.col("l_orderkey") % 3 == 0, "a.csv").otherwise("b.csv")
    return dirty(spark, sf_dir).withColumn("source_file", name)


@query("class_frequency", on_dirty(f'SELECT source_file, Label AS "Label", count(*) AS n_class, CAST(sum(count(*)) OVER (PARTITION BY source_file) AS BIGINT) AS n_all, round(count(*) / sum(count(*)) OVER (PARTITION BY source_file), 4) AS share FROM {_FILES} f GROUP BY source_file, Label'))
def class_frequency(spark, sf_dir):
    return rounded(sampling.class_frequency(filed(spark, sf_dir), "Label", ["source_file"]))


@query("label_counts", on_dirty(f"SELECT source_file, count(*) FILTER (WHERE {_Y} = 0) AS benign, count(*) FILTER (WHERE {_Y} = 1) AS attack FROM {_FILES} f GROUP BY source_file"))
def label_counts(spark, sf_dir):
    return metrics.label_counts(clean.with_binary_label(filed(spark, sf_dir)), ["source_file"])


@query(
    "sample_cap_stratified",
    on_dirty(
        f"""SELECT source_file, l_orderkey, l_linenumber FROM (
 SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY score, l_orderkey, l_linenumber) AS place FROM (
  SELECT *, -ln((h + 0.5) / 4294967296.0::DOUBLE) * (n_class / n_all) AS score FROM (
   SELECT *, {_HASH} AS h, count(*) OVER (PARTITION BY source_file, Label) AS n_class, count(*) OVER (PARTITION BY source_file) AS n_all FROM {_FILES} f) a) b) c
 WHERE place <= {CAP}"""
    ),
)
def sample_cap_stratified(spark, sf_dir):
    return sampling.sample_cap(filed(spark, sf_dir), IDS, cap=CAP).select("source_file", *IDS)


# Few attacks, so that balancing has something to do.
_RARE = f"(SELECT *, CASE WHEN {_Y} = 1 AND l_orderkey % 8 = 0 THEN 1 ELSE 0 END AS y FROM dirty_flows)"


def rare(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = (numeric.binary_label(F.col("Label")) == 1) & (F.col("l_orderkey") % 8 == 0)
    return dirty(spark, sf_dir).withColumn("y", F.when(hit, 1).otherwise(0))


@query(
    "undersample_benign",
    on_dirty(
        f"""SELECT l_orderkey, l_linenumber, y FROM (
 SELECT *, row_number() OVER (PARTITION BY y ORDER BY {_HASH}, l_orderkey, l_linenumber) AS place, sum(y) OVER () AS n_attack FROM {_RARE} r) t
 WHERE y = 1 OR place <= 10 * n_attack"""
    ),
)
def undersample_benign(spark, sf_dir):
    return sampling.undersample_benign(rare(spark, sf_dir), IDS, label="y").select(*IDS, "y")


@query("union_classes", on_dirty(f"SELECT l_orderkey, l_linenumber, y FROM {_RARE} r"))
def union_classes(spark, sf_dir):
    rows = rare(spark, sf_dir).select(*IDS, "y")
    return sampling.union_classes(rows.where("y = 0"), rows.where("y = 1"))


@query("shuffle_rows", on_dirty("SELECT l_orderkey, l_linenumber FROM dirty_flows"))
def shuffle_rows(spark, sf_dir):
    return sampling.shuffle_rows(dirty(spark, sf_dir), IDS).select(*IDS)


@query(
    "split_stratified",
    on_dirty(
        f"""SELECT l_orderkey, l_linenumber, y, place <= ceil(n * 0.2::DOUBLE) AS is_test FROM (
 SELECT *, row_number() OVER (PARTITION BY y ORDER BY {_HASH}, l_orderkey, l_linenumber) AS place, count(*) OVER (PARTITION BY y) AS n FROM {_RARE} r) t"""
    ),
)
def split_stratified(spark, sf_dir):
    return sampling.split_stratified(rare(spark, sf_dir), IDS, label="y").select(*IDS, "y", "is_test")


# ---------------------------------------------------------------- scaling and weights

_MATRIX = "(SELECT l_orderkey, l_linenumber, " + ", ".join(
    f"coalesce({_clipped(_finite(f'TRY_CAST({c} AS DOUBLE)'))}, 0.0) AS {c}" for c in FEATURES
) + f", {_Y} AS y FROM dirty_flows)"


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = dirty(spark, sf_dir).withColumn("y", numeric.binary_label(F.col("Label")))
    return clean.numeric_matrix(labelled, FEATURES).select(*IDS, *FEATURES, "y")


_STATS = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {i} AS pos, round(avg({c}), 2) AS mean, round(CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END, 2) AS std FROM {_MATRIX} m"
    for i, c in enumerate(FEATURES)
)


@query("scaler_stats", on_dirty(_STATS))
def scaler_stats(spark, sf_dir):
    stats = training.scaler_stats(matrix(spark, sf_dir), FEATURES)
    return stats.select("feature", "pos", F.round("mean", 2).alias("mean"), F.round("std", 2).alias("std"))


@query(
    "scale_apply",
    on_dirty(
        "SELECT l_orderkey, l_linenumber, "
        + ", ".join(
            f"round(({c} - (SELECT avg({c}) FROM m)) / (SELECT CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END FROM m), 4) AS {c}"
            for c in FEATURES
        )
        + " FROM m"
    ).replace("SELECT l_orderkey, l_linenumber, round", f", m AS {_MATRIX} SELECT l_orderkey, l_linenumber, round", 1),
)
def scale_apply(spark, sf_dir):
    rows = matrix(spark, sf_dir)
    return rounded(training.scale(rows, training.scaler_stats(rows, FEATURES), FEATURES).select(*IDS, *FEATURES))


@query("class_weights", on_dirty(f"SELECT y, count(*) AS n_class, round(sum(count(*)) OVER () / (2 * count(*)), 4) AS class_weight FROM {_MATRIX} m GROUP BY y"))
def class_weights(spark, sf_dir):
    return rounded(training.class_weights(matrix(spark, sf_dir), "y"))


# ---------------------------------------------------------------- metrics


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, "scored")


def on_scored(body: str) -> str:
    return with_views("scored", body)


def _matrix_sql(threshold: str = "0.5") -> str:
    hit = f"score >= {threshold}::DOUBLE"
    return (
        f"SELECT count(*) FILTER (WHERE y = 0 AND NOT {hit}) AS tn, count(*) FILTER (WHERE y = 0 AND {hit}) AS fp,"
        f" count(*) FILTER (WHERE y = 1 AND NOT {hit}) AS fn, count(*) FILTER (WHERE y = 1 AND {hit}) AS tp FROM scored"
    )


@query("confusion_matrix", on_scored(_matrix_sql()))
def confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(scored(spark, sf_dir))


@query("accuracy", on_scored("SELECT round(avg(CASE WHEN (score >= 0.5) = (y = 1) THEN 1.0::DOUBLE ELSE 0.0 END), 4) AS accuracy FROM scored"))
def accuracy(spark, sf_dir):
    return rounded(metrics.accuracy(metrics.confusion_matrix(scored(spark, sf_dir))))


_LINES = f"""WITH m AS ({_matrix_sql()}),
c AS (SELECT 'BENIGN' AS class, tn AS hit, tn + fn AS claimed, tn + fp AS support FROM m
 UNION ALL SELECT 'ATTACK', tp, tp + fp, fn + tp FROM m),
l AS (SELECT class, coalesce(hit / nullif(claimed, 0), 0) AS precision, coalesce(hit / nullif(support, 0), 0) AS recall,
 coalesce(2 * hit / nullif(claimed + support, 0), 0) AS f1, support FROM c)
SELECT class, round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1, 4) AS f1, support FROM l
UNION ALL SELECT 'macro avg', round(avg(precision), 4), round(avg(recall), 4), round(avg(f1), 4), CAST(sum(support) AS BIGINT) FROM l
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 4), round(sum(recall * support) / sum(support), 4),
 round(sum(f1 * support) / sum(support), 4), CAST(sum(support) AS BIGINT) FROM l"""


@query("classification_report", on_scored(_LINES))
def classification_report(spark, sf_dir):
    return rounded(metrics.classification_report(metrics.confusion_matrix(scored(spark, sf_dir))))


@query("detection_false_alarm", on_scored(f"SELECT round(tp / (tp + fn) * 100, 4) AS detection_pct, round(fp / (fp + tn) * 100, 4) AS false_alarm_pct FROM ({_matrix_sql()}) m"))
def detection_false_alarm(spark, sf_dir):
    return rounded(metrics.detection_false_alarm(metrics.confusion_matrix(scored(spark, sf_dir))))


@query("safe_ratio", on_scored("SELECT o_orderkey, round(coalesce(y / nullif(o_orderkey % 4, 0), 0), 4) AS ratio FROM scored"))
def safe_ratio(spark, sf_dir):
    return rounded(scored(spark, sf_dir).select("o_orderkey", numeric.safe_ratio(F.col("y"), F.col("o_orderkey") % 4).alias("ratio")))


_SWEEP = """WITH t AS (SELECT * FROM (VALUES """ + ", ".join(f"({i}, {t}::DOUBLE)" for i, t in enumerate(SWEEP_THRESHOLDS)) + """) v(pos, threshold)),
c AS (SELECT pos, threshold, count(*) FILTER (WHERE y = 0 AND score < threshold) AS tn, count(*) FILTER (WHERE y = 0 AND score >= threshold) AS fp,
 count(*) FILTER (WHERE y = 1 AND score < threshold) AS fn, count(*) FILTER (WHERE y = 1 AND score >= threshold) AS tp FROM scored, t GROUP BY pos, threshold),
p AS (SELECT *, coalesce(tp / nullif(fn + tp, 0), 0) * 100 AS detection, coalesce(fp / nullif(tn + fp, 0), 0) * 100 AS false_alarm,
 coalesce(tp / nullif(tp + fp, 0), 0) * 100 AS precision FROM c),
s AS (SELECT *, coalesce(2 * precision * detection / nullif(precision + detection, 0), 0) AS f1 FROM p)
"""  # fmt: skip


@query("threshold_sweep", on_scored(_SWEEP + "SELECT pos, threshold, tn, fp, fn, tp, round(detection, 4) AS detection, round(false_alarm, 4) AS false_alarm, round(precision, 4) AS precision, round(f1, 4) AS f1 FROM s"))
def threshold_sweep(spark, sf_dir):
    return rounded(metrics.threshold_sweep(scored(spark, sf_dir)))


@query("best_threshold", on_scored(_SWEEP + "SELECT threshold AS best_threshold, round(f1, 4) AS best_f1 FROM s ORDER BY f1 DESC, pos LIMIT 1"))
def best_threshold(spark, sf_dir):
    return rounded(metrics.best_threshold(metrics.threshold_sweep(scored(spark, sf_dir))))


@query("running_best", on_scored(_SWEEP + "SELECT pos, round(f1, 4) AS f1, f1 > coalesce(max(f1) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS is_best_so_far FROM s"))
def running_best(spark, sf_dir):
    return rounded(metrics.running_best(metrics.threshold_sweep(scored(spark, sf_dir))).select("pos", "f1", "is_best_so_far"))


def _verdict_query(name: str, column: str, sql: str) -> None:
    forms = {
        "verdict": lambda p: numeric.verdict(p),
        "verdict_first_version": lambda p: numeric.verdict(p, 0.90),
        "verdict_three": numeric.verdict_three,
        "band": numeric.probability_band,
    }
    picked = [c for c in column.split()]
    query(name, on_scored(f"SELECT o_orderkey, {sql} FROM scored"))(
        lambda spark, sf_dir: scored(spark, sf_dir).select("o_orderkey", *[forms[c](F.col("score")).alias(c) for c in picked])
    )


_verdict_query(
    "verdict_two_level",
    "verdict verdict_first_version",
    "CASE WHEN score > 0.4::DOUBLE THEN 'ATTACK' ELSE 'BENIGN' END AS verdict, CASE WHEN score > 0.9::DOUBLE THEN 'ATTACK' ELSE 'BENIGN' END AS verdict_first_version",
)
_verdict_query(
    "verdict_three_level",
    "verdict_three",
    "CASE WHEN score > 0.9::DOUBLE THEN 'ATTACK' WHEN score > 0.6::DOUBLE THEN 'SUSPICIOUS' ELSE 'BENIGN' END AS verdict_three",
)
_verdict_query(
    "probability_band",
    "band",
    "CASE WHEN score < 0.1::DOUBLE THEN 'very likely benign' WHEN score < 0.4::DOUBLE THEN 'probably benign' WHEN score < 0.7::DOUBLE THEN 'suspicious'"
    " WHEN score < 0.9::DOUBLE THEN 'likely attack' ELSE 'high-confidence attack' END AS band",
)
