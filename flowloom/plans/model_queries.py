"""Queries that train, store, load and apply the forest. They return what the model says: importances, scores, labels, reports, sweeps.

SQL cannot repeat a forest, so most have no check SQL; what must hold of them is in the tests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.constants import FLOW_FEATURES
from flowloom.functions import numeric
from flowloom.operators import clean, devices, filters, flows, metrics, names, sampling, training
from flowloom.operators.segments import LIVE
from flowloom.plans import device_queries as dq
from flowloom.plans.catalog import query
from flowloom.plans.derived import GATEWAYS, TEST_SERVICES, table_state
from flowloom.plans.flow_queries import FLOW, packets
from flowloom.plans.training_queries import _COMPLETE, _HASH, _Y, FEATURES, IDS, dirty, on_dirty
from flowloom.session import scratch_dir
from flowloom.streaming import jobs
from flowloom.streaming.tracker import scorable, track

_BALANCED = f"""(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY {_HASH}, l_orderkey, l_linenumber) AS place, sum(y) OVER () AS n_attack
 FROM (SELECT *, {_Y} AS y FROM {_COMPLETE} c WHERE Label <> 'Label') l) b WHERE y = 1 OR place <= 10 * n_attack)"""
_NAMES = ", ".join(f"({i}, '{f}')" for i, f in enumerate(FEATURES))

_trained: dict[tuple, str] = {}


def prepared(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Cleaned, labelled, balanced, split rows, written once: training reads them many times.

    So are the rows before balancing, with their hash order, and before the split, as both steps read them several times.
    """
    rows = clean.drop_incomplete_rows(clean.inf_to_null(dirty(spark, sf_dir), FEATURES))
    labelled = clean.numeric_matrix(clean.with_binary_label(clean.drop_header_rows(rows)), FEATURES)
    ordered = dq.stored(spark, labelled.withColumn("_order", numeric.hash_order(*[F.col(c) for c in IDS])), "labelled")
    balanced = dq.stored(spark, sampling.undersample_benign(ordered, IDS, order="_order"), "balanced")
    split = sampling.split_stratified(balanced, IDS, order="_order").drop("_order")
    path = path or scratch_dir(spark, "prepared")
    split.write.parquet(path)
    return spark.read.parquet(path)


def saved(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """A stored forest and its rows. Queries that only apply a model share one for each state of the table's files."""
    key = (spark.sparkContext.applicationId, *table_state(spark, f"{sf_dir}/lineitem.parquet"))
    if key not in _trained:
        folder = scratch_dir(spark, "model")
        rows = prepared(spark, sf_dir, f"{folder}/rows")
        training.train_forest(rows.where("NOT is_test"), FEATURES).save(spark, folder)
        _trained[key] = folder
    return _trained[key], spark.read.parquet(f"{_trained[key]}/rows")


def trained(spark: SparkSession, sf_dir: str) -> tuple[training.FlowModel, DataFrame]:
    folder, rows = saved(spark, sf_dir)
    return training.FlowModel.load(spark, folder), rows


@query("train_forest")
def train_forest(spark, sf_dir):
    """Importance of each feature in a forest fitted here."""
    rows = prepared(spark, sf_dir)
    model = training.train_forest(rows.where("NOT is_test"), FEATURES)
    shares = model.pipeline.stages[-1].featureImportances.toArray()
    found = [(i, f, float(v)) for i, (f, v) in enumerate(zip(model.features, shares, strict=True))]
    return spark.createDataFrame(found, "pos int, feature string, importance double")


@query("predict_proba")
def predict_proba(spark, sf_dir):
    """Probability of attack of every balanced row, beside its class."""
    model, rows = trained(spark, sf_dir)
    return model.score(rows, [*IDS, "is_test", clean.LABEL_BINARY]).drop("predicted")


@query("predict_label")
def predict_label(spark, sf_dir):
    model, rows = trained(spark, sf_dir)
    return model.score(rows, [*IDS, "is_test", clean.LABEL_BINARY]).drop("score")


@query("holdout_eval")
def holdout_eval(spark, sf_dir):
    """A forest fitted here, its report, accuracy and matrix on the rows held out."""
    rows = prepared(spark, sf_dir)
    model = training.train_forest(rows.where("NOT is_test"), FEATURES)
    scored = dq.stored(spark, model.score(rows.where("is_test"), [clean.LABEL_BINARY]), "scored")
    return training.evaluate(scored, clean.LABEL_BINARY)


@query("model_save", on_dirty(f"SELECT pos, feature, (SELECT count(*) FROM {_BALANCED} b) AS rows_of_table FROM (VALUES {_NAMES}) v(pos, feature)"))
def model_save(spark, sf_dir):
    """The saved feature contract, and how many rows of the table that it was fitted for have each feature."""
    folder, rows = saved(spark, sf_dir)
    contract = spark.read.parquet(f"{folder}/features")
    have = [F.struct(F.lit(c).alias("feature"), F.count(c).alias("rows_of_table")) for c in rows.columns]
    counted = rows.agg(F.array(*have).alias("c")).select(F.inline("c"))
    return contract.join(F.broadcast(counted), "feature", "left").select("pos", "feature", "rows_of_table")


@query("model_load")
def model_load(spark, sf_dir):
    """Every row's score by the model in memory and by one saved from it and loaded again."""
    model, rows = trained(spark, sf_dir)
    folder = scratch_dir(spark, "model")
    model.save(spark, folder)
    first = model.score(rows, [*IDS, *FEATURES]).withColumnRenamed("score", "memory_score").drop("predicted")
    again = training.FlowModel.load(spark, folder).score(first, [*IDS, "memory_score"])
    return again.select(*IDS, "memory_score", F.col("score").alias("loaded_score"))


@query("model_contract_check")
def model_contract_check(spark, sf_dir):
    """The contract against the columns of the raw table, of its prepared form, and of one that lacks a feature."""
    model, rows = trained(spark, sf_dir)
    tables = {"dirty_flows": dirty(spark, sf_dir), "prepared": rows, "without bulk_zero": rows.drop("bulk_zero")}
    checks = [training.contract_check(model, df).select(F.lit(n).alias("table"), "*") for n, df in tables.items()]
    return checks[0].unionByName(checks[1]).unionByName(checks[2])


def evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every complete row of the raw table, cleaned and aligned as for a table never seen, scored by the stored model.

    ``seen``: a row of its ids was among those that the model was fitted on; ids may repeat.
    """
    model, rows = trained(spark, sf_dir)
    cleaned = clean.drop_incomplete_rows(clean.inf_to_null(dirty(spark, sf_dir), FEATURES))
    labelled = clean.with_binary_label(clean.drop_header_rows(cleaned))
    taught = rows.where("NOT is_test").select(*IDS).distinct().withColumn("seen", F.lit(True))
    marked = clean.numeric_matrix(labelled, FEATURES).join(taught, IDS, "left").na.fill(False, ["seen"])
    return dq.stored(spark, model.score(marked, [*IDS, clean.LABEL_BINARY, "seen"]), "evaluated")


_PARTS = ("all rows", "unseen rows")


def _of_part(scored: DataFrame, part: str) -> DataFrame:
    return scored.where("NOT seen") if part == "unseen rows" else scored


@query("eval_saved_model")
def eval_saved_model(spark, sf_dir):
    """Load, clean, align, score the whole table once, then sweep the thresholds, over all rows and over those not seen in training."""
    scored = evaluated(spark, sf_dir)
    sweeps = [metrics.running_best(metrics.threshold_sweep(_of_part(scored, p), y=clean.LABEL_BINARY)).select(F.lit(p).alias("part"), "*") for p in _PARTS]
    return sweeps[0].unionByName(sweeps[1])


@query("eval_saved_report")
def eval_saved_report(spark, sf_dir):
    """Accuracy, class report, matrix, detection and false-alarm rate of the stored model at 0.5, and the best threshold of its sweep."""
    scored = evaluated(spark, sf_dir)
    tables = []
    for part in _PARTS:
        rows = _of_part(scored, part)
        matrix = metrics.confusion_matrix(rows, y=clean.LABEL_BINARY)
        rates = metrics.detection_false_alarm(matrix).join(metrics.best_threshold(metrics.threshold_sweep(rows, y=clean.LABEL_BINARY)), F.lit(True))
        report = training.evaluate(rows, clean.LABEL_BINARY)
        tables.append(report.join(F.broadcast(rates), F.lit(True)).select(F.lit(part).alias("part"), "*"))
    return tables[0].unionByName(tables[1])


@query("eval_saved_support", on_dirty(f"SELECT count(*) FILTER (WHERE y = 0) AS benign, count(*) FILTER (WHERE y = 1) AS attack FROM (SELECT {_Y} AS y FROM {_COMPLETE} c WHERE Label <> 'Label') l"))
def eval_saved_support(spark, sf_dir):
    """How many rows of either class the evaluation of the whole table covers."""
    matrix = metrics.confusion_matrix(evaluated(spark, sf_dir), y=clean.LABEL_BINARY)
    return matrix.selectExpr("tn + fp AS benign", "fn + tp AS attack")


# ---------------------------------------------------------------- flows scored by all features

ALL_FEATURES = list(FLOW_FEATURES)


def flow_model(spark: SparkSession, sf_dir: str) -> tuple[training.FlowModel, DataFrame]:
    """A forest over all 78 statistics, and the stored flows that it was fitted on.

    Captured packets carry no labels; flows that a RST ended are taken as attacks, so that there is something to learn.
    """
    rows = flows.closed_flows(filters.tracked(packets(spark, sf_dir)), LIVE, iface=True)
    target = F.when((F.col("rst_flag_cnt") > 0) & F.col("closed_by_flag"), 1).otherwise(0)
    stored = dq.stored(spark, rows.select(*FLOW, *ALL_FEATURES, "last_us", "iface", target.alias(clean.LABEL_BINARY)), "flows")
    return training.train_forest(stored, ALL_FEATURES), stored


@query("stream_score")
def stream_score(spark, sf_dir):
    """Closed flows of the stream scored as they close, on all features, by a forest trained on the batch form."""
    from flowloom.plans.stream_queries import DELAY, packet_source

    model, _ = flow_model(spark, sf_dir)
    _, stream, out, checkpoint = packet_source(spark, sf_dir)
    ended = flows.with_features(scorable(track(filters.tracked(stream), LIVE, DELAY), LIVE))
    alerts = model.score(ended, FLOW).withColumn("verdict", numeric.verdict(F.col("score")))
    jobs.run_available(alerts, out, checkpoint)
    return spark.read.parquet(out).select(*FLOW, "score", "verdict")


@query("batch_score")
def batch_score(spark, sf_dir):
    """The same flows scored in one batch."""
    model, rows = flow_model(spark, sf_dir)
    return model.score(rows, FLOW).withColumn("verdict", numeric.verdict(F.col("score"))).select(*FLOW, "score", "verdict")


@query("alert_line_scored")
def alert_line_scored(spark, sf_dir):
    """Alert lines under the model's scores, with names as of the flow's end."""
    model, rows = flow_model(spark, sf_dir)
    scored = model.score(rows, [*FLOW, "last_us", "iface"]).select(
        F.col("ip_a").alias("src_ip"), F.col("ip_b").alias("dst_ip"), F.col("port_a").alias("sport"), F.col("port_b").alias("dport"),
        "proto", "seg_id", F.col("last_us").alias("end_us"), "iface", "score",
    )
    macs = devices.mac_table(dq.registry(spark, sf_dir))
    flow_rows = dq.stored(spark, scored, "scored-flows")
    alerts = names.alert_rows(flow_rows, ["seg_id"], dq.answers(spark, sf_dir), macs, dq.hosts(spark, sf_dir), GATEWAYS, TEST_SERVICES)
    return alerts.select("seg_id", "score", "line")
