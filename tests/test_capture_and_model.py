"""Capture bytes, the forest's invariants, the registered catalog."""

import io
import struct

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from flowloom.operators import clean, training
from flowloom.plans.derived import table_state
from flowloom.plans.model_queries import prepared
from flowloom.plans.training_queries import FEATURES, IDS
from flowloom.sources import pcap
from tests.conftest import SF_SMALL

SMALL = training.ForestConfig(trees=20, depth=8)


def record(order, frame, ts=(7, 8), size=None):
    return struct.pack(order + "IIII", *ts, len(frame), size or len(frame)) + frame


def ether(kind, tag=b""):
    return bytes.fromhex("aabbcc000002") + bytes.fromhex("0c74c2000001") + tag + struct.pack(">H", kind)


def ipv4(proto, body):
    return struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(body), 0, 0, 61, proto, 0) + bytes([10, 0, 0, 1, 8, 8, 8, 8]) + body


@pytest.mark.parametrize("order,magic,per_us", [("<", 0xA1B2C3D4, 1), (">", 0xA1B2C3D4, 1), ("<", 0xA1B23C4D, 1000)])
@pytest.mark.parametrize("chunk", [50, 1 << 20])
def test_capture_forms(order, magic, per_us, chunk):
    tcp = struct.pack(">HHIIBBHHH", 1000, 443, 0, 0, 6 << 4, 0x92, 512, 0, 0) + bytes(4) + b"data!"
    arp = struct.pack(">HHBBH", 1, 0x800, 6, 4, 2) + bytes.fromhex("0c74c2000001") + bytes([10, 0, 0, 1]) + bytes(6) + bytes([10, 0, 0, 2])
    frames = [
        ether(0x800) + ipv4(6, tcp),
        ether(0x806) + arp,
        ether(0x800, bytes.fromhex("81000005")) + ipv4(17, struct.pack(">HHHH", 53, 9, 8, 0)),
        ether(0x86DD) + bytes(50),
        ether(0x800) + ipv4(1, bytes([8, 3, 0, 0])),
    ]
    head = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, 1)
    data = head + b"".join(record(order, f, (7, 8 * per_us)) for f in frames) + b"cut"
    rows = [r for part in pcap.read_capture(io.BytesIO(data), chunk=chunk) for r in part.astype(object).where(part.notna(), None).to_dict("records")]
    assert [r["file_pos"] for r in rows] == list(np.cumsum([24] + [16 + len(f) for f in frames])[:-1]) and {r["ts_us"] for r in rows} == {7_000_008}
    assert [r["src_ip"] for r in rows] == ["10.0.0.1", None, "10.0.0.1", None, "10.0.0.1"]
    t = rows[0]
    assert (t["sport"], t["dport"], t["tcp_flags"], t["tcp_window"], t["tcp_dataofs"], t["tcp_payload_len"], t["ttl"]) == (1000, 443, 0x92, 512, 6, 5, 61)
    assert (rows[1]["arp_op"], rows[1]["arp_psrc"], rows[1]["arp_hwsrc"], rows[1]["arp_pdst"]) == (2, "10.0.0.1", "0c:74:c2:00:00:01", "10.0.0.2")
    assert (rows[2]["sport"], rows[2]["dport"], rows[2]["proto"], rows[2]["tcp_flags"]) == (53, 9, 17, None)
    assert (rows[4]["sport"], rows[4]["dport"]) == (8, 3)


def test_boundaries_of_any_split(spark, tmp_path):
    """Every start offset finds the next true boundary, also with a capture inside a payload."""
    rng = np.random.default_rng(2)
    inner = b"".join(record("<", bytes(30), (7, i)) for i in range(5))
    bodies = [rng.bytes(int(n)) for n in rng.integers(30, 400, 60)] + [inner] + [rng.bytes(50) for _ in range(40)]
    head = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 1000, 1)
    records = [record("<", ether(0x800) + ipv4(17, struct.pack(">HHHH", 1, 2, 8, 0) + b), (100, i)) for i, b in enumerate(bodies)]
    data = head + b"".join(records)
    edges = np.cumsum([24] + [len(r) for r in records])
    for start in range(0, len(data), 37):
        found = pcap.first_boundary(io.BytesIO(data), start, len(data))
        assert found is None and start > len(data) - 2500 or found in edges[:-1] and start <= found <= start + 2100, start
    (tmp_path / "x.pcap").write_bytes(data)
    for split in (None, 300, 5000):
        rows = pcap.pcap_ingest(spark, str(tmp_path), split).orderBy("file_pos").collect()
        assert [r.file_pos for r in rows] == edges[:-1].tolist()
    with pytest.raises(ValueError):
        list(pcap.read_capture(io.BytesIO(data), 24, int(edges[3]) + 5))


def test_numbers_too_large_for_headers_come_back(spark, tmp_path):
    """Some rows have an address or a port that no IPv4 header holds; they stand between others, also where files are cut."""
    columns = "pkt_id bigint, ts_us bigint, src_ip string, dst_ip string, sport bigint, dport bigint, proto int, pkt_len bigint, tcp_flags int, tcp_window int, tcp_dataofs int, tcp_payload_len bigint, src_mac string"
    rows = []
    for i in range(600):
        proto = (6, 17, 1)[i % 3]
        tcp = (2 + i % 90, 1000 + i, 5 + i % 11, i % 1400) if proto == 6 else (None,) * 4
        ends = (f"192.168.{i}.{i % 200}", "8.8.8.8") if i % 2 else ("8.8.8.8", f"192.168.{i % 7}.{i * 3}")
        ports = (8, 0) if proto == 1 else (40_000 + 90 * i, 443)
        rows.append((i, 5_000_000 + i, *ends, *ports, proto, 54 + i, *tcp, "0c:74:c2:00:00:01"))
    df = spark.createDataFrame(rows, columns)
    pcap.write_captures(df, str(tmp_path), files=2)
    fields = df.drop("pkt_id").columns
    for split in (None, 5000):
        assert sorted(map(repr, pcap.pcap_ingest(spark, str(tmp_path), split).select(*fields).collect())) == sorted(map(repr, df.select(*fields).collect()))
    strange = pcap.CAPTURE_HEAD + record("<", ether(pcap.LOCAL_TYPE) + bytes(80)) + record("<", ether(pcap.LOCAL_TYPE) + pcap.WIDE_MARK)
    assert pd.concat(pcap.read_capture(io.BytesIO(strange)))["src_ip"].isna().all()


def test_not_a_capture():
    with pytest.raises(ValueError):
        list(pcap.read_capture(io.BytesIO(b"x" * 40)))


@pytest.fixture(scope="module")
def fitted(spark):
    rows = prepared(spark, SF_SMALL)
    return training.train_forest(rows.where("NOT is_test"), FEATURES, SMALL), rows


def test_forest_finds_the_attacks(fitted):
    model, rows = fitted
    scored = model.score(rows.where("is_test"), [clean.LABEL_BINARY])
    assert scored.where(~F.col("score").between(0, 1)).count() == 0
    auc = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol=clean.LABEL_BINARY).evaluate(scored)
    assert auc > 0.9


def test_training_rows_lie_in_parts_of_bounded_size(spark, monkeypatch):
    """Each row is cached with a count for every tree; parts that are small enough already stay as they are."""
    monkeypatch.setattr(training, "COUNTS_IN_PART", 4000)
    rows = spark.range(0, 1000, 1, 2).selectExpr("CAST(id AS DOUBLE) AS x", "CAST(id % 2 AS INT) AS Label_Binary", "id AS unused")
    seen = []
    fit = training.Pipeline.fit
    monkeypatch.setattr(training.Pipeline, "fit", lambda self, df: seen.append(df) or fit(self, df))
    training.train_forest(rows, ["x"], training.ForestConfig(trees=40, depth=3))
    training.train_forest(rows, ["x"], training.ForestConfig(trees=2, depth=3))
    many, few = seen
    assert many.rdd.getNumPartitions() == 10 and max(many.rdd.glom().map(len).collect()) <= 150
    assert few.rdd.getNumPartitions() == 2 and many.count() == few.count() == 1000


def test_balance_and_split(fitted):
    _, rows = fitted
    n = {(r.Label_Binary, r.is_test): r["count"] for r in rows.groupBy("Label_Binary", "is_test").count().collect()}
    assert n[0, True] + n[0, False] <= 10 * (n[1, True] + n[1, False])
    for y in (0, 1):
        assert abs(n[y, True] - 0.2 * (n[y, True] + n[y, False])) <= 1


def test_saved_model_scores_alike(spark, fitted, tmp_path):
    model, rows = fitted
    model.save(spark, str(tmp_path / "m"))
    loaded = training.FlowModel.load(spark, str(tmp_path / "m"))
    assert loaded.features == FEATURES
    scores = [sorted(tuple(r) for r in m.score(rows, IDS).collect()) for m in (model, loaded)]
    assert scores[0] == scores[1]


def test_contract(fitted):
    model, rows = fitted
    row = training.contract_check(model, rows.drop("bulk_zero")).first()
    assert (row.n_features, row.missing, row.zero_row_scored) == (4, "bulk_zero", True)


def test_scaling_divides_by_one_without_variance(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    assert [tuple(r) for r in training.scale(df, training.scaler_stats(df, ["a", "b"]), ["a", "b"]).collect()] == [(-1.0, 0.0), (1.0, 0.0)]


@pytest.fixture(scope="module")
def small_forests(spark):
    """Query results under forests of a size that suits tests."""
    training.train_forest.__defaults__ = (SMALL,)
    try:
        names = ["train_forest", "predict_proba", "predict_label", "holdout_eval", "model_load", "model_contract_check", "eval_saved_model", "eval_saved_report", "stream_score", "batch_score", "alert_line_scored"]
        yield {n: entry_module.queries()[n](spark, SF_SMALL).toPandas() for n in names}
    finally:
        training.train_forest.__defaults__ = (training.ForestConfig(),)


def test_importances_are_shares(small_forests):
    found = small_forests["train_forest"].set_index("feature").importance
    assert list(found.index) == FEATURES and found.between(0, 1).all() and abs(found.sum() - 1) < 1e-9
    # the class follows from these two
    assert found["tot_fwd_pkts"] + found["syn_flag_cnt"] > 0.8 and found["bulk_zero"] == 0


def test_scores_labels_and_saved_scores_agree(small_forests):
    scored, labelled, loaded = (small_forests[n].sort_values(IDS) for n in ("predict_proba", "predict_label", "model_load"))
    assert scored.score.between(0, 1).all() and scored.score.nunique() > 3
    assert ((scored.score.to_numpy() > 0.5) == (labelled.predicted.to_numpy() == 1)).all()
    assert (loaded.memory_score == loaded.loaded_score).all()
    assert (loaded.loaded_score.to_numpy() == scored.score.to_numpy()).all()
    unseen = scored[scored.is_test]
    assert unseen[unseen[clean.LABEL_BINARY] == 1].score.min() > unseen[unseen[clean.LABEL_BINARY] == 0].score.quantile(0.95)


def test_report_follows_from_the_scores(small_forests):
    unseen = small_forests["predict_proba"].query("is_test")
    report = small_forests["holdout_eval"].set_index("class")
    y, hit = unseen[clean.LABEL_BINARY].to_numpy(), unseen.score.to_numpy() >= 0.5
    line = report.loc["ATTACK"]
    assert (line.tp, line.fp, line.fn, line.tn) == ((y & hit).sum(), ((1 - y) & hit).sum(), (y & ~hit).sum(), ((1 - y) & ~hit).sum())
    assert line.accuracy == pytest.approx(((y == 1) == hit).mean()) and line.recall == pytest.approx(line.tp / y.sum())
    assert report.loc["macro avg"].f1 == pytest.approx((report.loc["ATTACK"].f1 + report.loc["BENIGN"].f1) / 2)


def test_sweep_of_the_whole_table(small_forests):
    sweep, report = small_forests["eval_saved_model"], small_forests["eval_saved_report"]
    for part, rows in sweep.groupby("part"):
        rows = rows.sort_values("pos")
        assert rows.threshold.tolist() == [0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.05]
        # lower thresholds find more, and raise more false alarms
        assert rows.tp.is_monotonic_increasing and rows.fp.is_monotonic_increasing and rows.tp.iloc[-1] <= rows.tp.iloc[-1] + rows.fn.iloc[-1]
        assert ((rows.tn + rows.fp).nunique(), (rows.tp + rows.fn).nunique()) == (1, 1)
        assert rows.detection.tolist() == pytest.approx((100 * rows.tp / (rows.tp + rows.fn)).tolist())
        best = rows.loc[rows.f1.idxmax()]
        line = report[(report.part == part) & (report["class"] == "ATTACK")].iloc[0]
        assert (line.best_threshold, line.best_f1) == (best.threshold, pytest.approx(best.f1))
        assert line.detection_pct == pytest.approx(rows.detection.iloc[0]) and line.false_alarm_pct == pytest.approx(rows.false_alarm.iloc[0])
        assert rows.is_best_so_far.iloc[0] == (rows.f1.iloc[0] > 0)
    totals = sweep.groupby("part").apply(lambda x: int((x.tn + x.fp + x.fn + x.tp).iloc[0]), include_groups=False)
    assert 0 < totals["unseen rows"] < totals["all rows"]


def test_contract_against_real_columns(small_forests):
    found = small_forests["model_contract_check"].set_index("table")
    assert found.missing.to_dict() == {"dirty_flows": "", "prepared": "", "without bulk_zero": "bulk_zero"}
    assert found.loc["dirty_flows"].unused == "l_orderkey,l_linenumber,Label"
    assert found.zero_row_score.between(0, 1).all() and found.zero_row_score.nunique() == 1


def test_stream_scores_equal_batch_scores(small_forests):
    key = ["ip_a", "ip_b", "port_a", "port_b", "proto", "seg_ts", "seg_id"]
    both = small_forests["stream_score"].merge(small_forests["batch_score"], on=key, suffixes=("", "_batch"))
    assert len(both) == len(small_forests["stream_score"]) == len(small_forests["batch_score"]) > 100
    # a statistic may differ in its last digit and cross a limit of a tree
    assert (abs(both.score - both.score_batch) < 1e-9).mean() > 0.99 and abs(both.score - both.score_batch).max() < 0.1
    assert both.score.nunique() > 5


def test_alert_lines_show_the_score(small_forests):
    for _, row in small_forests["alert_line_scored"].iterrows():
        assert ("ATTACK" in row.line) == (row.score > 0.4) and f"({row.score:.2f})" in row.line


def test_another_table_under_the_same_path_is_another_state(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(5).write.parquet(path)
    first = table_state(spark, path)
    assert table_state(spark, path) == first
    spark.range(5).write.mode("append").parquet(path)
    assert table_state(spark, path) != first


CHECKED = ["flow_agg_pcap", "device_registry", "asof_dns_label", "health_counters", "iface_rate", "flow_segment_v1", "classification_report", "pcap_ingest"]


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in "customer nation events pages lineitem orders".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_SMALL}/{t}.parquet'")
    cur = con.execute(entry_module.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    df = entry_module.queries()[name](spark, SF_SMALL)
    assert sorted(df.columns) == sorted(columns)
    got = sorted(repr(tuple(r)) for r in df.select(*columns).collect())
    assert got == sorted(repr(tuple(r)) for r in cur.fetchall())


def test_catalog():
    queries, checks = entry_module.queries(), entry_module.oracle_sql()
    assert set(checks) <= set(queries) and len(queries) > 110


def test_entry_runs(spark):
    df = entry_module.entry(spark)
    assert df.count() == 101 and len(df.columns) == 85
