"""CSV folders, cleaning, samplers, look-back, metrics."""

import random

import pytest
from pyspark.sql import functions as F

from flowloom.operators import clean, metrics, sampling
from flowloom.operators.timeline import asof_latest
from flowloom.sources import flow_csv


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "b-2017.csv").write_text(" Destination Port, Fwd Header Length, Fwd Header Length,Flow Bytes/s, Label\n80,1,2,Infinity,BENIGN\n443,3,4,5.5,DDoS\n")
    (tmp_path / "a-2018.csv").write_text("Dst Port,Timestamp,Flow Byts/s,Label\n22,x,abc,Benign\n23,y,,Bot\n")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "notes.txt").write_text("no table")
    return str(tmp_path)


def test_folder_of_different_headers(spark, folder):
    rows = flow_csv.scan_flow_csv_dir(spark, folder)
    got = {(r["source_file"], r["Dst Port"], r["Fwd Header Len"], r["Flow Byts/s"], r["Label"]) for r in rows.collect()}
    assert got == {
        ("b-2017.csv", "80", "1", "Infinity", "BENIGN"), ("b-2017.csv", "443", "3", "5.5", "DDoS"),
        ("a-2018.csv", "22", None, "abc", "Benign"), ("a-2018.csv", "23", None, None, "Bot"),
    }


def test_preferred_file(spark, folder, tmp_path):
    assert flow_csv.scan_preferred_csv(spark, folder, "b-2017.csv").count() == 2
    assert "Timestamp" in flow_csv.scan_preferred_csv(spark, folder, "missing.csv").columns  # first by name
    empty = tmp_path / "none"
    empty.mkdir()
    with pytest.raises(FileNotFoundError):
        flow_csv.scan_preferred_csv(spark, str(empty))


def test_cleaning_rows(spark):
    df = spark.createDataFrame([("1", "Infinity", "BENIGN"), ("2", "-inf", "x"), ("3", "NaN", "x"), ("4", "7", "x"), ("abc", "1", "x")], "`Flow ID` string, ` Flow Bytes/s` string, Label string")
    out = clean.clean_rows(df)
    assert out.columns == ["Flow Byts/s", "Label"] and sorted(r[0] for r in out.collect()) == ["1", "7"]


def test_numeric_matrix(spark):
    df = spark.createDataFrame([(v,) for v in ("abc", "Infinity", "1e12", "-1e12", None, "NaN", "2.5")], "x string")
    assert [r.x for r in clean.numeric_matrix(df, ["x"]).collect()] == [0.0, 0.0, 1e10, -1e10, 0.0, 0.0, 2.5]


def skewed(spark, n=6000):
    """Two thirds of the rows in one file; a class with ten rows."""
    df = spark.range(n).withColumn("source_file", F.when(F.col("id") % 3 < 2, "hot.csv").otherwise("cold.csv"))
    return df.withColumn("Label", F.when(F.col("id") % 600 == 0, "Rare").otherwise("Benign"))


def test_sample_cap_exact_and_keeps_rare(spark):
    out = sampling.sample_cap(skewed(spark), ["id"], cap=500).groupBy("source_file").agg(
        F.count("*").alias("n"), F.count_distinct("id").alias("d"), F.count_if(F.col("Label") == "Rare").alias("rare")
    )
    got = {r.source_file: (r.n, r.d, r.rare) for r in out.collect()}
    assert got["hot.csv"][:2] == (500, 500) and got["cold.csv"][:2] == (500, 500)
    assert got["hot.csv"][2] >= 8  # nearly all of the ten rare rows, 0.25 % of the file
    assert sampling.sample_cap(skewed(spark), ["id"], cap=10_000).count() == 6000


@pytest.mark.parametrize("wanted", [0, 1, 137, 2999, 3000, 5000])
def test_keep_smallest_equals_sorting(spark, wanted):
    rng = random.Random(wanted)
    values = [(i, rng.randrange(40) * 100 + rng.randrange(2)) for i in range(3000)]
    df = spark.createDataFrame(values, "id int, v bigint")
    limit = spark.createDataFrame([(wanted,)], "n_wanted bigint")
    got = sampling.keep_smallest(df, [], "v", ["id"], F.expr("v DIV 100"), limit)
    assert sorted(r.id for r in got.collect()) == sorted(i for i, _ in sorted(values, key=lambda x: (x[1], x[0]))[:wanted])


def test_split_and_balance(spark):
    df = skewed(spark).withColumn("y", F.when(F.col("Label") == "Rare", 1).otherwise(0))
    assert sampling.undersample_benign(df, ["id"], "y").groupBy("y").count().orderBy("y").collect()[0]["count"] == 100
    split = sampling.split_stratified(df, ["id"], "y").groupBy("y").agg(F.count_if("is_test").alias("t"), F.count("*").alias("n"))
    assert {r.y: (r.t, r.n) for r in split.collect()} == {0: (1198, 5990), 1: (2, 10)}


def test_asof_latest_on_a_hot_key(spark):
    rng = random.Random(5)
    right = [(i, rng.choice("aab"), rng.randrange(5000), f"v{i}") for i in range(300)]
    left = [(i, rng.choice("aac"), rng.randrange(5000)) for i in range(500)]
    got = asof_latest(
        spark.createDataFrame(left, "i int, k string, t bigint"), spark.createDataFrame(right, "id int, k string, t bigint, v string"),
        "k", "t", "id", ["v"], block_us=100,
    )

    def plain(k, t):
        known = [(r[2], r[0], r[3]) for r in right if r[1] == k and r[2] <= t]
        return max(known)[2] if known else None

    assert {r.i: r.v for r in got.collect()} == {i: plain(k, t) for i, k, t in left}


def test_metrics_without_attacks(spark):
    scored = spark.createDataFrame([(0, 0.2), (0, 0.7)], "y int, score double")
    sweep = metrics.threshold_sweep(scored)
    assert metrics.best_threshold(sweep).first() == (0.5, 0.0)
    assert metrics.detection_false_alarm(metrics.confusion_matrix(scored)).first() == (0.0, 50.0)


def test_values_of_a_group_are_broadcast_whatever_the_threshold(spark):
    """A join that deals rows by class or file sorts those of a large one in a single task."""
    rows = spark.range(2000).selectExpr("id", "CAST(id % 2 AS INT) AS y", "concat('f', id % 3) AS source_file", "CAST(id % 2 AS STRING) AS Label")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        split = sampling.split_stratified(rows, ["id"], label="y")
        drawn = sampling.sample_cap(rows, ["id"], cap=100)
        for df in (split, drawn):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
        assert split.where("is_test").count() == 400 and drawn.count() == 300
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
