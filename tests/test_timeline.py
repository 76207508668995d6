"""Prefix aggregates over blocks against plain sums; no task sees all rows or all blocks."""

import random

import pytest
from pyspark.sql import functions as F

from flowloom.operators import health
from flowloom.operators.timeline import before_blocks, previous, running_sums
from flowloom.plans.device_queries import frames
from tests.conftest import SF_SMALL


@pytest.mark.parametrize("span", [1, 7, 1000])
def test_sums_and_previous_rows(spark, span):
    rng = random.Random(span)
    rows = [(t, rng.randrange(-5, 20), rng.choice([None, 1, 2])) for t in rng.sample(range(3000), 400)]
    df = spark.createDataFrame(rows, "t bigint, v bigint, w bigint")
    summed = {r.t: (r.sv, r.sw) for r in running_sums(df, "t", span, {"sv": "v", "sw": "w"}).collect()}
    before = {r.t: (r.pv, r.pw) for r in previous(df, "t", span, {"pv": "v", "pw": "w"}).collect()}
    sv = sw = 0
    last = (None, None)
    for t, v, w in sorted(rows):
        assert before[t] == last
        sv, sw, last = sv + v, sw + (w or 0), (v, w)
        assert summed[t] == (sv, sw)


def test_blocks_far_apart(spark):
    blocks = [0, 1, 5, 2**31, 2**45 + 3]
    df = spark.createDataFrame([(b, i + 1) for i, b in enumerate(blocks)], "b bigint, v bigint")
    got = {r.b: r.s for r in before_blocks(df, "b", {"s": (F.sum("v"), F.sum)}).collect()}
    assert got == {b: sum(range(1, i + 1)) or None for i, b in enumerate(blocks)}


def test_no_rows(spark):
    empty = spark.createDataFrame([], "window_us bigint, n bigint")
    assert running_sums(empty, "window_us", 10, {"s": "n"}).count() == 0
    assert health.counter_delta(empty, ["n"]).count() == 0
    none = spark.createDataFrame([], "ts_us bigint, is_arp boolean, is_ip boolean, is_tracked boolean")
    assert health.health_counters(none, spark.createDataFrame([], "open_us bigint, end_us bigint"), none.select("ts_us")).count() == 0


def test_plans_have_no_single_task(spark):
    seen = frames(spark, SF_SMALL)
    spans = seen.select(F.col("ts_us").alias("open_us"), (F.col("ts_us") + 5).alias("end_us"))
    counters = health.health_counters(seen, spans, seen.select("ts_us"))
    delta = health.counter_delta(counters.select("window_us", "total_packets"), ["total_packets"])
    for df in (counters, delta):
        assert "SinglePartition" not in df._jdf.queryExecution().executedPlan().toString()
