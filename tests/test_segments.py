"""Segmentation against a plain fold, hand cases of the close rules, golden counts, plan shape."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.operators import filters, flows
from flowloom.operators.segments import KEY, LIVE, LIVE_TWO_WAY, VERSION_0, VERSION_1, FlowRules, _steps_of_block, blocked, segment
from flowloom.plans.derived import derive

SCHEMA = (
    "pkt_id bigint, ts_us bigint, src_ip string, dst_ip string, sport bigint, dport bigint, proto int, pkt_len bigint,"
    " tcp_flags int, tcp_window int, tcp_dataofs int, tcp_payload_len bigint, iface string"
)
A, B = "10.0.0.1", "10.0.0.2"


def packet(pkt_id, ts, src=A, dst=B, sport=1000, dport=80, proto=6, size=100, flags=16, window=500, dataofs=5, payload=10):
    if proto != 6:
        flags = window = dataofs = payload = None
    return (pkt_id, ts, src, dst, sport, dport, proto, size, flags, window, dataofs, payload, "eth")


def plain_key(p, rules):
    ports = p[6] in rules.ports
    src, dst = (p[2], p[4] if ports else 0), (p[3], p[5] if ports else 0)
    if rules.key == "canonical" and src > dst:
        src, dst = dst, src
    return (src[0], dst[0], src[1], dst[1], p[6])


def plain_fold(packets, rules):
    """pkt_id -> (seg_id, fwd, closes, gap, dgap, is_last), one packet after the other."""
    out, by_key = {}, {}
    for p in sorted(packets, key=lambda p: (p[1], p[0])):
        by_key.setdefault(plain_key(p, rules), []).append(p)
    for rows in by_key.values():
        flow = None
        for i, p in enumerate(rows):
            ts = p[1]
            if flow and rules.stale_us is not None and ts - flow["last"] > rules.stale_us:
                flow = None
            gap = None
            if flow is None:
                flow = {"start": ts, "id": p[0], "src": p[2], "dir": {}}
            else:
                gap = ts - flow["last"]
            fwd = p[2] == flow["src"]
            dgap = ts - flow["dir"][fwd] if fwd in flow["dir"] else None
            flow["last"] = flow["dir"][fwd] = ts
            flagged = rules.on_flags and p[8] is not None and p[8] & 5 != 0
            span = ts - flow["start"]
            closes = bool(flagged or (span >= rules.close_us if rules.inclusive else span > rules.close_us))
            out[p[0]] = (flow["id"], fwd, closes, gap, dgap, i == len(rows) - 1)
            if closes:
                flow = None
    return out


def run(spark, packets, rules):
    rows = segment(spark.createDataFrame(packets, SCHEMA), rules)
    rows = rows.select("pkt_id", "seg_id", "fwd", "closes", "gap_us", "dgap_us", "is_last").collect()
    return {r.pkt_id: (r.seg_id, r.fwd, r.closes, r.gap_us, r.dgap_us, r.is_last) for r in rows}


def random_packets(seed, n, mean_gap, close_share, keys=3):
    rng = random.Random(seed)
    packets, ts = [], 0
    for i in range(n):
        # Equal times happen; ids are not in time order.
        ts += rng.choice([0, 1, int(rng.expovariate(1 / mean_gap))])
        key = 0 if rng.random() < 0.5 else rng.randrange(keys)  # one key holds most rows
        src, dst, sp, dp = (A, B, 1000 + key, 80) if rng.random() < 0.6 else (B, A, 80, 1000 + key)
        proto = 6 if key % 2 == 0 else 17
        flags = rng.choice([1, 4, 17]) if rng.random() < close_share else 16
        packets.append(packet((i * 7919) % n, ts, src, dst, sp, dp, proto, flags=flags))
    return packets


CASES = [
    # (rules, mean gap, share of closing packets): blocks far smaller than flows, and around them
    (FlowRules(close_us=5000, stale_us=30_000, block_us=6000), 400, 0.0),
    (FlowRules(close_us=5000, stale_us=30_000, block_us=1000), 900, 0.02),
    (FlowRules(close_us=5000, stale_us=30_000, block_us=700), 3000, 0.0),
    (FlowRules(key="directed", close_us=5000, stale_us=9000, block_us=20_000), 4000, 0.05),
    (FlowRules(close_us=2000, inclusive=True, on_flags=False, stale_us=None, min_packets=1, block_us=1500), 700, 0.1),
    (FlowRules(close_us=2000, on_flags=False, stale_us=None, min_packets=1, block_us=100_000), 50, 0.0),
    (FlowRules(close_us=10**12, stale_us=None, block_us=3000), 700, 0.01),
    (FlowRules(ports=(6,), close_us=3000, on_flags=False, stale_us=None, block_us=2500), 500, 0.0),
    (FlowRules(close_us=5000, stale_us=30_000, block_rows=20), 400, 0.01),
    (FlowRules(close_us=5000, stale_us=30_000, block_us=50_000, block_rows=1), 3, 0.01),
    (FlowRules(close_us=2000, on_flags=False, stale_us=None, min_packets=1, block_rows=50), 50, 0.0),
]


@pytest.mark.parametrize("case", range(len(CASES)))
@pytest.mark.parametrize("batch", [7, 10_000])
def test_equals_plain_fold(spark, case, batch):
    rules, mean_gap, share = CASES[case]
    packets = random_packets(case, 1500, mean_gap, share)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        assert run(spark, packets, rules) == plain_fold(packets, rules)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_steps_of_block_equal_walking():
    """The step function of a block against walking it from every possible entry."""
    rng = np.random.default_rng(1)
    for trial in range(300):
        n, limit = int(rng.integers(1, 12)), int(rng.integers(1, 15))
        prev = 100
        ts = prev + np.cumsum(rng.integers(0, 6, n))
        ids = np.arange(n)
        lower, target = _steps_of_block(ts, ids, np.ones(n, bool), False, prev, limit)
        for entry in [None, *range(prev - limit, prev + 1)]:
            start, at = entry, -1
            for i in range(n):
                if start is None:
                    start, at = int(ts[i]), i
                if ts[i] - start > limit:
                    start, at = None, n
            # at: -1 passes through, n none open, else the opening packet
            if entry is None:
                got = target[0]
            else:
                got = target[np.searchsorted(lower, entry, side="right") - 1]
            assert got == at, (trial, entry, ts, limit)


def closes_of(spark, packets, rules=LIVE_TWO_WAY):
    got = run(spark, packets, rules)
    return {k: (v[0], v[2]) for k, v in got.items()}


def test_close_boundaries(spark):
    # exactly 5 s stays open, one microsecond more closes, the crossing packet included
    got = closes_of(spark, [packet(0, 0), packet(1, 5_000_000), packet(2, 5_000_001), packet(3, 5_000_002)])
    assert got == {0: (0, False), 1: (0, False), 2: (0, True), 3: (3, False)}


def test_stale_boundaries(spark):
    # 30 s of silence: kept and closed by duration; one microsecond more: abandoned
    assert closes_of(spark, [packet(0, 0), packet(1, 30_000_000)]) == {0: (0, False), 1: (0, True)}
    assert closes_of(spark, [packet(0, 0), packet(1, 30_000_001)]) == {0: (0, False), 1: (1, False)}


def test_flags_close(spark):
    # FIN as first packet closes at once; a UDP packet has no flags
    assert closes_of(spark, [packet(0, 0, flags=1), packet(1, 1)]) == {0: (0, True), 1: (1, False)}
    assert closes_of(spark, [packet(0, 0, proto=17), packet(1, 1, proto=17)]) == {0: (0, False), 1: (0, False)}


def test_version_rules(spark):
    late = [packet(0, 0), packet(1, 2_000_000), packet(2, 2_000_001)]
    assert [v[2] for _, v in sorted(run(spark, late, VERSION_0).items())] == [False, True, False]
    assert [v[2] for _, v in sorted(run(spark, late, VERSION_1).items())] == [False, False, True]


def test_talk_to_itself_is_forward(spark):
    got = run(spark, [packet(0, 0, A, A, 5, 6), packet(1, 10, A, A, 6, 5)], LIVE_TWO_WAY)
    assert [got[i][1] for i in (0, 1)] == [True, True]


# ignored, closed by flag, closed by time, closed under 3 packets, emitted, two-way, stale, open
GOLDEN = [
    ("sf0.001", LIVE, (216, 30, 171, 76, 125, 0, 20, 16)),
    ("sf0.001", LIVE_TWO_WAY, (216, 30, 130, 59, 101, 87, 7, 8)),
    ("sf0.01", LIVE, (2616, 273, 1565, 616, 1222, 0, 189, 171)),
    ("sf0.01", LIVE_TWO_WAY, (2616, 273, 1277, 453, 1097, 751, 53, 102)),
    ("sf0.1", LIVE, (26686, 2484, 15950, 6344, 12090, 0, 1846, 1663)),
    ("sf0.1", LIVE_TWO_WAY, (26686, 2484, 12953, 4705, 10732, 7453, 577, 1040)),
]


@pytest.mark.parametrize("sf,rules,want", GOLDEN)
def test_golden_counts(spark, sf, rules, want):
    packets = derive(spark, f"/root/testdata/{sf}", "packets")
    kept = filters.tracked(packets)
    rows = flows.flow_rows(segment(kept, rules))
    counts = rows.agg(
        F.count_if("closed_by_flag"),
        F.count_if(F.col("closed") & ~F.col("closed_by_flag")),
        F.count_if(F.col("closed") & (F.col("n_pkts") < 3)),
        F.count_if(F.col("closed") & (F.col("n_pkts") >= 3)),
        F.count_if(F.col("closed") & (F.col("n_pkts") >= 3) & (F.col("tot_bwd_pkts") > 0)),
        F.count_if(F.col("status") == "stale"),
        F.count_if(F.col("status") == "open"),
    ).first()
    assert (packets.count() - kept.count(), *counts) == want


def burst(n):
    """90 % of the packets are of one key and one minute, half of those in 50 ms, and 40 of them in one microsecond."""
    rng = random.Random(9)
    packets = []
    for i in range(n):
        if i < 40:
            packets.append(packet(i, 7_000_000))
        elif i < n * 0.45:
            packets.append(packet(i, 7_000_000 + rng.randrange(50_000)))
        elif i < n * 0.9:
            packets.append(packet(i, rng.randrange(60_000_000)))
        else:
            packets.append(packet(i, rng.randrange(600_000_000), sport=1000 + rng.randrange(50)))
    return packets


def test_a_busy_minute_is_cut_until_no_task_holds_much_of_it(spark):
    packets = burst(6000)
    rules = FlowRules(close_us=1_000_000, block_rows=100)
    assert run(spark, packets, rules) == plain_fold(packets, rules)
    frame = spark.createDataFrame(packets, SCHEMA)
    keyed, counts = blocked(frame, rules)
    sizes = keyed.groupBy(*KEY, "block").agg(F.count(F.lit(1)).alias("n"), F.min("ts_us").alias("lo"), F.max("ts_us").alias("hi")).toPandas()
    assert sizes.n.sum() == len(packets) and sizes.n.max() <= 100 and len(sizes) < 700
    assert sorted(sizes.n) == sorted(r.n for r in counts.select("n").collect())
    for _, part in sizes.groupby(list(KEY)):
        part = part.sort_values("block")
        assert (part.hi.to_numpy()[:-1] < part.lo.to_numpy()[1:]).all()
    # what a task of the walk gets, with as many tasks as the blocks can fill
    tasks = keyed.repartition(60, *KEY, "block").groupBy(F.spark_partition_id()).count().toPandas()["count"]
    assert tasks.max() < 0.1 * len(packets)
    wide, _ = blocked(frame, FlowRules(close_us=1_000_000))
    assert wide.groupBy(*KEY, "block").count().agg(F.max("count")).first()[0] > 0.85 * len(packets)


def test_one_instant_cannot_be_cut(spark):
    packets = [packet(i, 5) for i in range(50)] + [packet(50 + i, 5 + i) for i in range(50)]
    rules = FlowRules(close_us=10, block_rows=4)
    _, counts = blocked(spark.createDataFrame(packets, SCHEMA), rules)
    assert sorted(r.n for r in counts.collect())[-1] == 51
    assert run(spark, packets, rules) == plain_fold(packets, rules)


@pytest.mark.parametrize("odd", [packet(-1, 5), packet(1, -5)])
def test_negative_times_and_ids_are_an_error(spark, odd):
    with pytest.raises(ValueError, match="negative"):
        segment(spark.createDataFrame([packet(0, 0), odd], SCHEMA), LIVE)


def test_no_packets(spark):
    assert segment(spark.createDataFrame([], SCHEMA), LIVE).count() == 0


def test_plan_has_no_task_per_key(spark):
    """Packets are shuffled by (key, block); only block rows are ordered per key."""
    df = segment(filters.tracked(derive(spark, "/root/testdata/sf0.001", "packets")), LIVE_TWO_WAY)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan
    assert set(KEY) <= set(df.columns)


def test_both_aggregations_hash(spark):
    """No packets are sorted to be aggregated: neither into blocks nor into flows."""
    packets = filters.tracked(derive(spark, "/root/testdata/sf0.001", "packets"))
    for df in (flows.flow_features(packets, LIVE_TWO_WAY), flows.closed_flows(packets, LIVE_TWO_WAY, iface=True)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_ends_of_flows_without_their_statistics(spark):
    """The same flows, ends and interfaces; no length or flag field is read or passes through the walk."""
    from flowloom.operators import filters, flows
    from flowloom.operators.segments import LIVE_TWO_WAY
    from flowloom.plans.derived import derive
    from tests.conftest import SF_SMALL

    packets = filters.tracked(derive(spark, SF_SMALL, "packets"))
    columns = [*flows.FLOW_ID, "n_pkts", "last_us", "iface"]
    full, ends = (f(packets, LIVE_TWO_WAY, iface=True).select(*columns) for f in (flows.closed_flows, flows.closed_ends))
    assert sorted(map(tuple, full.collect())) == sorted(map(tuple, ends.collect())) != []
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (full, ends)]
    assert ["tcp_window" in p for p in plans] == [True, False]


def test_named_flows_do_not_carry_statistics(spark):
    from flowloom.plans import device_queries as dq
    from tests.conftest import SF_SMALL

    for iface in (True, False):
        assert "tcp_window" not in dq.scored_flows(spark, SF_SMALL, iface=iface)._jdf.queryExecution().executedPlan().toString()
