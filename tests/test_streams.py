"""Stream equals batch: order inside the delay, late rows, restart from a checkpoint."""

import pytest
from pyspark.sql import functions as F

from flowloom.operators import filters, flows
from flowloom.operators.segments import LIVE_TWO_WAY
from flowloom.plans.derived import derive
from flowloom.plans.stream_queries import DELAY, write_slices, write_tick
from flowloom.streaming import jobs, ordered
from flowloom.streaming.tracker import scorable, track
from tests.conftest import SF_SMALL

COLUMNS = ["ip_a", "ip_b", "port_a", "port_b", "proto", "seg_ts", "n_pkts", "tot_bwd_pkts", "bwd_iat_tot", "idle_max", "fwd_header_len"]
FLOATS = ["pkt_len_std", "flow_iat_std", "active_mean"]


def shape(df):
    cells = [F.col(c) for c in COLUMNS] + [F.round(c, 3).alias(c) for c in FLOATS]
    return sorted(tuple(r) for r in df.select(*cells).collect())


@pytest.fixture(scope="module")
def packets(spark):
    return derive(spark, SF_SMALL, "packets")


@pytest.fixture(scope="module")
def expected(packets):
    return shape(flows.closed_flows(filters.tracked(packets), LIVE_TWO_WAY))


def run(session, source, schema, out, checkpoint, max_files=8):
    stream = jobs.packet_stream(session, source, schema, max_files=max_files)
    ended = scorable(track(filters.tracked(stream), LIVE_TWO_WAY, DELAY), LIVE_TWO_WAY)
    return jobs.run_available(ended, out, checkpoint)


def folders(tmp_path):
    return [str(tmp_path / n) for n in ("in", "out", "checkpoint")]


def test_shuffled_files_and_restart(spark, packets, expected, tmp_path):
    """The second half arrives after the stream has stopped; the checkpoint carries the open flows."""
    session = jobs.stream_session(spark)
    source, out, checkpoint = folders(tmp_path)
    middle = packets.agg(F.expr("(min(ts_us) + max(ts_us)) DIV 2")).first()[0]
    write_slices(packets.where(F.col("ts_us") <= middle), source, 3, shuffled=True)
    run(session, source, packets.schema, out, checkpoint)
    first = spark.read.parquet(out).count()
    write_slices(packets.where(F.col("ts_us") > middle), source, 3, shuffled=True)
    write_tick(packets, source)
    run(session, source, packets.schema, out, checkpoint)
    assert 0 < first < len(expected)
    assert shape(spark.read.parquet(out)) == expected


def test_row_behind_the_watermark_is_dropped(spark, packets, expected, tmp_path):
    session = jobs.stream_session(spark)
    source, out, checkpoint = folders(tmp_path)
    write_slices(packets, source, 3)
    write_tick(packets, source)
    run(session, source, packets.schema, out, checkpoint)
    again = packets.where("src_ip NOT LIKE '239.%'").orderBy("ts_us").limit(5)
    again.write.mode("append").parquet(source)
    with jobs.ProgressTotals(session) as totals:
        run(session, source, packets.schema, out, checkpoint)
    assert shape(spark.read.parquet(out)) == expected
    kept = filters.tracked(again).count()
    assert totals.table().first()["rows_late"] == kept > 0


def test_totals_cover_more_micro_batches_than_spark_remembers(spark, tmp_path):
    source, out, checkpoint = folders(tmp_path)
    spark.range(150).repartition(150).write.parquet(source)
    session = jobs.stream_session(spark)
    stream = session.readStream.schema("id bigint").option("maxFilesPerTrigger", 1).parquet(source)
    with jobs.ProgressTotals(session) as totals:
        jobs.run_available(stream, out, checkpoint)
    row = totals.table().first()
    assert row["rows_read"] == 150 and row["batches"] > 100


def test_alert_sink_replaces_a_repeated_batch(spark, tmp_path):
    source, out, checkpoint = folders(tmp_path)
    spark.createDataFrame([("a",), ("b",)], "line string").write.parquet(source)
    stream = spark.readStream.schema("line string").parquet(source)
    jobs.alert_log_sink(stream, out, checkpoint)
    jobs.alert_log_sink(stream, out, str(tmp_path / "lost-checkpoint"))  # batch 0 once more
    assert sorted(r.value for r in spark.read.text(out).collect()) == ["a", "b"]


def stream_of(session, folder, schema, rows, files=1):
    """Adds rows to a folder, in so many files, and gives the stream over it."""
    session.createDataFrame(rows, schema).repartition(files).write.mode("append").parquet(folder)
    return session.readStream.schema(schema).parquet(folder)


FAR = 10**12


def test_asof_in_any_order_of_arrival(spark, tmp_path):
    """Names that come after the flows that ask, names of one moment, flows before any name, and a restart in between."""
    session = jobs.stream_session(spark)
    left, right, out, checkpoint = (str(tmp_path / n) for n in ("left", "right", "out", "checkpoint"))
    told = [(5_000_000, 1, "a", "one"), (9_000_000, 2, "a", "two"), (9_000_000, 3, "a", "three"), (30_000_000, 4, "a", None), (8_000_000, 5, "b", "other")]
    asks = [(i, k, t) for i, (k, t) in enumerate([("a", 4_999_999), ("a", 5_000_000), ("a", 8_999_999), ("a", 9_000_000), ("a", 29_000_000), ("a", 31_000_000), ("b", 7_000_000), ("b", 50_000_000), (None, 9_000_000), ("c", 9_000_000)])]
    expected = {0: None, 1: "one", 2: "one", 3: "three", 4: "three", 5: None, 6: None, 7: "other", 8: None, 9: None}
    asked_schema, told_schema = "i bigint, k string, ts_us bigint", "ts_us bigint, id bigint, k string, v string"
    for some_asks, some_told in (([asks[0], asks[7], asks[8]], told[3:]), (asks[1:7] + asks[9:], told[:3]), ([(99, "x", FAR)], [(FAR, 9, "x", "x")])):
        asked = stream_of(session, left, asked_schema, some_asks)
        names = stream_of(session, right, told_schema, some_told)
        jobs.run_available(ordered.asof(asked, names, "k", "id", ["v"], "100 seconds"), out, checkpoint)
    found = {r.i: (r.k, r.ts_us, r.v) for r in spark.read.parquet(out).collect()}
    assert found == {i: (k, t, expected[i]) for i, k, t in asks}


def test_asof_rows_that_only_move_time(spark, tmp_path):
    session = jobs.stream_session(spark)
    left, right, out, checkpoint = (str(tmp_path / n) for n in ("left", "right", "out", "checkpoint"))
    asked = stream_of(session, left, "i bigint, k string, ts_us bigint", [(1, "a", 5_000_000), (2, "a", FAR)])
    names = stream_of(session, right, "ts_us bigint, id bigint, k string, v string", [(1_000_000, 1, "a", "yes"), (2_000_000, 2, "a", "bad"), (FAR, 3, "z", "bad")])
    jobs.run_available(ordered.asof(asked, names, "k", "id", ["v"], "1 second", F.col("v") != "bad"), out, checkpoint)
    assert [(r.i, r.v) for r in spark.read.parquet(out).collect()] == [(1, "yes")]


def plain_cache(names, most, evict):
    held, out = [], []
    for step, name in enumerate(names, 1):
        if len(held) >= most:
            out += [(step, "evict", x) for x in held[:evict]]
            held = held[evict:]
        if name not in held:
            held.append(name)
            out.append((step, "put", name))
    return out


@pytest.mark.parametrize("most,evict", [(1, 1), (6, 2), (20, 5)])
def test_cache_evicts_the_oldest_across_restarts(spark, tmp_path, most, evict):
    import random

    session = jobs.stream_session(spark)
    source, out, checkpoint = folders(tmp_path)
    rng = random.Random(most)
    names = [f"n{int(rng.expovariate(0.12))}" for _ in range(300)]
    rows = [("c", 1_000_000 * (1 + i // 3), i, n) for i, n in enumerate(names)]
    schema = "cache string, ts_us bigint, id bigint, name string"
    for part in (rows[:170], rows[170:], [("tick", FAR, 0, "")]):
        rng.shuffle(part)
        jobs.run_available(ordered.bounded_cache(stream_of(session, source, schema, part, 3), most, evict, "100 seconds"), out, checkpoint)
    found = sorted(((r.step, r.op, r.name) for r in spark.read.parquet(out).where("cache = 'c'").collect()), key=lambda r: (r[0], r[1] == "put"))
    wanted = plain_cache(names, most, evict)
    assert sorted(found) == sorted(wanted)
    sizes = 0
    for _, op, _ in found:
        sizes += 1 if op == "put" else -1
        assert sizes <= most


def test_every_interface_falls_silent(spark, tmp_path):
    """No packet comes any more; the clock alone goes on, and each silent window is told once."""
    session = jobs.stream_session(spark)
    source, out, checkpoint = folders(tmp_path)
    ticks = str(tmp_path / "clock")
    sec = 1_000_000
    packets = [(t * sec, i) for t, i in ((5, "a"), (6, "a"), (40, "a"), (100, "a"), (35, "b"))]
    stream = stream_of(session, source, "ts_us bigint, iface string", packets)
    for tick in (1, 130, 150, 250, 251, 400):
        clock = stream_of(session, ticks, "ts_us bigint", [(tick * sec,)])
        jobs.run_available(jobs.rate_alarm(stream, clock, "10 seconds"), out, checkpoint)
    found = sorted((r.iface, r.window_us // sec, r.packets) for r in spark.read.parquet(out).collect())
    # a window is certain one width after its end: 390 s have passed, so windows up to 330 s are told
    quiet_a = [("a", w, 0) for w in (60, *range(120, 331, 30))]
    assert found == sorted([("a", 0, 2), ("a", 30, 1), ("a", 90, 1), ("b", 30, 1), *quiet_a, *(("b", w, 0) for w in range(60, 331, 30))])


def test_snapshots_merge_and_older_ones_go(spark, tmp_path):
    session = jobs.stream_session(spark)
    source, out, checkpoint = folders(tmp_path)
    schema = "ip string, ts_us bigint, mac string, iface string"
    for i in range(6):
        rows = [("10.0.0.1", 10 + i, "aa:bb:cc:dd:ee:01", "eth")] + ([(f"10.0.1.{i}", i, "", "")] if i % 2 else [])
        table = jobs.device_registry(stream_of(session, source, schema, rows))
        jobs.run_updates(table, out, checkpoint, ["ip"])
    table = {r.ip: (r.first_seen_us, r.last_seen_us, r.packets) for r in jobs.latest_rows(spark, out).collect()}
    assert table == {"10.0.0.1": (10, 15, 6), "10.0.1.1": (1, 1, 1), "10.0.1.3": (3, 3, 1), "10.0.1.5": (5, 5, 1)}
    kept = jobs._snapshots(spark, out)
    assert len(kept) == 2 and kept[-1] == 5


def test_a_repeated_batch_gives_the_same_snapshot(spark, tmp_path, monkeypatch):
    session = jobs.stream_session(spark)
    out = str(tmp_path / "out")
    written = []
    monkeypatch.setattr(jobs, "run_batches", lambda df, write, checkpoint, mode: written.append(write))
    jobs.run_updates(None, out, "", ["k"])
    batches = [[("a", 1), ("b", 1)], [("b", 2), (None, 5)], [("a", 3), (None, 6)]]
    for i, rows in enumerate(batches):
        batch = session.createDataFrame(rows, "k string, v int")
        written[0](batch, i)
        first = sorted(map(str, jobs.latest_rows(spark, out).collect()))
        written[0](batch, i)
        assert sorted(map(str, jobs.latest_rows(spark, out).collect())) == first
    assert {(r.k, r.v) for r in jobs.latest_rows(spark, out).collect()} == {("a", 3), ("b", 2), (None, 6)}


def test_backlog_falls_to_nothing(spark, tmp_path):
    session = jobs.stream_session(spark)
    source, out, checkpoint = folders(tmp_path)
    spark.range(90).repartition(9).write.parquet(source)
    stream = session.readStream.schema("id bigint").option("maxFilesPerTrigger", 4).parquet(source)
    jobs.run_available(stream, out, checkpoint)
    lag = jobs.file_backlog(spark, source, checkpoint).orderBy("batch_id").collect()
    assert [(r.files_taken, r.files_waiting) for r in lag] == [(4, 5), (4, 1), (1, 0)]
    assert lag[0].bytes_waiting == lag[1].bytes_taken + lag[2].bytes_taken and lag[-1].bytes_waiting == 0


def test_even_files_when_most_rows_lie_in_a_short_time(spark, tmp_path):
    from flowloom.plans.stream_queries import write_even_files

    times = [i % 100 for i in range(3000)] + list(range(100, 60_000, 200)) + [None] * 5
    df = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "pkt_id bigint, ts_us bigint").repartition(7)
    write_even_files(df, str(tmp_path / "in"), 6)
    written = spark.read.parquet(str(tmp_path / "in")).select("*", F.input_file_name().alias("file"))
    sizes = sorted(r["count"] for r in written.groupBy("file").count().collect())
    assert len(sizes) == 6 and sum(sizes) == len(times) and sizes[-1] <= 2 * len(times) / 6
    spans = sorted((r.lo, r.hi) for r in written.where("ts_us IS NOT NULL").groupBy("file").agg(F.min("ts_us").alias("lo"), F.max("ts_us").alias("hi")).collect())
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    write_even_files(df.limit(0), str(tmp_path / "none"), 6)
    assert spark.read.parquet(str(tmp_path / "none")).count() == 0


def packet_rows(session, packets, flows, start=0):
    """Packets of one way; flows: key number -> [(ts_us, length, flags)]."""
    zero = {"string": "", "boolean": False}
    rows, ids = [], iter(range(start, 10**9))
    for k, told in flows.items():
        for ts, length, flags in told:
            own = {"pkt_id": next(ids), "ts_us": ts, "src_ip": f"10.1.{k // 200}.{k % 200 + 1}", "dst_ip": "8.8.8.8", "proto": 6, "pkt_len": length, "tcp_flags": flags}
            rows.append(tuple(own.get(f.name, zero.get(f.dataType.simpleString(), 0)) for f in packets.schema))
    return session.createDataFrame(rows, packets.schema)


def plain_moments(values):
    """Mean of exact sums; deviation value by value, as a SQL engine takes it."""
    mean = m2 = 0.0
    for n, x in enumerate(values, 1):
        new = mean + (x - mean) / n
        m2 += (x - new) * (x - mean)
        mean = new
    return sum(values) / len(values), (m2 / len(values)) ** 0.5


def test_statistics_are_those_of_one_packet_after_the_other(spark, packets, tmp_path):
    """Bit for bit, over several micro-batches; the first packets come at the moment 0."""
    import random

    session = jobs.stream_session(spark)
    source, out, checkpoint = folders(tmp_path)
    rng, flows_of = random.Random(5), {}
    for k in range(40):
        times = [0] + sorted(rng.sample(range(1, 4_900_000), rng.randint(3, 60)))
        flows_of[k] = [(t, rng.randint(54, 1514), 1 if t == times[-1] else 16) for t in times]
    for lo, hi in ((0, 2_000_000), (2_000_000, 10**9)):
        packet_rows(session, packets, {k: [p for p in f if lo <= p[0] < hi] for k, f in flows_of.items()}, lo).write.mode("append").parquet(source)
        stream = jobs.packet_stream(session, source, packets.schema)
        jobs.run_available(track(stream, LIVE_TWO_WAY, "1 second"), out, checkpoint)
    write_tick(session.read.parquet(source), source)
    jobs.run_available(track(jobs.packet_stream(session, source, packets.schema), LIVE_TWO_WAY, "1 second"), out, checkpoint)
    found = {r.ip_a: r for r in spark.read.parquet(out).collect()}
    assert len(found) == len(flows_of)
    for k, f in flows_of.items():
        r, gaps = found[f"10.1.0.{k + 1}"], [b[0] - a[0] for a, b in zip(f, f[1:])]
        assert (r.seg_ts, r.last_us, r.n_pkts, r.status) == (0, f[-1][0], len(f), "closed")
        assert (r.pkt_len_mean, r.pkt_len_std) == plain_moments([p[1] for p in f])
        assert (r.flow_iat_mean, r.flow_iat_std) == plain_moments(gaps) and (r.flow_iat_max, r.fwd_iat_tot) == (max(gaps), sum(gaps))


def test_state_follows_the_groups_and_not_the_keys(spark, packets, tmp_path):
    session = jobs.stream_session(spark)
    source, out, checkpoint = folders(tmp_path)
    many = packet_rows(session, packets, {k: [(1_000_000 + k, 60, 16), (2_000_000 + k, 60, 16), (9_000_000, 60, 16), (50_000_000, 60, 16)] for k in range(900)})
    many.repartition(2).write.parquet(source)
    write_tick(many, source)
    stream = jobs.packet_stream(session, source, packets.schema, max_files=1)
    query = jobs.run_available(track(stream, LIVE_TWO_WAY, "100 seconds", groups=8), out, checkpoint)
    statuses = {r.status: r["count"] for r in spark.read.parquet(out).groupBy("status").count().collect()}
    assert statuses == {"closed": 900, "stale": 900}
    assert max(op.numRowsUpdated for p in query.recentProgress for op in p.stateOperators) <= 8 * 8


def test_asof_state_follows_the_groups_and_not_the_keys(spark, tmp_path):
    session = jobs.stream_session(spark)
    left, right, out, checkpoint = (str(tmp_path / n) for n in ("left", "right", "out", "checkpoint"))
    asked = stream_of(session, left, "i bigint, k string, ts_us bigint", [(i, f"k{i % 900}", 5_000_000 + i) for i in range(1800)] + [(-1, "x", FAR)])
    names = stream_of(session, right, "ts_us bigint, id bigint, k string, v string", [(1_000_000, i, f"k{i}", f"v{i}") for i in range(0, 900, 2)] + [(FAR, 9, "x", "x")])
    query = jobs.run_available(ordered.asof(asked, names, "k", "id", ["v"], "100 seconds", groups=8), out, checkpoint)
    found = {r.i: r.v for r in spark.read.parquet(out).collect()}
    assert found == {i: f"v{i % 900}" if i % 2 == 0 else None for i in range(1800)}
    assert max(op.numRowsUpdated for p in query.recentProgress for op in p.stateOperators) <= 8 * 8
