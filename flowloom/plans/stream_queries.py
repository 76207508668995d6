"""Stream queries. Each writes its input as files over time, runs the stream over them to the
end and returns what the stream wrote; checked against the batch result in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.constants import FLOW_FEATURES
from flowloom.operators import devices, filters, flows
from flowloom.operators.segments import KEY, LIVE
from flowloom.plans import device_queries as dq
from flowloom.plans import flow_sql
from flowloom.plans.catalog import query
from flowloom.plans.derived import OWN_MACS, TEST_SERVICES, with_views
from flowloom.plans.flow_queries import FLOW, rounded
from flowloom.streaming import jobs
from flowloom.streaming.ordered import LATER
from flowloom.streaming.tracker import scorable, track

SLICES = 6
# Files of one slice arrive in any order, so the delay covers a slice.
DELAY = "130 seconds"
# How long a clock runs on after the last packet.
CLOCK_GOES_ON = 3_600_000_000


def write_slices(df: DataFrame, folder: str, slices: int = SLICES, shuffled: bool = False) -> None:
    """Write rows as files in event-time order: one time slice after the other."""
    lo, hi = df.agg(F.min("ts_us"), F.max("ts_us")).first()
    width = (hi - lo) // slices + 1
    for i in range(slices):
        part = df.where(F.col("ts_us").between(lo + i * width, lo + (i + 1) * width - 1))
        part = part.repartition(F.hash("ts_us")) if shuffled else part
        part.write.mode("append").parquet(folder)


def write_even_files(df: DataFrame, folder: str, files: int) -> None:
    """Write rows as ``files`` files of nearly equal size, in event-time order; rows without a time go into the last.

    Many tasks read the table and the one that writes a file takes in no more than its rows.
    """
    cuts = df.approxQuantile("ts_us", [i / files for i in range(1, files)], 0.01)
    place = F.when(F.col("ts_us").isNull(), files - 1).otherwise(sum(((F.col("ts_us") > cut).cast("int") for cut in cuts), F.lit(0)))
    for i in range(files):
        df.where(place == i).repartition(1).write.mode("append").parquet(folder)


def write_tick(df: DataFrame, folder: str) -> None:
    """One last packet far in the future; it moves the watermark past all rows."""
    like = df.schema
    late = df.agg(F.max("ts_us").alias("m")).select((F.col("m") + 3_600_000_000).alias("ts_us"))
    values = {"pkt_id": F.lit(-1), "src_ip": F.lit("0.0.0.0"), "dst_ip": F.lit("0.0.0.0"), "ts_us": F.col("ts_us"), "iface": F.lit("tick")}
    zero = {"string": F.lit(""), "boolean": F.lit(False)}
    cells = [values.get(f.name, zero.get(f.dataType.simpleString(), F.lit(0))).cast(f.dataType).alias(f.name) for f in like]
    late.select(*cells).write.mode("append").parquet(folder)


def packet_source(spark: SparkSession, sf_dir: str, ticked: bool = True):
    """(session, stream of packets, output folder, checkpoint folder) over sliced packet files."""
    session = jobs.stream_session(spark)
    source, out, checkpoint = jobs.new_folders(spark, "in", "out", "checkpoint")
    rows = dq.packets(session, sf_dir)
    write_slices(rows, source)
    if ticked:
        write_tick(rows, source)
    return session, jobs.packet_stream(session, source, rows.schema), out, checkpoint


def ended_flows(spark: SparkSession, sf_dir: str) -> tuple[SparkSession, DataFrame, str, str]:
    session, stream, out, checkpoint = packet_source(spark, sf_dir)
    return session, track(filters.tracked(stream), LIVE, DELAY), out, checkpoint


_TRACKED_COLUMNS = [c for c in FLOW_FEATURES]


@query("stream_flow_tracker", flow_sql.flows(LIVE, _TRACKED_COLUMNS))
def stream_flow_tracker(spark, sf_dir):
    _, ended, out, checkpoint = ended_flows(spark, sf_dir)
    jobs.run_available(scorable(ended, LIVE), out, checkpoint)
    rows = flows.with_features(spark.read.parquet(out))
    return rounded(rows.select(*FLOW, *_TRACKED_COLUMNS))


@query(
    "stream_stale_eviction",
    with_views(
        "packets",
        f"WITH {flow_sql.segmented(LIVE)} SELECT {flow_sql.FLOW}, count(*) AS n_pkts FROM seg GROUP BY {flow_sql.FLOW} HAVING NOT bool_or(closes)",
        recursive=True,
    ),
)
def stream_stale_eviction(spark, sf_dir):
    """The tick outwaits every open flow, so all unclosed flows go stale."""
    _, ended, out, checkpoint = ended_flows(spark, sf_dir)
    jobs.run_available(ended.where("status = 'stale'"), out, checkpoint)
    return spark.read.parquet(out).select(*FLOW, "n_pkts")


@query("packet_stream", with_views("packets", "SELECT pkt_id, ts_us, src_ip, dst_ip FROM packets"))
def packet_stream(spark, sf_dir):
    session = jobs.stream_session(spark)
    source, out, checkpoint = jobs.new_folders(spark, "in", "out", "checkpoint")
    rows = dq.packets(session, sf_dir)
    write_slices(rows, source)
    stream = jobs.packet_stream(session, source, rows.schema, ip_only=True)
    jobs.run_available(stream.select("pkt_id", "ts_us", "src_ip", "dst_ip"), out, checkpoint)
    return spark.read.parquet(out)


@query("multi_iface_union", with_views("packets", "SELECT iface, count(*) AS packets, CAST(sum(pkt_len) AS BIGINT) AS bytes FROM packets GROUP BY iface"))
def multi_iface_union(spark, sf_dir):
    session = jobs.stream_session(spark)
    out, checkpoint, *sources = jobs.new_folders(spark, "out", "checkpoint", "in-wifi", "in-ethernet")
    rows = dq.packets(session, sf_dir)
    streams = {}
    for label, source in zip(("Wi-Fi", "Ethernet"), sources):
        own = rows.where(F.col("iface") == label).drop("iface")
        write_slices(own, source, 2)
        streams[label] = jobs.packet_stream(session, source, own.schema)
    jobs.run_available(jobs.union_ifaces(streams).select("iface", "pkt_len"), out, checkpoint)
    return spark.read.parquet(out).groupBy("iface").agg(F.count(F.lit(1)).alias("packets"), F.sum("pkt_len").alias("bytes"))


@query("alert_log_sink", dq._flow_views(dq.ALERT_SQL.replace("SELECT seg_id, '['", "SELECT '['")))
def alert_log_sink(spark, sf_dir):
    session = jobs.stream_session(spark)
    source, out, checkpoint = jobs.new_folders(spark, "in", "out", "checkpoint")
    dq.alert_lines(spark, sf_dir).write.parquet(source)
    stream = session.readStream.schema("seg_id bigint, line string").parquet(source)
    jobs.alert_log_sink(stream, out, checkpoint)
    return spark.read.text(out).select(F.col("value").alias("line"))


def _sighting_stream(spark: SparkSession, sf_dir: str):
    session, stream, out, checkpoint = packet_source(spark, sf_dir, ticked=False)
    return session, devices.packet_sightings(stream, OWN_MACS), out, checkpoint


_SIGHTS = f"""WITH sight AS (SELECT src_ip AS ip, {dq._LEARNED} AS mac, iface, ts_us FROM packets WHERE {flow_sql.TRACKED}
 UNION ALL SELECT dst_ip, '', iface, ts_us FROM packets WHERE {flow_sql.TRACKED})"""


@query("stream_new_device", with_views("packets", f"{_SIGHTS} SELECT DISTINCT ip FROM sight"))
def stream_new_device(spark, sf_dir):
    _, sightings, out, checkpoint = _sighting_stream(spark, sf_dir)
    jobs.run_available(jobs.new_devices(sightings), out, checkpoint)
    return spark.read.parquet(out)


@query(
    "stream_device_registry",
    with_views("packets", _SIGHTS + dq.REGISTRY_SQL[len(dq.SIGHT_SQL) :] + " SELECT * FROM registry"),
)
def stream_device_registry(spark, sf_dir):
    _, sightings, out, checkpoint = _sighting_stream(spark, sf_dir)
    jobs.run_updates(jobs.device_registry(sightings), out, checkpoint, ["ip"])
    return jobs.latest_rows(spark, out)


@query("stream_dns_cache", with_views("dns_answers", f"WITH {dq.NAMED_SQL}, {dq.SERVICES_SQL} SELECT * FROM services"))
def stream_dns_cache(spark, sf_dir):
    session = jobs.stream_session(spark)
    source, out, checkpoint = jobs.new_folders(spark, "in", "out", "checkpoint")
    rows = dq.answers(session, sf_dir)
    write_slices(rows, source, 3)
    stream = session.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    jobs.run_updates(jobs.dns_cache(stream, TEST_SERVICES), out, checkpoint, ["ip"])
    return jobs.latest_rows(spark, out)


_WINDOWS = f"""WITH {dq.FRAMES_SQL} SELECT ts_us - ts_us % 10000000 AS window_us, count(*) AS packets, count(*) FILTER (WHERE is_arp) AS arp,
 count(*) FILTER (WHERE is_ip) AS ip, count(*) FILTER (WHERE is_tracked) AS reached_tracker FROM frames GROUP BY 1"""


@query("stream_health", with_views("packets control_msgs", _WINDOWS))
def stream_health(spark, sf_dir):
    session = jobs.stream_session(spark)
    source, out, checkpoint = jobs.new_folders(spark, "in", "out", "checkpoint")
    rows = dq.frames(session, sf_dir)
    write_slices(rows, source)
    write_tick(rows, source)
    stream = session.readStream.schema(rows.schema).option("maxFilesPerTrigger", 8).parquet(source)
    jobs.run_available(jobs.health_windows(stream, DELAY), out, checkpoint)
    return spark.read.parquet(out)


@query(
    "stream_rate_alarm",
    with_views(
        "packets",
        """WITH p AS (SELECT * FROM packets WHERE NOT (iface = 'Wi-Fi' AND ts_us BETWEEN 20000000 AND 95000000)),
c AS (SELECT iface, ts_us - ts_us % 30000000 AS window_us, count(*) AS packets FROM p GROUP BY 1, 2),
i AS (SELECT iface, min(window_us) AS lo FROM c GROUP BY iface),
s AS (SELECT iface, window_us FROM i, (SELECT unnest(generate_series((SELECT min(window_us) FROM c), (SELECT max(window_us) FROM c), 30000000)) AS window_us) w WHERE window_us >= lo)
SELECT s.iface, s.window_us, coalesce(packets, 0) AS packets FROM s LEFT JOIN c ON c.iface = s.iface AND c.window_us = s.window_us""",
    ),
)
def stream_rate_alarm(spark, sf_dir):
    rows, found = _rates(spark, sf_dir, "iface = 'Wi-Fi' AND ts_us BETWEEN 20000000 AND 95000000")
    newest = rows.agg((F.max("ts_us") - F.max("ts_us") % 30_000_000).alias("newest"))
    return found.join(F.broadcast(newest), F.col("window_us") <= F.col("newest")).drop("newest")


def _rates(spark: SparkSession, sf_dir: str, quiet: str) -> tuple[DataFrame, DataFrame]:
    """The packets outside ``quiet``, and what the alarm gives for them under a clock that goes on for an hour after the last."""
    session = jobs.stream_session(spark)
    source, ticks, out, checkpoint = jobs.new_folders(spark, "in", "clock", "out", "checkpoint")
    rows = dq.packets(session, sf_dir).where(f"NOT ({quiet})")
    write_slices(rows, source)
    for tick in (F.min("ts_us"), F.max("ts_us") + CLOCK_GOES_ON):
        rows.agg(tick.alias("ts_us")).write.mode("append").parquet(ticks)
        stream = jobs.packet_stream(session, source, rows.schema)
        clock = session.readStream.schema("ts_us bigint").parquet(ticks)
        jobs.run_available(jobs.rate_alarm(stream, clock, DELAY), out, checkpoint)
    return rows, spark.read.parquet(out)


_OUTAGE = "ts_us >= 150000000"


@query(
    "stream_silence_alarm",
    with_views(
        "packets",
        f"""WITH p AS (SELECT * FROM packets WHERE NOT ({_OUTAGE})),
c AS (SELECT iface, ts_us - ts_us % 30000000 AS window_us, count(*) AS packets FROM p GROUP BY 1, 2),
s AS (SELECT iface, unnest(generate_series(lo, ((SELECT max(ts_us) FROM p) + {CLOCK_GOES_ON - 130_000_000}) // 30000000 * 30000000 - 60000000, 30000000)) AS window_us
 FROM (SELECT iface, min(window_us) AS lo FROM c GROUP BY iface) i)
SELECT s.iface, s.window_us, coalesce(packets, 0) AS packets FROM s LEFT JOIN c ON c.iface = s.iface AND c.window_us = s.window_us""",
    ),
)
def stream_silence_alarm(spark, sf_dir):
    """Every interface falls silent at once: the clock's timers tell it, up to the last window that is certain."""
    return _rates(spark, sf_dir, _OUTAGE)[1]


@query("stream_asof_dns_label", dq.ASOF_SQL)
def stream_asof_dns_label(spark, sf_dir):
    """Flows named by what DNS answers said when they ended, both as streams."""
    session = jobs.stream_session(spark)
    ended, told, out, checkpoint = jobs.new_folders(spark, "flows", "answers", "out", "checkpoint")
    closed = dq.scored_flows(session, sf_dir).select("seg_id", "dst_ip", F.col("end_us").alias("ts_us"))
    closed = dq.stored(session, closed, "flows")
    answers = dq.answers(session, sf_dir).withColumn("ts_us", F.col("ts_us") + LATER)
    closed = closed.withColumn("ts_us", F.col("ts_us") + LATER)
    write_slices(closed, ended)
    write_slices(answers, told, 3)
    for rows, folder in ((closed, ended), (answers, told)):
        write_tick(rows, folder)
    flow_stream = session.readStream.schema(closed.schema).option("maxFilesPerTrigger", 8).parquet(ended)
    answer_stream = session.readStream.schema(answers.schema).option("maxFilesPerTrigger", 8).parquet(told)
    named = jobs.asof_dns_label(flow_stream, answer_stream, "dst_ip", DELAY, TEST_SERVICES)
    jobs.run_available(named, out, checkpoint)
    return spark.read.parquet(out).select("seg_id", "dst_ip", "service")


CACHE_MOST, CACHE_EVICT = 20, 5
_CACHE_SQL = f"""WITH ev AS (SELECT row_number() OVER (ORDER BY ts_us, ans_id) AS step, ts_us, qname FROM dns_answers),
r AS (SELECT CAST(0 AS BIGINT) AS step, CAST([] AS VARCHAR[]) AS names, CAST([] AS VARCHAR[]) AS gone, FALSE AS fresh, CAST('' AS VARCHAR) AS name, CAST(0 AS BIGINT) AS ts_us
 UNION ALL
 SELECT step, CASE WHEN fresh THEN list_append(held, qname) ELSE held END, gone, fresh, qname, ts_us FROM (
  SELECT *, NOT list_contains(held, qname) AS fresh FROM (
   SELECT ev.step, ev.qname, ev.ts_us, CASE WHEN len(names) >= {CACHE_MOST} THEN names[{CACHE_EVICT + 1}:] ELSE names END AS held,
    CASE WHEN len(names) >= {CACHE_MOST} THEN names[:{CACHE_EVICT}] ELSE CAST([] AS VARCHAR[]) END AS gone
   FROM r JOIN ev ON ev.step = r.step + 1) h) f)
SELECT step, 'put' AS op, name, ts_us FROM r WHERE fresh
UNION ALL SELECT step, 'evict', unnest(gone), ts_us FROM r"""


@query("stream_bounded_cache", with_views("dns_answers", _CACHE_SQL, recursive=True))
def stream_bounded_cache(spark, sf_dir):
    """A name cache of limited size over the stream of DNS answers: what enters it and what it throws out."""
    session = jobs.stream_session(spark)
    source, out, checkpoint = jobs.new_folders(spark, "in", "out", "checkpoint")
    rows = dq.answers(session, sf_dir).select(F.lit("dns").alias("cache"), (F.col("ts_us") + LATER).alias("ts_us"), F.col("ans_id").alias("id"), F.col("qname").alias("name"))
    write_slices(rows, source, 3)
    write_tick(rows, source)
    stream = session.readStream.schema(rows.schema).option("maxFilesPerTrigger", 8).parquet(source)
    jobs.run_available(jobs.bounded_cache(stream, CACHE_MOST, CACHE_EVICT, DELAY), out, checkpoint)
    return spark.read.parquet(out).where("cache = 'dns'").select("step", "op", "name", (F.col("ts_us") - LATER).alias("ts_us"))


@query(
    "stream_backlog",
    with_views("packets", f"SELECT unnest(range(0, {SLICES})) AS batch_id, (SELECT count(*) FROM packets) AS rows_read, unnest(range({SLICES - 1}, -1, -1)) AS files_waiting"),
)
def stream_backlog(spark, sf_dir):
    """What waits while a stream catches up at one file per micro-batch, down to nothing."""
    session = jobs.stream_session(spark)
    source, out, checkpoint = jobs.new_folders(spark, "in", "out", "checkpoint")
    rows = dq.packets(session, sf_dir)
    write_even_files(rows, source, SLICES)
    stream = jobs.packet_stream(session, source, rows.schema, max_files=1)
    with jobs.ProgressTotals(session) as totals:
        jobs.run_available(stream.select("pkt_id"), out, checkpoint)
    read = totals.table().select("rows_read")
    return jobs.file_backlog(spark, source, checkpoint).select("batch_id", "files_waiting").join(F.broadcast(read), F.lit(True))


@query("stream_backpressure", with_views("packets", "SELECT count(*) AS rows_read, CAST(0 AS BIGINT) AS rows_late FROM packets"))
def stream_backpressure(spark, sf_dir):
    """The rate limit delays rows and never loses one: rows read over all micro-batches."""
    session = jobs.stream_session(spark)
    source, out, checkpoint = jobs.new_folders(spark, "in", "out", "checkpoint")
    rows = dq.packets(session, sf_dir)
    write_slices(rows, source)
    stream = jobs.packet_stream(session, source, rows.schema, max_files=2)
    with jobs.ProgressTotals(session) as totals:
        jobs.run_available(stream.select("pkt_id"), out, checkpoint)
    return totals.table().select("rows_read", "rows_late")


@query(
    "late_data",
    with_views(
        "packets",
        """SELECT ts_us - ts_us % 10000000 AS window_us, count(*) AS packets,
 (SELECT count(*) FROM packets WHERE ts_us < 50000000) AS rows_late FROM packets GROUP BY 1""",
    ),
)
def late_data(spark, sf_dir):
    """Rows of the first 50 s come again at the very end: behind the watermark, dropped, counted."""
    session = jobs.stream_session(spark)
    source, out, checkpoint = jobs.new_folders(spark, "in", "out", "checkpoint")
    rows = dq.packets(session, sf_dir)
    write_slices(rows, source)
    write_tick(rows, source)
    rows.where("ts_us < 50000000").write.mode("append").parquet(source)
    # One group of files at a time, so that the repeated rows come after the watermark has moved.
    stream = jobs.packet_stream(session, source, rows.schema, max_files=1)
    counted = jobs.windowed(stream, 10, DELAY, rows_at=F.count(F.lit(1)))
    with jobs.ProgressTotals(session) as totals:
        jobs.run_available(counted.withColumnRenamed("rows_at", "packets"), out, checkpoint)
    # Spark counts late rows after partial aggregation; packets are counted as read less counted
    # in windows, less the tick, whose window never ends.
    windows = spark.read.parquet(out)
    read = totals.table().select(F.col("rows_read").alias("read"))
    late = read.join(windows.agg(F.sum("packets").alias("kept")), F.lit(True)).selectExpr("read - kept - 1 AS rows_late")
    return windows.join(F.broadcast(late), F.lit(True))
