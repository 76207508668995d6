"""Health counters and interface rates over fixed windows.

The window tables have one row per window (or window and interface). Totals over them are summed by blocks of
windows, so that neither packets nor windows meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.operators.timeline import previous, running_sums
from flowloom.session import scratch_dir

HEALTH_US = 10_000_000
RATE_US = 30_000_000
#: Windows that are ordered in one task.
SPAN = 512


def window_start(ts: Column, width: int) -> Column:
    return ts - F.pmod(ts, F.lit(width))


def _stored(rows: DataFrame, name: str) -> DataFrame:
    path = scratch_dir(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _spine(starts: DataFrame, width: int) -> DataFrame:
    """Every window from the first to the last of a stored table; their two ends pass through the driver."""
    lo, hi = starts.agg(F.min("window_us"), F.max("window_us")).first()
    ends = (0, 0) if lo is None else (lo, hi + width)
    return starts.sparkSession.range(*ends, width).withColumnRenamed("id", "window_us")


def health_counters(frames: DataFrame, flow_spans: DataFrame, first_seen: DataFrame, width: int = HEALTH_US) -> DataFrame:
    """One row per window: new packets by kind, all packets so far, open flows, devices so far.

    frames: ts_us, is_arp, is_ip, is_tracked. flow_spans: open_us, end_us. first_seen: ts_us.
    Nothing is dropped here, so that counter is 0.
    """
    start = window_start(F.col("ts_us"), width).alias("window_us")
    counts = frames.groupBy(start).agg(
        F.count(F.lit(1)).alias("packets"),
        F.count_if("is_arp").alias("arp"),
        F.count_if("is_ip").alias("ip"),
        F.count_if("is_tracked").alias("reached_tracker"),
    )
    steps = F.array(F.struct(F.col("open_us").alias("at"), F.lit(1).alias("d")), F.struct(F.col("end_us").alias("at"), F.lit(-1).alias("d")))
    moves = (
        flow_spans.select(F.inline(steps))
        .groupBy(window_start(F.col("at"), width).alias("window_us"))
        .agg(F.sum("d").alias("flow_moves"))
    )
    devices = first_seen.groupBy(start).agg(F.count(F.lit(1)).alias("new_devices"))
    counts = _stored(counts, "window-counts")
    rows = (
        _spine(counts, width)
        .join(counts, "window_us", "left")
        .join(moves, "window_us", "left")
        .join(devices, "window_us", "left")
        .na.fill(0)
    )
    totals = {"total_packets": "packets", "active_flows": "flow_moves", "devices": "new_devices"}
    summed = running_sums(_stored(rows, "windows"), "window_us", SPAN * width, totals)
    return summed.select("window_us", "packets", "arp", "ip", "reached_tracker", *totals, F.lit(0).cast("bigint").alias("dropped"))


def counter_delta(snapshots: DataFrame, columns: list[str], order: str = "window_us", span: int = SPAN * HEALTH_US) -> DataFrame:
    """Counter values minus those of the snapshot before (the first counts from 0)."""
    found = previous(snapshots, order, span, {f"_p_{c}": c for c in columns})
    deltas = {f"d_{c}": F.col(c) - F.coalesce(f"_p_{c}", F.lit(0)) for c in columns}
    return found.withColumns(deltas).drop(*(f"_p_{c}" for c in columns))


def iface_rate(packets: DataFrame, width: int = RATE_US) -> DataFrame:
    """Packets per interface and window, silent windows included and marked."""
    counts = packets.groupBy("iface", window_start(F.col("ts_us"), width).alias("window_us")).agg(
        F.count(F.lit(1)).alias("packets")
    )
    # One row: the few interface names and the time range.
    frame = counts.agg(F.collect_set("iface").alias("ifaces"), F.min("window_us").alias("lo"), F.max("window_us").alias("hi"))
    spine = frame.where("lo IS NOT NULL").select(
        F.explode("ifaces").alias("iface"), F.sequence("lo", "hi", F.lit(width).cast("bigint")).alias("windows")
    ).select("iface", F.explode("windows").alias("window_us"))
    rows = spine.join(counts, ["iface", "window_us"], "left").na.fill(0, ["packets"])
    return rows.withColumn("is_silent", F.col("packets") == 0)
