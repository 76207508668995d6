"""Flow statistics: plain 5-tuple groups, and the 78 features of closed flows.

Every aggregate keeps fixed-width buffers, so Spark combines map-side in hash tables and a
flow is never held as a list of packets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.constants import FLOW_FEATURES
from flowloom.functions.numeric import safe_ratio
from flowloom.operators.segments import KEY, FlowRules, segment, with_flow_key

FLOW_ID = (*KEY, "seg_ts", "seg_id")
IDLE_US = 1_000_000


def _zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0))


def _count(condition: Column) -> Column:
    return F.sum(F.when(condition, F.lit(1)).otherwise(F.lit(0)).cast("bigint"))


def _header_len() -> Column:
    """TCP header bytes; a missing or zero data offset counts as five words."""
    return F.when(F.col("proto") == 6, F.coalesce(F.nullif("tcp_dataofs", F.lit(0)), F.lit(5)) * 4).cast("bigint")


def _spread(prefix: str, value: Column, names: dict[str, str]) -> dict[str, Column]:
    """max/min/mean/std columns of a series, 0 when it is empty; ``names`` picks and names them."""
    forms = {
        "max": _zero(F.max(value)),
        "min": _zero(F.min(value)),
        "mean": _zero(F.avg(value)),
        "std": _zero(F.stddev_pop(value)),
        "tot": _zero(F.sum(value)),
    }
    return {f"{prefix}_{name}": forms[form] for form, name in names.items()}


_FIVE = {"tot": "tot", "mean": "mean", "std": "std", "max": "max", "min": "min"}
_FOUR = {"mean": "mean", "std": "std", "max": "max", "min": "min"}


# Packet columns the statistics below read.
FLOW_COLUMNS = ("pkt_len", "tcp_flags", "tcp_window", "tcp_dataofs", "tcp_payload_len", "iface")


def flow_rows(segmented: DataFrame) -> DataFrame:
    """One row per flow, closed or not, with counters, moments and ``status``."""
    fwd, bwd = F.col("fwd"), ~F.col("fwd")
    length, gap, dgap = F.col("pkt_len"), F.col("gap_us"), F.col("dgap_us")
    flags = F.coalesce(F.col("tcp_flags"), F.lit(0))

    def flag(mask: int) -> Column:
        return flags.bitwiseAND(F.lit(mask)) != 0

    opens = gap.isNull()
    hdr = _header_len()
    aggs = {
        "n_pkts": F.count(F.lit(1)),
        "closed": F.bool_or("closes"),
        "closed_by_flag": F.bool_or("flag_close"),
        "reached_end": F.bool_or("is_last"),
        "opened_from_a": F.bool_or(opens & F.col("from_a")),
        "first_us": F.min("ts_us"),
        "last_us": F.max("ts_us"),
        # as a number: with text among them Spark would sort all packets to aggregate them
        "iface_hash": F.min(F.when(opens & F.col("iface").isNotNull(), F.xxhash64("iface"))),
        "tot_fwd_pkts": _count(fwd),
        "tot_bwd_pkts": _count(bwd),
        "totlen_fwd_pkts": _zero(F.sum(F.when(fwd, length))),
        "totlen_bwd_pkts": _zero(F.sum(F.when(bwd, length))),
        "fwd_header_len": _zero(F.sum(F.when(fwd, hdr))),
        "bwd_header_len": _zero(F.sum(F.when(bwd, hdr))),
        "fwd_psh_flags": _count(fwd & flag(8)),
        "bwd_psh_flags": _count(bwd & flag(8)),
        "fwd_urg_flags": _count(fwd & flag(32)),
        "bwd_urg_flags": _count(bwd & flag(32)),
        # The first packet of a direction is the one without an earlier packet of it.
        "init_fwd_win_byts": _zero(F.max(F.when(fwd & dgap.isNull(), F.col("tcp_window"))).cast("bigint")),
        "init_bwd_win_byts": _zero(F.max(F.when(bwd & dgap.isNull(), F.col("tcp_window"))).cast("bigint")),
        "fwd_act_data_pkts": _count(fwd & (F.coalesce(F.col("tcp_payload_len"), F.lit(0)) > 0)),
        **_spread("fwd_pkt_len", F.when(fwd, length), _FOUR),
        **_spread("bwd_pkt_len", F.when(bwd, length), _FOUR),
        **_spread("pkt_len", length, _FOUR),
        "pkt_len_var": _zero(F.var_pop(length)),
        **_spread("flow_iat", gap, _FOUR),
        **_spread("fwd_iat", F.when(fwd, dgap), _FIVE),
        **_spread("bwd_iat", F.when(bwd, dgap), _FIVE),
        "fin_flag_cnt": _count(flag(1)),
        "syn_flag_cnt": _count(flag(2)),
        "rst_flag_cnt": _count(flag(4)),
        "psh_flag_cnt": _count(flag(8)),
        "ack_flag_cnt": _count(flag(16)),
        "urg_flag_cnt": _count(flag(32)),
        "cwe_flag_count": _count(flag(128)),
        "ece_flag_cnt": _count(flag(64)),
        **_spread("active", F.when(gap <= IDLE_US, gap), _FOUR),
        **_spread("idle", F.when(gap > IDLE_US, gap), _FOUR),
    }
    rows = segmented.groupBy(*FLOW_ID).agg(*[c.alias(n) for n, c in aggs.items()])
    status = F.when(F.col("closed"), "closed").when(F.col("reached_end"), "open").otherwise("stale")
    return rows.withColumn("status", status)


def with_features(rows: DataFrame) -> DataFrame:
    """Add the features that follow from the counters of a flow row."""
    duration = F.greatest(F.col("last_us") - F.col("first_us"), F.lit(1))
    seconds = F.col("flow_duration") / F.lit(1e6)
    zero = F.lit(0).cast("bigint")
    n, size = F.col("tot_fwd_pkts") + F.col("tot_bwd_pkts"), F.col("totlen_fwd_pkts") + F.col("totlen_bwd_pkts")
    bulk = "fwd_byts_per_bulk_avg fwd_pkts_per_bulk_avg fwd_blk_rate_avg bwd_byts_per_bulk_avg bwd_pkts_per_bulk_avg bwd_blk_rate_avg"
    return rows.withColumn("flow_duration", duration).withColumns(
        {
            "dst_port": F.col("port_b"),
            "service_port": F.when(F.col("opened_from_a"), F.col("port_b")).otherwise(F.col("port_a")),
            "protocol": F.col("proto"),
            "down_up_ratio": safe_ratio(F.col("tot_bwd_pkts"), F.col("tot_fwd_pkts")),
            "pkt_size_avg": safe_ratio(size, n),
            **{name: zero for name in bulk.split()},
            "fwd_seg_size_avg": F.col("fwd_pkt_len_mean"),
            "bwd_seg_size_avg": F.col("bwd_pkt_len_mean"),
            "fwd_seg_size_min": F.col("fwd_pkt_len_min"),
            "flow_byts_per_s": size / seconds,
            "flow_pkts_per_s": n / seconds,
            "fwd_pkts_per_s": F.col("tot_fwd_pkts") / seconds,
            "bwd_pkts_per_s": F.col("tot_bwd_pkts") / seconds,
            "subflow_fwd_pkts": F.col("tot_fwd_pkts"),
            "subflow_fwd_byts": F.col("totlen_fwd_pkts"),
            "subflow_bwd_pkts": F.col("tot_bwd_pkts"),
            "subflow_bwd_byts": F.col("totlen_bwd_pkts"),
            "total_packets": F.col("n_pkts"),
            "total_bytes": size,
        }
    )


def closed_flows(packets: DataFrame, rules: FlowRules, iface: bool = False) -> DataFrame:
    """Packets -> scored-ready flows: closed, with at least ``min_packets``, all features; on request
    with ``iface``, the interface of the first packet."""
    rows = flow_rows(segment(packets, rules, FLOW_COLUMNS))
    kept = with_features(rows.where(F.col("closed") & (F.col("n_pkts") >= rules.min_packets)))
    return _named_iface(kept, packets) if iface else kept.drop("iface_hash")


def closed_ends(packets: DataFrame, rules: FlowRules, iface: bool = False) -> DataFrame:
    """The flows of ``closed_flows`` without their statistics: id, ``n_pkts``, ``last_us`` and on request the interface.

    Nothing but times and flags passes through the walk.
    """
    segmented = segment(packets, rules, ["iface"] if iface else [], gaps=False)
    opens = (F.col("ts_us") == F.col("seg_ts")) & (F.col("pkt_id") == F.col("seg_id"))
    first_iface = F.min(F.when(opens & F.col("iface").isNotNull(), F.xxhash64("iface"))).alias("iface_hash") if iface else None
    aggs = [F.count(F.lit(1)).alias("n_pkts"), F.bool_or("closes").alias("closed"), F.max("ts_us").alias("last_us"), *([first_iface] if iface else [])]
    rows = segmented.groupBy(*FLOW_ID).agg(*aggs)
    kept = rows.where(F.col("closed") & (F.col("n_pkts") >= rules.min_packets)).drop("closed")
    return _named_iface(kept, packets) if iface else kept


def _named_iface(rows: DataFrame, packets: DataFrame) -> DataFrame:
    """The names of ``iface_hash``: the few interfaces of the packets."""
    known = packets.where("iface IS NOT NULL").select("iface").distinct().select(F.xxhash64("iface").alias("iface_hash"), "iface")
    return rows.join(known, "iface_hash", "left").drop("iface_hash")


def flow_features(packets: DataFrame, rules: FlowRules) -> DataFrame:
    """The flow id and its 78 features under the engine's column names."""
    return closed_flows(packets, rules).select(*FLOW_ID, *FLOW_FEATURES)


def with_cic_names(features: DataFrame) -> DataFrame:
    """Feature columns under the names of the 2018 flow files."""
    return features.withColumnsRenamed(FLOW_FEATURES)


def with_flag_rates(rows: DataFrame) -> DataFrame:
    """Documented totals per second: SYN, RST and ACK packets over the flow's duration."""
    seconds = F.col("flow_duration") / F.lit(1e6)
    return rows.withColumns({f"{f}_rate": F.col(f"{f}_flag_cnt") / seconds for f in ("syn", "rst", "ack")})


def unique_dst_ports(segmented: DataFrame) -> DataFrame:
    """Distinct destination ports of the TCP and UDP packets of each flow."""
    port = F.when(F.col("proto").isin(6, 17), F.col("dport"))
    return segmented.groupBy(*FLOW_ID).agg(F.count_distinct(port).alias("unique_dst_ports"))


_CAPTURE_RULES = FlowRules(key="directed", ports=(6, 17))


def capture_flows(packets: DataFrame) -> DataFrame:
    """Whole-capture 5-tuple groups as the capture-file converter makes them.

    Duration is last minus first packet in file order, in seconds; nothing is backward.
    """
    length = F.col("pkt_len")
    grouped = (
        with_flow_key(packets.where(F.col("src_ip").isNotNull()), _CAPTURE_RULES)
        .groupBy(*KEY)
        .agg(
            F.count(F.lit(1)).alias("tot_fwd_pkts"),
            F.sum(length).alias("totlen_fwd_pkts"),
            F.max(length).alias("pkt_len_max"),
            F.min(length).alias("pkt_len_min"),
            F.avg(length).alias("pkt_len_mean"),
            F.stddev_pop(length).alias("pkt_len_std"),
            F.var_pop(length).alias("pkt_len_var"),
            (F.max_by("ts_us", "pkt_id") - F.min_by("ts_us", "pkt_id")).alias("span_us"),
        )
    )
    return grouped.withColumn("flow_duration_s", F.col("span_us") / F.lit(1e6)).drop("span_us")


def capture_feature_row(grouped: DataFrame) -> DataFrame:
    """The converter's full row: lengths and counts filled, every other feature 0, label BENIGN."""
    copies = {
        "dst_port": "port_b", "protocol": "proto", "flow_duration": "flow_duration_s",
        "tot_fwd_pkts": "tot_fwd_pkts", "totlen_fwd_pkts": "totlen_fwd_pkts",
        "subflow_fwd_pkts": "tot_fwd_pkts", "subflow_fwd_byts": "totlen_fwd_pkts",
        "fwd_pkt_len_max": "pkt_len_max", "fwd_pkt_len_min": "pkt_len_min",
        "fwd_pkt_len_mean": "pkt_len_mean", "fwd_pkt_len_std": "pkt_len_std",
        "pkt_len_max": "pkt_len_max", "pkt_len_min": "pkt_len_min", "pkt_len_mean": "pkt_len_mean",
        "pkt_len_std": "pkt_len_std", "pkt_len_var": "pkt_len_var", "pkt_size_avg": "pkt_len_mean",
        "fwd_seg_size_avg": "pkt_len_mean", "fwd_seg_size_min": "pkt_len_min",
    }
    columns = [(F.col(copies[c]) if c in copies else F.lit(0).cast("bigint")).alias(c) for c in FLOW_FEATURES]
    return constant_label(grouped.select(*columns))


def constant_label(rows: DataFrame, label: str = "BENIGN") -> DataFrame:
    return rows.withColumn("Label", F.lit(label))


def capture_flows_min(packets: DataFrame) -> DataFrame:
    """Six columns and the label."""
    return constant_label(
        with_flow_key(packets.where(F.col("src_ip").isNotNull()), _CAPTURE_RULES)
        .groupBy(*KEY)
        .agg(F.count(F.lit(1)).alias("tot_fwd_pkts"), F.sum("pkt_len").alias("totlen_fwd_pkts"))
        .select(
            *KEY,
            F.col("port_b").alias("dst_port"),
            F.col("proto").alias("protocol"),
            "tot_fwd_pkts",
            F.lit(0).cast("bigint").alias("tot_bwd_pkts"),
            "totlen_fwd_pkts",
            F.lit(0).cast("bigint").alias("totlen_bwd_pkts"),
        )
    )


def legacy_values(segmented: DataFrame, ttl: Column) -> DataFrame:
    """The eleven positional values of the first version, per flow."""
    first = F.col("gap_us").isNull()
    rows = segmented.groupBy(*FLOW_ID).agg(
        F.max(F.when(first, F.col("pkt_len") - 14)).alias("ip_len"),
        F.max(F.when(first, ttl)).alias("ttl"),
        F.max(F.when(first, F.when(F.col("proto").isin(6, 17), F.col("sport")).otherwise(0))).alias("sport"),
        F.max(F.when(first, F.when(F.col("proto").isin(6, 17), F.col("dport")).otherwise(0))).alias("dport"),
        F.count(F.lit(1)).alias("n_pkts"),
        F.sum("pkt_len").alias("total_bytes"),
        F.avg("pkt_len").alias("len_mean"),
        F.max("pkt_len").alias("len_max"),
        F.min("pkt_len").alias("len_min"),
        F.greatest(F.max("ts_us") - F.min("ts_us"), F.lit(1)).alias("span_us"),
        F.bool_or("closes").alias("closed"),
    )
    seconds = F.col("span_us") / F.lit(1e6)
    return rows.withColumns(
        {"byts_per_s": F.col("total_bytes") / seconds, "pkts_per_s": F.col("n_pkts") / seconds}
    ).drop("span_us")


def pad_or_trim(values: Column, size: int) -> Column:
    """Positional values padded with 0.0 or cut to ``size``."""
    return F.slice(F.concat(values, F.array_repeat(F.lit(0.0), size)), 1, size)
