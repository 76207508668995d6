"""Flow queries: keys, segmentation, per-flow statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.constants import FLOW_FEATURES
from flowloom.operators import filters, flows
from flowloom.operators.segments import KEY, LIVE, LIVE_TWO_WAY, VERSION_0, VERSION_1, FlowRules, segment, with_flow_key
from flowloom.plans import flow_sql as sql
from flowloom.plans.catalog import query
from flowloom.plans.derived import derive, with_views

FLOW = [*KEY, "seg_ts", "seg_id"]


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, "packets")


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to four digits, so that results compare across engines."""
    return df.select(*[F.round(c, 4).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def closed(spark: SparkSession, sf_dir: str, rules: FlowRules = LIVE_TWO_WAY) -> DataFrame:
    return flows.closed_flows(filters.tracked(packets(spark, sf_dir)), rules)


def _feature_query(name: str, columns: list[str], rules: FlowRules = LIVE_TWO_WAY) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = flows.with_flag_rates(closed(spark, sf_dir, rules))
        return rounded(rows.select(*FLOW, *columns))

    query(name, sql.flows(rules, columns))(run)


def _starting(*prefixes: str) -> list[str]:
    return [c for c in FLOW_FEATURES if c.startswith(prefixes)]


_feature_query("flow_features", list(FLOW_FEATURES))
_feature_query("flow_features_directed", list(FLOW_FEATURES), LIVE)
_feature_query(
    "flow_counts",
    ["tot_fwd_pkts", "tot_bwd_pkts", "totlen_fwd_pkts", "totlen_bwd_pkts", "down_up_ratio", "pkt_size_avg"] + _starting("subflow_"),
)
_feature_query("flow_len_stats", _starting("fwd_pkt_len", "bwd_pkt_len", "pkt_len"))
_feature_query("flow_iat_stats", _starting("flow_iat", "fwd_iat", "bwd_iat"))
_feature_query("flow_active_idle", _starting("active_", "idle_"))
_feature_query("flow_rates", ["flow_byts_per_s", "flow_pkts_per_s", "fwd_pkts_per_s", "bwd_pkts_per_s"])
_feature_query(
    "flow_flag_counts",
    [c for c in FLOW_FEATURES if "_flag_c" in c] + ["fwd_psh_flags", "bwd_psh_flags", "fwd_urg_flags", "bwd_urg_flags"],
)
_feature_query("flow_header_len", ["fwd_header_len", "bwd_header_len"])
_feature_query("flow_init_window", ["init_fwd_win_byts", "init_bwd_win_byts"])
_feature_query("flow_act_data_pkts", ["fwd_act_data_pkts"])
_feature_query("flow_seg_size", ["fwd_seg_size_avg", "bwd_seg_size_avg", "fwd_seg_size_min"])
_feature_query(
    "flow_totals_flag_rates", ["total_packets", "total_bytes", "syn_rate", "rst_rate", "ack_rate", "service_port"]
)
_feature_query("to_micros", ["flow_duration", "flow_iat_mean", "fwd_iat_tot", "active_max", "idle_max"])
_feature_query("zero_features", [c for c in FLOW_FEATURES if "_bulk_" in c or "_blk_" in c])


_V1_PORTS = with_views(
    "packets",
    f"WITH {sql.segmented(VERSION_1, 'src_ip IS NOT NULL')} SELECT {sql.FLOW}, "
    f"{sql.EXTRA_SQL['unique_dst_ports']} AS unique_dst_ports FROM seg GROUP BY {sql.FLOW}",
    recursive=True,
)


@query("flow_unique_dst_ports", _V1_PORTS)
def flow_unique_dst_ports(spark, sf_dir):
    return flows.unique_dst_ports(segment(filters.ip_only(packets(spark, sf_dir)), VERSION_1))


def _status_query(name: str, rules: FlowRules, tracked: bool = True, only: str | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        kept = packets(spark, sf_dir)
        kept = filters.tracked(kept) if tracked else filters.drop_multicast(filters.ip_only(kept)) if rules is VERSION_0 else kept
        rows = flows.flow_rows(segment(kept, rules, flows.FLOW_COLUMNS))
        rows = rows.where(F.col("status") == only) if only else rows
        return rows.select(*FLOW, "n_pkts", "closed_by_flag", "status")

    where = sql.TRACKED if tracked else sql.NOT_MULTICAST if rules is VERSION_0 else "src_ip IS NOT NULL"
    having = "HAVING NOT bool_or(closes) AND NOT bool_or(is_last)" if only == "stale" else ""
    query(name, sql.flow_status(rules, where, having))(run)


_status_query("flow_segment_live", LIVE)
_status_query("flow_segment_live_two_way", LIVE_TWO_WAY)
_status_query("flow_segment_v1", VERSION_1, tracked=False)
_status_query("flow_segment_v0", VERSION_0, tracked=False)
_status_query("stale_flows", LIVE, only="stale")
# FIN and RST alone: the time rules set beyond any capture.
_FLAGS_ONLY = FlowRules(key="canonical", close_us=10**15, stale_us=None, min_packets=1)
_status_query("flow_segment_flags", _FLAGS_ONLY)


@query(
    "filter_min_packets",
    with_views(
        "packets",
        f"WITH {sql.segmented(LIVE)} SELECT {sql.FLOW}, count(*) AS n_pkts FROM seg GROUP BY {sql.FLOW} "
        "HAVING bool_or(closes) AND count(*) >= 3",
        recursive=True,
    ),
)
def filter_min_packets(spark, sf_dir):
    return closed(spark, sf_dir, LIVE).select(*FLOW, "n_pkts")



@query(
    "packet_gaps",
    with_views("packets", f"WITH {sql.segmented(LIVE_TWO_WAY)} SELECT pkt_id, gap_us, dgap_us FROM seg", recursive=True),
)
def packet_gaps(spark, sf_dir):
    return segment(filters.tracked(packets(spark, sf_dir)), LIVE_TWO_WAY).select("pkt_id", "gap_us", "dgap_us")


@query(
    "flow_direction",
    with_views("packets", f"WITH {sql.segmented(LIVE_TWO_WAY)} SELECT pkt_id, seg_id, fwd FROM seg", recursive=True),
)
def flow_direction(spark, sf_dir):
    return segment(filters.tracked(packets(spark, sf_dir)), LIVE_TWO_WAY).select("pkt_id", "seg_id", "fwd")


@query("flow_key", with_views("packets", f"WITH {sql.keyed(LIVE, 'src_ip IS NOT NULL')} SELECT pkt_id, {sql.KEYS} FROM keyed"))
def flow_key(spark, sf_dir):
    return with_flow_key(filters.ip_only(packets(spark, sf_dir)), LIVE).select("pkt_id", *KEY)


@query(
    "canonical_key", with_views("packets", f"WITH {sql.keyed(VERSION_1, 'src_ip IS NOT NULL')} SELECT pkt_id, {sql.KEYS} FROM keyed")
)
def canonical_key(spark, sf_dir):
    return with_flow_key(filters.ip_only(packets(spark, sf_dir)), VERSION_1).select("pkt_id", *KEY)


_CAPTURE = sql.keyed(VERSION_0, "src_ip IS NOT NULL")


@query(
    "flow_agg_pcap",
    with_views(
        "packets",
        f"""WITH {_CAPTURE} SELECT {sql.KEYS}, count(*) AS tot_fwd_pkts, CAST(sum(pkt_len) AS BIGINT) AS totlen_fwd_pkts,
 max(pkt_len) AS pkt_len_max, min(pkt_len) AS pkt_len_min, round(avg(pkt_len), 4) AS pkt_len_mean,
 round(stddev_pop(pkt_len), 4) AS pkt_len_std, round(var_pop(pkt_len), 4) AS pkt_len_var,
 round((arg_max(ts_us, pkt_id) - arg_min(ts_us, pkt_id)) / 1e6::DOUBLE, 4) AS flow_duration_s
FROM keyed GROUP BY {sql.KEYS}""",
    ),
)
def flow_agg_pcap(spark, sf_dir):
    return rounded(flows.capture_flows(packets(spark, sf_dir)))


@query(
    "flow_agg_min",
    with_views(
        "packets",
        f"""WITH {_CAPTURE} SELECT {sql.KEYS}, port_b AS dst_port, proto AS protocol, count(*) AS tot_fwd_pkts,
 CAST(0 AS BIGINT) AS tot_bwd_pkts, CAST(sum(pkt_len) AS BIGINT) AS totlen_fwd_pkts, CAST(0 AS BIGINT) AS totlen_bwd_pkts,
 'BENIGN' AS "Label" FROM keyed GROUP BY {sql.KEYS}""",
    ),
)
def flow_agg_min(spark, sf_dir):
    return flows.capture_flows_min(packets(spark, sf_dir))


_CAPTURE_COPIES = {
    "dst_port": "port_b",
    "protocol": "min(proto)",
    "flow_duration": "round((arg_max(ts_us, pkt_id) - arg_min(ts_us, pkt_id)) / 1e6::DOUBLE, 4)",
    **dict.fromkeys(("tot_fwd_pkts", "subflow_fwd_pkts"), "count(*)"),
    **dict.fromkeys(("totlen_fwd_pkts", "subflow_fwd_byts"), "CAST(sum(pkt_len) AS BIGINT)"),
    **dict.fromkeys(("fwd_pkt_len_max", "pkt_len_max"), "max(pkt_len)"),
    **dict.fromkeys(("fwd_pkt_len_min", "pkt_len_min", "fwd_seg_size_min"), "min(pkt_len)"),
    **dict.fromkeys(("fwd_pkt_len_mean", "pkt_len_mean", "pkt_size_avg", "fwd_seg_size_avg"), "round(avg(pkt_len), 4)"),
    **dict.fromkeys(("fwd_pkt_len_std", "pkt_len_std"), "round(stddev_pop(pkt_len), 4)"),
    "pkt_len_var": "round(var_pop(pkt_len), 4)",
}


@query(
    "constant_label",
    with_views(
        "packets",
        f"WITH {_CAPTURE} SELECT "
        + ", ".join(f"{_CAPTURE_COPIES.get(c, 'CAST(0 AS BIGINT)')} AS {c}" for c in FLOW_FEATURES)
        + f""", 'BENIGN' AS "Label" FROM keyed GROUP BY {sql.KEYS}""",
    ),
)
def constant_label(spark, sf_dir):
    """The capture converter's whole row: filled lengths and counts, zeros, the label."""
    return rounded(flows.capture_feature_row(flows.capture_flows(packets(spark, sf_dir))))


_LEGACY = f"""WITH {sql.segmented(VERSION_0, sql.NOT_MULTICAST)}
SELECT {sql.FLOW}, arg_min(pkt_len - 14, (ts_us, pkt_id)) AS ip_len, 64 AS ttl,
 arg_min(CASE WHEN proto IN (6, 17) THEN sport ELSE 0 END, (ts_us, pkt_id)) AS sport,
 arg_min(CASE WHEN proto IN (6, 17) THEN dport ELSE 0 END, (ts_us, pkt_id)) AS dport,
 count(*) AS n_pkts, CAST(sum(pkt_len) AS BIGINT) AS total_bytes, round(avg(pkt_len), 4) AS len_mean,
 max(pkt_len) AS len_max, min(pkt_len) AS len_min,
 round(sum(pkt_len) / (greatest(max(ts_us) - min(ts_us), 1) / 1e6::DOUBLE), 4) AS byts_per_s,
 round(count(*) / (greatest(max(ts_us) - min(ts_us), 1) / 1e6::DOUBLE), 4) AS pkts_per_s
FROM seg GROUP BY {sql.FLOW} HAVING bool_or(closes) AND count(*) >= 2"""


def legacy_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = filters.drop_multicast(filters.ip_only(packets(spark, sf_dir)))
    rows = flows.legacy_values(segment(kept, VERSION_0), F.lit(64))
    return rows.where(F.col("closed") & (F.col("n_pkts") >= VERSION_0.min_packets)).drop("closed")


@query("flow_agg_legacy", with_views("packets", _LEGACY, recursive=True))
def flow_agg_legacy(spark, sf_dir):
    return rounded(legacy_flows(spark, sf_dir))


_PADDED = [
    "ip_len", "ttl", "sport", "dport", "n_pkts", "total_bytes", "len_mean", "len_max", "len_min", "byts_per_s", "pkts_per_s",
]


@query(
    "pad_or_trim_vector",
    "SELECT "
    + f"{sql.FLOW}, "
    + ", ".join(f"{f'CAST({_PADDED[i]} AS DOUBLE)' if i < 11 else 'CAST(0 AS DOUBLE)'} AS x{i}" for i in range(14))
    + ", CAST(5 AS INTEGER) AS cut_size"
    + f" FROM ({with_views('packets', _LEGACY, recursive=True)}) t",
)
def pad_or_trim_vector(spark, sf_dir):
    values = F.array(*[F.col(c).cast("double") for c in _PADDED])
    rows = legacy_flows(spark, sf_dir).select(
        *FLOW, flows.pad_or_trim(values, 14).alias("v"), F.size(flows.pad_or_trim(values, 5)).alias("cut_size")
    )
    return rows.select(*FLOW, *[F.round(F.col("v")[i], 4).alias(f"x{i}") for i in range(14)], "cut_size")
