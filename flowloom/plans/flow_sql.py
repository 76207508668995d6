"""SQL texts the flow queries are checked against.

Segmentation is a recursive step from packet to packet of a key, which is independent of
the block walk the Spark operator uses.
"""

from __future__ import annotations

from flowloom.constants import FLOW_FEATURES
from flowloom.operators.segments import KEY, FlowRules
from flowloom.plans.derived import with_views

KEYS = ", ".join(KEY)
FLOW = f"{KEYS}, seg_ts, seg_id"
TRACKED = (
    "NOT (dst_ip LIKE '224.%' OR dst_ip LIKE '239.%' OR dst_ip LIKE '%.255')"
    " AND NOT regexp_matches(src_ip, '^(192\\.168\\.(40|80|56|99)|10\\.0\\.2|172\\.16\\.0)\\.')"
    " AND NOT regexp_matches(dst_ip, '^(192\\.168\\.(40|80|56|99)|10\\.0\\.2|172\\.16\\.0)\\.')"
)
NOT_MULTICAST = "NOT (dst_ip LIKE '224.%' OR dst_ip LIKE '239.%' OR dst_ip LIKE '%.255')"


def keyed(rules: FlowRules, where: str) -> str:
    ports = ", ".join(str(p) for p in rules.ports)
    swap = "(src_ip, sp) <= (dst_ip, dp)" if rules.key == "canonical" else "TRUE"
    return f"""keyed AS (
 SELECT *, CASE WHEN {swap} THEN src_ip ELSE dst_ip END AS ip_a, CASE WHEN {swap} THEN dst_ip ELSE src_ip END AS ip_b,
  CASE WHEN {swap} THEN sp ELSE dp END AS port_a, CASE WHEN {swap} THEN dp ELSE sp END AS port_b
 FROM (SELECT *, CASE WHEN proto IN ({ports}) THEN sport ELSE 0 END AS sp, CASE WHEN proto IN ({ports}) THEN dport ELSE 0 END AS dp
       FROM packets WHERE {where}) k)"""


def segmented(rules: FlowRules, where: str = TRACKED) -> str:
    """CTEs up to ``seg``: packets with seg_ts, seg_id, fwd, closes, gap_us, dgap_us, is_last."""
    flag = "coalesce((tcp_flags & 5) <> 0, FALSE)" if rules.on_flags else "FALSE"
    stale = "FALSE" if rules.stale_us is None else f"o.ts_us - s.ts_us > {rules.stale_us}"
    late = f"> {rules.limit}"
    return f"""{keyed(rules, where)},
ordered AS (
 SELECT *, dense_rank() OVER (ORDER BY {KEYS}) AS kid, {flag} AS flag_close,
  row_number() OVER (PARTITION BY {KEYS} ORDER BY ts_us, pkt_id) AS rn,
  lead(ts_us) OVER (PARTITION BY {KEYS} ORDER BY ts_us, pkt_id) IS NULL AS is_last
 FROM keyed),
steps AS (
 SELECT kid, rn, ts_us, ts_us AS seg_ts, pkt_id AS seg_id, flag_close AS closes FROM ordered WHERE rn = 1
 UNION ALL
 SELECT o.kid, o.rn, o.ts_us,
  CASE WHEN s.closes OR {stale} THEN o.ts_us ELSE s.seg_ts END,
  CASE WHEN s.closes OR {stale} THEN o.pkt_id ELSE s.seg_id END,
  o.flag_close OR o.ts_us - (CASE WHEN s.closes OR {stale} THEN o.ts_us ELSE s.seg_ts END) {late}
 FROM steps s JOIN ordered o ON o.kid = s.kid AND o.rn = s.rn + 1),
placed AS (SELECT o.*, s.seg_ts, s.seg_id, s.closes FROM ordered o JOIN steps s ON o.kid = s.kid AND o.rn = s.rn),
sided AS (SELECT *, src_ip = first_value(src_ip) OVER (PARTITION BY kid, seg_ts, seg_id ORDER BY ts_us, pkt_id) AS fwd FROM placed),
seg AS (SELECT *,
 ts_us - lag(ts_us) OVER (PARTITION BY kid, seg_ts, seg_id ORDER BY ts_us, pkt_id) AS gap_us,
 ts_us - lag(ts_us) OVER (PARTITION BY kid, seg_ts, seg_id, fwd ORDER BY ts_us, pkt_id) AS dgap_us FROM sided)"""


def _count(cond: str) -> str:
    return f"CAST(count(*) FILTER (WHERE {cond}) AS BIGINT)"


def _four(prefix: str, value: str, cond: str) -> dict[str, str]:
    f = f"FILTER (WHERE {cond})"
    return {
        f"{prefix}_mean": f"coalesce(round(avg({value}) {f}, 4), 0)",
        f"{prefix}_std": f"coalesce(round(stddev_pop({value}) {f}, 4), 0)",
        f"{prefix}_max": f"coalesce(max({value}) {f}, 0)",
        f"{prefix}_min": f"coalesce(min({value}) {f}, 0)",
    }


def _sum(value: str, cond: str) -> str:
    return f"CAST(coalesce(sum({value}) FILTER (WHERE {cond}), 0) AS BIGINT)"


_DUR = "greatest(max(ts_us) - min(ts_us), 1)"
_F, _B = "fwd", "NOT fwd"
_HDR = "coalesce(nullif(tcp_dataofs, 0), 5) * 4"


def _flag(mask: int, cond: str = "TRUE") -> str:
    return _count(f"{cond} AND coalesce(tcp_flags & {mask}, 0) <> 0")


FEATURE_SQL: dict[str, str] = {
    "dst_port": "min(port_b)",
    "protocol": "min(proto)",
    "flow_duration": _DUR,
    "tot_fwd_pkts": _count(_F),
    "tot_bwd_pkts": _count(_B),
    "totlen_fwd_pkts": _sum("pkt_len", _F),
    "totlen_bwd_pkts": _sum("pkt_len", _B),
    "fwd_header_len": _sum(_HDR, "proto = 6 AND fwd"),
    "bwd_header_len": _sum(_HDR, "proto = 6 AND NOT fwd"),
    "down_up_ratio": "round(coalesce(count(*) FILTER (WHERE NOT fwd) / nullif(count(*) FILTER (WHERE fwd), 0), 0), 4)",
    "fwd_psh_flags": _flag(8, _F),
    "bwd_psh_flags": _flag(8, _B),
    "fwd_urg_flags": _flag(32, _F),
    "bwd_urg_flags": _flag(32, _B),
    "pkt_size_avg": "round(sum(pkt_len) / count(*), 4)",
    **{
        n: "CAST(0 AS BIGINT)"
        for n in (
            "fwd_byts_per_bulk_avg fwd_pkts_per_bulk_avg fwd_blk_rate_avg bwd_byts_per_bulk_avg bwd_pkts_per_bulk_avg bwd_blk_rate_avg"
        ).split()
    },
    "fwd_seg_size_avg": _four("x", "pkt_len", _F)["x_mean"],
    "bwd_seg_size_avg": _four("x", "pkt_len", _B)["x_mean"],
    "fwd_seg_size_min": _four("x", "pkt_len", _F)["x_min"],
    "init_fwd_win_byts": "CAST(coalesce(arg_min(tcp_window, (ts_us, pkt_id)) FILTER (WHERE fwd), 0) AS BIGINT)",
    "init_bwd_win_byts": "CAST(coalesce(arg_min(tcp_window, (ts_us, pkt_id)) FILTER (WHERE NOT fwd), 0) AS BIGINT)",
    "fwd_act_data_pkts": _count("fwd AND tcp_payload_len > 0"),
    **_four("fwd_pkt_len", "pkt_len", _F),
    **_four("bwd_pkt_len", "pkt_len", _B),
    **_four("pkt_len", "pkt_len", "TRUE"),
    "pkt_len_var": "round(var_pop(pkt_len), 4)",
    "flow_byts_per_s": f"round(sum(pkt_len) / ({_DUR} / 1e6::DOUBLE), 4)",
    "flow_pkts_per_s": f"round(count(*) / ({_DUR} / 1e6::DOUBLE), 4)",
    "fwd_pkts_per_s": f"round(count(*) FILTER (WHERE fwd) / ({_DUR} / 1e6::DOUBLE), 4)",
    "bwd_pkts_per_s": f"round(count(*) FILTER (WHERE NOT fwd) / ({_DUR} / 1e6::DOUBLE), 4)",
    **_four("flow_iat", "gap_us", "TRUE"),
    "fwd_iat_tot": _sum("dgap_us", _F),
    **_four("fwd_iat", "dgap_us", _F),
    "bwd_iat_tot": _sum("dgap_us", _B),
    **_four("bwd_iat", "dgap_us", _B),
    "fin_flag_cnt": _flag(1),
    "syn_flag_cnt": _flag(2),
    "rst_flag_cnt": _flag(4),
    "psh_flag_cnt": _flag(8),
    "ack_flag_cnt": _flag(16),
    "urg_flag_cnt": _flag(32),
    "cwe_flag_count": _flag(128),
    "ece_flag_cnt": _flag(64),
    "subflow_fwd_pkts": _count(_F),
    "subflow_fwd_byts": _sum("pkt_len", _F),
    "subflow_bwd_pkts": _count(_B),
    "subflow_bwd_byts": _sum("pkt_len", _B),
    **_four("active", "gap_us", "gap_us <= 1000000"),
    **_four("idle", "gap_us", "gap_us > 1000000"),
}
assert set(FEATURE_SQL) == set(FLOW_FEATURES)

EXTRA_SQL = {
    "service_port": "CASE WHEN bool_or(gap_us IS NULL AND src_ip = ip_a) THEN min(port_b) ELSE min(port_a) END",
    "total_packets": _count("TRUE"),
    "total_bytes": _sum("pkt_len", "TRUE"),
    **{f"{n}_rate": f"round({_flag(m)} / ({_DUR} / 1e6::DOUBLE), 4)" for n, m in (("syn", 2), ("rst", 4), ("ack", 16))},
    "unique_dst_ports": "count(DISTINCT dport) FILTER (WHERE proto IN (6, 17))",
}


def flows(rules: FlowRules, columns: list[str], where: str = TRACKED) -> str:
    """Closed flows with the named feature columns."""
    known = {**FEATURE_SQL, **EXTRA_SQL}
    listed = ", ".join(f"{known[c]} AS {c}" for c in columns)
    body = f"""WITH {segmented(rules, where)}
SELECT {FLOW}, {listed} FROM seg GROUP BY {FLOW}
HAVING bool_or(closes) AND count(*) >= {rules.min_packets}"""
    return with_views("packets", body, recursive=True)


def flow_status(rules: FlowRules, where: str = TRACKED, having: str = "") -> str:
    body = f"""WITH {segmented(rules, where)}
SELECT {FLOW}, count(*) AS n_pkts, bool_or(flag_close) AS closed_by_flag,
 CASE WHEN bool_or(closes) THEN 'closed' WHEN bool_or(is_last) THEN 'open' ELSE 'stale' END AS status
FROM seg GROUP BY {FLOW} {having}"""
    return with_views("packets", body, recursive=True)
