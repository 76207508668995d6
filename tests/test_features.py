"""Feature values of small flows, worked out by hand or with numpy."""

import numpy as np
import pytest

from flowloom.constants import FLOW_FEATURES
from flowloom.operators import flows
from flowloom.operators.segments import LIVE_TWO_WAY, FlowRules, segment
from tests.test_segments import A, B, SCHEMA, packet


def features(spark, packets, rules=LIVE_TWO_WAY, all_rows=False):
    df = spark.createDataFrame(packets, SCHEMA)
    rows = flows.with_features(flows.flow_rows(segment(df, rules, flows.FLOW_COLUMNS)))
    out = [r.asDict() for r in rows.collect()]
    return out if all_rows else out[0]


def test_single_packet(spark):
    f = features(spark, [packet(0, 5, size=60, flags=1)])
    assert f["flow_duration"] == 1 and f["pkt_len_std"] == 0 and f["flow_iat_mean"] == 0 and f["active_max"] == 0
    assert f["flow_byts_per_s"] == pytest.approx(60e6)
    assert f["fin_flag_cnt"] == 1 and f["status"] == "closed"


def test_two_way_flow_against_numpy(spark):
    ts = [0, 400_000, 1_400_000, 2_400_001, 2_500_000, 3_000_000]
    back = [False, True, False, True, True, False]
    size = [60, 1500, 60, 700, 900, 80]
    rows = [
        packet(i, t, *((B, A, 80, 1000) if b else (A, B, 1000, 80)), size=s, flags=24 if b else 16, window=100 + i, dataofs=None if i == 0 else 0 if i == 1 else 8)
        for i, (t, b, s) in enumerate(zip(ts, back, size))
    ]
    f = features(spark, rows)
    ts, back, size = np.array(ts), np.array(back), np.array(size)
    gap, fgap, bgap = np.diff(ts), np.diff(ts[~back]), np.diff(ts[back])
    want = {
        "tot_fwd_pkts": 3, "tot_bwd_pkts": 3, "down_up_ratio": 1.0, "pkt_len_var": size.var(), "pkt_len_std": size.std(),
        "bwd_pkt_len_mean": size[back].mean(), "flow_iat_std": gap.std(), "fwd_iat_tot": fgap.sum(), "bwd_iat_std": bgap.std(),
        "bwd_iat_min": bgap.min(), "active_max": 1_000_000, "idle_min": 1_000_001, "idle_std": 0, "active_mean": gap[gap <= 1_000_000].mean(),
        "fwd_header_len": 20 + 32 + 32, "bwd_header_len": 20 + 32 + 32, "init_fwd_win_byts": 100, "init_bwd_win_byts": 101,
        "bwd_psh_flags": 3, "psh_flag_cnt": 3, "fwd_psh_flags": 0, "ack_flag_cnt": 6, "flow_pkts_per_s": 2.0, "fwd_act_data_pkts": 3,
        "dst_port": 1000 if (A, 1000) > (B, 80) else 80, "service_port": 80,
    }
    for name, value in want.items():
        assert f[name] == pytest.approx(value), name


def test_flow_across_many_blocks(spark):
    """A flow longer than several blocks is one flow with the gaps of its packets."""
    rules = FlowRules(close_us=10_000, stale_us=30_000, block_us=700)
    rows = [packet(i, i * 500, proto=17) for i in range(25)]
    got = features(spark, rows, rules, all_rows=True)
    first = min(got, key=lambda r: r["seg_ts"])
    assert (first["n_pkts"], first["flow_iat_min"], first["flow_iat_max"], first["status"]) == (22, 500, 500, "closed")


def test_names_and_count():
    assert len(FLOW_FEATURES) == 78 and len(set(FLOW_FEATURES.values())) == 78
    assert FLOW_FEATURES["cwe_flag_count"] == "CWE Flag Count"


def test_cic_names(spark):
    df = spark.createDataFrame([packet(0, 0, flags=1), packet(1, 1), packet(2, 2), packet(3, 3, flags=4)], SCHEMA)
    out = flows.with_cic_names(flows.flow_features(df, LIVE_TWO_WAY))
    assert list(out.columns[-78:]) == list(FLOW_FEATURES.values()) and out.count() == 1
