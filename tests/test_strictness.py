"""What used to be lost, cut or mistaken without a word."""

import io
import ipaddress
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.functions import net
from flowloom.operators import clean, filters
from flowloom.operators.segments import cut
from flowloom.sources import flow_csv, pcap


def test_a_limit_beyond_any_capture_does_not_overflow():
    n = 20_000
    ts = np.arange(n, dtype=np.int64) * 1_000_000
    ones = np.ones(n, bool)
    _, closes = cut(ts, ones, np.zeros(n, bool), np.zeros(n, np.int64), 10**15)
    assert not closes.any()
    entered = np.zeros(n, bool)
    entered[::2] = True
    _, closes = cut(ts, ones, entered, ts - 5_000_001, 5_000_000)
    assert closes.tolist() == entered.tolist()


def capture(records, link=1):
    head = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, link)
    return head + b"".join(struct.pack("<IIII", 1000 + i, 0, size if size < 1 << 20 else size, 60) + bytes(60) for i, size in enumerate(records))


def test_bad_captures_are_errors():
    assert sum(map(len, pcap.read_capture(io.BytesIO(capture([60] * 11))))) == 11
    with pytest.raises(ValueError, match="bad record length"):
        list(pcap.read_capture(io.BytesIO(capture([60, 60, 60, 1 << 30] + [60] * 7))))
    with pytest.raises(ValueError, match="link type 101"):
        list(pcap.read_capture(io.BytesIO(capture([60], link=101))))


def test_csv_folders_are_strict(spark, tmp_path):
    folder = tmp_path / "csv"
    folder.mkdir()
    (folder / "a.csv").write_text("\nA,Label\n1,x\n2,y\n")
    (folder / "old_final_dataset.csv").write_text("A,Label\n3,z\n")
    (folder / "final_dataset.csv").write_text("A,Label\n4,w\n")
    assert flow_csv.scan_csv_exclude(spark, str(folder)).filter("A = 3").count() == 1
    assert flow_csv.scan_csv_exclude(spark, str(folder)).filter("A = 4").count() == 0
    assert flow_csv.scan_flow_csv_dir(spark, str(folder)).filter("Label IN ('x', 'y')").count() == 2
    (folder / "b.csv").write_text("\n \n")
    with pytest.raises(ValueError, match="no header"):
        flow_csv.scan_flow_csv_dir(spark, str(folder))
    assert [r["source_file"] for r in flow_csv.unreadable_csv(spark, str(folder)).collect()] == ["b.csv"]
    assert flow_csv.scan_flow_csv_dir(spark, str(folder), skip_unreadable=True).count() == 4
    (folder / "c.csv").write_text("A,Label\n5,v,surplus\n")
    with pytest.raises(Exception, match="MALFORMED|FAILED_READ_FILE|Malformed"):
        flow_csv.scan_flow_csv_dir(spark, str(folder), skip_unreadable=True).collect()


def test_private_addresses_as_the_standard_library_has_them(spark):
    ips = "8.8.8.8 10.1.2.3 192.0.0.9 192.0.0.1 100.64.0.1 ::1 :: ::2 ::ffff:8.8.8.8 ::ffff:10.0.0.1 64:ff9b:1::1 64:ff9b::1 100::1 100:1::1 2001:2::1 2001:3::1 2001:1::1 2001:1::3 2001:db8::1 2001:4860::1 2001:1ff::1 2001:200::1 2002::1 FE80::1 fc00::1 2600::1".split()
    found = spark.createDataFrame([(x,) for x in ips], "ip string").select("ip", net.is_private(F.col("ip")).alias("p")).collect()
    assert {r["ip"]: r["p"] for r in found} == {x: ipaddress.ip_address(x).is_private for x in ips}


def test_frames_without_ipv4_are_arp_only_if_they_say_so(spark):
    rows = spark.createDataFrame([(1, None, 1), (2, None, None), (3, "10.0.0.1", None)], "pkt_id int, src_ip string, arp_op int")
    routed = filters.route(rows.withColumns({"proto": F.lit(6), "sport": F.lit(1), "dport": F.lit(2)}))
    assert [r["parsed_as"] for r in routed.orderBy("pkt_id").collect()] == ["arp", "other", "ip"]


def test_missing_words_and_labels(spark):
    rows = spark.createDataFrame([("1", "BENIGN"), ("#N/A", "BENIGN"), ("2", "NaN"), ("1.#IND", "Bot")], "`Tot Fwd Pkts` string, Label string")
    assert [r[0] for r in clean.clean_rows(rows).collect()] == ["1"]
