"""Capture files: packets written as captures and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowloom.plans.catalog import query
from flowloom.plans.derived import derive, with_views
from flowloom.session import scratch_dir
from flowloom.sources import pcap, pcap_format
from flowloom.streaming import jobs

_FIELDS = ["ts_us", "src_ip", "dst_ip", "sport", "dport", "proto", "pkt_len", "tcp_flags", "tcp_window", "tcp_dataofs", "tcp_payload_len", "src_mac"]


_SQL = with_views(
    "packets",
    "SELECT ts_us, src_ip, dst_ip, sport, dport, proto, pkt_len, tcp_flags, tcp_window, CASE WHEN proto = 6 THEN coalesce(tcp_dataofs, 5) END AS tcp_dataofs, tcp_payload_len, src_mac FROM packets",
)


def _captures(spark, sf_dir):
    """A missing data offset is written as five words, the length of a plain header."""
    folder = scratch_dir(spark, "captures")
    pcap.write_captures(derive(spark, sf_dir, "packets"), folder, files=8)
    return folder


@query("pcap_ingest", _SQL)
def pcap_ingest(spark, sf_dir):
    return pcap.pcap_ingest(spark, _captures(spark, sf_dir), split_bytes=64 << 10).select(*[F.col(c) for c in _FIELDS])


@query("pcap_format", _SQL)
def pcap_format_batch(spark, sf_dir):
    pcap_format.register(spark)
    return spark.read.format("pcap").option("splitBytes", 64 << 10).load(_captures(spark, sf_dir)).select(*_FIELDS)


@query("pcap_follow", _SQL)
def pcap_follow(spark, sf_dir):
    """A stream without state, so the session needs no settings for it."""
    out, checkpoint = jobs.new_folders(spark, "out", "checkpoint")
    pcap_format.register(spark)
    stream = spark.readStream.format("pcap").option("splitBytes", 64 << 10).load(_captures(spark, sf_dir))
    jobs.run_available(stream.select(*_FIELDS), out, checkpoint)
    return spark.read.parquet(out)
