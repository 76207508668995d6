import os
import struct

import pytest

from flowloom.sources import pcap, pcap_format
from flowloom.sources.pcap import CAPTURE_HEAD


def record(i: int, size: int) -> bytes:
    frame = bytes(12) + b"\x08\x00" + struct.pack(">BBHHHBBH4B4B", 0x45, 0, size, 0, 0, 64, 17, 0, 10, 0, i >> 8 & 255, i & 255, 10, 1, 2, 3)
    frame += struct.pack(">HHHH", 1000 + i % 5000, 53, 8, 0)
    return struct.pack("<IIII", 1_700_000_000 + i // 10, i % 10 * 1000, len(frame), size) + frame


def capture(n: int, begin: int = 0) -> bytes:
    return b"".join(record(i, 60 + i % 40) for i in range(begin, begin + n))


def rows(df):
    return sorted(tuple("" if v is None else v for v in r) for r in df.select("file", "file_pos", "ts_us", "src_ip", "sport", "pkt_len").collect())


@pytest.mark.parametrize("split", [1 << 30, 4000])
def test_batch_rows_are_those_of_the_ingest_job(spark, tmp_path, split):
    (tmp_path / "a.pcap").write_bytes(CAPTURE_HEAD + capture(3000))
    (tmp_path / "b.pcap").write_bytes(CAPTURE_HEAD + capture(5, 9000) + record(7, 90)[:20])
    (tmp_path / "empty.pcap").write_bytes(CAPTURE_HEAD)
    (tmp_path / "other.txt").write_text("no capture")
    pcap_format.register(spark)
    found = spark.read.format("pcap").option("splitBytes", split).load(str(tmp_path))
    assert found.schema == pcap.PACKET_FILE_SCHEMA
    assert found.rdd.getNumPartitions() > (20 if split == 4000 else 2)
    got = rows(found)
    assert len(got) == 3005 and got == rows(pcap.pcap_ingest(spark, str(tmp_path), None))


def test_empty_folder(spark, tmp_path):
    pcap_format.register(spark)
    assert spark.read.format("pcap").load(str(tmp_path)).count() == 0


def test_complete_until(tmp_path):
    data = CAPTURE_HEAD + capture(2000)
    edges = [24]
    while edges[-1] < len(data):
        edges.append(edges[-1] + 16 + struct.unpack_from("<I", data, edges[-1] + 8)[0])
    (tmp_path / "x.pcap").write_bytes(data)
    with pcap._opened(f"file://{tmp_path}/x.pcap") as stream:
        for size in (24, 25, 39, edges[1] - 1, edges[1], edges[500] + 17, len(data) - 1, len(data)):
            assert pcap_format.complete_until(stream, size) == max(e for e in edges if e <= size)


def test_growing_captures_are_followed(spark, tmp_path):
    """Three runs of one query; records cut in the middle at the end of a run come once, with the next one."""
    folder, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    os.makedirs(folder)
    first, second = CAPTURE_HEAD + capture(2500), CAPTURE_HEAD + capture(700, 5000)
    pcap_format.register(spark)

    def written(name: str, data: bytes) -> None:
        with open(f"{folder}/{name}", "ab") as file:
            file.write(data)

    def run() -> int:
        stream = spark.readStream.format("pcap").option("splitBytes", 5000).load(folder)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(pcap.PACKET_FILE_SCHEMA).parquet(out).count()

    written("a.pcap", first[:50_003])
    written("b.pcap", second[:10])  # not even a whole head
    seen = run()
    assert 0 < seen < 2500
    written("a.pcap", first[50_003:90_001])
    written("b.pcap", second[10:])
    assert run() > seen + 700
    written("a.pcap", first[90_001:])
    assert run() == 3200
    assert run() == 3200
    assert rows(spark.read.parquet(out)) == rows(pcap.pcap_ingest(spark, folder, None))
