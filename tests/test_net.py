"""Address and name expressions against the standard library and fixed cases."""

import ipaddress
import random

from pyspark.sql import functions as F

from flowloom.functions import net
from flowloom.operators import devices, names


def column(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in df.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


def test_is_private_equals_standard_library(spark):
    rng = random.Random(3)
    edges = [
        "0.0.0.0", "0.255.255.255", "1.0.0.0", "10.0.0.0", "11.0.0.0", "100.64.0.1", "127.9.9.9", "169.254.1.1", "172.15.255.255",
        "172.16.0.0", "172.31.255.255", "172.32.0.0", "192.0.0.8", "192.0.0.9", "192.0.0.10", "192.0.0.11", "192.0.0.170", "192.0.1.0",
        "192.0.2.7", "192.168.0.0", "192.169.0.0", "198.17.0.0", "198.18.0.0", "198.19.255.255", "198.20.0.0", "198.51.100.1",
        "203.0.113.9", "224.0.0.1", "239.1.1.1", "240.0.0.0", "255.255.255.255", "::1", "::", "fe80::1", "fc00::1", "2606:4700::1",
    ]
    values = edges + [str(ipaddress.IPv4Address(rng.getrandbits(32))) for _ in range(500)]
    assert column(spark, values, net.is_private) == [ipaddress.ip_address(v).is_private for v in values]


def test_text_that_is_no_address(spark):
    values = ["", "abc", "1.2.3", "256.1.1.1", "10.0.0.01", "10.0.0.1.2", None]
    assert column(spark, values, net.is_private) == [False] * 7


def test_services_first_entry_wins(spark):
    values = ["www.YouTube.com.", "teams.microsoft.com", "play.google.com", "notyoutube.com", "youtube.com", "x.prime", "com", ""]
    got = column(spark, values, names.service_of)
    assert got == ["YouTube", "Microsoft", "Google", None, "YouTube", "Amazon Prime", None, None]


def test_vendor(spark):
    assert column(spark, ["0C:74:C2:00:00:01", "02:00:00:00:00:01", ""], names.vendor_of) == ["Apple", "", ""]


def test_iface_tag(spark):
    assert column(spark, ["Intel Wi-Fi 6", "wlan0", "Ethernet 2", ""], net.iface_tag) == ["[WiFi]", "[WiFi]", "[ ETH]", "[    ]"]


def test_local_name_answers_before_questions(spark):
    df = spark.createDataFrame([(["a.example", "Tom.local."], ["Kim.local"]), ([], ["Kim.local"]), (["a.b"], [])], "a array<string>, q array<string>")
    assert [r.n for r in df.select(net.local_device_name(F.col("a"), F.col("q")).alias("n")).collect()] == ["Tom", "Kim", None]


def test_numeric_order_puts_other_text_last(spark):
    values = ["10.0.0.10", "fe80::2", "10.0.0.9", "9.1.1.1", "192.168.1.1", "fe80::1", "host"]
    rows = devices.numbered_by_ip(spark.createDataFrame([(v,) for v in values], "ip string")).orderBy("position").collect()
    assert [r.ip for r in rows] == ["9.1.1.1", "10.0.0.9", "10.0.0.10", "192.168.1.1", "fe80::1", "fe80::2", "host"]
    assert [r.position for r in rows] == list(range(1, 8))


def test_numbers_beyond_an_address_are_ordered_as_numbers(spark):
    values = ["192.168.1000.2", "192.168.256.9", "192.168.99.1", "192.168.256.10", "300.1.1.1", "10.0.0.01", "192.168.70000.1", None]
    frame = spark.createDataFrame([(v,) for v in values], "ip string")
    wanted = ["192.168.99.1", "192.168.256.9", "192.168.256.10", "192.168.1000.2", "192.168.70000.1", "300.1.1.1"]
    rows = devices.numbered_by_ip(frame).orderBy("position").collect()
    assert [r.ip for r in rows][:6] == wanted and {r.ip for r in rows[6:]} == {"10.0.0.01", None}
    assert [r.ip for r in devices.sort_by_ip(frame).collect()][:6] == wanted


def test_alert_line(spark):
    df = spark.sql("SELECT 0.957D AS s, 3723000000L AS t, 'Wi-Fi' AS i, '10.0.0.5' AS a, '8.8.8.8' AS b, 5L AS sp, 443L AS dp, 6 AS p")
    flow = {"src_ip": F.col("a"), "dst_ip": F.col("b"), "sport": F.col("sp"), "dport": F.col("dp"), "proto": F.col("p")}
    line = df.select(names.alert_line(F.col("s"), F.col("t"), F.col("i"), F.col("a"), F.col("b"), flow)).first()[0]
    assert line == "[01:02:03] !! ATTACK  (0.96) [WiFi] | 10.0.0.5 -> 8.8.8.8 | Port 443 | TCP | LAN->WAN"
