"""Queries over single packets and control messages: filters, lookups, text forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.constants import ICMP_TYPES, PROTO_NAMES
from flowloom.functions import net
from flowloom.operators import filters
from flowloom.plans.catalog import query
from flowloom.plans.derived import OWN_MACS, derive, with_views
from flowloom.plans.flow_sql import NOT_MULTICAST


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, "packets")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, "control_msgs")


def on_packets(body: str) -> str:
    return with_views("packets", body)


def on_messages(body: str) -> str:
    return with_views("control_msgs", body)


def _number(ip: str) -> int:
    a, b, c, d = (int(octet) for octet in ip.split("."))
    return ((a * 256 + b) * 256 + c) * 256 + d


def private_sql(ip: str) -> str:
    """Range test over the address as a number, apart from the pattern the operator uses."""
    number = "(" + " + ".join(f"split_part({ip}, '.', {i + 1})::BIGINT * {256 ** (3 - i)}" for i in range(4)) + ")"
    nets = (
        ("0.0.0.0", 8), ("10.0.0.0", 8), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.2.0", 24),
        ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("240.0.0.0", 4),
    )
    tests = " OR ".join(
        f"{number} BETWEEN {_number(a)} AND {_number(a) + 2 ** (32 - bits) - 1}" for a, bits in nets
    )
    return f"({tests})"


def direction_sql(src: str = "src_ip", dst: str = "dst_ip") -> str:
    return (
        f"CASE WHEN {private_sql(src)} THEN 'LAN' ELSE 'WAN' END || '->' || CASE WHEN {private_sql(dst)} THEN 'LAN' ELSE 'WAN' END"
    )


def case_sql(column: str, names: dict[int, str], otherwise: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in names.items()) + f" ELSE {otherwise} END"


ICMP_SQL = case_sql("sport", ICMP_TYPES, "'Type-' || sport::VARCHAR")
PROTO_SQL = case_sql("proto", PROTO_NAMES, "'PROTO-' || proto::VARCHAR")
PORT_SQL = (
    "CASE WHEN proto IN (6, 17) THEN 'Port ' || dport::VARCHAR WHEN proto = 1 THEN 'ICMP ' || "
    + ICMP_SQL
    + " WHEN sport = 0 AND dport = 0 THEN 'No Port' ELSE 'Port ' || dport::VARCHAR END"
)
TAG_SQL = (
    "CASE WHEN regexp_matches(lower(iface), 'wi-fi|wifi|wireless|wlan') THEN '[WiFi]' WHEN iface <> '' THEN '[ ETH]' ELSE '[    ]' END"
)
VIRTUAL_SQL = "regexp_matches({0}, '^(192\\.168\\.(40|80|56|99)|10\\.0\\.2|172\\.16\\.0)\\.')"


def _filter_query(name: str, sql_where: str, keep) -> None:
    query(name, on_packets(f"SELECT pkt_id, src_ip, dst_ip FROM packets WHERE {sql_where}"))(
        lambda spark, sf_dir: keep(packets(spark, sf_dir)).select("pkt_id", "src_ip", "dst_ip")
    )


def _with_arp_rows(df: DataFrame) -> DataFrame:
    """Packets without an IP layer among the others: those of the slow protocol-1 users."""
    no_ip = (F.col("proto") == 1) & (F.col("tcp_flags").isNull()) & (F.col("pkt_id") % 3 == 0)
    return df.withColumn("src_ip", F.when(~no_ip, F.col("src_ip")))


_filter_query(
    "filter_ip_only", "NOT (proto = 1 AND pkt_id % 3 = 0)", lambda df: filters.ip_only(_with_arp_rows(df))
)
_filter_query("filter_multicast_broadcast", NOT_MULTICAST, filters.drop_multicast)
_filter_query(
    "filter_device_only", f"NOT ({private_sql('src_ip')} AND {private_sql('dst_ip')})", filters.drop_private_pairs
)
_filter_query(
    "filter_virtual_adapters",
    f"NOT ({VIRTUAL_SQL.format('src_ip')} OR {VIRTUAL_SQL.format('dst_ip')})",
    filters.drop_virtual_adapters,
)
_filter_query("filter_ip_scope", f"NOT {private_sql('src_ip')}", lambda df: filters.in_scope(df, "src_ip", show_private=False))


def _rerouted(df: DataFrame) -> DataFrame:
    """Move some UDP packets to the ports that are parsed, so that all routes occur."""
    port = F.element_at(F.array(*[F.lit(p) for p in (53, 67, 68, 5353, 1900, 443)]), (F.col("pkt_id") % 6 + 1).cast("int"))
    return _with_arp_rows(df).withColumn("dport", F.when(F.col("proto") == 17, port.cast("bigint")).otherwise(F.col("dport")))


_ROUTE = """WITH r AS (SELECT pkt_id, proto, sport, CASE WHEN proto = 1 AND pkt_id % 3 = 0 THEN NULL ELSE src_ip END AS src_ip,
  CASE WHEN proto = 17 THEN CASE pkt_id % 6 WHEN 0 THEN 53 WHEN 1 THEN 67 WHEN 2 THEN 68 WHEN 3 THEN 5353 WHEN 4 THEN 1900 ELSE 443 END ELSE dport END AS dport
 FROM packets)
SELECT pkt_id, CASE WHEN src_ip IS NULL THEN 'arp' WHEN proto = 17 AND (sport = 53 OR dport = 53) THEN 'dns'
 WHEN proto = 17 AND (sport IN (67, 68) OR dport IN (67, 68)) THEN 'dhcp' WHEN proto = 17 AND 5353 IN (sport, dport) THEN 'mdns'
 WHEN proto = 17 AND 1900 IN (sport, dport) THEN 'ssdp' ELSE 'ip' END AS parsed_as,
 src_ip IS NOT NULL AND NOT (proto = 17 AND 1900 IN (sport, dport)) AS is_tracked FROM r"""


@query("route_by_protocol", on_packets(_ROUTE))
def route_by_protocol(spark, sf_dir):
    return filters.route(_rerouted(packets(spark, sf_dir))).select("pkt_id", "parsed_as", "is_tracked")


@query(
    "filter_own_mac",
    on_messages("SELECT msg_id, arp_hwsrc FROM control_msgs WHERE kind = 'arp' AND lower(arp_hwsrc) <> 'aa:bb:cc:00:00:01'"),
)
def filter_own_mac(spark, sf_dir):
    return filters.arp_not_ours(messages(spark, sf_dir), OWN_MACS).select("msg_id", "arp_hwsrc")


@query(
    "filter_zero_ip",
    on_messages(
        """SELECT msg_id, 0 AS part, arp_psrc AS ip, arp_hwsrc AS mac FROM control_msgs WHERE kind = 'arp' AND arp_psrc <> '0.0.0.0'
UNION ALL SELECT msg_id, 1, arp_pdst, arp_hwdst FROM control_msgs WHERE kind = 'arp' AND arp_op = 2 AND arp_pdst <> '0.0.0.0'"""
    ),
)
def filter_zero_ip(spark, sf_dir):
    return filters.arp_sightings(messages(spark, sf_dir).where("kind = 'arp'")).drop("ts_us")


@query("filter_dhcp_type", on_messages("SELECT msg_id, dhcp_type FROM control_msgs WHERE kind = 'dhcp' AND dhcp_type IN (1, 3)"))
def filter_dhcp_type(spark, sf_dir):
    return filters.dhcp_requests(messages(spark, sf_dir)).select("msg_id", "dhcp_type")


@query("filter_dns_response", on_messages("SELECT msg_id, dns_qdcount FROM control_msgs WHERE kind = 'dns' AND dns_qr = 1 AND dns_qdcount > 0"))
def filter_dns_response(spark, sf_dir):
    return filters.dns_responses(messages(spark, sf_dir)).select("msg_id", "dns_qdcount")


def _column_query(query_name: str, sql_columns: str, **columns) -> None:
    query(query_name, on_packets(f"SELECT pkt_id, {sql_columns} FROM packets"))(
        lambda spark, sf_dir: packets(spark, sf_dir).select("pkt_id", *[c().alias(n) for n, c in columns.items()])
    )


SRC, DST = (lambda: F.col("src_ip")), (lambda: F.col("dst_ip"))
_column_query(
    "ip_is_private",
    f"src_ip, {private_sql('src_ip')} AS src_private, {private_sql('dst_ip')} AS dst_private",
    src_ip=SRC,
    src_private=lambda: net.is_private(SRC()),
    dst_private=lambda: net.is_private(DST()),
)
_column_query("traffic_direction", f"{direction_sql()} AS direction", direction=lambda: net.traffic_direction(SRC(), DST()))
_column_query(
    "join_proto_name",
    f"{PROTO_SQL} AS name, CASE proto WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' ELSE 'P' || proto::VARCHAR END AS name_v0,"
    " CASE proto WHEN 6 THEN 'TCP' ELSE 'UDP' END AS name_v1",
    name=lambda: net.proto_name(F.col("proto")),
    name_v0=lambda: net.proto_name_short(F.col("proto")),
    name_v1=lambda: net.proto_name_two(F.col("proto")),
)
_column_query("join_icmp_type", f"{ICMP_SQL} AS icmp", icmp=lambda: net.icmp_type_name(F.col("sport")))
_column_query(
    "format_port_info", f"{PORT_SQL} AS port_info", port_info=lambda: net.port_info(F.col("proto"), F.col("sport"), F.col("dport"))
)
_column_query("iface_tag", f"{TAG_SQL} AS tag", tag=lambda: net.iface_tag(F.col("iface")))
_column_query(
    "subnet24",
    "regexp_replace(src_ip, '\\.[0-9]+$', '') || '.0/24' AS subnet,"
    " regexp_replace(src_ip, '[0-9]+$', '') = regexp_replace(dst_ip, '[0-9]+$', '') AS same_subnet",
    subnet=lambda: net.subnet24(SRC()),
    same_subnet=lambda: net.in_subnet24(SRC(), DST()),
)
_column_query(
    "mac_valid",
    "length(src_mac) = 17 AND lower(src_mac) <> 'aa:bb:cc:00:00:01' AS valid",
    valid=lambda: net.mac_valid(F.col("src_mac"), OWN_MACS),
)


_LOCAL_NAME = "split_part(rtrim({0}, '.'), '.', 1)"
MDNS_NAME_SQL = (
    f"CASE WHEN mdns_rrname LIKE '%.local%' THEN {_LOCAL_NAME.format('mdns_rrname')}"
    f" WHEN mdns_qname LIKE '%.local%' THEN {_LOCAL_NAME.format('mdns_qname')} END"
)


def name_arrays() -> tuple:
    return F.array_compact(F.array("mdns_rrname")), F.array_compact(F.array("mdns_qname"))


@query("mdns_local_name", on_messages(f"SELECT msg_id, {MDNS_NAME_SQL} AS local_name FROM control_msgs WHERE kind = 'mdns'"))
def mdns_local_name(spark, sf_dir):
    rows = messages(spark, sf_dir).where("kind = 'mdns'")
    return rows.select("msg_id", net.local_device_name(*name_arrays()).alias("local_name"))


DHCP_IP_SQL = "coalesce(dhcp_requested, nullif(dhcp_ciaddr, '0.0.0.0'))"


@query("dhcp_host_ip", on_messages(f"SELECT msg_id, {DHCP_IP_SQL} AS host_ip FROM control_msgs WHERE kind = 'dhcp'"))
def dhcp_host_ip(spark, sf_dir):
    rows = messages(spark, sf_dir).where("kind = 'dhcp'")
    return rows.select("msg_id", net.dhcp_host_ip(F.col("dhcp_requested"), F.col("dhcp_ciaddr")).alias("host_ip"))


@query("decode_trim_name", on_messages("SELECT msg_id, rtrim(mdns_rrname, '.') AS name FROM control_msgs WHERE kind = 'mdns'"))
def decode_trim_name(spark, sf_dir):
    # The names as bytes on the wire, with one byte that is no UTF-8 in front.
    wire = F.concat(F.unhex(F.lit("FF")), F.encode("mdns_rrname", "UTF-8"))
    rows = messages(spark, sf_dir).where("kind = 'mdns'")
    name = net.trim_name(net.decode_name(wire))
    return rows.select("msg_id", F.regexp_replace(name, "^\uFFFD", "").alias("name"))
