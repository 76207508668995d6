"""Service and host names of addresses: from DNS answers, DHCP and mDNS messages."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.constants import OUI_VENDORS, SERVICE_SUFFIXES, UNKNOWN_MAC
from flowloom.functions import net
from flowloom.operators import filters
from flowloom.operators.timeline import asof_latest

Service = tuple[int, str, str]
DEFAULT_SERVICES: tuple[Service, ...] = tuple((i, s, n) for i, (s, n) in enumerate(SERVICE_SUFFIXES.items()))


def service_of(domain: Column, services: Sequence[Service] = DEFAULT_SERVICES) -> Column:
    """Service of a domain: the lowest-ranked map entry that equals it or one of its suffixes.

    The map is a short parameter and rides along as a literal: no join, no shuffle.
    """
    entries = F.map_from_entries(
        F.array(*[F.struct(F.lit(s), F.struct(F.lit(r).alias("rank"), F.lit(n).alias("name"))) for r, s, n in services])
    )
    hits = F.transform(net.domain_suffixes(domain), lambda s: F.try_element_at(entries, s))
    return F.array_min(F.array_compact(hits))["name"]


def vendor_of(mac: Column) -> Column:
    """Vendor by the first three octets, empty when unknown."""
    vendors = F.create_map(*[F.lit(x) for pair in OUI_VENDORS.items() for x in pair])
    return F.coalesce(F.try_element_at(vendors, F.lower(F.substring(mac, 1, 8))), F.lit(""))


def _latest(df: DataFrame, key: str, values: Sequence[str], ts: str) -> DataFrame:
    """Latest values per key in two steps: whole value combinations first (hash aggregation on
    fixed-width buffers), then the few combinations of a key. Equal times go by the values."""
    combos = df.groupBy(key, *values).agg(F.max(ts).alias(ts))
    return combos.groupBy(key).agg(F.max(F.struct(ts, *values)).alias("_v")).select(key, *[f"_v.{v}" for v in values], f"_v.{ts}")


def named_answers(answers: DataFrame, services: Sequence[Service] = DEFAULT_SERVICES) -> DataFrame:
    """DNS answers of known services whose data looks like an IPv4 address."""
    return with_service(answers, services).where(is_named())


def with_service(answers: DataFrame, services: Sequence[Service] = DEFAULT_SERVICES) -> DataFrame:
    return answers.withColumn("qname", net.trim_name(F.col("qname"))).withColumn("service", service_of(F.col("qname"), services))


def is_named() -> Column:
    """Whether an answer with its ``service`` names an address."""
    return F.coalesce(F.col("service").isNotNull() & F.col("answer_ip").contains("."), F.lit(False))


def dns_ip_service(answers: DataFrame, services: Sequence[Service] = DEFAULT_SERVICES) -> DataFrame:
    """ip -> (service, qname) of its latest named answer."""
    rows = named_answers(answers, services).withColumnRenamed("answer_ip", "ip")
    return _latest(rows, "ip", ["service", "qname"], "ts_us")


def asof_dns_label(flows: DataFrame, answers: DataFrame, ip: str, ts: str, services: Sequence[Service] = DEFAULT_SERVICES) -> DataFrame:
    """Add the ``service`` an address was known under at time ``ts``."""
    right = named_answers(answers, services).select(
        F.col("answer_ip").alias(ip), F.col("ts_us").alias(ts), "ans_id", "service"
    )
    return asof_latest(flows, right, ip, ts, "ans_id", ["service"])


def dhcp_names(messages: DataFrame) -> DataFrame:
    """ip -> host name of its latest DHCP request that told one."""
    rows = filters.dhcp_requests(messages).select(
        net.dhcp_host_ip(F.col("dhcp_requested"), F.col("dhcp_ciaddr")).alias("ip"), F.col("dhcp_hostname").alias("name"), "ts_us"
    )
    return _latest(rows.where(F.col("ip").isNotNull() & (F.length("name") > 0)), "ip", ["name"], "ts_us")


def with_local_name(messages: DataFrame) -> DataFrame:
    """mDNS messages that carry a ``.local`` name."""
    answers, questions = (F.array_compact(F.array(c)) for c in ("mdns_rrname", "mdns_qname"))
    rows = messages.where("kind = 'mdns'").withColumn("local_name", net.local_device_name(answers, questions))
    return rows.where(F.col("local_name").isNotNull())


def mdns_names(messages: DataFrame) -> DataFrame:
    rows = with_local_name(messages).select(F.col("src_ip").alias("ip"), F.col("local_name").alias("name"), "ts_us")
    return _latest(rows, "ip", ["name"], "ts_us")


def gateway_mac(ip: Column, gateways: Iterable[tuple[str, str]]) -> Column:
    """MAC of a capturing interface's gateway; the few (ip, mac) pairs are a parameter."""
    pairs = [F.lit(x) for pair in gateways for x in pair]
    return F.try_element_at(F.create_map(*pairs), ip) if pairs else F.lit(None).cast("string")


def endpoint_label(ip: Column, gateway: Column, mac: Column, service: Column, host: Column) -> Column:
    """``ip (mac  name)`` on the LAN and for gateways, ``ip (name)`` or the bare ip outside."""
    name = F.coalesce(F.nullif(service, F.lit("")), F.nullif(host, F.lit("")))
    lan = F.when(net.is_private(ip), F.coalesce(mac, F.lit(UNKNOWN_MAC)))
    inner = F.concat_ws("  ", F.coalesce(gateway, lan), name)
    return F.when(F.length(inner) > 0, F.concat(ip, F.lit(" ("), inner, F.lit(")"))).otherwise(ip)


def endpoint_labels(
    ips: DataFrame, mac_table: DataFrame, gateways: Iterable[tuple[str, str]], services: DataFrame, hosts: DataFrame
) -> DataFrame:
    """ip -> label, one row per address."""
    rows = (
        ips.join(mac_table.select("ip", "mac"), "ip", "left")
        .join(services.select("ip", "service"), "ip", "left")
        .join(hosts.select("ip", "host"), "ip", "left")
    )
    ip = F.col("ip")
    label = endpoint_label(ip, gateway_mac(ip, gateways), F.col("mac"), F.col("service"), F.col("host"))
    return rows.select("ip", label.alias("label"))


def with_endpoint_labels(flows: DataFrame, labels: DataFrame, src: str = "src_ip", dst: str = "dst_ip") -> DataFrame:
    def side(ip: str, name: str) -> DataFrame:
        return labels.select(F.col("ip").alias(ip), F.col("label").alias(name))

    return flows.join(side(src, "src_label"), src, "left").join(side(dst, "dst_label"), dst, "left")


def alert_rows(
    flows: DataFrame,
    flow_id: Sequence[str],
    answers: DataFrame,
    macs: DataFrame,
    hosts: DataFrame,
    gateways: Sequence[tuple[str, str]] = (),
    services: Sequence[Service] = DEFAULT_SERVICES,
    threshold: float = 0.40,
) -> DataFrame:
    """Scored flows with their endpoint labels as of the flow's end, and the alert line.

    flows: src_ip, dst_ip, sport, dport, proto, iface, end_us, score, the columns of
    ``flow_id`` and any others. Both endpoints go through one look-back and one join per
    lookup and meet again by flow id. ``flows`` is read twice: give a stored table.
    """
    ends = F.array(
        F.struct(F.col("src_ip").alias("ip"), F.lit(True).alias("is_src")),
        F.struct(F.col("dst_ip").alias("ip"), F.lit(False).alias("is_src")),
    )
    sides = flows.select(F.struct("*").alias("flow"), "end_us", F.inline(ends))
    sides = asof_dns_label(sides, answers, "ip", "end_us", services)
    sides = sides.join(macs.select("ip", "mac"), "ip", "left").join(hosts.select("ip", "host"), "ip", "left")
    ip = F.col("ip")
    label = endpoint_label(ip, gateway_mac(ip, gateways), F.col("mac"), F.col("service"), F.col("host"))
    rows = (
        sides.select("flow", "is_src", label.alias("label"), *[F.col(f"flow.{c}").alias(f"_{c}") for c in flow_id])
        .groupBy(*[f"_{c}" for c in flow_id])
        .agg(
            F.any_value("flow").alias("flow"),
            F.max(F.when(F.col("is_src"), F.col("label"))).alias("src_label"),
            F.max(F.when(~F.col("is_src"), F.col("label"))).alias("dst_label"),
        )
        .select("flow.*", "src_label", "dst_label")
    )
    parts = {c: F.col(c) for c in ("src_ip", "dst_ip", "sport", "dport", "proto")}
    line = alert_line(
        F.col("score"), F.col("end_us"), F.col("iface"), F.col("src_label"), F.col("dst_label"), parts, threshold
    )
    return rows.withColumn("line", line)


def alert_line(score: Column, ts_us: Column, iface: Column, src_label: Column, dst_label: Column, flow: dict[str, Column], threshold: float = 0.40) -> Column:
    """The alert log's line. flow: src_ip, dst_ip, sport, dport, proto."""
    clock = F.date_format(F.timestamp_micros(ts_us), "HH:mm:ss")
    mark = F.when(score > threshold, "!! ATTACK ").otherwise("   BENIGN ")
    return F.format_string(
        "[%s] %s (%.2f) %s | %s -> %s | %s | %s | %s",
        clock,
        mark,
        score,
        net.iface_tag(iface),
        src_label,
        dst_label,
        net.port_info(flow["proto"], flow["sport"], flow["dport"]),
        net.proto_name(flow["proto"]),
        net.traffic_direction(flow["src_ip"], flow["dst_ip"]),
    )
