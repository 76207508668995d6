"""Device registry and its reports."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.constants import UNKNOWN_MAC
from flowloom.functions import net
from flowloom.operators import filters, names
from flowloom.operators.timeline import numbered


def packet_sightings(packets: DataFrame, own_macs: Iterable[str]) -> DataFrame:
    """Both endpoints of every tracked packet.

    A MAC is learned for the sender only, if it is on the LAN and the frame is not ours; a
    frame from outside carries the gateway's MAC.
    """
    learned = net.is_private(F.col("src_ip")) & ~F.coalesce(net.is_own_mac(F.col("src_mac"), own_macs), F.lit(True))
    ends = F.array(
        F.struct(F.col("src_ip").alias("ip"), F.when(learned, F.col("src_mac")).otherwise("").alias("mac")),
        F.struct(F.col("dst_ip").alias("ip"), F.lit("").alias("mac")),
    )
    seen = filters.tracked(filters.route(packets).where("is_tracked"))
    return seen.select("ts_us", "iface", F.inline(ends)).select("ip", "mac", "iface", "ts_us")


def message_sightings(messages: DataFrame, own_macs: Iterable[str]) -> DataFrame:
    """Devices told by ARP, DHCP, mDNS and SSDP messages."""

    def rows(df: DataFrame, ip: Column, mac: Column, tag: str) -> DataFrame:
        return df.select(ip.alias("ip"), F.coalesce(mac, F.lit("")).alias("mac"), F.lit(tag).alias("iface"), "ts_us")

    arp = rows(filters.arp_sightings(filters.arp_not_ours(messages, own_macs)), F.col("ip"), F.col("mac"), "")
    dhcp_ip = net.dhcp_host_ip(F.col("dhcp_requested"), F.col("dhcp_ciaddr"))
    dhcp = rows(filters.dhcp_requests(messages), dhcp_ip, F.col("src_mac"), "[DHCP]").where(F.col("ip").isNotNull())
    mdns = rows(names.with_local_name(messages).where(F.length("src_mac") > 0), F.col("src_ip"), F.col("src_mac"), "[mDNS]")
    ssdp = messages.where((F.col("kind") == "ssdp") & net.is_private(F.col("src_ip")))
    return arp.unionByName(dhcp).unionByName(mdns).unionByName(rows(ssdp, F.col("src_ip"), F.col("src_mac"), "[SSDP]"))


def device_registry(sightings: DataFrame) -> DataFrame:
    """ip -> first and last seen, sightings, last real MAC, first named interface.

    First by (ip, mac, iface) with fixed-width buffers, where a busy address shrinks to a
    few rows before anything is shuffled by address; equal times go by the text.
    """
    combos = sightings.groupBy("ip", "mac", "iface").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us")
    )
    real_mac = (F.length("mac") > 0) & (F.col("mac") != UNKNOWN_MAC)
    named_iface = F.length("iface") > 0
    return combos.groupBy("ip").agg(
        F.min("first_us").alias("first_seen_us"),
        F.max("last_us").alias("last_seen_us"),
        F.sum("n").alias("packets"),
        F.coalesce(F.max(F.when(real_mac, F.struct("last_us", "mac")))["mac"], F.lit(UNKNOWN_MAC)).alias("mac"),
        F.coalesce(F.min(F.when(named_iface, F.struct("first_us", "iface")))["iface"], F.lit("")).alias("iface"),
    )


def mac_table(registry: DataFrame) -> DataFrame:
    return registry.where(F.col("mac") != UNKNOWN_MAC).select("ip", "mac")


def is_local(ip: Column) -> Column:
    """Private for reports: private addresses, and multicast ones as well."""
    return net.is_private(ip) | net.is_multicast_or_broadcast(ip)


def with_display_name(devices: DataFrame, services: DataFrame, dhcp: DataFrame, mdns: DataFrame, hosts: DataFrame) -> DataFrame:
    """Outside: service, else host name. Local: DHCP, mDNS, host name, else '-'."""
    rows = (
        devices.join(services.select("ip", "service"), "ip", "left")
        .join(dhcp.select("ip", F.col("name").alias("_dhcp")), "ip", "left")
        .join(mdns.select("ip", F.col("name").alias("_mdns")), "ip", "left")
        .join(hosts.select("ip", F.col("host").alias("_host")), "ip", "left")
    )

    def filled(*columns: str) -> list[Column]:
        return [F.nullif(c, F.lit("")) for c in columns]

    public = F.coalesce("service", "_host", F.lit(""))
    private = F.coalesce(*filled("_dhcp", "_mdns", "_host"), F.lit("-"))
    shown = F.when(is_local(F.col("ip")), private).otherwise(public)
    return rows.withColumn("display_name", shown).drop("service", "_dhcp", "_mdns", "_host")


def ip_bucket(ip: Column) -> Column:
    """Rising with numeric address order: the first two numbers and the third by its multiples of 256, so the /16 of an
    IPv4 address; other text comes after all of them, by its first eight characters."""
    text = [F.coalesce(F.ascii(F.substring(ip, i + 1, 1)), F.lit(0)).cast("bigint") * (128 ** (7 - i)) for i in range(8)]
    total = text[0]
    for t in text[1:]:
        total = total + t
    first, second, third, _ = net.four_numbers(ip)
    return F.struct(
        first.isNull().alias("is_text"), first.alias("first"), second.alias("second"), F.shiftright(third, 8).alias("third"),
        F.when(first.isNull(), total).alias("text"),
    )


def ip_order(ip: Column) -> list[Column]:
    return [*(n.asc_nulls_last() for n in net.four_numbers(ip)), ip.asc()]


def sort_by_ip(df: DataFrame, ip: str = "ip") -> DataFrame:
    """Rows by address as four numbers; text that is no dotted quad comes last."""
    return df.orderBy(*ip_order(F.col(ip)))


def numbered_by_ip(df: DataFrame, groups: Iterable[str] = (), ip: str = "ip") -> DataFrame:
    return numbered(df, list(groups), ip_bucket(F.col(ip)), ip_order(F.col(ip)))


def device_summary(named: DataFrame) -> DataFrame:
    """The two report tables: scope, number within scope, vendor, name, and the scope's total."""
    rows = named.withColumns(
        {
            "scope": F.when(is_local(F.col("ip")), "private").otherwise("public"),
            "vendor": F.when(F.col("mac") == UNKNOWN_MAC, "").otherwise(names.vendor_of(F.col("mac"))),
            "tag": net.iface_tag(F.col("iface")),
        }
    )
    totals = rows.groupBy("scope").agg(F.count(F.lit(1)).alias("total_devices"))
    return numbered_by_ip(rows, ["scope"]).join(totals, "scope")


def host_status(devices: DataFrame, flows: DataFrame, threshold: float = 0.90) -> DataFrame:
    """Per source address: status, latest flow's facts, attack flows, flows, last seen.

    flows: src_ip, end_us, flow_no, score, dst_port, proto, direction.
    """
    latest = F.max(F.struct("end_us", "flow_no", "score", "dst_port", "proto", "direction"))
    per_host = flows.groupBy(F.col("src_ip").alias("ip")).agg(
        latest.alias("l"), F.count_if(F.col("score") > threshold).alias("attack_flows"), F.count(F.lit(1)).alias("flows")
    )
    rows = devices.join(per_host, "ip", "left")
    status = (
        F.when(F.col("l.score") > threshold, "ATTACK").when(F.col("flows") > 0, "ACTIVE").otherwise("DISCOVERED")
    )
    return rows.select(
        "ip",
        status.alias("status"),
        F.col("l.score").alias("score"),
        F.col("l.dst_port").alias("dst_port"),
        net.proto_name(F.col("l.proto")).alias("proto"),
        F.col("l.direction").alias("direction"),
        F.coalesce("attack_flows", F.lit(0)).alias("attack_flows"),
        F.coalesce("flows", F.lit(0)).alias("flows"),
        "last_seen_us",
    )
