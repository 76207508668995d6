"""Packet filters and routing. All are narrow: they run before the first shuffle."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.constants import VIRTUAL_PREFIXES
from flowloom.functions import net

SSDP_PORT = 1900
DNS_PORT = 53
DHCP_PORTS = (67, 68)
MDNS_PORT = 5353


def ip_only(packets: DataFrame) -> DataFrame:
    return packets.where(F.col("src_ip").isNotNull())


def drop_multicast(packets: DataFrame) -> DataFrame:
    return packets.where(~net.is_multicast_or_broadcast(F.col("dst_ip")))


def drop_private_pairs(packets: DataFrame) -> DataFrame:
    """Device-only mode: traffic between two private addresses is left out."""
    return packets.where(~(net.is_private(F.col("src_ip")) & net.is_private(F.col("dst_ip"))))


def drop_virtual_adapters(packets: DataFrame, prefixes: Iterable[str] = VIRTUAL_PREFIXES) -> DataFrame:
    prefixes = tuple(prefixes)
    hit = net.is_virtual_adapter(F.col("src_ip"), prefixes) | net.is_virtual_adapter(F.col("dst_ip"), prefixes)
    return packets.where(~hit)


def tracked(packets: DataFrame, device_only: bool = False) -> DataFrame:
    """The packets the flow tracker sees: the filters above, one pattern per address."""
    virtual = net.prefix_pattern(VIRTUAL_PREFIXES)
    kept = packets.where(~F.col("src_ip").rlike(virtual)).where(
        ~F.col("dst_ip").rlike(f"{net.MULTICAST_PATTERN}|{virtual}")
    )
    return drop_private_pairs(kept) if device_only else kept


def _on_port(*ports: int) -> Column:
    return (F.col("proto") == 17) & (F.col("sport").isin(*ports) | F.col("dport").isin(*ports))


def route(packets: DataFrame) -> DataFrame:
    """Tag each packet with what it is parsed as and whether it also enters flow tracking.

    SSDP only registers its sender. DNS, DHCP and mDNS are parsed and tracked as well. Frames
    without an IPv4 address are ARP if they say so, else ``other``; tables without ``arp_op`` hold no other frames.
    """
    no_ip = F.col("src_ip").isNull()
    is_arp = no_ip & F.col("arp_op").isNotNull() if "arp_op" in packets.columns else no_ip
    parsed = (
        F.when(is_arp, "arp")
        .when(no_ip, "other")
        .when(_on_port(DNS_PORT), "dns")
        .when(_on_port(*DHCP_PORTS), "dhcp")
        .when(_on_port(MDNS_PORT), "mdns")
        .when(_on_port(SSDP_PORT), "ssdp")
        .otherwise("ip")
    )
    # A packet between two of these ports is still SSDP for the tracker.
    enters = F.col("src_ip").isNotNull() & ~F.coalesce(_on_port(SSDP_PORT), F.lit(False))
    return packets.withColumn("parsed_as", parsed).withColumn("is_tracked", enters)


def arp_not_ours(messages: DataFrame, own_macs: Iterable[str]) -> DataFrame:
    """ARP rows not sent by this machine itself."""
    ours = net.is_own_mac(F.col("arp_hwsrc"), own_macs)
    return messages.where((F.col("kind") == "arp") & ~F.coalesce(ours, F.lit(False)))


def arp_sightings(messages: DataFrame) -> DataFrame:
    """(ip, mac) pairs told by ARP rows: the sender, and the target of a reply; 0.0.0.0 is nobody."""
    pairs = F.array(
        F.struct(F.col("arp_psrc").alias("ip"), F.col("arp_hwsrc").alias("mac"), F.lit(True).alias("valid")),
        F.struct(F.col("arp_pdst").alias("ip"), F.col("arp_hwdst").alias("mac"), (F.col("arp_op") == 2).alias("valid")),
    )
    rows = messages.select("msg_id", "ts_us", F.posexplode(pairs).alias("part", "s"))
    return rows.where(F.col("s.valid") & (F.col("s.ip") != "0.0.0.0")).select("msg_id", "ts_us", "part", "s.ip", "s.mac")


def dhcp_requests(messages: DataFrame) -> DataFrame:
    """Discover (1) and request (3) messages that carry a sender MAC."""
    return messages.where((F.col("kind") == "dhcp") & F.col("dhcp_type").isin(1, 3) & (F.length("src_mac") > 0))


def dns_responses(messages: DataFrame) -> DataFrame:
    return messages.where((F.col("kind") == "dns") & (F.col("dns_qr") == 1) & (F.col("dns_qdcount") >= 1))


def in_scope(rows: DataFrame, ip: str, show_private: bool = True, show_public: bool = True) -> DataFrame:
    """Show-private / show-public switches."""
    private = net.is_private(F.col(ip))
    return rows.where((private & F.lit(show_private)) | (~private & F.lit(show_public)))
