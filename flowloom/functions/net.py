"""Expressions over addresses, ports and packet fields. All of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowloom.constants import ICMP_TYPES, PRIVATE_PATTERNS, PROTO_NAMES, UNKNOWN_MAC, VIRTUAL_PREFIXES

_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
# IPv4 addresses mapped into IPv6 are as private as themselves.
PRIVATE_PATTERN = "(?i)^((::ffff:)?(" + "|".join(p for p in PRIVATE_PATTERNS if "#" in p).replace("#", _OCTET) + ")|" + "|".join(p for p in PRIVATE_PATTERNS if "#" not in p) + ")$"


def four_numbers(ip: Column) -> list[Column]:
    """The numbers of a dotted quad, which may be larger than an address allows (up to nine digits); null for any other text."""
    octets = F.split(ip, r"\.")
    quad = ip.rlike(r"^(0|[1-9][0-9]{0,8})(\.(0|[1-9][0-9]{0,8})){3}$")
    return [F.when(quad, F.get(octets, F.lit(i)).try_cast("bigint")) for i in range(4)]


def is_private(ip: Column) -> Column:
    """True for addresses that are not globally reachable; text that is no address is False.

    One pattern, so that the address expression appears once in the plan.
    """
    return F.coalesce(ip.rlike(PRIVATE_PATTERN), F.lit(False))


def scope_name(ip: Column) -> Column:
    return F.when(is_private(ip), F.lit("LAN")).otherwise(F.lit("WAN"))


def traffic_direction(src: Column, dst: Column, arrow: str = "->") -> Column:
    return F.concat(scope_name(src), F.lit(arrow), scope_name(dst))


MULTICAST_PATTERN = r"^(224|239)\.|\.255$"


def prefix_pattern(prefixes: Iterable[str]) -> str:
    return "^(" + "|".join(p.replace(".", r"\.") for p in prefixes) + ")"


def is_multicast_or_broadcast(ip: Column) -> Column:
    return ip.rlike(MULTICAST_PATTERN)


def is_virtual_adapter(ip: Column, prefixes: Iterable[str] = VIRTUAL_PREFIXES) -> Column:
    return ip.rlike(prefix_pattern(prefixes))


def subnet24(ip: Column) -> Column:
    return F.concat(F.substring_index(ip, ".", 3), F.lit(".0/24"))


def in_subnet24(ip: Column, other: Column) -> Column:
    return ip.startswith(F.concat(F.substring_index(other, ".", 3), F.lit(".")))


def literal_map(names: Mapping[int, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in names.items() for x in pair])


def proto_name(proto: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(PROTO_NAMES), proto), F.concat(F.lit("PROTO-"), proto.cast("string")))


def proto_name_short(proto: Column) -> Column:
    """First-version naming: TCP, UDP, else ``P<n>``."""
    return F.when(proto == 6, "TCP").when(proto == 17, "UDP").otherwise(F.concat(F.lit("P"), proto.cast("string")))


def proto_name_two(proto: Column) -> Column:
    """Second-version naming: TCP, everything else UDP."""
    return F.when(proto == 6, "TCP").otherwise("UDP")


def icmp_type_name(icmp_type: Column) -> Column:
    known = F.try_element_at(literal_map(ICMP_TYPES), icmp_type.cast("int"))
    return F.coalesce(known, F.concat(F.lit("Type-"), icmp_type.cast("string")))


def port_info(proto: Column, sport: Column, dport: Column) -> Column:
    port = F.concat(F.lit("Port "), dport.cast("string"))
    return (
        F.when(proto.isin(6, 17), port)
        .when(proto == 1, F.concat(F.lit("ICMP "), icmp_type_name(sport)))
        .when((sport == 0) & (dport == 0), F.lit("No Port"))
        .otherwise(port)
    )


def iface_tag(label: Column) -> Column:
    return (
        F.when(F.lower(label).rlike("wi-fi|wifi|wireless|wlan"), "[WiFi]")
        .when(F.length(label) > 0, "[ ETH]")
        .otherwise("[    ]")
    )


def mac_valid(mac: Column, own_macs: Iterable[str]) -> Column:
    return F.coalesce((F.length(mac) == 17) & ~is_own_mac(mac, own_macs), F.lit(False))


def is_own_mac(mac: Column, own_macs: Iterable[str]) -> Column:
    own = [m.lower() for m in own_macs]
    return F.lower(mac).isin(own) if own else F.lit(False)


def mac_or_unknown(mac: Column) -> Column:
    return F.coalesce(F.nullif(mac, F.lit("")), F.lit(UNKNOWN_MAC))


def trim_name(name: Column) -> Column:
    """Names on the wire may end in dots."""
    return F.rtrim(name, F.lit("."))


def decode_name(raw: Column) -> Column:
    """Bytes to text; what is not UTF-8 becomes the replacement character."""
    return F.make_valid_utf8(raw.cast("string"))


def local_device_name(answers: Column, questions: Column) -> Column:
    """First label of the first ``.local`` name; answer names come before question names."""
    names = F.transform(F.concat(answers, questions), trim_name)
    local = F.get(F.filter(names, lambda n: n.contains(".local")), F.lit(0))
    return F.substring_index(local, ".", 1)


def dhcp_host_ip(requested: Column, ciaddr: Column) -> Column:
    """Requested address, else the client's current one; 0.0.0.0 counts as none."""
    wanted = F.when(requested.isNull() | requested.isin("", "None"), F.nullif(ciaddr, F.lit("0.0.0.0"))).otherwise(requested)
    return F.nullif(F.nullif(wanted, F.lit("0.0.0.0")), F.lit(""))


def domain_suffixes(domain: Column) -> Column:
    """All label suffixes of a domain, longest first: a.b.c -> [a.b.c, b.c, c]."""
    clean = F.lower(trim_name(domain))
    labels = F.split(clean, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
