"""Address and port predicates as column expressions, so that they reach the scan and stay in codegen."""

from __future__ import annotations

import ipaddress
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

PRIVATE = ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16")
#: IPv4 ranges that are not public, besides the private ones.
RESERVED = ("127.0.0.0/8", "169.254.0.0/16", "255.255.255.255/32", "224.0.0.0/4", "0.0.0.0/32", "192.0.2.0/24", "198.51.100.0/24", "203.0.113.0/24")

#: Transport and port of a service.
PORT_LABELS = [
    (6, 502, "modbus"), (6, 44818, "enip"), (17, 2222, "enip-io"), (6, 102, "s7comm"), (6, 4840, "opcua"), (6, 1911, "fox-niagara"), (6, 4911, "fox-niagara"),
    (17, 47808, "bacnet"), (17, 20000, "dnp3"), (6, 20000, "dnp3"), (6, 21, "ftp"), (6, 22, "ssh"), (6, 23, "telnet"), (6, 25, "smtp"), (6, 587, "smtp"),
    (6, 80, "http"), (6, 8080, "http"), (6, 389, "ldap"), (6, 443, "https"), (6, 445, "smb"), (6, 636, "ldaps"), (6, 3268, "ldap-gc"), (6, 3389, "rdp"),
    (17, 53, "dns"), (17, 67, "dhcp"), (17, 68, "dhcp"), (17, 123, "ntp"), (17, 137, "netbios"), (17, 138, "netbios"), (6, 139, "netbios"),
    (17, 161, "snmp"), (17, 162, "snmp"), (17, 5353, "mdns"), (17, 5355, "llmnr"),
]
#: Protocols that have no place on a control network; transport, first and last port.
NO_FLY = [
    (6, 25, 25, "smtp"), (6, 587, 587, "smtp"), (6, 465, 465, "smtp"), (6, 6881, 6889, "bittorrent"), (17, 6881, 6889, "bittorrent"), (6, 1935, 1935, "rtmp"),
    (6, 5223, 5223, "apns"), (6, 5228, 5230, "gcm"), (17, 3478, 3479, "stun"), (6, 5060, 5060, "sip"), (17, 5060, 5060, "sip"), (6, 6667, 6667, "irc"),
    (6, 6697, 6697, "irc"), (6, 1194, 1194, "openvpn"), (17, 1194, 1194, "openvpn"), (6, 5938, 5938, "teamviewer"), (6, 7070, 7070, "anydesk"), (6, 6568, 6568, "anydesk"),
]
EPHEMERAL = 49152


def is_v4(ip: Column) -> Column:
    return ~ip.contains(":")


def ip_num(ip: Column) -> Column:
    """The number of an IPv4 address; null for IPv6 and null."""
    parts = [F.substring_index(F.substring_index(ip, ".", k), ".", -1).cast("long") for k in (1, 2, 3, 4)]
    return F.when(is_v4(ip), parts[0] * 16777216 + parts[1] * 65536 + parts[2] * 256 + parts[3])


def v6_hex(ip: Column) -> Column:
    """The 32 hex digits of an IPv6 address, for its range predicates; null for others."""
    head, tail = F.substring_index(ip, "::", 1), F.when(ip.contains("::"), F.substring_index(ip, "::", -1)).otherwise(F.lit(""))
    pad = lambda part: F.transform(F.filter(F.split(part, ":"), lambda g: g != ""), lambda g: F.lpad(F.lower(g), 4, "0"))
    a, b = pad(head), pad(tail)
    zeros = F.array_repeat(F.lit("0000"), F.lit(8) - F.size(a) - F.size(b))
    return F.when(~is_v4(ip), F.concat_ws("", a, zeros, b))


def bounds(cidr: str) -> tuple[int, int]:
    net = ipaddress.ip_network(cidr)
    return int(net.network_address), int(net.broadcast_address)


def in_nets(ip: Column, cidrs: Iterable[str], number: Column | None = None) -> Column:
    """Whether any of the networks holds the address; IPv6 networks match whole hex digits of a prefix. number: of ip, if it is at hand."""
    number, out = ip_num(ip) if number is None else number, F.lit(False)
    for cidr in cidrs:
        net = ipaddress.ip_network(cidr)
        if net.version == 4:
            low, high = bounds(cidr)
            out = out | F.coalesce((number >= low) & (number <= high), F.lit(False))
        else:
            low, high = (format(int(a), "032x") for a in (net.network_address, net.broadcast_address))
            out = out | F.coalesce((v6_hex(ip) >= low) & (v6_hex(ip) <= high), F.lit(False))
    return out


def ip_order(number: Column, v6: Column) -> Column:
    """Text that sorts like addresses do, of their number or digits: IPv4 before IPv6; empty without either."""
    return F.coalesce(F.lpad(number.cast("string"), 10, "0"), F.concat(F.lit("~"), v6), F.lit(""))


def in_ot(ip: Column, ot: Iterable[str] | None = None, number: Column | None = None) -> Column:
    return in_nets(ip, ot or PRIVATE, number)


def is_public(ip: Column, number: Column | None = None, v6: Column | None = None) -> Column:
    """IPv6 link-local counts as public; null is not. number, v6: of ip, if they are at hand."""
    v6 = v6_hex(ip) if v6 is None else v6
    special = v6.rlike("^(0{31}[01]|ff|f[cd])")
    return F.coalesce(F.when(is_v4(ip), ~in_nets(ip, PRIVATE + RESERVED, number)).otherwise(~special), F.lit(False))


def is_group_address(ip: Column, number: Column | None = None, v6: Column | None = None) -> Column:
    """Multicast, limited broadcast or unspecified."""
    v6 = v6_hex(ip) if v6 is None else v6
    return F.coalesce(F.when(is_v4(ip), in_nets(ip, ("224.0.0.0/4", "255.255.255.255/32", "0.0.0.0/32"), number)).otherwise(v6.rlike("^(ff|0{32})")), F.lit(False))


def is_multicast(ip: Column) -> Column:
    return F.coalesce(F.when(is_v4(ip), in_nets(ip, ("224.0.0.0/4", "255.255.255.255/32"))).otherwise(v6_hex(ip).startswith("ff")), F.lit(False))


def mac_is_group(mac: Column) -> Column:
    """Broadcast or multicast: the low bit of the first octet."""
    return F.coalesce(F.conv(F.substring(mac, 1, 2), 16, 10).cast("int") % 2 == 1, F.lit(False))


def _choose(rows: list, test, otherwise: Column) -> Column:
    out = None
    for row in rows:
        out = F.when(test(row), row[-1]) if out is None else out.when(test(row), row[-1])
    return out.otherwise(otherwise)


def _by_service(rows: list, proto: Column, port: Column) -> Column:
    """The last entry of the row (transport, port, ..., value) that proto and port are in, looked up once."""
    names = F.create_map(*(F.lit(x) for r in rows for p in range(r[1], r[-2] + 1) for x in (r[0] * 65536 + p, r[-1])))
    return F.element_at(names, (proto * 65536 + port).cast("int"))


def port_label(proto: Column, src_port: Column, dst_port: Column) -> Column:
    """The service of the destination port if it is below the ephemeral range, else of the source port."""
    return _by_service(PORT_LABELS, proto, F.when(dst_port < EPHEMERAL, dst_port).when(src_port < EPHEMERAL, src_port))


def no_fly_label(proto: Column, port: Column) -> Column:
    return _by_service(NO_FLY, proto, port)


def proto_label(proto: Column) -> Column:
    return F.when(proto == 6, "tcp").when(proto == 17, "udp").when(proto == 1, "icmp").otherwise(F.concat(F.lit("ip/"), proto.cast("string")))


def subnet_of(ip: Column) -> Column:
    """The /24 of an IPv4 or the /64 of an IPv6 address."""
    v6 = v6_hex(ip)
    groups = [F.regexp_replace(F.substring(v6, 4 * k + 1, 4), "^0{1,3}", "") for k in range(4)]
    return F.when(is_v4(ip), F.concat(F.substring_index(ip, ".", 3), F.lit(".0/24"))).otherwise(F.concat(F.concat_ws(":", *groups), F.lit("::/64")))


def zone_slug(subnet: Column) -> Column:
    return F.concat(F.lit("zone-"), F.regexp_replace(subnet, "[.:/]+", "-"))


#: Purdue level of a role.
ROLE_LEVELS = {"plc": "L1", "hmi": "L2", "engineering_workstation": "L3", "historian": "L3", "network_infra": "L3", "it_endpoint": "L4", "unknown": "L3"}


def role_level(role: Column) -> Column:
    return _choose([(k, v) for k, v in ROLE_LEVELS.items()], lambda r: role == r[0], F.lit("L3"))


def conn_bucket(state: Column) -> Column:
    """established, attempted or other of a connection-log state."""
    return F.when(state.isin("S1", "S2", "S3", "SF", "RSTO", "RSTR", "OTH"), "established").when(state.isin("S0", "REJ", "RSTOS0", "RSTRH", "SH", "SHR"), "attempted").otherwise("other")


def violation_grade(state: Column) -> Column:
    return F.when(conn_bucket(state) == "attempted", "attempted").otherwise("established")


def service_source(label: Column) -> Column:
    """Whether a flow's service was recognised by content, guessed from its port, or is unknown."""
    return F.when(label.isin("modbus", "dnp3", "enip", "s7comm", "bacnet", "opcua"), "dpi_confirmed").when(label.isNotNull(), "port_heuristic").otherwise("unknown")


def opaque_label(ip: Column, salt: str) -> Column:
    return F.concat(F.lit("unmapped_"), F.substring(F.sha2(F.concat(F.lit(salt), ip).cast("binary"), 256), 1, 16))
