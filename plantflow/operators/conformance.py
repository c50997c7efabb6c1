"""Zones, conduits and the verdict on every flow.

The policy is a small declared document; the flow table is large. Addresses resolve by one broadcast
join with the policy's disjoint intervals, and conduits by one broadcast join on (protocol, zone pair),
with the port test as an array expression. So classifying flows needs no shuffle.
"""

from __future__ import annotations

import hashlib
import ipaddress
import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import net
from ..schemas import EXTERNAL, LEVEL_RANK

PROTOS = {"tcp": 6, "udp": 17, "icmp": 1, "other": 0}
DIRECTIONS = {"forward": "forward", "unidirectional": "forward", "bidirectional": "bidirectional"}


@dataclass(frozen=True)
class Zone:
    zone: str
    level: str
    members: tuple[str, ...] = ()


@dataclass(frozen=True)
class Conduit:
    from_zone: str
    to_zone: str
    direction: str
    proto: str
    #: Ranges of ports; None is any port, and no port at all.
    ports: tuple[tuple[int, int], ...] | None


@dataclass(frozen=True)
class Policy:
    zones: tuple[Zone, ...]
    conduits: tuple[Conduit, ...] = field(default=())


def canonical_ports(ranges) -> tuple[tuple[int, int], ...]:
    """Sorted, with overlapping and adjacent ranges merged."""
    out: list[tuple[int, int]] = []
    for low, high in sorted(ranges):
        if out and low <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return tuple(out)


def _ports(value) -> tuple[tuple[int, int], ...] | None:
    if value == "any":
        return None
    ranges = []
    for part in value if isinstance(value, list) else [value]:
        low, _, high = str(part).partition("-")
        ranges.append((int(low), int(high or low)))
        if not 0 <= ranges[-1][0] <= ranges[-1][1] <= 65535:
            raise ValueError(f"not a port range: {part!r}")
    return canonical_ports(ranges)


def load_policy(document: str | dict) -> Policy:
    """Of a JSON document; keys and tokens that are not known raise ValueError."""
    doc = json.loads(document) if isinstance(document, str) else document

    def keys(value: dict, allowed: set) -> dict:
        if more := set(value) - allowed:
            raise ValueError(f"unknown keys {sorted(more)}")
        return value

    keys(doc, {"zones", "conduits"})
    zones = []
    for z in doc.get("zones", []):
        keys(z, {"id", "name", "level", "members"})
        if z["level"] not in LEVEL_RANK:
            raise ValueError(f"unknown level {z['level']!r}")
        zones.append(Zone(z["id"], z["level"], tuple(str(ipaddress.ip_network(m)) for m in z.get("members", []))))
    conduits = []
    for c in doc.get("conduits", []):
        keys(c, {"from", "to", "direction", "proto", "ports"})
        if c["direction"] not in DIRECTIONS or c["proto"] not in PROTOS:
            raise ValueError(f"unknown direction or protocol in {c!r}")
        conduits.append(Conduit(c["from"], c["to"], DIRECTIONS[c["direction"]], c["proto"], _ports(c.get("ports", "any"))))
    return Policy(tuple(zones), tuple(conduits))


def check_policy(policy: Policy) -> list[tuple[str, str, str]]:
    """(grade, problem, subject) of a policy: errors make verdicts meaningless, warnings do not."""
    out, seen, nets = [], set(), {}
    for z in policy.zones:
        if z.zone in seen:
            out.append(("error", "duplicate_zone", z.zone))
        if z.zone == EXTERNAL:
            out.append(("error", "reserved_zone", z.zone))
        seen.add(z.zone)
        if not z.members:
            out.append(("warning", "empty_zone", z.zone))
        for m in z.members:
            n = ipaddress.ip_network(m)
            mapped = n.network_address.ipv4_mapped if n.version == 6 and n.prefixlen >= 96 else None
            n = ipaddress.ip_network((mapped, n.prefixlen - 96)) if mapped is not None else n
            if n.prefixlen == 0:
                out.append(("error", "catch_all_member", f"{z.zone} {m}"))
            elif n.prefixlen < 8:
                out.append(("warning", "broad_member", f"{z.zone} {m}"))
            if nets.setdefault(n, z.zone) != z.zone:
                out.append(("error", "shared_member", str(n)))
    for k, c in enumerate(policy.conduits):
        out += [("error", "unknown_zone", f"conduit {k} {z}") for z in (c.from_zone, c.to_zone) if z not in seen]
    return sorted(out)


def policy_digest(policy: Policy) -> str:
    """SHA-256 of a canonical form: zones by id, members sorted, conduits sorted and distinct."""
    ports = lambda p: "any" if p is None else [f"{a}-{b}" for a, b in canonical_ports(p)]
    conduits = sorted({json.dumps({"direction": c.direction, "from": c.from_zone, "ports": ports(c.ports), "proto": c.proto, "to": c.to_zone}, sort_keys=True, separators=(",", ":")) for c in policy.conduits})
    doc = {"conduits": [json.loads(c) for c in conduits], "zones": [{"id": z.zone, "level": z.level, "members": sorted(z.members)} for z in sorted(policy.zones, key=lambda z: z.zone)]}
    return hashlib.sha256(json.dumps(doc, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def disjoint(members: list[tuple]) -> list[tuple[int, int, tuple]]:
    """(first, last, member) of intervals that do not overlap, from members (network, ...) of one family: the longest network that holds an address has it.

    Of equal networks the first declared counts.
    """
    members = sorted({m[0]: m for m in reversed(members)}.values(), key=lambda m: (int(m[0].network_address), m[0].prefixlen))
    out: list[tuple[int, int, tuple]] = []
    open_: list[tuple] = []
    at = 0

    def until(end: int) -> None:
        """Close networks that end before, and give what is left of each to it."""
        nonlocal at
        while open_ and int(open_[-1][0].broadcast_address) < end:
            last = int(open_[-1][0].broadcast_address)
            if at <= last:
                out.append((at, last, open_[-1]))
                at = last + 1
            open_.pop()
        if open_ and at < end:
            out.append((at, end - 1, open_[-1]))

    for member in members:
        first = int(member[0].network_address)
        until(first)
        at = first
        open_.append(member)
    until(1 << 129)
    return out


def _intervals(policy: Policy) -> list[tuple]:
    """bucket, first, last, zone, level, end: disjoint intervals of addresses as hex digits, once for each bucket they touch."""
    rows = []
    for version, digits, head in ((4, 8, 2), (6, 32, 4)):
        members = [(n, z.zone, z.level) for z in policy.zones for m in z.members if (n := ipaddress.ip_network(m)).version == version]
        for low, high, (network, zone, level) in disjoint(members):
            first, last = (format(x, f"0{digits}x") for x in (low, high))
            end = format(int(network.broadcast_address), f"0{digits}x") if version == 4 and network.prefixlen <= 30 else None
            rows += [(format(k, f"0{head}x"), first, last, zone, level, end) for k in range(int(first[:head], 16), int(last[:head], 16) + 1)]
    return rows


def resolve(df: DataFrame, ip: str, policy: Policy, out: str) -> DataFrame:
    """df with a struct column out (zone, level, directed): the longest member network that holds ip, else EXTERNAL.

    directed: ip is that network's broadcast address, of an IPv4 network of /30 or shorter. Nested members are
    flattened to disjoint intervals, so members of all lengths and both families meet addresses in one join, by the
    first byte (IPv4) or the first two (IPv6).
    """
    spark, key = df.sparkSession, f"_{out}_key"
    table = spark.createDataFrame(_intervals(policy), f"_bucket string, _first string, _last string, _{out}_zone string, _{out}_level string, _{out}_end string")
    number = F.lpad(F.lower(F.hex(net.ip_num(F.col(ip)))), 8, "0")
    df = df.withColumn(key, F.coalesce(number, net.v6_hex(F.col(ip))))
    bucket = F.substring(F.col(key), F.lit(1), F.when(F.length(key) == 8, 2).otherwise(4))
    df = df.join(F.broadcast(table), (bucket == F.col("_bucket")) & F.col(key).between(F.col("_first"), F.col("_last")), "left")  # as large as the policy
    value = F.struct(F.coalesce(f"_{out}_zone", F.lit(EXTERNAL)).alias("zone"), F.col(f"_{out}_level").alias("level"), F.coalesce(F.col(key) == F.col(f"_{out}_end"), F.lit(False)).alias("directed"))
    return df.withColumn(out, value).drop("_bucket", "_first", "_last", key, f"_{out}_zone", f"_{out}_level", f"_{out}_end")


def _conduits(spark: SparkSession, policy: Policy) -> DataFrame:
    """One row per (protocol, source zone, destination zone), with all conduits of the pair in either orientation."""
    pairs: dict[tuple, list] = {}
    for k, c in enumerate(policy.conduits):
        ports = [] if c.ports is None else list(c.ports)
        for a, b, forward in ((c.from_zone, c.to_zone, True), (c.to_zone, c.from_zone, False)):
            pairs.setdefault((PROTOS[c.proto], a, b), []).append((k, forward or c.direction == "bidirectional", c.ports is None, ports))
    schema = "c_proto int, c_src string, c_dst string, conduits array<struct<conduit:int,fits:boolean,any:boolean,ports:array<struct<lo:int,hi:int>>>>"
    return spark.createDataFrame([(*k, v) for k, v in pairs.items()], schema)


def verdicts(flows: DataFrame, policy: Policy) -> DataFrame:
    """flows with src_zone, dst_zone, kind, conduit (its number) and idmz_bypass.

    Kinds, first that holds: multicast_exempt, intra_zone, allowed, wrong_direction,
    no_matching_conduit. A flow without a port matches conduits of any port alone.
    """
    rows = resolve(resolve(flows, "src_ip", policy, "_src"), "dst_ip", policy, "_dst")
    table = F.broadcast(_conduits(flows.sparkSession, policy))  # as large as the policy
    rows = rows.join(table, (F.col("proto") == F.col("c_proto")) & (F.col("_src.zone") == F.col("c_src")) & (F.col("_dst.zone") == F.col("c_dst")), "left")
    port = F.col("dst_port")
    open_ = F.filter("conduits", lambda c: c["any"] | F.coalesce(F.exists(c["ports"], lambda r: port.between(r["lo"], r["hi"])), F.lit(False)))
    allowed = F.array_min(F.transform(F.filter(open_, lambda c: c["fits"]), lambda c: c["conduit"]))
    reverse = F.coalesce(F.exists(open_, lambda c: ~c["fits"]), F.lit(False))
    group = net.is_multicast(F.col("dst_ip")) | F.col("_dst.directed")
    same = F.col("_src.zone") == F.col("_dst.zone")
    kind = F.when(group, "multicast_exempt").when(same, "intra_zone").when(allowed.isNotNull(), "allowed").when(reverse, "wrong_direction").otherwise("no_matching_conduit")
    low, high = (lambda s: F.col(f"{s}.level").isin("L0", "L1", "L2", "L3")), (lambda s: F.col(f"{s}.level").isin("L4", "L5"))
    bypass = ~group & ~same & ((low("_src") & high("_dst")) | (high("_src") & low("_dst")))
    out = rows.select(*flows.columns, F.col("_src.zone").alias("src_zone"), F.col("_dst.zone").alias("dst_zone"), kind.alias("kind"), allowed.alias("conduit"), F.coalesce(bypass, F.lit(False)).alias("idmz_bypass"))
    return out.withColumn("conduit", F.when(F.col("kind") == "allowed", F.col("conduit")))


def violations(verdict_table: DataFrame, conn_state: str | None = None) -> DataFrame:
    """None, one or two rows per flow: a conduit violation, an IDMZ bypass; with a grade, and first_seen where flows have it."""
    seen = [c for c in ("first_seen",) if c in verdict_table.columns]
    grade = net.violation_grade(F.col(conn_state)) if conn_state else F.lit("established")
    kinds = F.array_compact(F.array(F.when(F.col("kind").isin("wrong_direction", "no_matching_conduit"), F.col("kind")), F.when(F.col("idmz_bypass"), F.lit("idmz_bypass"))))
    return verdict_table.select("src_ip", "dst_ip", "dst_port", "proto", "src_zone", "dst_zone", "packets", "bytes", *seen, grade.alias("grade"), F.explode(kinds).alias("violation"))


def conformance_tally(verdict_table: DataFrame) -> DataFrame:
    """One row: flows by kind, bypasses, external endpoints and violating flows."""
    kinds = ["allowed", "intra_zone", "multicast_exempt", "wrong_direction", "no_matching_conduit"]
    bad = F.col("kind").isin("wrong_direction", "no_matching_conduit") | F.col("idmz_bypass")
    return verdict_table.agg(
        F.count("*").alias("flows"),
        *(F.count_if(F.col("kind") == k).alias(k) for k in kinds),
        F.count_if("idmz_bypass").alias("idmz_bypasses"),
        F.coalesce(F.sum((F.col("src_zone") == EXTERNAL).cast("long") + (F.col("dst_zone") == EXTERNAL).cast("long")), F.lit(0)).alias("external_endpoints"),
        F.count_if(bad).alias("violating_flows"),
    )
