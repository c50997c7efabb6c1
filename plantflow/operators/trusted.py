"""The allow-list of writers: ordered declarations source=destination:protocol."""

from __future__ import annotations

import ipaddress
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import net

PROTOCOLS = ("modbus", "cip", "s7", "dnp3", "any")


@dataclass(frozen=True)
class Writer:
    src: str
    dst: str
    proto: str

    @classmethod
    def parse(cls, text: str) -> Writer:
        """Of '10.0.0.0/24=10.1.0.5:modbus'; a bare address is a network of one."""
        match = re.fullmatch(r"\s*([^=\s]+)=([^=\s]+):([a-z0-9]+)\s*", text)
        if not match or match[3] not in PROTOCOLS:
            raise ValueError(f"not a trusted writer: {text!r}")
        return cls(*(str(ipaddress.ip_network(match[k])) for k in (1, 2)), match[3])


def rule_index(rules: list[Writer], proto: Column, src: Column | None = None, dst: Column | None = None) -> Column:
    """The 1-based number of the first declaration that covers src_ip, dst_ip and proto; null where none does.

    src and dst: the numbers of the addresses, if they are at hand.
    """
    tries = [F.when(net.in_nets(F.col("src_ip"), [r.src], src) & net.in_nets(F.col("dst_ip"), [r.dst], dst) & (F.lit(r.proto == "any") | (proto == r.proto)), k) for k, r in enumerate(rules, 1)]
    return F.coalesce(*tries, F.lit(None).cast("int"))


#: Lists up to this length are tried as one expression; longer ones are joined.
UNROLLED = 16


def _prefix(digits: Column, length: Column) -> Column:
    """The first length bits of an address of hex digits, as text: whole digits and the bits of the next one as a number."""
    whole = F.floor(length / 4).cast("int")
    rest = F.coalesce(F.conv(F.nullif(F.substring(digits, whole + 1, F.lit(1)), F.lit("")), 16, 10).cast("int"), F.lit(0))
    return F.concat(F.substring(digits, F.lit(1), whole), F.lit("."), F.floor(rest / F.pow(F.lit(2), 4 - length % 4)).cast("string"))


def _declared_prefix(network: ipaddress.IPv4Network | ipaddress.IPv6Network) -> str:
    digits = network.network_address.packed.hex()
    whole, bits = divmod(network.prefixlen, 4)
    return f"{digits[:whole]}.{int(digits[whole : whole + 1] or '0', 16) >> (4 - bits)}"


def _first_declared(pairs: DataFrame, rules: list[Writer], proto: str, out: str) -> DataFrame:
    """src_ip, dst_ip, proto and out of the pairs that a declaration covers: a join on the prefixes of both sides.

    A pair meets the declarations by one key for each two lengths of prefixes that the list declares together, so the work
    grows with those (few in practice), not with the declarations.
    """
    spark = pairs.sparkSession
    side = lambda n: (len(n.network_address.packed) * 2, n.prefixlen)
    nets = [(k, ipaddress.ip_network(r.src), ipaddress.ip_network(r.dst), r.proto) for k, r in enumerate(rules, 1)]
    told = spark.createDataFrame([(k, p, *side(s), *side(d), _declared_prefix(s), _declared_prefix(d)) for k, s, d, p in nets], "_rule int, _proto string, s_digits int, s_length int, d_digits int, d_length int, _s string, _d string")
    kinds = sorted({(*side(s), *side(d)) for _, s, d, _ in nets})
    names = ("s_digits", "s_length", "d_digits", "d_length")
    kind = F.explode(F.array(*(F.struct(*(F.lit(x).alias(n) for x, n in zip(k, names, strict=True))) for k in kinds)))
    digits = lambda ip: F.coalesce(F.lpad(F.lower(F.hex(net.ip_num(F.col(ip)))), 8, "0"), net.v6_hex(F.col(ip)))
    rows = pairs.select("src_ip", "dst_ip", proto, digits("src_ip").alias("_src"), digits("dst_ip").alias("_dst")).withColumn("_kind", kind)
    rows = rows.select("src_ip", "dst_ip", proto, "_src", "_dst", "_kind.*").where((F.length("_src") == F.col("s_digits")) & (F.length("_dst") == F.col("d_digits")))
    rows = rows.select("src_ip", "dst_ip", proto, *names, _prefix(F.col("_src"), F.col("s_length")).alias("_s"), _prefix(F.col("_dst"), F.col("d_length")).alias("_d"))
    met = rows.join(told, [*names, "_s", "_d"]).where((F.col("_proto") == "any") | (F.col("_proto") == F.col(proto)))
    return met.groupBy("src_ip", "dst_ip", proto).agg(F.min("_rule").alias(out))


def match_trusted(events: DataFrame, rules: list[Writer], proto: str = "proto_name", out: str = "rule", src: Column | None = None, dst: Column | None = None) -> DataFrame:
    """events and the number of their first declaration, null where none covers them.

    Short lists are one expression. Distinct pairs of events meet long ones in a join by prefixes of both sides, and rows
    get their number from there; null addresses are covered by none. src and dst: the numbers of the addresses, if they are
    at hand.
    """
    if len(rules) <= UNROLLED:
        return events.withColumn(out, rule_index(rules, F.col(proto), src, dst))
    found = _first_declared(events.select("src_ip", "dst_ip", proto).distinct(), rules, proto, out)
    return events.join(found, ["src_ip", "dst_ip", proto], "left").select(*events.columns, out)


def unmatched_trusted(events: DataFrame, rules: list[Writer]) -> DataFrame:
    """Declarations no event matches first: rule, declaration."""
    spark = events.sparkSession
    declared = spark.createDataFrame([(k, f"{r.src}={r.dst}:{r.proto}") for k, r in enumerate(rules, 1)], "rule int, declaration string")
    return declared.join(match_trusted(events, rules).where("rule IS NOT NULL").select("rule").distinct(), "rule", "left_anti")


def trusted_digest(rules: list[Writer]) -> str:
    """SHA-256 of the sorted, distinct declarations."""
    import hashlib

    return hashlib.sha256("\n".join(sorted({f"{r.src}={r.dst}:{r.proto}" for r in rules})).encode()).hexdigest()
