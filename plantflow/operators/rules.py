"""Findings: rules yield evidence rows, and one chain of aggregations makes findings of them all.

An evidence row is (rule_id, severity, entity, place, item, weight, attempted). Entity is empty where a rule has one
finding in all, else the source or the pair. Place tells the items of a finding apart and orders them; rows of one place
add up. A finding sums the weights, takes the highest severity and keeps the first items in the order of its rule.

Packets are scanned once for what recognisers mark, once for flows, and once more for each of what needs the order of
events: details of engineering, StartTLS and first credentials.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import net
from ..schemas import SEVERITY_RANK
from . import extract, observe
from .trusted import Writer, match_trusted

#: Evidence kept for a finding, where it is not 15; the rules whose evidence is in order of place, not of weight.
EVIDENCE = 15
CAPS = {"creds.ldap_simple_bind": 5, "compat.ntlmv1": 5, "creds.rdp_no_nla": 5, "compat.weak_tls_cipher": 5, "attack.spoofed_sources": 5, "ics.trusted_writer_activity": 30}
BY_PLACE = ("creds.ldap_simple_bind", "compat.ntlmv1", "creds.rdp_no_nla", "compat.weak_tls_cipher", "ics.modbus_writes", "ics.cip_engineering", "ics.s7_engineering", "ics.dnp3_engineering", "ics.trusted_writer_activity", "segmentation.idmz_bypass", "segmentation.wrong_direction", "segmentation.deny_by_default")
#: Calls told for a pair.
DETAILS = 5
#: A finding with this many hits or fewer is none.
MORE_THAN = {"attack.spoofed_sources": 500}
#: Parts that the items of a finding are dealt to before they meet.
PARTS = 16


@dataclass
class Context:
    """What rules read; flow_table is the flows, or the verdicts on them where a policy is declared."""

    packets: DataFrame
    ot: tuple[str, ...] = ()
    trusted: list[Writer] = field(default_factory=list)
    verdicts: DataFrame | None = None


def _evidence(rule: str | Column, severity: str | Column, item: Column, weight: Column | str | int = 1, entity: Column | None = None, place: Column | None = None, attempted: Column | None = None) -> Column:
    """One evidence row as a struct; without a place, the item is its own."""
    text = lambda v: F.lit(v) if isinstance(v, str) else v
    count = F.lit(weight) if isinstance(weight, int) else F.col(weight) if isinstance(weight, str) else weight
    return F.struct(
        text(rule).alias("rule_id"),
        text(severity).alias("severity"),
        (F.lit("") if entity is None else entity).alias("entity"),
        (item if place is None else place).alias("place"),
        item.alias("item"),
        count.cast("long").alias("weight"),
        (F.lit(0) if attempted is None else attempted).cast("long").alias("attempted"),
    )


def _rows(df: DataFrame, *evidence: Column) -> DataFrame:
    """The evidence rows of df: one, or those of several that are not null."""
    if len(evidence) == 1:
        return df.select(evidence[0].alias("e")).select("e.*")
    return df.select(F.explode(F.array_compact(F.array(*evidence))).alias("e")).select("e.*")


def _pair() -> Column:
    return F.concat("src_ip", F.lit(" -> "), "dst_ip")


def _service() -> Column:
    return F.concat("src_ip", F.lit(" -> "), "dst_ip", F.lit(":"), F.col("dst_port").cast("string"))


def _numbered(df: DataFrame) -> DataFrame:
    """df with numbers, IPv6 digits and sort texts of both addresses, so that predicates read them once."""
    sides = ("src", "dst")
    df = df.withColumns({f"_{s}": net.ip_num(F.col(f"{s}_ip")) for s in sides} | {f"_{s}6": net.v6_hex(F.col(f"{s}_ip")) for s in sides})
    return df.withColumns({f"_at_{s}": net.ip_order(F.col(f"_{s}"), F.col(f"_{s}6")) for s in sides})


def _at(*columns: str) -> Column:
    """Addresses (of _numbered rows) and ports as text that sorts like them."""
    return F.concat(*(F.col(f"_at_{c[:3]}") if c.endswith("_ip") else F.lpad(F.col(c).cast("string"), 5, "0") for c in columns))


#: Protocol of engineering marks, their rule, and severity of any source where it does not depend on the source.
ENGINEERING = {"modbus": ("ics.modbus_writes", None), "cip": ("ics.cip_engineering", "high"), "s7": ("ics.s7_engineering", None), "dnp3": ("ics.dnp3_engineering", None)}


def _call(mark: Column, code: Column) -> Column:
    """What an engineering mark says."""
    modbus = extract.modbus_label(F.floor(code / 65536), code % 65536)
    return F.when(mark == "modbus", modbus).when(mark == "cip", extract.named(code, extract.ENIP_LABELS)).when(mark == "s7", extract.named(code, extract.S7_LABELS)).otherwise(F.concat(F.lit("function "), code.cast("string")))


def engineering_events(packets: DataFrame) -> DataFrame:
    """src_ip, dst_ip, proto_name and label of all engineering events, with ts and pkt_id."""
    return extract.marks(packets, tuple(ENGINEERING)).select("src_ip", "dst_ip", F.col("mark").alias("proto_name"), _call(F.col("mark"), F.col("code")).alias("label"), "ts", "pkt_id")


def _judged(rows: DataFrame, c: Context) -> tuple[DataFrame, Column, Column, Column]:
    """rows (src_ip, dst_ip, mark) with their trusted declaration, and rule, severity and place of their pair."""
    rows = _numbered(rows)
    rows = match_trusted(rows, c.trusted, "mark", "trusted", F.col("_src"), F.col("_dst"))
    inside = net.in_ot(F.col("src_ip"), c.ot or None, F.col("_src"))
    rule, severity, order = F.lit(None).cast("string"), F.when(inside, "high").otherwise("critical"), F.lit("")
    for k, (name, (rule_id, always)) in enumerate(ENGINEERING.items()):
        here = F.col("mark") == name
        rule = F.when(here, rule_id).otherwise(rule)
        severity = F.when(here, always).otherwise(severity) if always else severity
        order = F.when(here, str(k)).otherwise(order)
    known = F.col("trusted").isNotNull()
    place = F.concat(F.when(known, order).otherwise(""), _at("src_ip", "dst_ip"))
    return rows, F.when(known, "ics.trusted_writer_activity").otherwise(rule), F.when(known, "info").otherwise(severity), place


def marked(c: Context, names: Iterable[str]) -> DataFrame:
    """All that single packets show, from one scan and one aggregation."""
    rules = {
        **{f"creds.{kind}": (kind,) for kind in extract.CLEAR},
        **{rule: (mark,) for mark, (rule, _) in ENGINEERING.items()},
        "ics.trusted_writer_activity": tuple(ENGINEERING),
        "compat.ntlmv1": ("ntlmv1",),
        "compat.smbv1": ("smbv1",),
        "compat.stale_tls": ("tls",),
        "compat.weak_tls_cipher": ("cipher",),
        "creds.rdp_no_nla": ("rdp",),
        "ics.modbus_unit_id_sweep": ("units",),
    }
    wanted = {m for rule in names for m in rules.get(rule, ())}
    rows = extract.marks(c.packets, tuple(m for m in extract.MARKS if m in wanted)).groupBy("mark", "src_ip", "dst_ip", "port", "code").agg(F.count("*").alias("n"))
    rows, rule, severity, place = _judged(rows, c)
    mark, code = F.col("mark"), F.col("code")
    rows = rows.withColumn("dst_port", F.col("port"))
    target = F.concat("dst_ip", F.lit(":"), F.col("port").cast("string"))
    calls = F.when(mark.isin(*ENGINEERING), _evidence(rule, severity, F.lit(None).cast("string"), "n", None, place))
    simple = F.when(mark.isin(*extract.CLEAR), _evidence(F.concat(F.lit("creds."), mark), "critical", target, "n", None, _at("dst_ip", "port")))
    simple = simple.when(mark == "ntlmv1", _evidence("compat.ntlmv1", "high", _service(), "n", _pair(), _at("port")))
    simple = simple.when(mark == "smbv1", _evidence("compat.smbv1", "high", _service(), "n", None, _at("src_ip", "dst_ip", "port")))
    simple = simple.when(mark == "tls", _evidence("compat.stale_tls", "medium", F.concat(_pair(), F.lit(" "), F.hex("code")), "n", None, F.concat(_at("src_ip", "dst_ip"), F.hex("code"))))
    simple = simple.when(mark == "cipher", _evidence("compat.weak_tls_cipher", "medium", F.hex("code"), "n", _pair(), F.lpad(F.hex("code"), 4, "0")))
    simple = simple.when(mark == "rdp", _evidence("creds.rdp_no_nla", "critical", _pair(), "n", _pair()))
    # ids of a sweep add up at their own places; the finding tells the first ten
    sweep = F.when(mark == "units", _evidence("ics.modbus_unit_id_sweep", "medium", code.cast("string"), 1, _pair(), F.lpad(code.cast("string"), 3, "0")))
    return _rows(rows, calls, simple, sweep)


def engineering_details(c: Context, names: Iterable[str]) -> DataFrame:
    """The first DETAILS calls of each pair: every task sends as many of a pair at most."""
    wanted = tuple(ENGINEERING) if "ics.trusted_writer_activity" in names else tuple(m for m, (rule, _) in ENGINEERING.items() if rule in names)
    k = F.row_number().over(Window.partitionBy("mark", "src_ip", "dst_ip").orderBy("ts", "pkt_id"))
    first = extract.marks(c.packets, wanted).withColumn("k", k).where(F.col("k") <= DETAILS).groupBy("mark", "src_ip", "dst_ip").agg(F.array_sort(F.collect_list(F.struct("k", "code"))).alias("first"))
    first, rule, severity, place = _judged(first, c)
    told = F.array_join(F.transform("first", lambda e: _call(F.col("mark"), e["code"])), ", ")
    known = F.col("trusted").isNotNull()
    item = F.concat(F.when(known, F.concat("mark", F.lit(" "))).otherwise(""), _pair(), F.lit(" : "), told, F.when(known, F.concat(F.lit(" #"), F.col("trusted").cast("string"))).otherwise(""))
    return _rows(first, _evidence(rule, severity, item, 0, None, place))


def weak_creds(c: Context, names: Iterable[str]) -> DataFrame:
    events = extract.cred_events(c.packets, ("ftp", "http_basic"))
    return _rows(extract.weak_credentials(events), _evidence("creds.default_or_weak_credentials", "critical", F.concat(_service(), F.lit(" "), F.col("category")), "n"))


def ldap_simple_bind(c: Context, names: Iterable[str]) -> DataFrame:
    binds = extract.ldap_binds(c.packets).where("NOT used_starttls AND NOT anonymous").groupBy("src_ip", "dst_ip").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("dst_port")).alias("ports"))
    ports = F.array_join(F.transform("ports", lambda p: p.cast("string")), ",")
    return _rows(_numbered(binds), _evidence("creds.ldap_simple_bind", "critical", F.concat(_pair(), F.lit(":"), ports), "n", None, _at("src_ip", "dst_ip")))


#: Ports of encrypted tunnels.
TUNNEL_PORTS = (1194, 4500, 500, 51820)


def _flows(c: Context) -> DataFrame:
    """Flows with what the rules on flows need. All of them read all columns, so that one aggregation serves them."""
    named = net.port_label(F.col("proto"), F.col("src_port"), F.col("dst_port")).isNotNull()
    known = lambda mac: F.coalesce(F.col(mac) != "00:00:00:00:00:00", F.lit(False))
    rows = c.packets.select(*observe.FLOW_KEY, "payload_len", known("src_mac").alias("src_known"), known("dst_mac").alias("dst_known"), named.alias("named"))
    rows = rows.groupBy(*observe.FLOW_KEY).agg(F.count("*").alias("packets"), F.sum("payload_len").alias("bytes"), F.max("src_known").alias("src_known"), F.max("dst_known").alias("dst_known"), F.max("named").alias("named"))
    return rows.where("bytes IS NOT NULL OR src_known OR dst_known OR named OR packets > 0")


def flow_rules(c: Context, names: Iterable[str]) -> DataFrame:
    """Egress (with the kind of traffic where it is telling), boundary services, protocols out of place and, with verdicts, violations: one pass over the flows."""
    rows = _numbered(c.verdicts if c.verdicts is not None else _flows(c))
    src_ot, dst_ot = net.in_ot(F.col("src_ip"), c.ot or None, F.col("_src")), net.in_ot(F.col("dst_ip"), c.ot or None, F.col("_dst"))
    rows = rows.withColumns({"src_ot": src_ot, "dst_ot": dst_ot, "public": net.is_public(F.col("dst_ip"), F.col("_dst"), F.col("_dst6")), "no_fly": net.no_fly_label(F.col("proto"), F.col("dst_port"))})
    port = F.col("dst_port")
    flow = F.concat(_service(), F.lit("/"), net.proto_label(F.col("proto")))
    traffic = F.when(port == 53, " dns").when(port == 123, " ntp").when(port.isin(*TUNNEL_PORTS), " tunnel").otherwise("")
    leaves = F.col("src_ot") & ~F.col("dst_ot")
    at = F.concat(_at("src_ip", "dst_ip", "dst_port"), F.lpad(F.col("proto").cast("string"), 3, "0"))
    evidence = [
        F.when(F.col("src_ot") & F.col("public"), _evidence("egress.ot_to_internet", "critical", F.concat(flow, traffic), "bytes", None, at)),
        F.when(leaves & (port == 53), _evidence("boundary.dns_resolver", "medium", _pair(), "packets", None, _at("src_ip", "dst_ip"))),
        F.when(leaves & (port == 123), _evidence("boundary.ntp_external", "medium", _pair(), "packets", None, _at("src_ip", "dst_ip"))),
        F.when(F.col("no_fly").isNotNull() & (F.col("src_ot") | F.col("dst_ot")), _evidence("ot.unexpected_protocols", "medium", F.concat("no_fly", F.lit(" "), _service()), "packets", None, F.concat(_at("src_ip", "dst_ip", "dst_port"), "no_fly"))),
    ]
    if c.verdicts is not None:
        grade = net.violation_grade(F.col("conn_state")) if "conn_state" in c.verdicts.columns else F.lit("established")
        attempted = (grade == "attempted").cast("int")
        violation = lambda rule, severity: _evidence(rule, severity, F.concat(flow, F.lit(" "), grade), 1, None, F.concat(attempted.cast("string"), at), attempted)
        evidence.append(F.when(F.col("idmz_bypass"), violation("segmentation.idmz_bypass", "critical")))
        evidence.append(F.when(F.col("kind") == "wrong_direction", violation("segmentation.wrong_direction", "high")))
        evidence.append(F.when(F.col("kind") == "no_matching_conduit", violation("segmentation.deny_by_default", "high")))
    return _rows(rows, *evidence)


def port_scan(c: Context, names: Iterable[str], least: int = 10, few: int = 3, high: int = 50) -> DataFrame:
    """Sources that reach many destinations or many (port, protocol); group addresses do not count.

    Destinations, and then ports, are counted by a flow's first appearance among those of its source, so
    no row is expanded.
    """
    rows = _flows(c).where(~net.is_group_address(F.col("dst_ip"))).select("src_ip", "packets", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("dst_ip").alias("value"), F.col("packets").alias("p")), F.struct(F.lit(1).alias("side"), F.concat(F.col("dst_port").cast("string"), F.lit("/"), F.col("proto").cast("string")).alias("value"), F.lit(0).cast("long").alias("p")))).alias("s"))
    seen = rows.groupBy("src_ip", "s.side", "s.value").agg(F.sum("s.p").alias("packets"))
    rows = seen.groupBy("src_ip").agg(F.count_if(F.col("side") == 0).alias("d"), F.count_if(F.col("side") == 1).alias("p"), F.sum("packets").alias("packets"))
    d, p = F.col("d"), F.col("p")
    kind = F.when((d >= least) & (p <= few), "horizontal").when((d <= few) & (p >= least), "vertical").otherwise("combined")
    rows = rows.where((d >= least) | (p >= least))
    return _rows(rows, _evidence("recon.port_scan", F.when((d >= high) | (p >= high), "high").otherwise("medium"), F.concat(kind, F.lit(" "), d.cast("string"), F.lit(" hosts "), p.cast("string"), F.lit(" ports")), "packets", F.col("src_ip")))


def spoofed_sources(c: Context, names: Iterable[str]) -> DataFrame:
    """The targets of one-packet sources without a MAC, a reply or a protocol: one aggregation of flows by address."""
    side = lambda ip, mac, sent: F.struct(F.col(ip).alias("ip"), F.col(mac).alias("known"), (F.col("packets") if sent else F.lit(0).cast("long")).alias("sent"), (F.col("dst_ip") if sent else F.lit(None).cast("string")).alias("target"))
    sides = _flows(c).select("packets", "named", F.explode(F.array(side("src_ip", "src_known", True), side("dst_ip", "dst_known", False))).alias("h"))
    one = sides.groupBy("h.ip").agg(F.sum("packets").alias("packets"), F.sum("h.sent").alias("sent"), F.max("h.known").alias("known"), F.max("named").alias("named"), F.max("h.target").alias("dst_ip"))
    one = one.where("packets = 1 AND sent = 1 AND NOT known AND NOT named").select("dst_ip", F.lit(None).cast("string").alias("src_ip"))
    return _rows(_numbered(one), _evidence("attack.spoofed_sources", "high", F.col("dst_ip"), 1, None, _at("dst_ip")))


CONFORMANCE_RULES = ("segmentation.idmz_bypass", "segmentation.wrong_direction", "segmentation.deny_by_default")
_CALLS = (*(rule for rule, _ in ENGINEERING.values()), "ics.trusted_writer_activity")
#: Functions and the rules whose evidence they find.
SOURCES: list[tuple[Callable[[Context, Iterable[str]], DataFrame], tuple[str, ...]]] = [
    (marked, (*(f"creds.{kind}" for kind in extract.CLEAR), *_CALLS, "compat.ntlmv1", "compat.smbv1", "compat.stale_tls", "compat.weak_tls_cipher", "creds.rdp_no_nla", "ics.modbus_unit_id_sweep")),
    (engineering_details, _CALLS),
    (weak_creds, ("creds.default_or_weak_credentials",)),
    (ldap_simple_bind, ("creds.ldap_simple_bind",)),
    (flow_rules, ("egress.ot_to_internet", "boundary.dns_resolver", "boundary.ntp_external", "ot.unexpected_protocols", *CONFORMANCE_RULES)),
    (port_scan, ("recon.port_scan",)),
    (spoofed_sources, ("attack.spoofed_sources",)),
]
RULES = tuple(dict.fromkeys(rule for _, rules in SOURCES for rule in rules))


def severity_rank(severity: Column) -> Column:
    return F.coalesce(*(F.when(severity == k, v) for k, v in SEVERITY_RANK.items()))


def _of_rule(values: dict, otherwise) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), F.col("rule_id")), F.lit(otherwise))


#: Units that make a sweep, and a grave one.
SWEEP, GRAVE_SWEEP, SWEEP_SHOWN = 5, 50, 10


def findings(rows: DataFrame, whole: Iterable[str] = ()) -> DataFrame:
    """rule_id, entity, severity, hits, attempted (of hits), items and the first evidence of each finding; of the rules of whole, all of it.

    The items of a finding are dealt to PARTS parts, so none is too large for a task. Each part adds up its items,
    cuts its evidence to what the rule shows and counts all; then the parts of a finding, a row each, meet. Evidence is in
    falling order of weight or in that of places; ties by place. Rules of whole are to have few items for each entity.
    """
    part = ["rule_id", "entity", "part"]
    rows = rows.withColumn("part", F.pmod(F.xxhash64("place"), F.lit(PARTS))).repartition(*part)
    items = rows.groupBy(*part, "place").agg(F.sum("weight").alias("weight"), F.sum("attempted").alias("attempted"), F.max(severity_rank(F.col("severity"))).alias("rank"), F.max("item").alias("item"))
    order = F.when(F.col("rule_id").isin(*BY_PLACE), F.lit(0).cast("long")).otherwise(-F.col("weight"))
    cap, uncut = _of_rule(CAPS, EVIDENCE), F.col("rule_id").isin(*whole) if whole else F.lit(False)
    items = items.withColumn("order", order).withColumn("k", F.row_number().over(Window.partitionBy(*part).orderBy("order", "place")))
    sweep = F.col("rule_id") == "ics.modbus_unit_id_sweep"
    text = F.when(sweep, F.col("item")).otherwise(F.concat("item", F.lit(" ("), F.col("weight").cast("string"), F.lit(")")))
    kept = F.collect_list(F.when(uncut | (F.col("k") <= cap), F.struct("order", "place", text.alias("text"))))
    sums = lambda names: [F.sum(n).alias(n) for n in names]
    parts = items.groupBy(*part).agg(*sums(("weight", "attempted")), F.count("*").alias("items"), F.max("rank").alias("rank"), kept.alias("top"))
    found = parts.groupBy("rule_id", "entity").agg(*sums(("weight", "attempted", "items")), F.max("rank").alias("rank"), F.flatten(F.collect_list("top")).alias("top"))
    top = F.array_sort("top")
    shown = F.transform(F.when(uncut, top).otherwise(F.slice(top, 1, cap)), lambda e: e["text"])
    units = F.concat(F.array_join(F.slice(shown, 1, SWEEP_SHOWN), ","), F.lit(" ("), F.col("items").cast("string"), F.lit(")"))
    few = F.coalesce(F.col("weight") <= F.coalesce(_of_rule(MORE_THAN, 0)), F.lit(False)) | (sweep & (F.col("items") < SWEEP))
    rank = F.when(sweep & (F.col("items") >= GRAVE_SWEEP), SEVERITY_RANK["high"]).otherwise(F.col("rank"))
    severity = F.element_at(F.array(*(F.lit(k) for k, _ in sorted(SEVERITY_RANK.items(), key=lambda x: x[1]))), rank + 1)
    return found.where(~few).select("rule_id", "entity", severity.alias("severity"), F.col("weight").alias("hits"), "attempted", F.when(sweep, 1).otherwise(F.col("items")).cast("long").alias("items"), F.when(sweep, F.array(units)).otherwise(shown).alias("evidence"))


def run_rules(c: Context, only: Iterable[str] | None = None, whole: Iterable[str] = ()) -> DataFrame:
    """All findings, as one plan; those of the rules of whole show all of their evidence. With verdicts, the egress rule gives way to the three conformance rules; trusted activity needs declarations."""
    if only is None:
        names = [n for n in RULES if n not in CONFORMANCE_RULES or c.verdicts is not None]
        names = [n for n in names if n != "egress.ot_to_internet" or c.verdicts is None]
    else:
        names = list(only)
        if unknown := set(names) - set(RULES):
            raise ValueError(f"no rules named {sorted(unknown)}")
    rows = reduce(DataFrame.unionByName, (find(c, names) for find, rules in SOURCES if set(rules) & set(names)))
    return findings(rows.where(F.col("rule_id").isin(*names)), whole)
