"""Queries over the derived packets and the text tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import net
from ..operators import catalog, conformance, drift, extract, hostnames, inventory, observe, privacy, rules
from ..operators.trusted import unmatched_trusted
from ..sources.packets import packets_table
from .fixtures import OT, POLICY, SPLIT, TRUSTED

Query = Callable[[SparkSession, str], DataFrame]


def _of(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: f(packets_table(spark, d))


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = packets_table(spark, d)
    return p.where(F.col("ts") < F.lit(SPLIT).cast("timestamp_ntz")), p.where(F.col("ts") >= F.lit(SPLIT).cast("timestamp_ntz"))


def _assets(p: DataFrame) -> DataFrame:
    return inventory.assets(observe.hosts(p, OT), inventory.oui_table(p.sparkSession))


def _context(p: DataFrame, conform: bool = False, trusted: bool = True) -> rules.Context:
    return rules.Context(p, OT, TRUSTED if trusted else [], conformance.verdicts(_states(observe.flows(p)), POLICY) if conform else None)


def _shown(findings: DataFrame) -> DataFrame:
    return findings.select("rule_id", "entity", "severity", "hits", "attempted", "items", F.array_join("evidence", "; ").alias("evidence"))


#: Rules whose own queries show all evidence of a pair: it has an item for each port, or for each of six ciphers.
WHOLE = ("compat.ntlmv1", "compat.weak_tls_cipher")


def _rule(name: str) -> Query:
    return _of(lambda p: _shown(rules.run_rules(_context(p, name in rules.CONFORMANCE_RULES), [name], [name] if name in WHOLE else [])))


def _verdicts(p: DataFrame) -> DataFrame:
    return conformance.verdicts(observe.flows(p), POLICY)


def _predicates(p: DataFrame) -> DataFrame:
    ips = p.select(F.explode(F.array("src_ip", "dst_ip")).alias("ip")).distinct()
    ip = F.col("ip")
    return ips.select("ip", net.ip_num(ip).alias("num"), net.in_ot(ip, OT).alias("in_ot"), net.is_public(ip).alias("public"), net.is_group_address(ip).alias("group_address"), net.subnet_of(ip).alias("subnet"), net.opaque_label(ip, "salt").alias("opaque"))


def _labels(p: DataFrame) -> DataFrame:
    label = net.port_label(F.col("proto"), F.col("src_port"), F.col("dst_port"))
    return p.groupBy(label.alias("label"), net.proto_label(F.col("proto")).alias("transport"), net.no_fly_label(F.col("proto"), F.col("dst_port")).alias("no_fly")).agg(F.count("*").alias("packets"), F.sum("payload_len").alias("bytes"))


def _findings(p: DataFrame) -> DataFrame:
    return rules.run_rules(_context(p))


def _addresses(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select(F.explode(F.regexp_extract_all("text", F.lit(f"({privacy.IPV4})"), 1)).alias("real")).distinct()


def scrub_map(spark: SparkSession, d: str) -> DataFrame:
    return privacy.build_scrub_map(_addresses(spark, d), "host")


def scrubbed_docs(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    return privacy.scrub(docs, "text", scrub_map(spark, d)).select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.length("text").cast("long").alias("chars"))


def unscrub_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose text a scrub and its reverse do not leave as it was: none."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    m = scrub_map(spark, d)
    back = privacy.unscrub(privacy.scrub(docs.withColumn("back", F.col("text")), "back", m), "back", m)
    return back.agg(F.count("*").alias("texts"), F.count_if(F.col("text") != F.col("back")).alias("changed"))


def leak_scan(spark: SparkSession, d: str) -> DataFrame:
    return privacy.leak_scan(spark.read.parquet(f"{d}/documents.parquet"), "text", ["doc_id"])


def conversation_leaks(spark: SparkSession, d: str) -> DataFrame:
    return privacy.leak_scan(spark.read.parquet(f"{d}/conversations.parquet"), "text", ["conv_id", "turn"])


def map_leaks(spark: SparkSession, d: str) -> DataFrame:
    return privacy.map_leaks(spark.read.parquet(f"{d}/documents.parquet"), "text", scrub_map(spark, d), ["doc_id"])


def flow_shifts(spark: SparkSession, d: str) -> DataFrame:
    base, now = _sides(spark, d)
    return drift.flow_delta(observe.flows(base), observe.flows(now))


def hosts_new(spark: SparkSession, d: str) -> DataFrame:
    base, now = _sides(spark, d)
    return drift.new_rows(observe.hosts(base, OT), observe.hosts(now, OT), ["ip"]).select("ip", "packets", "bytes", "in_ot")


def hosts_gone(spark: SparkSession, d: str) -> DataFrame:
    base, now = _sides(spark, d)
    return drift.new_rows(observe.hosts(now, OT), observe.hosts(base, OT), ["ip"]).select("ip", "packets", "bytes", "in_ot")


def role_shifts(spark: SparkSession, d: str) -> DataFrame:
    base, now = _sides(spark, d)
    return drift.role_shifts(_assets(base), _assets(now))


def findings_delta(spark: SparkSession, d: str) -> DataFrame:
    return drift.finding_delta(*(rules.run_rules(_context(p), ["recon.port_scan", "compat.smbv1", "compat.weak_tls_cipher"]) for p in _sides(spark, d)))


def segmentation_drift(spark: SparkSession, d: str) -> DataFrame:
    delta = drift.violation_delta(*(conformance.violations(_verdicts(p)) for p in _sides(spark, d)))
    return delta.groupBy("violation", "change").agg(F.count("*").alias("violations"))


def segmentation_tally(spark: SparkSession, d: str) -> DataFrame:
    return drift.tally_delta(*(conformance.conformance_tally(_verdicts(p)) for p in _sides(spark, d)))


def flow_rates(spark: SparkSession, d: str) -> DataFrame:
    """Flows that shift by bytes a second, of a base capture of 12 and a current one of 10 days."""
    base, now = _sides(spark, d)
    return drift.flow_delta(observe.flows(base), observe.flows(now), 3.0, 12 * 86400.0, 10 * 86400.0)


def _states(flows: DataFrame) -> DataFrame:
    """flows with the state that a connection log would have, by a fixed rule on their packets."""
    return flows.withColumn("conn_state", F.when(F.col("packets") == 1, "S0").when(F.col("packets") % 3 == 0, "REJ").when(F.col("packets") % 3 == 1, "SF").otherwise("OTH"))


def violations_graded(p: DataFrame) -> DataFrame:
    found = conformance.violations(conformance.verdicts(_states(observe.flows(p)), POLICY), "conn_state")
    return found.groupBy("violation", "grade").agg(F.count("*").alias("flows"), F.sum("packets").alias("packets"))


def _host_map(p: DataFrame) -> DataFrame:
    """A map of two thirds of the hosts."""
    hosts = p.select(F.explode(F.array("src_ip", "dst_ip")).alias("real")).distinct()
    return privacy.build_scrub_map(hosts.where(net.ip_num(F.col("real")) % 3 < 2), "host")


def unscrub_counts(spark: SparkSession, d: str) -> DataFrame:
    """Pseudonyms in the scrubbed documents, against a map that lacks every third of them."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    m = scrub_map(spark, d)
    part = m.where(F.regexp_extract("pseudonym", "_([0-9]+)$", 1).cast("long") % 3 != 0)
    return privacy.unscrub_report(privacy.scrub(docs, "text", m), "text", part)


def flow_shifts_pseudonyms(spark: SparkSession, d: str) -> DataFrame:
    """Flow drift keyed on pseudonyms; a third of the hosts is not in the map."""
    m = _host_map(packets_table(spark, d))
    return drift.flow_delta(*(privacy.pseudonymised(observe.flows(p), ["src_ip", "dst_ip"], m, "salt") for p in _sides(spark, d)))


def hosts_new_pseudonyms(spark: SparkSession, d: str) -> DataFrame:
    m = _host_map(packets_table(spark, d))
    base, now = (privacy.pseudonymised(observe.hosts(p, OT), ["ip"], m, "salt") for p in _sides(spark, d))
    return drift.new_rows(base, now, ["ip"]).select("ip", "packets", "bytes", "in_ot")


def role_shifts_pseudonyms(spark: SparkSession, d: str) -> DataFrame:
    m = _host_map(packets_table(spark, d))
    return drift.role_shifts(*(privacy.pseudonymised(_assets(p), ["ip"], m, "salt") for p in _sides(spark, d)))


def findings_delta_pseudonyms(spark: SparkSession, d: str) -> DataFrame:
    m = _host_map(packets_table(spark, d))
    found = (rules.run_rules(_context(p), ["recon.port_scan", "compat.smbv1", "compat.weak_tls_cipher"]) for p in _sides(spark, d))
    return drift.finding_delta(*(privacy.pseudonymised_entities(f, m, "salt") for f in found))


def segmentation_drift_pseudonyms(spark: SparkSession, d: str) -> DataFrame:
    m = _host_map(packets_table(spark, d))
    return drift.violation_delta(*(privacy.pseudonymised(conformance.violations(_verdicts(p)), ["src_ip", "dst_ip"], m, "salt") for p in _sides(spark, d)))


def findings_ranked(p: DataFrame) -> DataFrame:
    """Findings numbered by severity, then by rule and entity."""
    rank = F.array_position(F.array(*map(F.lit, ("critical", "high", "medium", "info"))), F.col("severity"))
    return privacy.numbered(_findings(p).select("rule_id", "entity", "severity", "hits"), [rank, "rule_id", "entity"], "position")


def assets_ranked(p: DataFrame) -> DataFrame:
    """Assets numbered with OT ones first, then by address."""
    return privacy.numbered(_assets(p).select("ip", "role", "in_ot"), [~F.col("in_ot"), net.ip_num(F.col("ip")), "ip"], "position")


def violations_ranked(p: DataFrame) -> DataFrame:
    """Violations numbered by the time of their flow, its key and their kind."""
    found = conformance.violations(_verdicts(p)).select("first_seen", *observe.FLOW_KEY, "violation")
    return privacy.numbered(found, ["first_seen", net.ip_num(F.col("src_ip")), net.ip_num(F.col("dst_ip")), "dst_port", "proto", "violation"], "position")


def _asset_names(p: DataFrame) -> DataFrame:
    return inventory.assets(observe.hosts(p, OT), inventory.oui_table(p.sparkSession), hostnames.hostnames(p)).select("ip", "hostname", "host_label")


QUERIES: dict[str, Query] = {
    "hostnames": _of(hostnames.hostnames),
    "asset_names": _of(_asset_names),
    "flow_shifts_pseudonyms": flow_shifts_pseudonyms,
    "hosts_new_pseudonyms": hosts_new_pseudonyms,
    "role_shifts_pseudonyms": role_shifts_pseudonyms,
    "findings_delta_pseudonyms": findings_delta_pseudonyms,
    "segmentation_drift_pseudonyms": segmentation_drift_pseudonyms,
    "asset_omitted": _of(lambda p: inventory.omitted_assets(_assets(p))),
    "findings_ranked": _of(findings_ranked),
    "assets_ranked": _of(assets_ranked),
    "violations_ranked": _of(violations_ranked),
    "flow_index": _of(lambda p: observe.flow_index(observe.flows(p)).select("flow_index", *observe.FLOW_KEY, net.service_source(F.col("label")).alias("service_source"))),
    "map_coverage": _of(lambda p: inventory.map_coverage(observe.hosts(p, OT), _host_map(p))),
    "violations_graded": _of(violations_graded),
    "segmentation_tally": segmentation_tally,
    "flow_rates": flow_rates,
    "unscrub_counts": unscrub_counts,
    "ip_predicates": _of(_predicates),
    "flow_labels": _of(_labels),
    "capture_totals": _of(observe.capture_totals),
    "mac_frames": _of(observe.mac_frames),
    "hosts": _of(lambda p: observe.hosts(p, OT).drop("macs", "protocols")),
    "host_protocols": _of(lambda p: observe.hosts(p, OT).select("ip", F.explode("protocols").alias("protocol"))),
    "flows": _of(observe.flows),
    "external_flows": _of(lambda p: observe.external_flows(observe.flows(p), OT).select(*observe.FLOW_KEY, "packets", "bytes")),
    "sent_received": _of(lambda p: observe.sent_received(observe.flows(p))),
    "comms_top25": _of(lambda p: observe.comms_matrix(observe.flows(p)).select(*observe.FLOW_KEY, "packets", "bytes")),
    "slice_hosts": _of(lambda p: observe.slice_packets(p, ["10.20.1.200", "10.10.0.1"], [("10.10.1.2", "10.20.1.2", 502)]).select("pkt_id", "src_ip", "dst_ip", "dst_port")),
    "modbus_events": _of(lambda p: extract.modbus_events(p).groupBy("fc", "sub", "label", "engineering").agg(F.count("*").alias("n"), F.count_distinct("src_ip").alias("sources"))),
    "s7_events": _of(lambda p: extract.s7_events(p).groupBy("fc", "label", "engineering", "read").agg(F.count("*").alias("n"))),
    "dnp3_events": _of(lambda p: extract.dnp3_events(p).groupBy("proto", "fc", "engineering").agg(F.count("*").alias("n"))),
    "enip_events": _of(lambda p: extract.enip_events(p).groupBy("command", "label", "cip_service", "engineering").agg(F.count("*").alias("n"))),
    "cred_events": _of(lambda p: extract.cred_events(p).drop("note")),
    "smbv1_pairs": _of(extract.smbv1_pairs),
    "tls_hellos": _of(extract.tls_hellos),
    "tls_ciphers": _of(extract.tls_ciphers),
    "rdp_events": _of(lambda p: extract.rdp_events(p).select("pkt_id", "src_ip", "dst_ip", "selected_protocol")),
    "ldap_binds": _of(lambda p: extract.ldap_binds(p).select("pkt_id", "src_ip", "dst_ip", "version", "anonymous", "used_starttls")),
    "modbus_units": _of(lambda p: extract.modbus_units(p).drop("unit_ids")),
    "findings_all": _of(lambda p: _shown(_findings(p))),
    "findings_policy": _of(lambda p: _shown(rules.run_rules(_context(p, True)))),
    "findings_by_severity": _of(lambda p: _findings(p).groupBy("severity").agg(F.count("*").alias("findings"), F.sum("hits").alias("hits"))),
    "findings_mitre": _of(lambda p: catalog.techniques(_findings(p))),
    "assets": _of(lambda p: _assets(p).select("ip", "mac", "vendor", "role", "packets", "bytes", "in_ot")),
    "asset_roles": _of(lambda p: _assets(p).groupBy("role", "vendor").agg(F.count("*").alias("assets"))),
    "asset_top100": _of(lambda p: inventory.top_assets(_assets(p)).select("ip", "role", "packets")),
    "capture_source": _of(lambda p: inventory.capture_source(observe.mac_frames(p), observe.capture_totals(p))),
    "capture_sanity": _of(lambda p: inventory.capture_sanity(observe.capture_totals(p), observe.steps_back(p))),
    "zone_suggest": _of(lambda p: inventory.suggest_zones(_assets(p).where("in_ot"))),
    "zone_resolve": _of(lambda p: conformance.resolve(p.select(F.explode(F.array("src_ip", "dst_ip")).alias("ip")).distinct(), "ip", POLICY, "z").select("ip", F.col("z.zone").alias("zone"), F.col("z.level").alias("level"), F.col("z.directed").alias("directed"))),
    "verdicts": _of(lambda p: _verdicts(p).select(*observe.FLOW_KEY, "src_zone", "dst_zone", "kind", "conduit", "idmz_bypass")),
    "violations": _of(lambda p: conformance.violations(_verdicts(p)).groupBy("violation", "src_zone", "dst_zone", "grade").agg(F.count("*").alias("flows"), F.sum("bytes").alias("bytes"))),
    "conformance_tally": _of(lambda p: conformance.conformance_tally(_verdicts(p))),
    "trusted_unmatched": _of(lambda p: unmatched_trusted(rules.engineering_events(p), TRUSTED)),
    "hosts_new": hosts_new,
    "hosts_gone": hosts_gone,
    "flow_shifts": flow_shifts,
    "role_shifts": role_shifts,
    "findings_delta": findings_delta,
    "segmentation_drift": segmentation_drift,
    "scrub_map": scrub_map,
    "leak_scan": leak_scan,
    "conversation_leaks": conversation_leaks,
    "map_leaks": map_leaks,
    "scrubbed_docs": scrubbed_docs,
    "unscrub_roundtrip": unscrub_roundtrip,
} | {f"rule_{n.split('.')[1]}": _rule(n) for n in rules.RULES}
