"""The rule catalogue as a dimension, and findings enriched with it."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import net

#: Severity and public ATT&CK for ICS techniques of a rule; titles and actions are ours.
CATALOG = [
    ("creds.ftp", "critical", ["T0859"], "FTP logins in clear text", "Move the transfer to SFTP and change the accounts seen."),
    ("creds.telnet", "critical", ["T0859"], "Telnet sessions", "Replace Telnet by SSH, or confine it to a console network."),
    ("creds.http_basic", "critical", ["T0859"], "HTTP Basic credentials in clear text", "Serve the page over TLS and change the accounts seen."),
    ("creds.snmp", "critical", ["T0859"], "SNMP community strings in clear text", "Move to SNMPv3 and change the communities seen."),
    ("creds.default_or_weak_credentials", "critical", ["T0859"], "Default or weak credentials", "Set strong, distinct credentials on the devices listed."),
    ("creds.ldap_simple_bind", "critical", ["T0859"], "LDAP simple binds without TLS", "Require StartTLS or LDAPS on the directory."),
    ("compat.ntlmv1", "high", ["T0859"], "NTLMv1 negotiation", "Refuse NTLMv1 on servers and clients."),
    ("ics.modbus_writes", "high", ["T0836", "T0855"], "Modbus writes or diagnostics", "Check each writer against planned work; declare it or stop it."),
    ("ics.cip_engineering", "high", ["T0858"], "CIP engineering services", "Check each source against planned work."),
    ("ics.s7_engineering", "high", ["T0858", "T0843"], "S7 engineering functions", "Check each source against planned work; look for program changes."),
    ("ics.dnp3_engineering", "high", ["T0855", "T0836"], "DNP3 control functions", "Check each master against planned operation."),
    ("ics.trusted_writer_activity", "info", [], "Activity of declared writers", "Confirm that the declarations still hold."),
    ("compat.smbv1", "high", ["T0866"], "SMBv1 in use", "Turn SMBv1 off, or isolate hosts that need it."),
    ("compat.stale_tls", "medium", ["T0830"], "Outdated TLS versions offered", "Update the clients to TLS 1.2 or later."),
    ("compat.weak_tls_cipher", "medium", ["T0830"], "Weak TLS ciphers offered", "Remove the ciphers from the client's configuration."),
    ("creds.rdp_no_nla", "critical", ["T0822"], "Remote desktop without network-level authentication", "Require network-level authentication."),
    ("ics.modbus_unit_id_sweep", "medium", ["T0846", "T0888"], "Sweep over Modbus unit ids", "Find out who runs the sweep."),
    ("egress.ot_to_internet", "critical", ["T0883"], "OT hosts reach public addresses", "Block the path and find its purpose."),
    ("boundary.dns_resolver", "medium", ["T0884"], "DNS leaves the OT networks", "Point OT hosts to a resolver inside."),
    ("boundary.ntp_external", "medium", ["T0884"], "Time is taken from outside the OT networks", "Provide a time source inside."),
    ("recon.port_scan", "medium", ["T0846"], "Scan of hosts or ports", "Find out who runs the scan."),
    ("ot.unexpected_protocols", "medium", ["T0883"], "Protocols that have no place on a control network", "Identify the devices and remove the service."),
    ("attack.spoofed_sources", "high", ["T0814"], "Flood from spoofed sources", "Filter at the border and check the targets listed."),
    ("segmentation.idmz_bypass", "critical", [], "Flows between OT and IT that skip the DMZ", "Route the service through the DMZ."),
    ("segmentation.wrong_direction", "high", [], "Flows against the direction of their conduit", "Check which side starts the connection."),
    ("segmentation.deny_by_default", "high", [], "Flows that no conduit allows", "Declare the conduit or block the flow."),
]


def rule_catalog(spark: SparkSession) -> DataFrame:
    """position, rule_id, severity, techniques, title, action of every rule, in a fixed order."""
    return spark.createDataFrame([(k, *row) for k, row in enumerate(CATALOG, 1)], "position int, rule_id string, base_severity string, techniques array<string>, title string, action string")


def with_catalog(findings: DataFrame) -> DataFrame:
    """findings with title, techniques and a playbook: the rule's action, then what to start from."""
    out = findings.join(F.broadcast(rule_catalog(findings.sparkSession)), "rule_id", "left")  # one row a rule
    first = F.when(F.size("evidence") > 0, F.concat(F.lit("Start with "), F.element_at("evidence", 1)))
    return out.withColumn("playbook", F.array_compact(F.array("action", first))).drop("position", "base_severity", "action")


def techniques(findings: DataFrame) -> DataFrame:
    """technique, findings, hits."""
    return with_catalog(findings).select(F.explode("techniques").alias("technique"), "hits").groupBy("technique").agg(F.count("*").alias("findings"), F.sum("hits").alias("hits"))


def write_json(findings: DataFrame, assets: DataFrame, path: str) -> None:
    """Findings and inventory as JSON lines in two folders, written by all tasks."""
    with_catalog(findings).write.json(f"{path}/findings")
    assets.write.json(f"{path}/inventory")


def document_lines(findings: DataFrame, assets: DataFrame, version: str, source: str) -> DataFrame:
    """section, position and line: in this order, the lines of one JSON document with version, input, inventory and findings.

    Assets come by address, findings by rule and entity; rows are numbered over ranges, so no task holds a list.
    """
    from .privacy import numbered

    def listed(df: DataFrame, section: int, order: list, keep: list[str]) -> DataFrame:
        rows = numbered(df, order, "_position")
        line = F.concat(F.when(F.col("_position") > 1, ",").otherwise(""), F.to_json(F.struct(*keep)))
        return rows.select(F.lit(section).alias("section"), F.col("_position").cast("long").alias("position"), line.alias("line"))

    told = with_catalog(findings)
    fixed = [(0, 0, f'{{"version":{json.dumps(version)},"input":{json.dumps(source)},"inventory":['), (2, 0, '],"findings":['), (4, 0, "]}")]
    edges = findings.sparkSession.createDataFrame(fixed, "section int, position long, line string")
    by_address = [F.coalesce(net.ip_num(F.col("ip")), F.lit(1 << 33)), F.col("ip")]
    return edges.unionByName(listed(assets, 1, by_address, assets.columns)).unionByName(listed(told, 3, ["rule_id", "entity"], told.columns))


def write_document(findings: DataFrame, assets: DataFrame, path: str, version: str = "1", source: str = "") -> None:
    """One JSON document in a folder of text files, written by all tasks: the files in the order of their names, joined, are the document."""
    lines = document_lines(findings, assets, version, source)
    lines.repartitionByRange("section", "position").sortWithinPartitions("section", "position").select("line").write.text(path)
