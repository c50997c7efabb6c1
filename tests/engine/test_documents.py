import json

from plantflow.operators import catalog, inventory, privacy


def test_one_document_of_all_files(spark, tmp_path):
    assets = spark.createDataFrame([(f"10.0.{k // 200}.{k % 200}", None if k % 3 else "PLC") for k in range(500)] + [("fe80::1", 'a "quoted" role')], "ip string, role string")
    findings = spark.createDataFrame([("recon.port_scan", f"10.0.0.{k}", "high", 3, ["one", "two"]) for k in range(40)] + [("made.up", "", "info", 1, [])], "rule_id string, entity string, severity string, hits long, evidence array<string>")
    catalog.write_document(findings, assets, str(tmp_path / "out"), "1.2", 'a "b".pcap')
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    got = json.loads(text)
    assert list(got) == ["version", "input", "inventory", "findings"] and got["version"] == "1.2" and got["input"] == 'a "b".pcap'
    assert [a["ip"] for a in got["inventory"]][:3] == ["10.0.0.0", "10.0.0.1", "10.0.0.2"] and len(got["inventory"]) == 501 and got["inventory"][-1]["role"] == 'a "quoted" role'
    assert len(got["findings"]) == 41 and got["findings"][0]["rule_id"] == "made.up" and got["findings"][1]["techniques"]
    catalog.write_document(findings.limit(0), assets.limit(0), str(tmp_path / "none"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "none").glob("part-*")))
    assert json.loads(text) == {"version": "1", "input": "", "inventory": [], "findings": []}


def test_entities_tell_pseudonyms_and_nothing_else(spark):
    known = spark.createDataFrame([("10.0.0.1", "host_001"), ("10.0.0.2", "host_002")], "real string, pseudonym string")
    rows = spark.createDataFrame([(k, e) for k, e in enumerate(["10.0.0.1", "10.0.0.1 -> 10.0.0.2", "", None, "10.0.0.1 -> 10.9.9.9"])], "k int, entity string")
    got = {r.k: r.entity for r in privacy.pseudonymised_entities(rows, known, "salt").collect()}
    assert got[0] == "host_001" and got[1] == "host_001 -> host_002" and got[2] == "" and got[3] == ""
    assert got[4].startswith("host_001 -> ") and "10.9.9.9" not in got[4]


def test_omitted(spark):
    assets = spark.range(7)
    assert tuple(inventory.omitted_assets(assets, 5).first()) == (7, 5, 2) and tuple(inventory.omitted_assets(assets, 9).first()) == (7, 7, 0)
