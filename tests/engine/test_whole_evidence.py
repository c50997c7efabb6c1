import datetime
import struct

import duckdb
import pytest

from plantflow.operators import rules
from plantflow.plans import oracle, queries
from plantflow.schemas import PACKETS

PORTS = (80, 135, 139, 443, 445, 8080)
CIPHERS = (1, 2, 4, 5, 9, 10)


def ntlm() -> str:
    return ("00000040" + "4E544C4D53535000" + "01000000" + struct.pack("<I", 1 << 9).hex()).upper()


def hello() -> str:
    suites = b"".join(struct.pack(">H", c) for c in CIPHERS)
    body = b"\x03\x01" + bytes(32) + b"\x00" + struct.pack(">H", len(suites)) + suites + b"\x01\x00"
    inner = b"\x01" + struct.pack(">I", len(body))[1:] + body
    return (b"\x16\x03\x01" + struct.pack(">H", len(inner)) + inner).hex().upper()


def packets(spark, rows):
    start = datetime.datetime(2024, 1, 1)
    return spark.createDataFrame([(k, start, "00:1B:1B:00:00:01", "00:0E:8C:01:00:01", "10.0.0.1", "10.0.0.2", 6, 50000, port, h, len(h) // 2) for k, (port, h) in enumerate(rows)], PACKETS)


@pytest.mark.parametrize(("rule", "rows", "items"), [("ntlmv1", [(p, ntlm()) for p in PORTS], [f"10.0.0.1 -> 10.0.0.2:{p} (1)" for p in PORTS]), ("weak_tls_cipher", [(443, hello())], [f"{c:X} (1)" for c in CIPHERS])])
def test_a_rules_own_query_shows_all_evidence(spark, monkeypatch, rule, rows, items):
    made = packets(spark, rows)
    monkeypatch.setattr(queries, "packets_table", lambda *_: made)
    got = queries.QUERIES[f"rule_{rule}"](spark, "").collect()
    assert [(r.items, r.hits, r.evidence) for r in got] == [(len(items), len(items), "; ".join(items))]
    few = rules.run_rules(rules.Context(made), [f"compat.{rule}"]).collect()  # the list of all findings tells the first ones
    assert [(r.items, r.evidence) for r in few] == [(len(items), items[:5])]


def test_only_whole_queries_leave_the_cap_out():
    cut = {n: "FILTER (k <= " in s for n, s in oracle.ORACLE.items() if n.startswith("rule_")}
    assert sorted(n for n, c in cut.items() if not c) == ["rule_ntlmv1", "rule_weak_tls_cipher"]


@pytest.mark.parametrize("rule", ["compat.ntlmv1", "compat.weak_tls_cipher"])
def test_sql_shows_all_evidence(rule):
    made = "SELECT '10.0.0.1 -> 10.0.0.2' AS entity, lpad(i::VARCHAR, 5, '0') AS place, 'item ' || i AS item, 1 AS weight, 'high' AS severity FROM range(40) r(i)"
    sql = oracle._found(rule, True).replace(oracle._RULES[rule], made)
    assert duckdb.sql(f"SELECT len(string_split(evidence, '; ')) FROM ({sql})").fetchall() == [(40,)]
