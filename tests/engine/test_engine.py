import re
import datetime
import struct

import pytest
from pyspark.sql import functions as F

from plantflow.functions import net
from plantflow.operators import conformance, drift, extract, hostnames, inventory, observe, privacy, rules
from plantflow.operators.trusted import Writer, trusted_digest
from plantflow.schemas import PACKETS
from plantflow.sources.captures import CaptureError, check_link_types, read_captures
from plantflow.streaming import windows

T0 = datetime.datetime(2024, 1, 1)


def packets(spark, rows):
    """rows: src, dst, proto, src_port, dst_port, payload hex[, seconds]."""
    made = [(k, T0 + datetime.timedelta(seconds=r[6] if len(r) > 6 else k), "00:1B:1B:00:00:01", "00:0E:8C:01:00:01", r[0], r[1], r[2], r[3], r[4], r[5], len(r[5]) // 2) for k, r in enumerate(rows)]
    return spark.createDataFrame(made, PACKETS)


def test_addresses(spark):
    ips = ["10.1.2.3", "172.15.0.1", "172.31.0.1", "8.8.8.8", "127.0.0.1", "224.0.0.1", "255.255.255.255", "192.0.2.7", "fe80::1", "fd00::1", "::1", "ff02::1", "2001:db8::1", None]
    ip = F.col("ip")
    rows = spark.createDataFrame([(i,) for i in ips], "ip string").select("ip", net.is_public(ip), net.in_ot(ip), net.is_group_address(ip), net.in_nets(ip, ["2001:db8::/32"])).collect()
    assert [r.ip for r in rows if r[1]] == ["172.15.0.1", "8.8.8.8", "fe80::1", "2001:db8::1"]
    assert [r.ip for r in rows if r[2]] == ["10.1.2.3", "172.31.0.1"]
    assert [r.ip for r in rows if r[3]] == ["224.0.0.1", "255.255.255.255", "ff02::1"]
    assert [r.ip for r in rows if r[4]] == ["2001:db8::1"]


@pytest.mark.parametrize(("hosts", "ports", "expected"), [(9, 1, None), (10, 1, ("medium", "horizontal")), (49, 3, ("medium", "horizontal")), (50, 1, ("high", "horizontal")), (1, 10, ("medium", "vertical")), (10, 10, ("medium", "combined")), (3, 50, ("high", "vertical"))])
def test_port_scan(spark, hosts, ports, expected):
    n = max(hosts, ports)
    p = packets(spark, [("10.0.0.1", f"10.0.1.{k % hosts + 1}", 6, 50000, 1000 + k % ports, "") for k in range(n * n if hosts > 1 and ports > 1 else n)] + [("10.0.0.1", "224.0.0.9", 6, 50000, 9, "")])
    got = rules.run_rules(rules.Context(p, ("10.0.0.0/8",)), ["recon.port_scan"]).collect()
    assert [(r.severity, r.evidence[0].split()[0]) for r in got] == ([expected] if expected else [])


@pytest.mark.parametrize(("units", "severity"), [(4, None), (5, "medium"), (49, "medium"), (50, "high")])
def test_unit_sweep(spark, units, severity):
    p = packets(spark, [("10.0.0.1", "10.0.0.2", 6, 50000, 502, f"000100000006{k:02X}03006B0003") for k in range(units)])
    got = rules.run_rules(rules.Context(p), ["ics.modbus_unit_id_sweep"]).collect()
    assert [r.severity for r in got] == ([severity] if severity else [])


def test_cip_walk(spark):
    head = "6F00" + "00" * 22 + "00000000" + "0000"
    item = lambda kind, data: struct.pack("<HH", kind, len(data)).hex().upper() + data.hex().upper()
    payload = lambda *items: head + struct.pack("<H", len(items)).hex().upper() + "".join(items)
    bodies = [payload(item(0, b""), item(0xB2, b"\x0e")), payload(item(0, b""), item(0xB1, b"\x00\x00\x07")), payload(item(0xB2, b"\x01"), item(0xB2, b"\x85")), payload(item(0xB2, b""))[:-2] + "09", "6500" + "00" * 22]
    rows = extract.enip_events(packets(spark, [("10.0.0.1", "10.0.0.2", 6, 50000, 44818, b) for b in bodies])).orderBy("pkt_id").collect()
    assert [r.cip_service for r in rows] == [None, 7, 5, None, None]


def test_ntlm_and_tls(spark):
    ntlm = lambda flags: "00" * 3 + "4E544C4D53535000" + "01000000" + struct.pack("<I", flags).hex().upper()
    p = packets(spark, [("10.0.0.1", "10.0.0.2", 6, 50000, 445, ntlm(1 << 9)), ("10.0.0.1", "10.0.0.2", 6, 50000, 445, ntlm(1 << 19 | 1 << 9)), ("10.0.0.1", "10.0.0.2", 6, 50000, 445, ntlm(0))])
    assert [r.version for r in extract.ntlm_events(p).orderBy("pkt_id").collect()] == ["v1", "v2"]


def test_starttls_protects_later_binds(spark):
    bind, reply = "3012020101600D0201030404636E3D6180027077", "300C02010178070A010004000400"
    c = ("10.0.0.1", "10.0.0.2", 6, 50000, 389, bind)
    p = packets(spark, [c, ("10.0.0.2", "10.0.0.1", 6, 389, 50000, reply), c, ("10.0.0.1", "10.0.0.2", 6, 50001, 389, bind)])
    assert [r.used_starttls for r in extract.ldap_binds(p).orderBy("pkt_id").collect()] == [False, True, False]


def test_weak_credentials(spark):
    import base64

    basic = lambda pair: (b"GET / HTTP/1.1\r\nAuthorization: Basic " + base64.b64encode(pair) + b"\r\n\r\n").hex().upper()
    p = packets(spark, [("10.0.0.1", f"10.0.1.{k}", 6, 50000, 80, basic(b)) for k, b in enumerate((b"u:admin", b"u:", b"u:long secret", b"nopair"))] + [("10.0.0.1", "10.0.0.9", 6, 50000, 21, b"user Anonymous\r\n".hex().upper())])
    got = {r.dst_ip: r.category for r in extract.weak_credentials(extract.cred_events(p)).collect()}
    assert got == {"10.0.1.0": "weak_password", "10.0.1.1": "empty_password", "10.0.0.9": "anonymous_ftp"}


def test_many_duplicates_are_few_rows(spark):
    p = spark.range(200_000).selectExpr("id AS pkt_id", "timestamp_ntz'2024-01-01 00:00:00' AS ts", "'10.0.0.1' AS src_ip", "'10.0.0.2' AS dst_ip", "6 AS proto", "50000L AS src_port", "23L AS dst_port", "'6C6F67' AS payload_hex", "3L AS payload_len")
    rows = extract.cred_events(p).collect()
    assert [(r.kind, r.n) for r in rows] == [("telnet", 200_000)]


def test_order_of_rows_changes_nothing(spark):
    p = packets(spark, [("10.0.0.1", "10.0.0.2", 6, 50000 + k % 3, 502, "000100000006010500010000", k % 5) for k in range(40)])
    a, b = (sorted(map(str, observe.flows(x).collect())) for x in (p, p.repartition(7, "src_port").orderBy(F.desc("pkt_id"))))
    assert a == b


@pytest.fixture(scope="module")
def policy():
    return conformance.load_policy({"zones": [{"id": "a", "level": "L2", "members": ["10.0.0.0/24"]}, {"id": "b", "level": "L4", "members": ["10.0.1.0/24"]}, {"id": "in", "level": "L1", "members": ["10.0.0.128/25"]}], "conduits": [{"from": "a", "to": "b", "direction": "forward", "proto": "tcp", "ports": ["80-90"]}, {"from": "in", "to": "a", "direction": "bidirectional", "proto": "tcp", "ports": "any"}]})


def test_verdicts(spark, policy):
    flows = [("10.0.0.1", "10.0.1.1", 80, "allowed", True), ("10.0.0.1", "10.0.1.1", 91, "no_matching_conduit", True), ("10.0.1.1", "10.0.0.1", 85, "wrong_direction", True), ("10.0.0.1", "10.0.0.2", 1, "intra_zone", False), ("10.0.0.1", "10.0.0.200", 5, "allowed", False), ("10.0.1.1", "10.0.0.255", 5, "multicast_exempt", False), ("8.8.8.8", "9.9.9.9", 5, "intra_zone", False), ("10.0.0.1", "9.9.9.9", 80, "no_matching_conduit", False), ("10.0.0.1", "239.0.0.1", 80, "multicast_exempt", False)]
    df = spark.createDataFrame([(s, d, p, 6, 1, 10) for s, d, p, _, _ in flows], "src_ip string, dst_ip string, dst_port long, proto int, packets long, bytes long")
    table = conformance.verdicts(df, policy)
    assert {(r.src_ip, r.dst_ip, r.dst_port, r.kind, r.idmz_bypass) for r in table.collect()} == set(flows)
    tally = conformance.conformance_tally(table).first()
    assert tally.flows == sum(tally[k] for k in ("allowed", "intra_zone", "multicast_exempt", "wrong_direction", "no_matching_conduit")) == len(flows)
    assert conformance.violations(table).count() == 3 + 3


def test_policy_checks(policy):
    assert conformance.check_policy(policy) == []
    bad = conformance.Policy((conformance.Zone("x", "L1", ("10.0.0.0/8",)), conformance.Zone("x", "L1"), conformance.Zone("EXTERNAL", "L1", ("10.0.0.0/8", "0.0.0.0/0", "64.0.0.0/3"))), (conformance.Conduit("x", "nope", "forward", "tcp", None),))
    assert {(g, p) for g, p, _ in conformance.check_policy(bad)} == {("error", "duplicate_zone"), ("error", "reserved_zone"), ("error", "shared_member"), ("error", "catch_all_member"), ("warning", "broad_member"), ("warning", "empty_zone"), ("error", "unknown_zone")}
    for doc in ({"zone": []}, {"zones": [{"id": "a", "level": "L9"}]}, {"conduits": [{"from": "a", "to": "b", "direction": "up", "proto": "tcp"}]}):
        with pytest.raises(ValueError):
            conformance.load_policy(doc)
    assert conformance.canonical_ports([(5, 9), (10, 12), (1, 2), (8, 11)]) == ((1, 2), (5, 12))
    swapped = conformance.Policy(policy.zones[::-1], policy.conduits[::-1] + policy.conduits[:1])
    assert conformance.policy_digest(policy) == conformance.policy_digest(swapped)
    a, b = Writer.parse("10.0.0.0/8=10.0.0.1:any"), Writer.parse("10.0.0.1=10.0.0.2:s7")
    assert trusted_digest([a, b]) == trusted_digest([b, a, a])


def test_capture_source(spark):
    frames = lambda *n: spark.createDataFrame([(f"m{k:02d}", c) for k, c in enumerate(n)], "mac string, frames long")
    totals = lambda n, b=0: spark.createDataFrame([(n, b)], "packets long, broadcast_frames long")
    of = lambda *a, **k: tuple(inventory.capture_source(*a, **k).select("source", "confidence", "conflict").first())
    assert of(frames(1000, 990, 50), totals(1000)) == ("tap", "high", False)
    assert of(frames(990, 200), totals(1000)) == ("host_side", "high", False)
    assert of(frames(850, 200), totals(1000), declared="span") == ("host_side", "medium", True)
    assert of(frames(*[100] * 10), totals(500, 3)) == ("span", "medium", False)
    assert of(frames(*[100] * 9), totals(500, 3), declared="tap") == ("ambiguous", "low", False)


def test_scrubbing(spark):
    m = spark.createDataFrame([("host", "host_001", "10.0.0.1"), ("host", "host_002", "10.0.0.10"), ("name", "name_001", "plc")], "family string, pseudonym string, real string")
    df = spark.createDataFrame([(1, "a 10.0.0.10 b 10.0.0.1, plc-host"), (2, None), (3, "none")], "id long, text string")
    out = privacy.scrub(df, "text", m)
    assert [r.text for r in out.orderBy("id").collect()] == ["a host_002 b host_001, name_001-host", None, "none"]
    assert privacy.unscrub(out, "text", m).exceptAll(df).count() == 0
    with pytest.raises(privacy.LeakError):
        privacy.assert_no_leaks(df, "text", m)
    privacy.assert_no_leaks(out, "text", m)
    merged = privacy.merge_scrub_map(m, spark.createDataFrame([("10.0.0.1",), ("10.9.9.9",)], "real string"), "host")
    assert {r.pseudonym for r in merged.where("real = '10.9.9.9'").collect()} == {"host_003"} and merged.count() == 4
    bad = m.unionByName(spark.createDataFrame([("host", "host_1", ""), ("x", "odd", "q"), ("host", "host_003", "plc")], m.schema))
    assert {r.problem for r in privacy.map_problems(bad).collect()} == {"empty_real", "bad_pseudonym", "repeated_real"}
    leaks = spark.createDataFrame([(1, "x fe80:0:0:1:2:3:4:5"), (2, "m 00:1b:1B:00:00:0f 1.2.3.4")], "id long, text string")
    assert [(r.id, r.kind, r["offset"], r.length) for r in privacy.leak_scan(leaks, "text", ["id"]).orderBy("id").collect()] == [(1, "ipv6", 2, 18), (2, "ipv4", 20, 7)]


def test_vetting(spark):
    proposed = spark.createDataFrame([("a", 0.9, "host_001 talks to host_002"), ("b", 0.8, "host_001 and host_009"), ("c", 0.7, "host_001 alone"), ("d", 0.6, "no names")], "id string, confidence double, text string")
    known = spark.createDataFrame([("host_001",), ("host_002",)], "pseudonym string")
    found = spark.createDataFrame([("r", "host_001")], "id string, pseudonym string")
    assert [r.id for r in privacy.vet_proposed(proposed, known, found).collect()] == ["a", "d"]
    assert [r.id for r in privacy.vet_proposed(proposed, known, found, cap=1).collect()] == ["a"]


def test_drift(spark):
    f = lambda *rows: spark.createDataFrame([("s", "d", p, 6, b) for p, b in rows], "src_ip string, dst_ip string, dst_port long, proto int, bytes long")
    base, now = f((1, 100), (2, 100), (3, 0), (4, 5)), f((1, 199), (2, 50), (3, 9), (5, 5))
    assert {(r.dst_port, r.change, r.ratio) for r in drift.flow_delta(base, now).collect()} == {(2, "shifted", 2.0), (4, "gone", None), (5, "new", None)}
    assert {r.dst_port for r in drift.flow_delta(base, now, 2.0, 10.0, 5.0).where("change = 'shifted'").collect()} == {1}
    with pytest.raises(ValueError):
        drift.flow_delta(base, now, 0.5)
    assert [drift.window_advisory(*w) for w in ((0.5, 9), (10, 20), (10, 19))] == ["degenerate", "mismatch", "comparable"]


def _frame(src, dst, sport, dport, payload, udp=False):
    body = struct.pack(">HHHH", sport, dport, 8 + len(payload), 0) + payload if udp else struct.pack(">HHIIBBHHH", sport, dport, 0, 0, 0x50, 0x18, 0, 0, 0) + payload
    head = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(body), 0, 0, 64, 17 if udp else 6, 0, bytes(map(int, src.split("."))), bytes(map(int, dst.split("."))))
    return bytes.fromhex("000E8C010001") + bytes.fromhex("001B1B000001") + b"\x08\x00" + head + body


def _classic(frames, link=1):
    return struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, link) + b"".join(struct.pack("<IIII", 1_700_000_000 + k, 250_000, len(f), len(f)) + f for k, f in enumerate(frames))


def _ng(frames):
    block = lambda kind, body: struct.pack("<II", kind, len(body) + 12) + body + struct.pack("<I", len(body) + 12)
    out = block(0x0A0D0D0A, b"\x4d\x3c\x2b\x1a" + struct.pack("<HHq", 1, 0, -1)) + block(1, struct.pack("<HHI", 1, 0, 65535) + struct.pack("<HHB3x", 9, 1, 9) + struct.pack("<HH", 0, 0))
    for k, f in enumerate(frames):
        t = (1_700_000_000 + k) * 10**9
        out += block(6, struct.pack("<IIIII", 0, t >> 32, t & 0xFFFFFFFF, len(f), len(f)) + f + b"\0" * (-len(f) % 4))
    return out


def test_captures(spark, tmp_path):
    frames = [_frame("10.0.0.1", "10.0.0.2", 50000, 502, bytes.fromhex("000100000006010500010000")), b"\0" * 12 + b"\x08\x06" + b"\0" * 28, _frame("10.0.0.1", "10.0.0.2", 50000, 53, b"x", True)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pcap").write_bytes(_classic(frames))
    (tmp_path / "in" / "b.pcapng").write_bytes(_ng(frames))
    df = read_captures(spark, str(tmp_path / "in"))
    rows = df.orderBy("pkt_id").collect()
    assert [(r.src_ip, r.proto, r.dst_port, r.payload_len, r.capture_seq) for r in rows] == [("10.0.0.1", 6, 502, 12, 0), ("10.0.0.1", 17, 53, 1, 0), ("10.0.0.1", 6, 502, 12, 1), ("10.0.0.1", 17, 53, 1, 1)]
    assert rows[0].src_mac == "00:1B:1B:00:00:01" and rows[0].ts.microsecond == 250_000 and rows[2].ts.year == 2023
    assert extract.modbus_events(df).where("engineering").count() == 2
    (tmp_path / "c.pcap").write_bytes(_classic(frames, 113))
    both = [str(tmp_path / "in" / "a.pcap"), str(tmp_path / "c.pcap")]
    with pytest.raises(CaptureError, match="link types differ: a.pcap: 1, c.pcap: 113$"):
        check_link_types(spark, both)
    with pytest.raises(Exception, match="link types differ"):
        read_captures(spark, ",".join(both)).count()
    (tmp_path / "d.pcap").write_bytes(b"\x0a\x0d\x0d\x0a")  # too short to tell
    check_link_types(spark, [both[0], str(tmp_path / "d.pcap")])
    with pytest.raises(Exception, match="link type 113"):
        read_captures(spark, str(tmp_path / "c.pcap")).collect()


def test_hostnames(spark):
    label = lambda *n: b"".join(bytes([len(x)]) + x for x in n) + b"\0"
    answer = lambda name, ip: name + struct.pack(">HHIH", 1, 0x8001, 1, 4) + bytes(map(int, ip.split(".")))
    mdns = struct.pack(">HHHHHH", 0, 0x8400, 0, 1, 0, 0) + answer(label(b"plc1", b"local"), "10.0.0.5")
    llmnr = struct.pack(">HHHHHH", 0, 0x8000, 1, 1, 0, 0) + label(b"q") + b"\0\1\0\1" + answer(label(b"hmi"), "10.0.0.6")
    dhcp = b"\2" + b"\0" * 15 + bytes([10, 0, 0, 7]) + b"\0" * 216 + b"\x63\x82\x53\x63" + b"\x0c\x03abc\xff"
    name = b"STATION        \0"
    netbios = struct.pack(">HHHHHH", 0, 0x2810, 1, 0, 0, 1) + b"\x20" + bytes(x for b in name for x in (65 + (b >> 4), 65 + (b & 15))) + b"\0" + b"\0" * 4
    p = packets(spark, [("10.0.0.9", "224.0.0.251", 17, 5353, 5353, mdns.hex().upper()), ("10.0.0.9", "10.0.0.8", 17, 5355, 50000, llmnr.hex().upper()), ("10.0.0.1", "10.0.0.7", 17, 67, 68, dhcp.hex().upper()), ("10.0.0.4", "10.0.0.255", 17, 137, 137, netbios.hex().upper()), ("10.0.0.9", "224.0.0.251", 17, 5353, 5353, mdns.replace(b"plc1", b"plc2").hex().upper())])
    assert {r.ip: r.name for r in hostnames.hostnames(p).collect()} == {"10.0.0.5": "plc2", "10.0.0.6": "hmi", "10.0.0.7": "abc", "10.0.0.4": "STATION"}


def test_stream_equals_batch(spark, tmp_path):
    p = packets(spark, [("10.0.0.1", f"10.0.1.{k % 12}", 6, 50000, 502, "00", k * 7) for k in range(200)])
    p.repartition(3).write.parquet(str(tmp_path / "in"))
    got = []
    stream = windows.windowed_flows(windows.read_packets(spark, str(tmp_path / "in"), PACKETS))
    windows.run_available(stream, lambda df, _: got.extend(df.collect()), str(tmp_path / "cp"), "complete")
    batch = windows.windowed_flows(p).collect()
    assert sorted(map(str, got)) == sorted(map(str, batch)) and len(batch) > 12


def test_stream_of_verdicts(spark, tmp_path, policy):
    p = packets(spark, [("10.0.0.1", f"10.0.{k % 3}.{k % 12}", 6, 50000, 502, "00", k * 7) for k in range(200)])
    p.repartition(3).write.parquet(str(tmp_path / "in"))
    got = []
    stream = windows.windowed_verdicts(windows.read_packets(spark, str(tmp_path / "in"), PACKETS), policy)
    windows.run_available(stream, lambda df, _: got.extend(df.collect()), str(tmp_path / "cp"), "complete")
    assert sorted(map(str, got)) == sorted(map(str, windows.windowed_verdicts(p, policy).collect())) and got


def test_stream_keeps_starttls(spark, tmp_path):
    bind, reply = "3012020101600D0201030404636E3D6180027077", "300C02010178070A010004000400"
    c, other = ("10.0.0.1", "10.0.0.2", 6, 50000, 389, bind), ("10.0.0.1", "10.0.0.2", 6, 50001, 389, bind)
    p = packets(spark, [c, ("10.0.0.2", "10.0.0.1", 6, 389, 50000, reply), other, c, other])
    for k in range(5):
        p.where(F.col("pkt_id") == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = []
    stream = windows.starttls_binds(windows.read_packets(spark, str(tmp_path / "in"), PACKETS, 1))
    windows.run_available(stream, lambda df, _: got.extend(df.collect()), str(tmp_path / "cp"))
    assert sorted((r.pkt_id, r.used_starttls, r.version) for r in got) == [(0, False, 3), (2, False, 3), (3, True, 3), (4, False, 3)]


def test_pseudonyms_of_columns(spark):
    df = spark.createDataFrame([("10.0.0.1", "10.0.0.2", 1), ("10.0.0.2", None, 2)], "src_ip string, dst_ip string, n long")
    m = spark.createDataFrame([("host", "host_001", "10.0.0.1")], "family string, pseudonym string, real string")
    rows = privacy.pseudonymised(df, ["src_ip", "dst_ip"], m, "s").orderBy("n").collect()
    assert rows[0].src_ip == "host_001" and rows[0].dst_ip == rows[1].src_ip and rows[1].src_ip.startswith("unmapped_") and rows[1].dst_ip is None


def test_time_that_runs_back(spark):
    forward = packets(spark, [("10.0.0.1", "10.0.0.2", 6, 1, 2, "", k) for k in range(40)]).repartition(5)
    back = packets(spark, [("10.0.0.1", "10.0.0.2", 6, 1, 2, "", s) for s in [*range(20), 3, 4, 5, 2, *range(30, 60)]]).repartition(5)
    assert observe.steps_back(forward).first().steps == 0 and observe.steps_back(back).first().steps == 2
    by = forward.withColumn("capture_id", F.lit("a")).unionByName(back.withColumn("capture_id", F.lit("b")))
    assert {r.capture_id: r.steps for r in observe.steps_back(by, "capture_id").collect()} == {"a": 0, "b": 2}
    of = lambda p: tuple(inventory.capture_sanity(observe.capture_totals(p), observe.steps_back(p)).first())[1:]
    assert of(forward) == (False, False, False) and of(back) == (False, False, True) and of(forward.limit(0)) == (False, False, False)
    early = packets(spark, [("10.0.0.1", "10.0.0.2", 6, 1, 2, "", k) for k in range(2)]).withColumn("ts", F.expr("timestamp_ntz'1970-01-01 00:00:00.5'"))
    assert of(early) == (True, False, False)


def test_numbers_are_dense(spark):
    df = spark.createDataFrame([(x % 7, x) for x in range(500)], "a long, b long").repartition(6)
    rows = privacy.numbered(df, ["a", "b"], "n", 0).orderBy("n").collect()
    assert [r.n for r in rows] == list(range(500)) and [(r.a, r.b) for r in rows] == sorted((r.a, r.b) for r in rows)
    assert privacy.numbered(df.limit(0), ["a"]).count() == 0


def test_scrubbing_like_a_longest_first_replacement(spark):
    import random
    import re

    rng = random.Random(3)
    for _ in range(3):
        values = sorted({"".join(rng.choice("aé1.") for _ in range(rng.randint(1, 5))) for _ in range(25)})
        texts = [None, ""] + ["".join(rng.choice("aé1.x") for _ in range(rng.randint(0, 60))) for _ in range(40)]
        names = {v: f"host_{k:03d}" for k, v in enumerate(values, 1)}
        m = spark.createDataFrame([("host", n, v) for v, n in names.items()], "family string, pseudonym string, real string")
        df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
        find = re.compile("|".join(re.escape(v) for v in sorted(values, key=lambda v: (-len(v.encode()), v))))
        assert {r.id: r.text for r in privacy.scrub(df, "text", m).collect()} == {i: None if t is None else find.sub(lambda x: names[x[0]], t) for i, t in enumerate(texts)}
        assert {r.id for r in privacy.map_leaks(df, "text", m, ["id"]).collect()} == {i for i, t in enumerate(texts) if t and find.search(t)}
    none = m.limit(0)
    assert privacy.scrub(df, "text", none).exceptAll(df).count() == 0 and privacy.map_leaks(df, "text", none, ["id"]).count() == 0
    report = privacy.unscrub_report(spark.createDataFrame([("host_001 host_777 host_777 xhost_001",)], "text string"), "text", m).first()
    assert (report.replaced, report.unmapped) == (1, 1)


def test_evidence_and_policy(spark, policy):
    flows = [("10.0.0.1", f"10.0.1.{k}", 6, 50000, 99, "", 1) for k in range(20) for _ in range(k + 1)]
    c = rules.Context(packets(spark, flows), ("10.0.0.0/8",), [], conformance.verdicts(observe.flows(packets(spark, flows)), policy))
    found = {r.rule_id: r for r in rules.run_rules(c).collect()}
    assert set(found) == {"segmentation.idmz_bypass", "segmentation.deny_by_default", "recon.port_scan"}
    deny = found["segmentation.deny_by_default"]
    assert (deny.hits, deny.items, len(deny.evidence)) == (20, 20, 15) and deny.evidence[0] == "10.0.0.1 -> 10.0.1.0:99/tcp established (1)"
    with pytest.raises(ValueError):
        rules.run_rules(c, ["no.such_rule"])


def test_shared_folder(spark):
    from plantflow.sources.staging import shared_folder, staged

    assert staged(spark.range(5)).count() == 5 and shared_folder(spark) == shared_folder(spark)


def test_evidence_caps_and_orders(spark):
    """Five calls of a pair in their order, pairs by number, thirty declared pairs, five binds, totals of parts in full."""
    from plantflow.operators.trusted import Writer

    write, read = "0001000000060106000100FF", "00010000000601050001FF00"
    rows = [("10.0.0.9", f"10.0.1.{k}", 6, 50000, 502, write if j % 2 else read) for k in range(1, 41) for j in range(7)]
    rows += [("10.0.0.10", f"10.0.2.{k}", 6, 50000, 502, write) for k in range(1, 41)]
    rows += [("10.0.0.9", f"10.0.3.{k}", 6, 50000, 389, "3012020101600D0201030404636E3D6180027077") for k in range(1, 9)]
    c = rules.Context(packets(spark, rows), ("10.0.0.0/8",), [Writer.parse("10.0.0.10=10.0.2.0/24:modbus")])
    found = {r.rule_id: r for r in rules.run_rules(c, ["ics.modbus_writes", "ics.trusted_writer_activity", "creds.ldap_simple_bind"]).collect()}
    own, known, binds = found["ics.modbus_writes"], found["ics.trusted_writer_activity"], found["creds.ldap_simple_bind"]
    assert (own.hits, own.items, len(own.evidence)) == (280, 40, 15)
    calls = "Write Single Coil, Write Single Register, Write Single Coil, Write Single Register, Write Single Coil"
    assert list(own.evidence) == [f"10.0.0.9 -> 10.0.1.{k} : {calls} (7)" for k in range(1, 16)]
    assert (known.hits, known.items, len(known.evidence), known.severity) == (40, 40, 30, "info") and known.evidence[1] == "modbus 10.0.0.10 -> 10.0.2.2 : Write Single Register #1 (1)"
    assert (binds.hits, binds.items) == (8, 8) and list(binds.evidence) == [f"10.0.0.9 -> 10.0.3.{k}:389 (1)" for k in range(1, 6)]


def test_attempted_violations_come_last(spark, policy):
    flows = [("10.0.0.1", f"10.0.1.{k}", 6, 50000, 99, "") for k in range(20)]
    table = observe.flows(packets(spark, flows)).withColumn("conn_state", F.when(F.col("dst_ip").endswith("7"), "SF").otherwise("REJ"))
    c = rules.Context(packets(spark, flows), ("10.0.0.0/8",), [], conformance.verdicts(table, policy))
    deny = rules.run_rules(c, ["segmentation.deny_by_default"]).first()
    assert (deny.hits, deny.attempted, deny.items) == (20, 18, 20)
    assert list(deny.evidence[:3]) == ["10.0.0.1 -> 10.0.1.7:99/tcp established (1)", "10.0.0.1 -> 10.0.1.17:99/tcp established (1)", "10.0.0.1 -> 10.0.1.0:99/tcp attempted (1)"]


def test_one_aligned_byte_or_none(spark):
    from plantflow.functions import wire

    rows = spark.createDataFrame([("A0201B",), ("0201",), ("1020102010",), ("",), ("FF",)], "h string")
    assert [tuple(r) for r in rows.select(wire.find(F.col("h"), "0201"), wire.be(F.col("h"), 1), wire.be(F.col("h"), F.lit(1))).collect()] == [(-1, 0x20, 0x20), (0, 1, 1), (-1, 0x20, 0x20), (-1, None, None), (-1, None, None)]


def test_offsets_of_leaks_are_bytes(spark):
    rows = spark.createDataFrame([(1, "ééé 10.0.0.1"), (2, "日本 x fe80:0:0:1:2:3:4:5"), (3, "😀00:1b:1B:00:00:0f")], "id long, text string")
    assert [tuple(r) for r in privacy.leak_scan(rows, "text", ["id"]).select("id", "offset").orderBy("id").collect()] == [(1, 7), (2, 9), (3, 4)]


def test_pseudonyms_are_words_of_all_scripts(spark):
    m = spark.createDataFrame([("host", "host_001", "10.0.0.1")], "family string, pseudonym string, real string")
    texts = ["éhost_001 host_001", "日host_001", "host_001é host_001.", "é host_001\nhost_001 é", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    want = [None if t is None else re.sub(privacy.PSEUDONYM, "10.0.0.1", t) for t in texts]
    assert want[0] == "éhost_001 10.0.0.1"
    assert [r.text for r in privacy.unscrub(df, "text", m).orderBy("id").collect()] == want
    assert {r.id for r in privacy.pseudonyms_in(df, "text", ["id"]).collect()} == {0, 2, 3}


def test_head_table_against_plain_search():
    """Values of one byte to many, in texts side by side; the time does not grow with the map."""
    import random
    import time

    import numpy as np

    rng = random.Random(4)
    values = {b"a", b"bc", "é".encode(), b"abcabc", "日本".encode(), b"cc", b"ccc"} | {bytes(rng.choices(b"abc", k=rng.randint(4, 7))) for _ in range(50)}
    heads = {}
    for v in values:
        heads.setdefault(v[:3], set()).add(len(v))
    texts = ["".join(rng.choices(["a", "b", "c", "é", "日", "本", " "], k=rng.randint(0, 40))).encode() for _ in range(60)]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    got = {(int(t), int(s) - int(offsets[t]), f.as_py().encode()) for ts, ss, fs in privacy.HeadTable({h: sorted(s) for h, s in heads.items()}).find(data, offsets) for t, s, f in zip(ts, ss, fs, strict=True) if f.as_py().encode() in values}
    want = {(k, a, v) for k, t in enumerate(texts) for v in values for a in range(len(t) - len(v) + 1) if t[a : a + len(v)] == v}
    assert got == want

    def took(n: int) -> float:
        table = privacy.HeadTable({bytes(f"{k:03x}", "ascii")[:3].upper(): [8] for k in range(n)})
        text = np.frombuffer(b"some text of lower case letters " * 60_000, np.uint8)
        begin = time.perf_counter()
        list(table.find(text, np.array([0, text.size])))
        return time.perf_counter() - begin

    took(10)
    assert took(4000) < 5 * took(10) + 0.05


def test_members_of_any_length(spark):
    """Random nested networks of both families against a search for the longest that holds an address."""
    import ipaddress
    import random

    rng = random.Random(8)
    nets = {f"10.{rng.randrange(4)}.{rng.randrange(4)}.{rng.randrange(256)}/{rng.randint(8, 32)}" for _ in range(60)} | {f"fd00::{rng.randrange(4):x}:{rng.randrange(65536):x}/{rng.randint(30, 128)}" for _ in range(60)} | {"2001:db8::/33", "2001:db8:0:4::/62", "::/0"}
    nets = {str(ipaddress.ip_network(n, strict=False)) for n in nets}
    zones = [{"id": f"z{k}", "level": "L1", "members": [n]} for k, n in enumerate(sorted(nets))]
    policy = conformance.load_policy({"zones": zones, "conduits": []})
    inside = [ipaddress.ip_network(n) for n in sorted(nets)]
    ips = {str(n[rng.randrange(min(n.num_addresses, 1 << 40))]) for n in inside for _ in range(4)} | {str(n.broadcast_address) for n in inside} | {"11.0.0.1", "fe80::1"}
    rows = spark.createDataFrame([(i,) for i in sorted(ips)] + [(None,)], "ip string")
    got = {r.ip: (r.z.zone, r.z.directed) for r in conformance.resolve(rows, "ip", policy, "z").collect()}
    assert len(got) == len(ips) + 1 and got.pop(None) == ("EXTERNAL", False)
    for ip, found in got.items():
        a = ipaddress.ip_address(ip)
        best = max((n for n in inside if n.version == a.version and a in n), key=lambda n: n.prefixlen, default=None)
        last = best is not None and best.version == 4 and best.prefixlen <= 30 and a == best.broadcast_address
        assert found == (f"z{inside.index(best)}" if best is not None else "EXTERNAL", last), ip
    plan = conformance.resolve(rows, "ip", policy, "z")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 1 and "NestedLoop" not in plan


def test_published_rows_are_the_checked_rows(spark, tmp_path):
    m = spark.createDataFrame([("host", "host_001", "plc-7")], "family string, pseudonym string, real string")
    good, bad = (spark.createDataFrame([(1, t)], "id long, text string") for t in ("host_001 is fine", "plc-7 is not"))
    privacy.write_clean(good, "text", m, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).first().text == "host_001 is fine"
    with pytest.raises(privacy.LeakError):
        privacy.write_clean(bad, "text", m, str(tmp_path / "bad"))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["out"]
    with pytest.raises(FileExistsError):
        privacy.write_clean(good, "text", m, str(tmp_path / "out"))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["out"]


def test_slice_summary(spark, tmp_path):
    p = packets(spark, [("10.0.0.1", "10.0.0.2", 6, 5000, 80, ""), ("10.0.0.3", "10.0.0.4", 6, 5000, 80, "")])
    assert observe.write_slice(p, str(tmp_path / "s"), ["10.0.0.4"]) == {"scanned": 2, "matched": 1}
    assert [r.src_ip for r in spark.read.parquet(str(tmp_path / "s")).collect()] == ["10.0.0.3"]
    assert observe.write_slice(p, str(tmp_path / "n"), ["10.9.9.9"]) == {"scanned": 2, "matched": 0}


def test_rotated_captures_arrive_once_across_a_restart(spark, tmp_path):
    from plantflow.sources.captures import stream_captures

    frame = lambda k: bytes(12) + b"\x08\x00" + struct.pack(">BBHHHBBH4s4s", 0x45, 0, 28, 0, 0, 64, 17, 0, bytes([10, 0, 0, k]), bytes([10, 0, 1, 1])) + struct.pack(">HHHH", 1000, 53, 8, 0)
    folder = tmp_path / "in"
    folder.mkdir()
    add = lambda name, k: (folder / name).write_bytes(_classic([frame(k)]))

    def run() -> None:
        query = stream_captures(spark, str(folder)).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
        query.awaitTermination()

    add("cap-1.pcap", 1)
    add("cap-2.pcap", 2)
    run()
    run()
    add("cap-3.pcap", 3)
    run()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("src_ip").collect()
    assert [(r.src_ip, r.capture_id) for r in got] == [(f"10.0.0.{k}", f"cap-{k}.pcap") for k in (1, 2, 3)]
    (folder / "cap-1.pcap").unlink()
    add("cap-4.pcap", 4)
    run()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
    for name in ("cap-00.pcap", "cap-01.pcap", "cap-5.pcap"):
        add(name, 9)
    with pytest.raises(Exception, match="must sort by time"):
        run()
