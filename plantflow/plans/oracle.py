"""DuckDB SQL of the registered queries, written apart from their DataFrame code."""

from __future__ import annotations

import ipaddress

from ..functions.net import NO_FLY, PORT_LABELS, PRIVATE, RESERVED
from ..operators import extract
from ..operators.catalog import CATALOG
from ..operators.inventory import SEED_OUIS
from ..sources.packets import derived_sql
from .fixtures import OT, POLICY, SPLIT, TRUSTED

_Q = "'"


def _num(ip: str) -> str:
    return "(" + " + ".join(f"CAST(split_part({ip}, '.', {k + 1}) AS BIGINT) * {256 ** (3 - k)}" for k in range(4)) + ")"


def _in(ip: str, cidrs) -> str:
    nets = [ipaddress.ip_network(c) for c in cidrs]
    return "(" + " OR ".join(f"{_num(ip)} BETWEEN {int(n.network_address)} AND {int(n.broadcast_address)}" for n in nets) + ")"


def _ot(ip: str) -> str:
    return _in(ip, OT)


def _public(ip: str) -> str:
    return f"NOT {_in(ip, PRIVATE + RESERVED)}"


def _group(ip: str) -> str:
    return _in(ip, ("224.0.0.0/4", "255.255.255.255/32", "0.0.0.0/32"))


def _case(rows, test, otherwise: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {test(r)} THEN '{r[-1]}'" for r in rows) + f" ELSE {otherwise} END"


_LABEL = _case(PORT_LABELS, lambda r: f"proto = {r[0]} AND (CASE WHEN dst_port < 49152 THEN dst_port WHEN src_port < 49152 THEN src_port END) = {r[1]}")
_NO_FLY = _case(NO_FLY, lambda r: f"proto = {r[0]} AND dst_port BETWEEN {r[1]} AND {r[2]}")
_PROTO = "CASE proto WHEN 6 THEN 'tcp' WHEN 17 THEN 'udp' WHEN 1 THEN 'icmp' ELSE 'ip/' || proto END"
_SERVICE = "src_ip || ' -> ' || dst_ip || ':' || dst_port"
_PAIR = "src_ip || ' -> ' || dst_ip"


def _byte(k: str | int, n: int = 1) -> str:
    return f"TRY_CAST(('0x' || substr(payload_hex, 2 * ({k}) + 1, {2 * n})) AS BIGINT)"


def _hex(k: str | int, n: int = 1) -> str:
    return f"substr(payload_hex, 2 * ({k}) + 1, {2 * n})"


_LEN = "(length(payload_hex) // 2)"


def _dotted(k: str | int) -> str:
    return "(" + " || '.' || ".join(f"CAST({_byte(f'{k} + {i}')} AS VARCHAR)" for i in range(4)) + ")"


def _either(port: int, proto: int = 6) -> str:
    return f"proto = {proto} AND (src_port = {port} OR dst_port = {port})"


def _names(code: str, rows) -> str:
    return "CASE " + " ".join(f"WHEN {code} = {v} THEN '{n}'" for v, n in rows) + " ELSE 'Unknown' END"


# each name may use those before it
_CTES: list[tuple[str, str]] = [
    ("packets", derived_sql()),
    ("base_packets", f"SELECT * FROM packets WHERE ts < TIMESTAMP '{SPLIT}'"),
    ("now_packets", f"SELECT * FROM packets WHERE ts >= TIMESTAMP '{SPLIT}'"),
]


def _hosts_sql(packets: str) -> str:
    side = f"SELECT src_ip AS ip, src_mac AS mac, ts, pkt_id, payload_len, {_LABEL} AS label FROM {packets} UNION ALL SELECT dst_ip, dst_mac, ts, pkt_id, payload_len, {_LABEL} FROM {packets}"
    return f"""SELECT ip, count(*) AS packets, CAST(sum(payload_len) AS BIGINT) AS bytes, list_sort(list(DISTINCT label) FILTER (label IS NOT NULL)) AS protocols,
 arg_min(mac, (ts, pkt_id)) FILTER (mac IS NOT NULL AND mac <> '00:00:00:00:00:00') AS mac, arg_min(ts, (ts, pkt_id)) AS first_seen, arg_max(ts, (ts, pkt_id)) AS last_seen, {_ot('ip')} AS in_ot FROM ({side}) GROUP BY ip"""


def _flows_sql(packets: str) -> str:
    return f"""SELECT src_ip, dst_ip, dst_port, proto, count(*) AS packets, CAST(sum(payload_len) AS BIGINT) AS bytes, arg_min(ts, (ts, pkt_id)) AS first_seen, arg_max(ts, (ts, pkt_id)) AS last_seen,
 arg_min(label, (ts, pkt_id)) FILTER (label IS NOT NULL) AS label, count(DISTINCT src_port) AS connections FROM (SELECT *, {_LABEL} AS label FROM {packets}) GROUP BY src_ip, dst_ip, dst_port, proto"""


def _assets_sql(hosts: str) -> str:
    has = lambda *p: "(" + " OR ".join(f"list_contains(coalesce(protocols, []), '{x}')" for x in p) + ")"
    ics = "['modbus', 'enip', 's7comm', 'dnp3', 'opcua', 'bacnet', 'fox-niagara']"
    plc = "('Siemens', 'Rockwell/Allen-Bradley', 'Schneider Electric', 'ABB', 'GE', 'Mitsubishi', 'Omron', 'B&R Industrial Automation', 'Beckhoff', 'WAGO')"
    ouis = ", ".join(f"('{p}', '{v}')" for p, v in SEED_OUIS)
    return f"""SELECT h.*, vendor, CASE
 WHEN {has('s7comm', 'enip', 'dnp3')} OR ({has('modbus')} AND coalesce(vendor IN {plc}, false)) OR (len(coalesce(protocols, [])) > 0 AND len(list_filter(protocols, lambda x: NOT list_contains({ics}, x))) = 0) THEN 'plc'
 WHEN {has('modbus')} AND {has('http', 'rdp', 'smb')} THEN 'hmi' WHEN {has('smb', 'rdp', 'netbios')} AND {has('modbus', 'enip', 's7comm')} THEN 'engineering_workstation'
 WHEN {has('modbus')} AND {has('https')} THEN 'historian' WHEN coalesce(vendor IN ('Cisco', 'Hirschmann', 'Moxa'), false) THEN 'network_infra' WHEN {has('smb', 'rdp', 'netbios', 'https')} THEN 'it_endpoint' ELSE 'unknown' END AS role
 FROM {hosts} h LEFT JOIN (VALUES {ouis}) o(prefix, vendor) ON substr(h.mac, 1, 8) = o.prefix"""


_MEMBERS = [(z.zone, z.level, ipaddress.ip_network(m)) for z in POLICY.zones for m in z.members]
_ZONE_ROWS = ", ".join(f"('{z}', '{lv}', {int(n.network_address)}, {int(n.broadcast_address)}, {n.prefixlen})" for z, lv, n in _MEMBERS)
_CONDUIT_ROWS = ", ".join(f"({k}, '{c.from_zone}', '{c.to_zone}', {'true' if c.direction == 'bidirectional' else 'false'}, { {'tcp': 6, 'udp': 17}[c.proto]}, {lo}, {hi})" for k, c in enumerate(POLICY.conduits) for lo, hi in (c.ports or ((-1, 70000),)))


def _verdicts_sql(flows: str) -> str:
    return f"""SELECT f.*, s.zone AS src_zone, d.zone AS dst_zone, s.level AS src_level, d.level AS dst_level,
 CASE WHEN g THEN 'multicast_exempt' WHEN s.zone = d.zone THEN 'intra_zone' WHEN a.conduit IS NOT NULL THEN 'allowed' WHEN coalesce(a.reverse, false) THEN 'wrong_direction' ELSE 'no_matching_conduit' END AS kind,
 CASE WHEN NOT g AND s.zone <> d.zone THEN a.conduit END AS conduit,
 coalesce(NOT g AND s.zone <> d.zone AND ((s.level IN ('L0', 'L1', 'L2', 'L3') AND d.level IN ('L4', 'L5')) OR (d.level IN ('L0', 'L1', 'L2', 'L3') AND s.level IN ('L4', 'L5'))), false) AS idmz_bypass
 FROM (SELECT *, {_in('dst_ip', ('224.0.0.0/4', '255.255.255.255/32'))} AS multi FROM {flows}) f JOIN zoned s ON s.ip = f.src_ip JOIN (SELECT *, directed AS dirb FROM zoned) d ON d.ip = f.dst_ip,
 LATERAL (SELECT multi OR d.dirb AS g) gg,
 LATERAL (SELECT min(c.id) FILTER (c.src = s.zone AND c.dst = d.zone OR c.bidi AND c.src = d.zone AND c.dst = s.zone) AS conduit, bool_or(NOT c.bidi AND c.src = d.zone AND c.dst = s.zone) AS reverse
   FROM (VALUES {_CONDUIT_ROWS}) c(id, src, dst, bidi, proto, lo, hi) WHERE c.proto = f.proto AND f.dst_port BETWEEN c.lo AND c.hi) a"""


def _trusted_rule(name: str) -> str:
    return "CASE " + " ".join(f"WHEN {_in('src_ip', [w.src])} AND {_in('dst_ip', [w.dst])} AND {'true' if w.proto == 'any' else f'{_Q}{w.proto}{_Q} = {name}'} THEN {k}" for k, w in enumerate(TRUSTED, 1)) + " END"


def _find(needle: str) -> str:
    """Offset of the first aligned occurrence, -1 without one."""
    spaced = " ".join(needle[k : k + 2] for k in range(0, len(needle), 2))
    return f"((position('{spaced}' IN regexp_replace(payload_hex, '(..)', '\\1 ', 'g')) + 2) // 3 - 1)"


_CTES += [
    ("hosts", _hosts_sql("packets")), ("base_hosts", _hosts_sql("base_packets")), ("now_hosts", _hosts_sql("now_packets")),
    ("flows", _flows_sql("packets")), ("base_flows", _flows_sql("base_packets")), ("now_flows", _flows_sql("now_packets")),
    ("assets", _assets_sql("hosts")), ("base_assets", _assets_sql("base_hosts")), ("now_assets", _assets_sql("now_hosts")),
    ("frames", "SELECT mac, count(*) AS frames FROM (SELECT DISTINCT pkt_id, ts, n, mac FROM (SELECT row_number() OVER () AS n, * FROM packets) UNPIVOT (mac FOR side IN (src_mac, dst_mac))) WHERE mac <> '00:00:00:00:00:00' GROUP BY mac"),
    ("zoned", f"SELECT ip, coalesce(z.zone, 'EXTERNAL') AS zone, z.level, coalesce(z.last = {_num('ip')} AND z.plen <= 30, false) AS directed FROM (SELECT DISTINCT ip FROM hosts) h LEFT JOIN (SELECT ip AS zip, arg_max((zone, level, hi), plen) AS best, max(plen) AS plen FROM (SELECT DISTINCT ip FROM hosts) JOIN (VALUES {_ZONE_ROWS}) m(zone, level, lo, hi, plen) ON {_num('ip')} BETWEEN lo AND hi GROUP BY ip) b ON b.zip = h.ip LEFT JOIN (VALUES {_ZONE_ROWS}) z(zone, level, first, last, plen) ON z.plen = b.plen AND {_num('ip')} BETWEEN z.first AND z.last"),
    ("verdicts", _verdicts_sql("flows")), ("base_verdicts", _verdicts_sql("base_flows")), ("now_verdicts", _verdicts_sql("now_flows")),
]
for _side in ("", "base_", "now_"):
    _CTES.append((f"{_side}violations", f"SELECT src_ip, dst_ip, dst_port, proto, src_zone, dst_zone, packets, bytes, kind AS violation FROM {_side}verdicts WHERE kind IN ('wrong_direction', 'no_matching_conduit') UNION ALL SELECT src_ip, dst_ip, dst_port, proto, src_zone, dst_zone, packets, bytes, 'idmz_bypass' FROM {_side}verdicts WHERE idmz_bypass"))
_SUB = f"coalesce(CASE WHEN {_LEN} >= 10 THEN {_byte(8, 2)} END, 0)"
_MODBUS_LABEL = f"CASE WHEN fc = 8 AND sub = 1 THEN 'Diagnostic: Restart Communications' WHEN fc = 8 AND sub = 4 THEN 'Diagnostic: Force Listen Only Mode' WHEN fc = 8 AND sub = 10 THEN 'Diagnostic: Clear Counters' ELSE {_names('fc', extract.MODBUS_LABELS)} END"
_S7_FC = "5 + cot + CASE WHEN rosctr IN (2, 3) THEN 12 ELSE 10 END"
_CTES += [
    ("modbus", f"SELECT *, {_MODBUS_LABEL} AS label, fc IN (5, 6, 15, 16, 21, 22, 23) OR fc = 8 AND sub IN (1, 4, 10) AS engineering FROM (SELECT *, {_byte(6)} AS unit_id, {_byte(7)} AS fc, {_SUB} AS sub FROM packets WHERE {_either(502)} AND {_LEN} >= 8 AND {_hex(2, 2)} = '0000' AND {_byte(4, 2)} >= 2 AND {_byte(4, 2)} + 6 <= {_LEN})"),
    ("s7", f"SELECT *, {_names('fc', extract.S7_LABELS)} AS label, fc IN {extract.S7_ENGINEERING} AS engineering, fc = 4 AS read FROM (SELECT *, {_byte(_S7_FC)} AS fc FROM (SELECT *, {_byte('6 + cot')} AS rosctr FROM (SELECT *, {_byte(4)} AS cot FROM packets WHERE {_either(102)} AND {_LEN} >= 7 AND {_hex(0, 2)} = '0300') WHERE cot <= 17 AND {_hex('5 + cot')} = '32' AND {_LEN} > 15 + cot) WHERE {_byte('11 + cot', 2)} > 0)"),
    ("dnp3", f"SELECT *, fc IN {extract.DNP3_ENGINEERING} AS engineering FROM (SELECT *, {_byte(12)} AS fc FROM packets WHERE proto IN (6, 17) AND (src_port = 20000 OR dst_port = 20000) AND {_LEN} >= 13 AND {_hex(0, 2)} = '0564')"),
    # the derived packets hold a null item and one data item
    ("enip", f"SELECT *, {_names('command', extract.ENIP_LABELS)} AS label, cip_service IS NOT NULL AS engineering FROM (SELECT *, {_byte(0)} + 256 * {_byte(1)} AS command, CASE WHEN {_byte(0)} IN (111, 112) AND {_hex(36, 2)} = 'B200' AND {_byte(40)} & 127 IN {extract.CIP_ENGINEERING} THEN {_byte(40)} & 127 END AS cip_service FROM packets WHERE {_either(44818)} AND {_LEN} >= 24)"),
    ("creds", f"""SELECT src_ip, dst_ip, dst_port, kind, count(*) AS n, min(ts) AS ts, arg_min(payload_hex, (ts, pkt_id)) AS payload_hex FROM (
 SELECT *, 'ftp' AS kind FROM packets WHERE proto = 6 AND dst_port = 21 AND (payload_hex LIKE '5553455220%' OR payload_hex LIKE '5041535320%')
 UNION ALL SELECT * REPLACE (23 AS dst_port), 'telnet' FROM packets WHERE {_either(23)} AND payload_hex <> ''
 UNION ALL SELECT *, 'http_basic' FROM packets WHERE proto = 6 AND dst_port IN (80, 8080) AND payload_hex LIKE '%417574686F72697A6174696F6E3A20426173696320%'
 UNION ALL SELECT *, 'snmp' FROM packets WHERE proto = 17 AND (src_port IN (161, 162) OR dst_port IN (161, 162)) AND {_LEN} > 8 AND payload_hex LIKE '30%' AND {_find('0201')} >= 0 AND {_hex(_find('0201') + ' + 2')} IN ('00', '01')) GROUP BY src_ip, dst_ip, dst_port, kind"""),
    ("smb", f"SELECT src_ip, dst_ip, dst_port, count(*) AS packets FROM packets WHERE proto = 6 AND (src_port IN (445, 139) OR dst_port IN (445, 139)) AND ({_hex(0, 4)} = 'FF534D42' OR {_hex(4, 4)} = 'FF534D42') GROUP BY 1, 2, 3"),
    ("hello", f"SELECT * FROM packets WHERE proto = 6 AND dst_port IN (443, 8443) AND {_LEN} >= 11 AND {_hex(0)} = '16' AND {_hex(5)} = '01'"),
    ("tls", f"SELECT src_ip, dst_ip, {_byte(9, 2)} AS version, count(*) AS hellos FROM hello GROUP BY 1, 2, 3"),
    ("ciphers", f"SELECT src_ip, dst_ip, cipher, count(*) AS hellos FROM (SELECT src_ip, dst_ip, CAST(('0x' || unnest(regexp_extract_all(substr(payload_hex, 2 * (46 + {_byte(43)}) + 1, 2 * {_byte(f'44 + {_byte(43)}', 2)}), '....'))) AS BIGINT) AS cipher FROM hello WHERE {_LEN} >= 44) GROUP BY 1, 2, 3"),
    ("rdp", f"SELECT pkt_id, src_ip, dst_ip, {_byte(15)} + 256 * {_byte(16)} + 65536 * {_byte(17)} + 16777216 * {_byte(18)} AS selected_protocol FROM packets WHERE proto = 6 AND dst_port = 3389 AND {_LEN} >= 19 AND {_hex(0, 2)} = '0300' AND {_byte(2, 2)} = {_LEN} AND {_byte(5)} & 240 = 208 AND {_hex(11)} = '02'"),
    ("ldap_rows", f"SELECT *, CASE WHEN dst_port IN (389, 3268) THEN (src_ip, src_port, dst_ip, dst_port) ELSE (dst_ip, dst_port, src_ip, src_port) END AS conn, src_port IN (389, 3268) AND payload_hex LIKE '30%' AND {_find('78')} >= 0 AND {_find('0A0100')} >= 0 AS reply FROM packets WHERE proto = 6 AND (src_port IN (389, 3268) OR dst_port IN (389, 3268))"),
    ("ldap", f"SELECT pkt_id, src_ip, dst_ip, dst_port, {_byte(9)} AS version, {_byte('10 + 2 + ' + _byte(11) + ' + 1')} = 0 AS anonymous, coalesce(started, false) AS used_starttls FROM (SELECT *, bool_or(reply) OVER (PARTITION BY conn ORDER BY ts, pkt_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS started FROM ldap_rows) WHERE dst_port IN (389, 3268) AND payload_hex LIKE '30__020101%' AND {_hex(5)} = '60' AND {_hex(7)} = '02' AND {_hex(10)} = '04' AND {_hex('12 + ' + _byte(11))} = '80'"),
    ("engineering", "SELECT src_ip, dst_ip, ts, pkt_id, 'modbus' AS name, label FROM modbus WHERE engineering UNION ALL SELECT src_ip, dst_ip, ts, pkt_id, 'cip', label FROM enip WHERE engineering UNION ALL SELECT src_ip, dst_ip, ts, pkt_id, 's7', label FROM s7 WHERE engineering UNION ALL SELECT src_ip, dst_ip, ts, pkt_id, 'dnp3', 'function ' || fc FROM dnp3 WHERE engineering"),
    ("judged", f"SELECT *, {_trusted_rule('name')} AS rule FROM engineering"),
    # the derived packets tell names of eight bytes at fixed offsets
    ("told", f"SELECT pkt_id, ts, CASE dst_port WHEN 137 THEN src_ip WHEN 67 THEN {_dotted(16)} ELSE {_dotted(_LEN + ' - 4')} END AS ip, decode(unhex(CASE dst_port WHEN 137 THEN translate(decode(unhex({_hex(13, 16)})), 'ABCDEFGHIJKLMNOP', '0123456789ABCDEF') WHEN 67 THEN {_hex(242, 8)} ELSE {_hex(13, 8)} END)) AS name FROM packets WHERE proto = 17 AND (dst_port IN (67, 137, 5353) OR dst_port = 5355 AND {_byte(2)} >= 128)"),
    ("last_names", "SELECT ip, arg_max(name, (ts, pkt_id)) AS name FROM told GROUP BY ip"),
    ("aliases", f"SELECT ip, CASE WHEN known THEN 'host_' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END ELSE 'unmapped_' || substr(sha256('salt' || ip), 1, 16) END AS alias FROM (SELECT ip, known, row_number() OVER (PARTITION BY known ORDER BY ip) AS n FROM (SELECT ip, {_num('ip')} % 3 < 2 AS known FROM hosts))"),
    ("scans", f"SELECT src_ip, count(DISTINCT dst_ip) AS d, count(DISTINCT (dst_port, proto)) AS p, sum(packets) AS packets FROM flows WHERE NOT {_group('dst_ip')} GROUP BY src_ip"),
    ("single", "SELECT src_ip FROM (SELECT src_ip, sum(packets) AS sent FROM flows GROUP BY 1) WHERE sent = 1 AND src_ip NOT IN (SELECT dst_ip FROM flows) AND src_ip IN (SELECT ip FROM hosts WHERE packets = 1 AND mac IS NULL AND len(coalesce(protocols, [])) = 0)"),
]


def _sql(body: str) -> str:
    """body with the named parts it needs before it."""
    import re

    need, todo = set(), [body]
    while todo:
        text = todo.pop()
        for name, sql in _CTES:
            if name not in need and re.search(rf"\b{name}\b", text):
                need.add(name)
                todo.append(sql)
    parts = ", ".join(f"{n} AS ({s})" for n, s in _CTES if n in need)
    if parts and body.startswith("WITH "):
        return f"WITH {parts}, {body[5:]}"
    return f"WITH {parts} {body}" if parts else body


def _place(*columns: str) -> str:
    """Addresses and ports as text that sorts like them."""
    return " || ".join(f"lpad(CAST({_num(c)} AS VARCHAR), 10, '0')" if c.endswith("_ip") else f"lpad(CAST({c} AS VARCHAR), 5, '0')" for c in columns)


_PAIR_PLACE = _place("src_ip", "dst_ip")
_FLOW_PLACE = _place("src_ip", "dst_ip", "dst_port") + " || lpad(CAST(proto AS VARCHAR), 3, '0')"


def _calls(trusted: bool) -> str:
    """Engineering by pair, with its first five calls."""
    own = "name || ' ' || " if trusted else ""
    known = " || ' #' || rule" if trusted else ""
    return f"SELECT src_ip, dst_ip, name, {own}{_PAIR} || ' : ' || string_agg(label, ', ' ORDER BY k) FILTER (k <= 5){known} AS item, count(*) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY name, src_ip, dst_ip ORDER BY ts, pkt_id) AS k FROM judged) WHERE rule IS {'NOT ' if trusted else ''}NULL GROUP BY src_ip, dst_ip, name, rule"


def _engineering_rule(name: str, always: str | None = None) -> str:
    severity = f"'{always}'" if always else f"CASE WHEN {_ot('src_ip')} THEN 'high' ELSE 'critical' END"
    return f"SELECT {severity} AS severity, '' AS entity, {_PAIR_PLACE} AS place, item, weight FROM ({_calls(False)}) WHERE name = '{name}'"


def _boundary(port: int) -> str:
    return f"SELECT 'medium' AS severity, '' AS entity, {_PAIR_PLACE} AS place, {_PAIR} AS item, packets AS weight FROM flows WHERE dst_port = {port} AND {_ot('src_ip')} AND NOT {_ot('dst_ip')}"


#: The state that a connection log would have, by a fixed rule on packets.
_TRIED = "(packets = 1 OR packets % 3 = 0)"


def _violation(kind: str, severity: str) -> str:
    return f"SELECT '{severity}' AS severity, '' AS entity, CASE WHEN {_TRIED} THEN '1' ELSE '0' END || {_FLOW_PLACE} AS place, {_SERVICE} || '/' || {_PROTO} || CASE WHEN {_TRIED} THEN ' attempted' ELSE ' established' END AS item, 1 AS weight, {_TRIED}::INT AS attempted FROM violations WHERE violation = '{kind}'"


_RULES = {
    **{f"creds.{k}": f"SELECT 'critical' AS severity, '' AS entity, {_place('dst_ip', 'dst_port')} AS place, dst_ip || ':' || dst_port AS item, n AS weight FROM creds WHERE kind = '{k}'" for k in ("ftp", "telnet", "http_basic", "snmp")},
    "creds.default_or_weak_credentials": f"SELECT 'critical' AS severity, '' AS entity, {_SERVICE} || ' ' || CASE kind WHEN 'ftp' THEN 'anonymous_ftp' ELSE 'weak_password' END AS item, n AS weight FROM creds WHERE kind = 'ftp' AND payload_hex LIKE '5553455220616E6F6E796D6F7573%' OR kind = 'http_basic' AND split_part(decode(from_base64(regexp_extract(decode(unhex(payload_hex)), 'Basic ([A-Za-z0-9+/=]+)', 1))), ':', 2) IN ('admin', 'password', '123456')",
    "creds.ldap_simple_bind": f"SELECT 'critical' AS severity, '' AS entity, {_PAIR_PLACE} AS place, {_PAIR} || ':' || array_to_string(list_sort(list(DISTINCT dst_port)), ',') AS item, count(*) AS weight FROM ldap WHERE NOT used_starttls AND NOT anonymous GROUP BY src_ip, dst_ip",
    # the derived negotiations have their flags at one offset
    "compat.ntlmv1": f"SELECT 'high' AS severity, {_PAIR} AS entity, {_place('dst_port')} AS place, {_SERVICE} AS item, 1 AS weight FROM packets WHERE payload_hex LIKE '%4E544C4D5353500001000000%' AND {_byte(17)} & 2 = 2 AND {_byte(18)} & 8 = 0",
    "ics.modbus_writes": _engineering_rule("modbus"),
    "ics.cip_engineering": _engineering_rule("cip", "high"),
    "ics.s7_engineering": _engineering_rule("s7"),
    "ics.dnp3_engineering": _engineering_rule("dnp3"),
    "ics.trusted_writer_activity": f"SELECT 'info' AS severity, '' AS entity, CASE name WHEN 'modbus' THEN '0' WHEN 'cip' THEN '1' WHEN 's7' THEN '2' ELSE '3' END || {_PAIR_PLACE} AS place, item, weight FROM ({_calls(True)})",
    "compat.smbv1": f"SELECT 'high' AS severity, '' AS entity, {_place('src_ip', 'dst_ip', 'dst_port')} AS place, {_SERVICE} AS item, packets AS weight FROM smb",
    "compat.stale_tls": f"SELECT 'medium' AS severity, '' AS entity, {_PAIR_PLACE} || hex(version) AS place, {_PAIR} || ' ' || hex(version) AS item, hellos AS weight FROM tls WHERE version BETWEEN 768 AND 770",
    "compat.weak_tls_cipher": f"SELECT 'medium' AS severity, {_PAIR} AS entity, lpad(hex(cipher), 4, '0') AS place, hex(cipher) AS item, hellos AS weight FROM ciphers WHERE cipher IN (1, 2, 4, 5, 9, 10)",
    "creds.rdp_no_nla": f"SELECT 'critical' AS severity, {_PAIR} AS entity, {_PAIR} AS item, 1 AS weight FROM rdp WHERE selected_protocol = 0",
    "ics.modbus_unit_id_sweep": f"SELECT CASE WHEN len(ids) >= 50 THEN 'high' ELSE 'medium' END AS severity, {_PAIR} AS entity, array_to_string(ids[1:10], ',') AS item, len(ids) AS weight FROM (SELECT src_ip, dst_ip, list_sort(list(DISTINCT unit_id)) AS ids FROM modbus GROUP BY 1, 2) WHERE len(ids) >= 5",
    "egress.ot_to_internet": f"SELECT 'critical' AS severity, '' AS entity, {_FLOW_PLACE} AS place, {_SERVICE} || '/' || {_PROTO} || CASE WHEN dst_port = 53 THEN ' dns' WHEN dst_port = 123 THEN ' ntp' WHEN dst_port IN (500, 1194, 4500, 51820) THEN ' tunnel' ELSE '' END AS item, bytes AS weight FROM flows WHERE {_ot('src_ip')} AND {_public('dst_ip')}",
    "boundary.dns_resolver": _boundary(53),
    "boundary.ntp_external": _boundary(123),
    "recon.port_scan": "SELECT CASE WHEN d >= 50 OR p >= 50 THEN 'high' ELSE 'medium' END AS severity, src_ip AS entity, CASE WHEN d >= 10 AND p <= 3 THEN 'horizontal' WHEN d <= 3 AND p >= 10 THEN 'vertical' ELSE 'combined' END || ' ' || d || ' hosts ' || p || ' ports' AS item, packets AS weight FROM scans WHERE d >= 10 OR p >= 10",
    "ot.unexpected_protocols": f"SELECT 'medium' AS severity, '' AS entity, {_place('src_ip', 'dst_ip', 'dst_port')} || {_NO_FLY} AS place, {_NO_FLY} || ' ' || {_SERVICE} AS item, packets AS weight FROM flows WHERE {_NO_FLY} IS NOT NULL AND ({_ot('src_ip')} OR {_ot('dst_ip')})",
    "attack.spoofed_sources": f"SELECT 'high' AS severity, '' AS entity, {_place('dst_ip')} AS place, dst_ip AS item, packets AS weight FROM flows JOIN single USING (src_ip) WHERE (SELECT count(*) FROM single) > 500",
    "segmentation.idmz_bypass": _violation("idmz_bypass", "critical"),
    "segmentation.wrong_direction": _violation("wrong_direction", "high"),
    "segmentation.deny_by_default": _violation("no_matching_conduit", "high"),
}
_RANK = "CASE severity WHEN 'info' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2 ELSE 3 END"


#: Evidence that a rule shows, where it is not 15, and the rules that show it in order of place.
_SHOWN = {"creds.ldap_simple_bind": 5, "compat.ntlmv1": 5, "creds.rdp_no_nla": 5, "compat.weak_tls_cipher": 5, "attack.spoofed_sources": 5, "ics.trusted_writer_activity": 30}
_IN_PLACE = ("creds.ldap", "compat.ntlm", "creds.rdp", "compat.weak", "ics.", "segmentation.")


#: Rules whose own queries show all evidence.
_WHOLE = ("compat.ntlmv1", "compat.weak_tls_cipher")


def _found(name: str, whole: bool = False) -> str:
    place = "" if " AS place" in _RULES[name] else ", item AS place"
    tried = "" if " AS attempted" in _RULES[name] else ", 0 AS attempted"
    items = f"SELECT entity, place, item, CAST(sum(weight) AS BIGINT) AS w, CAST(sum(attempted) AS BIGINT) AS tried, max({_RANK}) AS rank FROM (SELECT *{place}{tried} FROM ({_RULES[name]})) GROUP BY entity, place, item"
    order = "place" if name.startswith(_IN_PLACE) else "w DESC, place"
    ranked = f"SELECT *, row_number() OVER (PARTITION BY entity ORDER BY {order}) AS k FROM ({items})"
    severity = "CASE max(rank) WHEN 0 THEN 'info' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'critical' END"
    cut = "" if whole else f" FILTER (k <= {_SHOWN.get(name, 15)})"
    return f"SELECT '{name}' AS rule_id, entity, {severity} AS severity, CAST(sum(w) AS BIGINT) AS hits, CAST(sum(tried) AS BIGINT) AS attempted, count(*) AS items, string_agg(item || ' (' || w || ')', '; ' ORDER BY k){cut} AS evidence FROM ({ranked}) GROUP BY entity"


_ALL = " UNION ALL ".join(_found(n) for n in _RULES if not n.startswith("segmentation."))
_POLICY_AWARE = " UNION ALL ".join(_found(n) for n in _RULES if n != "egress.ot_to_internet")
_KEY = "src_ip, dst_ip, dst_port, proto"
_IP = r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"
_IP6 = r"\b(?:[0-9A-Fa-f]{1,4}:){2,7}[0-9A-Fa-f]{1,4}\b"
_MAC = r"\b(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}\b"


def _leaks(table: str, keys: str) -> str:
    tries = " ".join(f"WHEN regexp_extract(text, '{p}') <> '' THEN {{'kind': '{k}', 'hit': regexp_extract(text, '{p}')}}" for k, p in (("ipv4", _IP), ("ipv6", _IP6), ("mac", _MAC)))
    offset = "strlen(regexp_extract(text, '^((?s:.*?))' || CASE leak.kind WHEN 'ipv4' THEN '" + _IP + "' WHEN 'ipv6' THEN '" + _IP6 + "' ELSE '" + _MAC + "' END, 1))"
    return f"SELECT {keys}, leak.kind AS kind, {offset} AS \"offset\", length(leak.hit) AS length, substr(sha256(leak.hit), 1, 4) AS hash FROM (SELECT *, CASE {tries} END AS leak FROM {table}) WHERE leak IS NOT NULL"


def _delta(key: str, base: str, now: str, third: str) -> str:
    return f"SELECT {key}, CASE WHEN was IS NULL THEN 'new' WHEN now IS NULL THEN 'resolved' ELSE '{third}' END AS change FROM (SELECT DISTINCT {key}, true AS was FROM {base}) FULL JOIN (SELECT DISTINCT {key}, true AS now FROM {now}) USING ({key})"


_SIDE_RULES = {
    "recon.port_scan": "SELECT src_ip AS entity FROM (SELECT src_ip, count(DISTINCT dst_ip) AS d, count(DISTINCT (dst_port, proto)) AS p FROM {side}_flows WHERE NOT " + _group("dst_ip") + " GROUP BY src_ip) WHERE d >= 10 OR p >= 10",
    "compat.smbv1": f"SELECT DISTINCT '' AS entity FROM {{side}}_packets WHERE proto = 6 AND (src_port IN (445, 139) OR dst_port IN (445, 139)) AND ({_hex(0, 4)} = 'FF534D42' OR {_hex(4, 4)} = 'FF534D42')",
    # the derived hellos offer two ciphers, the first of them weak
    "compat.weak_tls_cipher": f"SELECT DISTINCT {_PAIR} AS entity FROM {{side}}_packets WHERE proto = 6 AND dst_port IN (443, 8443) AND {_hex(0)} = '16' AND {_hex(5)} = '01' AND {_hex(46, 2)} = '0005'",
}


def _side_findings(side: str) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS rule_id, entity FROM ({s.format(side=side)})" for n, s in _SIDE_RULES.items())


_TALLY = [(k, f"count(*) FILTER (kind = '{k}')") for k in ("allowed", "intra_zone", "no_matching_conduit", "wrong_direction", "multicast_exempt")] + [
    ("violating_flows", "count(*) FILTER (kind IN ('wrong_direction', 'no_matching_conduit') OR idmz_bypass)"), ("idmz_bypasses", "count(*) FILTER (idmz_bypass)"),
    ("external_endpoints", "CAST(coalesce(sum(CAST(src_zone = 'EXTERNAL' AS BIGINT) + CAST(dst_zone = 'EXTERNAL' AS BIGINT)), 0) AS BIGINT)"),
]
#: What stands between the addresses, and a pseudonym for each of them.
_SCRUBBED = f"""WITH m AS (SELECT real, 'host_' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS pseudonym FROM (SELECT real, row_number() OVER (ORDER BY real) AS n FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '{_IP}')) AS real FROM documents))),
 p AS (SELECT doc_id, unnest(regexp_split_to_array(text, '{_IP}')) AS part, generate_subscripts(regexp_split_to_array(text, '{_IP}'), 1) AS i FROM documents),
 a AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_IP}')) AS real, generate_subscripts(regexp_extract_all(text, '{_IP}'), 1) AS i FROM documents),
 t AS (SELECT doc_id, string_agg(part || coalesce(pseudonym, ''), '' ORDER BY i) AS text FROM p LEFT JOIN a USING (doc_id, i) LEFT JOIN m USING (real) GROUP BY doc_id)
SELECT d.doc_id, sha256(t.text) AS sha256, length(t.text) AS chars FROM documents d LEFT JOIN t USING (doc_id)"""

_SHIFTS = f"SELECT * FROM (SELECT {_KEY}, b.bytes AS base_bytes, n.bytes AS current_bytes, CASE WHEN least(b.bytes, n.bytes) > 0 AND b.bytes IS NOT NULL AND n.bytes IS NOT NULL THEN round(greatest(b.bytes, n.bytes) / least(b.bytes, n.bytes), 6) END AS ratio, CASE WHEN b.bytes IS NULL THEN 'new' WHEN n.bytes IS NULL THEN 'gone' WHEN least(b.bytes, n.bytes) > 0 AND greatest(b.bytes, n.bytes) / least(b.bytes, n.bytes) >= 2 THEN 'shifted' END AS change FROM base_flows b FULL JOIN now_flows n USING ({_KEY})) WHERE change IS NOT NULL"

ORACLE: dict[str, str] = {
    k: _sql(v)
    for k, v in (
        {
            "ip_predicates": f"SELECT ip, {_num('ip')} AS num, {_ot('ip')} AS in_ot, {_public('ip')} AS public, {_group('ip')} AS group_address, regexp_replace(ip, '[0-9]+$', '0/24') AS subnet, 'unmapped_' || substr(sha256('salt' || ip), 1, 16) AS opaque FROM hosts",
            "flow_labels": f"SELECT {_LABEL} AS label, {_PROTO} AS transport, {_NO_FLY} AS no_fly, count(*) AS packets, CAST(sum(payload_len) AS BIGINT) AS bytes FROM packets GROUP BY 1, 2, 3",
            "capture_totals": "SELECT count(*) AS packets, CAST(sum(payload_len) AS BIGINT) AS bytes, arg_min(ts, pkt_id) AS first_ts, arg_max(ts, pkt_id) AS last_ts, min(ts) AS min_ts, max(ts) AS max_ts, count(*) FILTER (CAST(('0x' || substr(dst_mac, 1, 2)) AS INTEGER) % 2 = 1) AS broadcast_frames FROM packets",
            "mac_frames": "SELECT mac, frames FROM frames",
            "hosts": "SELECT ip, packets, bytes, mac, first_seen, last_seen, in_ot FROM hosts",
            "host_protocols": "SELECT ip, unnest(protocols) AS protocol FROM hosts",
            "flows": "SELECT * FROM flows",
            "external_flows": f"SELECT {_KEY}, packets, bytes FROM flows WHERE {_ot('src_ip')} AND {_public('dst_ip')}",
            "sent_received": "SELECT ip, CAST(sum(sent) AS BIGINT) AS sent, CAST(sum(received) AS BIGINT) AS received FROM (SELECT src_ip AS ip, packets AS sent, 0 AS received FROM flows UNION ALL SELECT dst_ip, 0, packets FROM flows) GROUP BY ip",
            "comms_top25": f"SELECT {_KEY}, packets, bytes FROM flows ORDER BY bytes DESC, {_KEY} LIMIT 25",
            "slice_hosts": "SELECT pkt_id, src_ip, dst_ip, dst_port FROM packets WHERE src_ip IN ('10.20.1.200', '10.10.0.1') OR dst_ip IN ('10.20.1.200', '10.10.0.1') OR src_ip = '10.10.1.2' AND dst_ip = '10.20.1.2' AND dst_port = 502",
            "modbus_events": "SELECT fc, sub, label, engineering, count(*) AS n, count(DISTINCT src_ip) AS sources FROM modbus GROUP BY 1, 2, 3, 4",
            "s7_events": "SELECT fc, label, engineering, read, count(*) AS n FROM s7 GROUP BY 1, 2, 3, 4",
            "dnp3_events": "SELECT proto, fc, engineering, count(*) AS n FROM dnp3 GROUP BY 1, 2, 3",
            "enip_events": "SELECT command, label, cip_service, engineering, count(*) AS n FROM enip GROUP BY 1, 2, 3, 4",
            "cred_events": "SELECT src_ip, dst_ip, dst_port, kind, n, ts FROM creds",
            "smbv1_pairs": "SELECT * FROM smb",
            "tls_hellos": "SELECT * FROM tls",
            "tls_ciphers": "SELECT * FROM ciphers",
            "rdp_events": "SELECT * FROM rdp",
            "ldap_binds": "SELECT pkt_id, src_ip, dst_ip, version, anonymous, used_starttls FROM ldap",
            "modbus_units": "SELECT src_ip, dst_ip, count(DISTINCT unit_id) AS units FROM modbus GROUP BY 1, 2",
            "findings_all": _ALL,
            "findings_policy": _POLICY_AWARE,
            "findings_by_severity": f"SELECT severity, count(*) AS findings, CAST(sum(hits) AS BIGINT) AS hits FROM ({_ALL}) GROUP BY severity",
            "findings_mitre": "SELECT technique, count(*) AS findings, CAST(sum(hits) AS BIGINT) AS hits FROM (" + _ALL + ") JOIN (VALUES " + ", ".join(f"('{r[0]}', '{t}')" for r in CATALOG for t in r[2]) + ") v(rule, technique) ON rule = rule_id GROUP BY technique",
            "assets": "SELECT ip, mac, vendor, role, packets, bytes, in_ot FROM assets",
            "asset_roles": "SELECT role, vendor, count(*) AS assets FROM assets GROUP BY 1, 2",
            "asset_top100": f"SELECT ip, role, packets FROM assets ORDER BY packets DESC, {_num('ip')} LIMIT 100",
            "capture_source": "SELECT n AS packets, distinct_macs, round(top / n, 6) AS top_share, CASE WHEN distinct_macs >= 10 AND top / n < 0.6 AND b > 0 THEN 'span' ELSE 'ambiguous' END AS source, CASE WHEN distinct_macs >= 10 AND top / n < 0.6 AND b > 0 THEN CASE WHEN n >= 1000 THEN 'high' ELSE 'medium' END ELSE 'low' END AS confidence, false AS conflict FROM (SELECT count(*) AS n, count(*) FILTER (dst_mac = 'FF:FF:FF:FF:FF:FF') AS b FROM packets), (SELECT count(*) AS distinct_macs, max(frames) AS top FROM frames)",
            "capture_sanity": "SELECT count(*) AS packets, max(epoch_us(ts)) < 1000000 AS epoch_zero, count(*) >= 2 AND max(epoch_us(ts)) >= 1000000 AND max(epoch_us(ts)) - min(epoch_us(ts)) < 1000000 AS sub_second, coalesce(bool_or(ts < before), false) AS non_monotonic FROM (SELECT *, lag(ts) OVER (ORDER BY pkt_id) AS before FROM packets)",
            "flow_index": f"SELECT row_number() OVER (ORDER BY {_num('src_ip')}, {_num('dst_ip')}, dst_port, proto) - 1 AS flow_index, {_KEY}, CASE WHEN label IN ('modbus', 'dnp3', 'enip', 's7comm', 'bacnet', 'opcua') THEN 'dpi_confirmed' WHEN label IS NOT NULL THEN 'port_heuristic' ELSE 'unknown' END AS service_source FROM flows",
            "map_coverage": f"SELECT count(*) AS hosts, count(*) FILTER ({_num('ip')} % 3 < 2) AS mapped, round(count(*) FILTER ({_num('ip')} % 3 < 2) / count(*), 6) AS share, count(*) FILTER ({_num('ip')} % 3 < 2) / count(*) < 0.5 AS low FROM hosts",
            "violations_graded": "SELECT violation, CASE WHEN packets = 1 OR packets % 3 = 0 THEN 'attempted' ELSE 'established' END AS grade, count(*) AS flows, CAST(sum(packets) AS BIGINT) AS packets FROM violations GROUP BY 1, 2",
            "segmentation_tally": " UNION ALL ".join(f"SELECT '{m}' AS metric, (SELECT {e} FROM base_verdicts) AS baseline, (SELECT {e} FROM now_verdicts) AS current" for m, e in _TALLY),
            "flow_rates": f"SELECT * FROM (SELECT {_KEY}, b.bytes AS base_bytes, n.bytes AS current_bytes, CASE WHEN least(b.bytes, n.bytes) > 0 AND b.bytes IS NOT NULL AND n.bytes IS NOT NULL THEN round(greatest(b.bytes / 1036800.0, n.bytes / 864000.0) / least(b.bytes / 1036800.0, n.bytes / 864000.0), 6) END AS ratio, CASE WHEN b.bytes IS NULL THEN 'new' WHEN n.bytes IS NULL THEN 'gone' WHEN least(b.bytes, n.bytes) > 0 AND greatest(CAST(b.bytes AS DOUBLE) / 1036800, CAST(n.bytes AS DOUBLE) / 864000) / least(CAST(b.bytes AS DOUBLE) / 1036800, CAST(n.bytes AS DOUBLE) / 864000) >= 3 THEN 'shifted' END AS change FROM base_flows b FULL JOIN now_flows n USING ({_KEY})) WHERE change IS NOT NULL",
            "unscrub_counts": f"SELECT CAST(coalesce(sum(k) FILTER (n % 3 <> 0), 0) AS BIGINT) AS replaced, count(*) FILTER (n % 3 = 0) AS unmapped FROM (SELECT real, count(*) AS k, row_number() OVER (ORDER BY real) AS n FROM (SELECT unnest(regexp_extract_all(text, '{_IP}')) AS real FROM documents) GROUP BY real)",
            "scrubbed_docs": _SCRUBBED,
            "zone_suggest": "WITH r AS (SELECT regexp_replace(ip, '[0-9]+$', '0/24') AS cidr, role, CASE role WHEN 'plc' THEN 'L1' WHEN 'hmi' THEN 'L2' WHEN 'it_endpoint' THEN 'L4' ELSE 'L3' END AS level FROM assets WHERE in_ot), l AS (SELECT cidr, level, count(*) AS n FROM r GROUP BY 1, 2), t AS (SELECT cidr, string_agg(n || ' ' || role, ', ' ORDER BY n DESC, role) AS roles FROM (SELECT cidr, role, count(*) AS n FROM r GROUP BY 1, 2) GROUP BY cidr) SELECT 'zone-' || regexp_replace(cidr, '[./]+', '-', 'g') AS zone, cidr, arg_min(level, (-n, level)) AS level, CAST(sum(n) AS BIGINT) AS assets, any_value(roles) AS roles FROM l JOIN t USING (cidr) GROUP BY cidr",
            "zone_resolve": "SELECT ip, zone, level, directed FROM zoned",
            "verdicts": f"SELECT {_KEY}, src_zone, dst_zone, kind, conduit, idmz_bypass FROM verdicts",
            "violations": "SELECT violation, src_zone, dst_zone, 'established' AS grade, count(*) AS flows, CAST(sum(bytes) AS BIGINT) AS bytes FROM violations GROUP BY 1, 2, 3",
            "conformance_tally": "SELECT count(*) AS flows, " + ", ".join(f"count(*) FILTER (kind = '{k}') AS {k}" for k in ("allowed", "intra_zone", "multicast_exempt", "wrong_direction", "no_matching_conduit")) + ", count(*) FILTER (idmz_bypass) AS idmz_bypasses, CAST(sum(CAST(src_zone = 'EXTERNAL' AS BIGINT) + CAST(dst_zone = 'EXTERNAL' AS BIGINT)) AS BIGINT) AS external_endpoints, count(*) FILTER (kind IN ('wrong_direction', 'no_matching_conduit') OR idmz_bypass) AS violating_flows FROM verdicts",
            "trusted_unmatched": "SELECT rule, declaration FROM (VALUES " + ", ".join(f"({k}, '{w.src}={w.dst}:{w.proto}')" for k, w in enumerate(TRUSTED, 1)) + ") v(rule, declaration) WHERE rule NOT IN (SELECT rule FROM judged WHERE rule IS NOT NULL)",
            "hosts_new": "SELECT ip, packets, bytes, in_ot FROM now_hosts WHERE ip NOT IN (SELECT ip FROM base_hosts)",
            "hosts_gone": "SELECT ip, packets, bytes, in_ot FROM base_hosts WHERE ip NOT IN (SELECT ip FROM now_hosts)",
            "flow_shifts": _SHIFTS,
            "flow_shifts_pseudonyms": f"SELECT s.alias AS src_ip, d.alias AS dst_ip, dst_port, proto, base_bytes, current_bytes, ratio, change FROM ({_SHIFTS}) f JOIN aliases s ON s.ip = f.src_ip JOIN aliases d ON d.ip = f.dst_ip",
            "hosts_new_pseudonyms": "SELECT alias AS ip, packets, bytes, in_ot FROM now_hosts JOIN aliases USING (ip) WHERE ip NOT IN (SELECT ip FROM base_hosts)",
            "hostnames": "SELECT ip, name FROM last_names",
            "asset_names": "SELECT ip, name AS hostname, CASE WHEN name IS NULL THEN ip ELSE name || ' (' || ip || ')' END AS host_label FROM hosts LEFT JOIN last_names USING (ip)",
            "role_shifts_pseudonyms": "SELECT alias AS ip, b.role AS was, n.role AS now FROM base_assets b JOIN now_assets n USING (ip) JOIN aliases USING (ip) WHERE b.role <> n.role",
            "findings_delta_pseudonyms": f"SELECT rule_id, concat_ws(' -> ', s.alias, d.alias) AS entity, change FROM ({_delta('rule_id, entity', '(' + _side_findings('base') + ')', '(' + _side_findings('now') + ')', 'recurring')}) f LEFT JOIN aliases s ON s.ip = split_part(entity, ' -> ', 1) LEFT JOIN aliases d ON d.ip = split_part(entity, ' -> ', 2)",
            "segmentation_drift_pseudonyms": f"SELECT violation, s.alias AS src_ip, d.alias AS dst_ip, dst_port, proto, change FROM ({_delta('violation, ' + _KEY, 'base_violations', 'now_violations', 'persisting')}) f JOIN aliases s ON s.ip = f.src_ip JOIN aliases d ON d.ip = f.dst_ip",
            "asset_omitted": "SELECT count(*) AS assets, least(count(*), 100) AS shown, count(*) - least(count(*), 100) AS omitted FROM assets",
            "findings_ranked": f"SELECT row_number() OVER (ORDER BY {_RANK} DESC, rule_id, entity) AS position, rule_id, entity, severity, hits FROM ({_ALL})",
            "assets_ranked": f"SELECT row_number() OVER (ORDER BY in_ot DESC, {_num('ip')}) AS position, ip, role, in_ot FROM assets",
            "violations_ranked": f"SELECT row_number() OVER (ORDER BY first_seen, {_num('src_ip')}, {_num('dst_ip')}, dst_port, proto, violation) AS position, first_seen, {_KEY}, violation FROM violations JOIN flows USING ({_KEY})",
            "role_shifts": "SELECT ip, b.role AS was, n.role AS now FROM base_assets b JOIN now_assets n USING (ip) WHERE b.role <> n.role",
            "findings_delta": _delta("rule_id, entity", f"({_side_findings('base')})", f"({_side_findings('now')})", "recurring"),
            "segmentation_drift": f"SELECT violation, change, count(*) AS violations FROM ({_delta('violation, ' + _KEY, 'base_violations', 'now_violations', 'persisting')}) GROUP BY 1, 2",
            "scrub_map": f"SELECT 'host' AS family, 'host_' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS pseudonym, real FROM (SELECT real, row_number() OVER (ORDER BY real) AS n FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '{_IP}')) AS real FROM documents))",
            "leak_scan": _leaks("documents", "doc_id"),
            "conversation_leaks": _leaks("conversations", "conv_id, turn"),
            "map_leaks": f"SELECT doc_id FROM documents WHERE regexp_matches(text, '{_IP}')",
            "unscrub_roundtrip": "SELECT count(*) AS texts, CAST(0 AS BIGINT) AS changed FROM documents",
        }
        | {f"rule_{n.split('.')[1]}": _found(n, n in _WHOLE) for n in _RULES}
    ).items()
}
