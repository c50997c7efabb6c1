"""Protocol events of a packet table: a port filter first, then byte expressions on what is left."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import net, wire

_BASE = ["pkt_id", "ts", "src_ip", "dst_ip", "src_port", "dst_port"]

#: Names of function codes.
MODBUS_LABELS = [
    (1, "Read Coils"), (2, "Read Discrete Inputs"), (3, "Read Holding Registers"), (4, "Read Input Registers"), (5, "Write Single Coil"), (6, "Write Single Register"),
    (7, "Read Exception Status"), (8, "Diagnostic"), (15, "Write Multiple Coils"), (16, "Write Multiple Registers"), (17, "Report Server ID"), (20, "Read File Record"),
    (21, "Write File Record"), (22, "Mask Write Register"), (23, "Read/Write Multiple Registers"),
]
S7_LABELS = [
    (0x00, "CPU services"), (0x04, "Read Var"), (0x05, "Write Var"), (0x1A, "Request download"), (0x1B, "Download block"), (0x1C, "Download ended"), (0x1D, "Start upload"),
    (0x1E, "Upload"), (0x1F, "End upload"), (0x28, "PLC Control"), (0x29, "PLC Stop"), (0xF0, "Setup communication"),
]
ENIP_LABELS = [(0x0004, "ListServices"), (0x0063, "ListIdentity"), (0x0064, "ListInterfaces"), (0x0065, "RegisterSession"), (0x0066, "UnRegisterSession"), (0x006F, "SendRRData"), (0x0070, "SendUnitData")]
MODBUS_WRITES = (5, 6, 15, 16, 21, 22, 23)
S7_ENGINEERING = (0x05, 0x1A, 0x1B, 0x1C, 0x1D, 0x1E, 0x1F, 0x28, 0x29)
DNP3_ENGINEERING = (4, 5, 6, 13, 14, 15, 16, 20, 21, 24)
#: CIP services that change a device: set attributes, reset, start, stop, create, delete, forward open and close.
CIP_ENGINEERING = (0x02, 0x10, 0x05, 0x06, 0x07, 0x08, 0x09, 0x54, 0x4E)
CPF_ITEMS = 16
WEAK_CIPHERS = (0x0001, 0x0002, 0x0004, 0x0005, 0x0009, 0x000A)


def _h() -> Column:
    return F.col("payload_hex")


def named(code: Column, rows: list) -> Column:
    """The name of a code, looked up once."""
    names = F.create_map(*(F.lit(x) for row in rows for x in row))
    return F.coalesce(F.element_at(names, code.cast("int")), F.lit("Unknown"))


def _tcp(packets: DataFrame, *ports: int) -> DataFrame:
    return packets.where((F.col("proto") == 6) & (F.col("src_port").isin(*ports) | F.col("dst_port").isin(*ports)))


def _udp(packets: DataFrame, *ports: int) -> DataFrame:
    return packets.where((F.col("proto") == 17) & (F.col("src_port").isin(*ports) | F.col("dst_port").isin(*ports)))


def _tcp_to(packets: DataFrame, *ports: int) -> DataFrame:
    return packets.where((F.col("proto") == 6) & F.col("dst_port").isin(*ports))


def _modbus() -> tuple[Column, Column, Column]:
    """Whether the payload is a Modbus/TCP frame, its function code and its subfunction (0 without one)."""
    length = wire.be(_h(), 4, 2)
    good = (wire.size(_h()) >= 8) & (wire.hex_at(_h(), 2, 2) == "0000") & (length >= 2) & (length + 6 <= wire.size(_h()))
    return good, wire.be(_h(), 7), F.coalesce(wire.be(_h(), 8, 2), F.lit(0))


def _modbus_engineering(fc: Column, sub: Column) -> Column:
    return fc.isin(*MODBUS_WRITES) | ((fc == 8) & sub.isin(1, 4, 10))


def modbus_label(fc: Column, sub: Column) -> Column:
    return F.when((fc == 8) & (sub == 1), "Diagnostic: Restart Communications").when((fc == 8) & (sub == 4), "Diagnostic: Force Listen Only Mode").when((fc == 8) & (sub == 10), "Diagnostic: Clear Counters").otherwise(named(fc, MODBUS_LABELS))


def modbus_events(packets: DataFrame) -> DataFrame:
    """Modbus/TCP requests and responses alike."""
    good, fc, sub = _modbus()
    rows = _tcp(packets, 502).where(good).select(*_BASE, wire.be(_h(), 6).alias("unit_id"), fc.alias("fc"), sub.alias("sub"))
    fc, sub = F.col("fc"), F.col("sub")
    return rows.withColumn("label", modbus_label(fc, sub)).withColumn("engineering", _modbus_engineering(fc, sub))


def _s7() -> tuple[Column, Column]:
    """Whether the payload is S7 communication over TPKT and COTP, and its function code; the header is longer for acknowledgements."""
    n = wire.be(_h(), 4)
    start = n + 5
    head = F.when(wire.be(_h(), start + 1).isin(2, 3), 12).otherwise(10)
    good = (wire.size(_h()) >= 7) & (wire.hex_at(_h(), 0, 2) == "0300") & (n <= 17) & (wire.hex_at(_h(), start) == "32")
    return good & (wire.be(_h(), start + 6, 2) > 0) & (wire.size(_h()) > start + head), wire.be(_h(), start + head)


def s7_events(packets: DataFrame) -> DataFrame:
    good, fc = _s7()
    rows = _tcp(packets, 102).where(good).select(*_BASE, fc.alias("fc"))
    return rows.select("*", named(F.col("fc"), S7_LABELS).alias("label"), F.col("fc").isin(*S7_ENGINEERING).alias("engineering"), (F.col("fc") == 4).alias("read"))


def _dnp3() -> tuple[Column, Column]:
    return (wire.size(_h()) >= 13) & (wire.hex_at(_h(), 0, 2) == "0564"), wire.be(_h(), 12)


def dnp3_events(packets: DataFrame) -> DataFrame:
    ports = F.col("proto").isin(6, 17) & ((F.col("src_port") == 20000) | (F.col("dst_port") == 20000))
    good, fc = _dnp3()
    rows = packets.where(ports).where(good).select(*_BASE, "proto", fc.alias("fc"))
    return rows.withColumn("engineering", F.col("fc").isin(*DNP3_ENGINEERING))


def _cip_service() -> Column:
    """The first engineering service in the data items of an encapsulated request, by a bounded walk."""
    count = F.least(wire.le(_h(), 30, 2), F.lit(CPF_ITEMS))
    zero = F.struct(F.lit(32).cast("long").alias("at"), F.lit(None).cast("long").alias("service"))

    def step(state: Column, i: Column) -> Column:
        kind, length = wire.le(_h(), state["at"], 2), wire.le(_h(), state["at"] + 2, 2)
        data = state["at"] + 4
        whole = (i < count) & (data + length <= wire.size(_h()))
        skip = F.when(kind == 0xB2, 0).when(kind == 0xB1, 2)
        code = F.when(whole & (length > skip), wire.be(_h(), data + skip)).bitwiseAND(F.lit(0x7F))
        found = F.when(code.isin(*CIP_ENGINEERING), code)
        return F.struct(F.when(whole, data + length).otherwise(F.lit(1 << 40)).alias("at"), F.coalesce(state["service"], found).alias("service"))

    items = F.slice(F.array(*(F.lit(k) for k in range(CPF_ITEMS))), F.lit(1), F.coalesce(count, F.lit(0)).cast("int"))
    return F.aggregate(items, zero, step, lambda s: s["service"])


def enip_events(packets: DataFrame) -> DataFrame:
    command = wire.le(_h(), 0, 2)
    rows = _tcp(packets, 44818).where(wire.size(_h()) >= 24).select(*_BASE, command.alias("command"), F.when(command.isin(0x6F, 0x70), _cip_service()).alias("cip_service"))
    return rows.select("*", named(F.col("command"), ENIP_LABELS).alias("label"), F.col("cip_service").isNotNull().alias("engineering"))


#: Kinds of credentials in clear, with their protocol, ports, and whether a packet from them counts too.
CLEAR = {"ftp": (6, (21,), False), "telnet": (6, (23,), True), "http_basic": (6, (80, 8080), False), "snmp": (17, (161, 162), True)}


def _clear(kind: str) -> Column:
    """Whether the payload shows a credential of the kind."""
    if kind == "ftp":
        return F.upper(wire.text(wire.hex_at(_h(), 0, 5))).isin("USER ", "PASS ")
    if kind == "telnet":
        return F.length(_h()) > 0
    if kind == "http_basic":
        return wire.text(_h()).contains("Authorization: Basic ")
    at = wire.find(_h(), "0201")
    return (wire.size(_h()) > 8) & (wire.hex_at(_h(), 0) == "30") & (at >= 0) & wire.be(_h(), at + 2).isin(0, 1)


def _at(proto: int, ports: tuple, either: bool) -> Column:
    to = F.col("dst_port").isin(*ports)
    return (F.col("proto") == proto) & ((to | F.col("src_port").isin(*ports)) if either else to)


def cred_packets(packets: DataFrame, kinds=tuple(CLEAR)) -> DataFrame:
    """Packets that show a credential in clear: kind, dst_port and note (for the weak-password check alone)."""
    note = {"ftp": wire.first_line(_h(), 80), "http_basic": F.substring(F.regexp_extract(wire.text(_h()), r"(Authorization: Basic [^\r\n]*)", 1), 1, 120)}
    parts = []
    for kind in kinds:
        rows = packets.where(_at(*CLEAR[kind])).where(_clear(kind)).select(*_BASE, F.lit(kind).alias("kind"), note.get(kind, F.lit("")).alias("note"))
        parts.append(rows.withColumn("dst_port", F.lit(23).cast("long")) if kind == "telnet" else rows)
    return reduce(DataFrame.unionByName, parts)


def cred_events(packets: DataFrame, kinds=tuple(CLEAR)) -> DataFrame:
    """cred_packets once per (source, destination, port, kind): count (at most 2**32 - 1), first time and first note."""
    order = F.struct("ts", "pkt_id")
    rows = cred_packets(packets, kinds).groupBy("src_ip", "dst_ip", "dst_port", "kind")
    return rows.agg(F.least(F.count("*"), F.lit(4294967295)).alias("n"), F.min_by("ts", order).alias("ts"), F.min_by("note", order).alias("note"))


def _smbv1() -> Column:
    return (wire.hex_at(_h(), 0, 4) == "FF534D42") | (wire.hex_at(_h(), 4, 4) == "FF534D42")


def smbv1_pairs(packets: DataFrame) -> DataFrame:
    rows = _tcp(packets, 445, 139).where(_smbv1())
    return rows.groupBy("src_ip", "dst_ip", "dst_port").agg(F.count("*").alias("packets"))


def _hello() -> Column:
    return (wire.size(_h()) >= 11) & (wire.hex_at(_h(), 0) == "16") & (wire.hex_at(_h(), 5) == "01")


def _hellos(packets: DataFrame) -> DataFrame:
    return _tcp_to(packets, 443, 8443).where(_hello())


def tls_hellos(packets: DataFrame) -> DataFrame:
    """Client hellos by pair and offered version."""
    return _hellos(packets).select("src_ip", "dst_ip", wire.be(_h(), 9, 2).alias("version")).groupBy("src_ip", "dst_ip", "version").agg(F.count("*").alias("hellos"))


def _ciphers() -> tuple[Column, Column]:
    """Whether the offered codes of a hello are whole, and the codes."""
    at = F.lit(44) + wire.be(_h(), 43)
    n = wire.be(_h(), at, 2)
    good = (wire.size(_h()) >= 44) & (n > 0) & (n % 2 == 0) & (at + 2 + n <= wire.size(_h()))
    return good, F.transform(F.sequence(F.lit(0), (n / 2 - 1).cast("long")), lambda i: wire.be(_h(), at + 2 + i * 2, 2))


def tls_ciphers(packets: DataFrame) -> DataFrame:
    """Offered cipher codes by pair."""
    good, codes = _ciphers()
    rows = _hellos(packets).where(wire.size(_h()) >= 44).where(good)
    return rows.select("src_ip", "dst_ip", F.explode(codes).alias("cipher")).groupBy("src_ip", "dst_ip", "cipher").agg(F.count("*").alias("hellos"))


_NTLM = "4E544C4D53535000"
NTLM_PORTS = (445, 139, 80, 443, 8080, 135)


def _ntlm() -> tuple[Column, Column]:
    """Whether the payload negotiates NTLM, and the version, null where its flags say neither."""
    at = wire.find(_h(), _NTLM)
    # bits 19 and 9 of the flags, which stand from byte 12 on
    flag = lambda byte, bit: wire.be(_h(), at + 12 + byte).bitwiseAND(F.lit(bit)) != 0
    version = F.when(flag(2, 8), "v2").when(flag(1, 2), "v1")
    return _h().contains(_NTLM) & (at >= 0) & (wire.le(_h(), at + 8, 4) == 1), version


def ntlm_events(packets: DataFrame) -> DataFrame:
    """NTLM negotiations with their version; flags that say neither are dropped."""
    good, version = _ntlm()
    return _tcp(packets, *NTLM_PORTS).where(good).select(*_BASE, version.alias("version")).where("version IS NOT NULL")


def _rdp() -> tuple[Column, Column]:
    good = (wire.size(_h()) >= 19) & (wire.hex_at(_h(), 0, 2) == "0300") & (wire.be(_h(), 2, 2) == wire.size(_h())) & (wire.be(_h(), 5).bitwiseAND(F.lit(0xF0)) == 0xD0) & (wire.hex_at(_h(), 11) == "02")
    return good, wire.le(_h(), 15, 4)


def rdp_events(packets: DataFrame, either_direction: bool = False) -> DataFrame:
    """Connection confirms with the selected protocol; by default to the service port alone."""
    good, protocol = _rdp()
    rows = _tcp(packets, 3389) if either_direction else _tcp_to(packets, 3389)
    return rows.where(good).select(*_BASE, protocol.alias("selected_protocol"))


def ldap_marks(packets: DataFrame) -> DataFrame:
    """LDAP packets with client and server (ip, port), whether they are a StartTLS reply or a simple bind, version and anonymous.

    Lengths are read in short form.
    """
    ports = (389, 3268)
    rows = _tcp(packets, *ports)
    to_server = F.col("dst_port").isin(*ports)
    client = F.when(to_server, F.struct(F.col("src_ip").alias("ip"), F.col("src_port").alias("port"))).otherwise(F.struct(F.col("dst_ip").alias("ip"), F.col("dst_port").alias("port")))
    server = F.when(to_server, F.struct(F.col("dst_ip").alias("ip"), F.col("dst_port").alias("port"))).otherwise(F.struct(F.col("src_ip").alias("ip"), F.col("src_port").alias("port")))
    reply = F.col("src_port").isin(*ports) & (wire.hex_at(_h(), 0) == "30") & (wire.find(_h(), "78") >= 0) & (wire.find(_h(), "0A0100") >= 0)
    message = wire.be(_h(), 3)  # bytes of the message id
    bind = message + 4
    version = bind + 2
    name = version + wire.be(_h(), version + 1) + 2
    auth = name + wire.be(_h(), name + 1) + 2
    good = to_server & (wire.hex_at(_h(), 0) == "30") & (wire.be(_h(), 1) < 128) & (wire.hex_at(_h(), 2) == "02") & (wire.hex_at(_h(), bind) == "60") & (wire.hex_at(_h(), version) == "02") & (wire.hex_at(_h(), name) == "04") & (wire.hex_at(_h(), auth) == "80")
    return rows.select(*_BASE, client.alias("client"), server.alias("server"), F.coalesce(reply, F.lit(False)).alias("reply"), F.coalesce(good, F.lit(False)).alias("bind"), wire.be(_h(), version + 2).alias("version"), (wire.be(_h(), auth + 1) == 0).alias("anonymous"))


def ldap_binds(packets: DataFrame) -> DataFrame:
    """Simple binds with version, whether the password is empty, and whether a StartTLS reply came before on the connection.

    The state of a connection is a running flag over its packets in order.
    """
    before = Window.partitionBy("client", "server").orderBy("ts", "pkt_id").rowsBetween(Window.unboundedPreceding, -1)
    out = ldap_marks(packets).withColumn("used_starttls", F.coalesce(F.max("reply").over(before), F.lit(False)))
    return out.where("bind").select(*_BASE, "version", "anonymous", "used_starttls")


def modbus_units(packets: DataFrame) -> DataFrame:
    """Unit ids addressed by pair."""
    return modbus_events(packets).groupBy("src_ip", "dst_ip").agg(F.count_distinct("unit_id").alias("units"), F.array_sort(F.collect_set("unit_id")).alias("unit_ids"))


def weak_credentials(events: DataFrame, watchlist=("admin", "password", "123456")) -> DataFrame:
    """src_ip, dst_ip, dst_port, category of default or weak credentials; the values stay behind."""
    anonymous = (F.col("kind") == "ftp") & F.lower(F.col("note")).startswith("user anonymous")
    pair = F.decode(F.try_to_binary(F.regexp_extract("note", r"Basic ([A-Za-z0-9+/=]+)", 1), F.lit("base64")), "ISO-8859-1")
    password = F.when(F.locate(":", pair) > 0, F.expr("1")).isNotNull()
    secret = F.regexp_extract(pair, r"^[^:]*:(.*)$", 1)
    weak = (F.col("kind") == "http_basic") & password & ((secret == "") | F.lower(secret).isin(*watchlist))
    category = F.when(anonymous, "anonymous_ftp").when(weak, F.when(secret == "", "empty_password").otherwise("weak_password"))
    return events.withColumn("category", category).where("category IS NOT NULL").select("src_ip", "dst_ip", "dst_port", "category", "n")


#: Marks that marks() can find, by what they say.
MARKS = ("units", "modbus", "cip", "s7", "dnp3", *CLEAR, "smbv1", "tls", "cipher", "ntlmv1", "rdp")


def marks(packets: DataFrame, wanted=MARKS) -> DataFrame:
    """mark, src_ip, dst_ip, port, code, ts, pkt_id: what recognisers see in packets, side by side.

    Each branch filters by port in its scan and stays in codegen, so that readers aggregate all marks at once. code: the
    unit id (units), function and subfunction as one number (modbus), the command (cip), the function (s7, dnp3;
    engineering alone), the old version (tls), the weak cipher (cipher), 0 of others.
    """

    def branch(name: str) -> tuple[Column, Column, Column | int]:
        """Where packets must go, what they must be, and the code."""
        if name in ("units", "modbus"):
            good, fc, sub = _modbus()
            return _at(6, (502,), True), *((good, wire.be(_h(), 6)) if name == "units" else (good & _modbus_engineering(fc, sub), fc * 65536 + sub))
        if name == "cip":
            command = wire.le(_h(), 0, 2)
            return _at(6, (44818,), True), (wire.size(_h()) >= 24) & command.isin(0x6F, 0x70) & _cip_service().isNotNull(), command
        if name == "s7":
            good, fc = _s7()
            return _at(6, (102,), True), good & fc.isin(*S7_ENGINEERING), fc
        if name == "dnp3":
            good, fc = _dnp3()
            return _at(6, (20000,), True) | _at(17, (20000,), True), good & fc.isin(*DNP3_ENGINEERING), fc
        if name in CLEAR:
            return _at(*CLEAR[name]), _clear(name), F.lit(0)
        if name == "smbv1":
            return _at(6, (445, 139), True), _smbv1(), F.lit(0)
        if name == "tls":
            version = wire.be(_h(), 9, 2)
            return _at(6, (443, 8443), False), _hello() & version.between(0x0300, 0x0302), version
        if name == "cipher":
            whole, codes = _ciphers()
            return _at(6, (443, 8443), False), _hello() & whole, F.explode(F.filter(codes, lambda c: c.isin(*WEAK_CIPHERS)))
        if name == "ntlmv1":
            good, version = _ntlm()
            return _at(6, NTLM_PORTS, True), good & (version == "v1"), F.lit(0)
        good, protocol = _rdp()
        return _at(6, (3389,), False), good & (protocol == 0), F.lit(0)

    port = lambda name: F.lit(23).cast("long") if name == "telnet" else F.col("dst_port")
    parts = []
    for name in (m for m in MARKS if m in wanted):
        at, good, code = branch(name)
        parts.append(packets.where(at).where(good).select(F.lit(name).alias("mark"), "src_ip", "dst_ip", port(name).alias("port"), code.alias("code"), "ts", "pkt_id").withColumn("code", F.col("code").cast("long")))
    return reduce(DataFrame.unionByName, parts)
