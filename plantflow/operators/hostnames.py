"""Host names from DHCP, mDNS, LLMNR and NetBIOS payloads: a port filter in the JVM, a bounded walk in Arrow batches."""

from __future__ import annotations

import ipaddress
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _dhcp(p: bytes) -> Iterator[tuple[str, str]]:
    if len(p) < 240 or p[236:240] != b"\x63\x82\x53\x63":
        return
    ip, name, at = p[16:20] if any(p[16:20]) else p[12:16], None, 240
    asked = None
    while at < len(p) and p[at] != 255:
        if p[at] == 0:
            at += 1
            continue
        if at + 1 >= len(p) or at + 2 + p[at + 1] > len(p):
            return
        code, value = p[at], p[at + 2 : at + 2 + p[at + 1]]
        name = value if code == 12 else name
        asked = value if code == 50 and len(value) == 4 else asked
        at += 2 + len(value)
    ip = ip if any(ip) else asked
    if ip and name and all(33 <= b < 127 for b in name):
        yield str(ipaddress.ip_address(ip)), name.decode()


def _name(p: bytes, at: int) -> tuple[str, int] | None:
    """A name without compression, and where it ends."""
    labels = []
    while at < len(p):
        size = p[at]
        if size == 0:
            return ".".join(labels), at + 1
        if size > 63 or at + 1 + size > len(p):
            return None
        labels.append(p[at + 1 : at + 1 + size].decode("ascii", "replace"))
        at += 1 + size
    return None


def _answers(p: bytes, local: bool) -> Iterator[tuple[str, str]]:
    """Address answers of a response."""
    if len(p) < 12 or (not local and not p[2] & 0x80):
        return
    asked, count = struct.unpack_from(">HH", p, 4)
    at, out = 12, []
    for _ in range(asked):
        if (got := _name(p, at)) is None:
            return
        at = got[1] + 4
    for _ in range(count):
        if (got := _name(p, at)) is None or got[1] + 10 > len(p):
            return
        name, at = got
        kind, cls, _, size = struct.unpack_from(">HHIH", p, at)
        data = p[at + 10 : at + 10 + size]
        at += 10 + size
        if kind == 1 and cls & 0x7FFF == 1 and size == 4 and len(data) == 4:
            name = name.rstrip(".")
            name = name[: -len(".local")] if local and name.lower().endswith(".local") else name
            if name:
                out.append((str(ipaddress.ip_address(data)), name))
    yield from out


def _netbios(p: bytes, src: str) -> Iterator[tuple[str, str]]:
    """A name registration."""
    if len(p) < 46 or p[2] & 0x80 or (p[2] >> 3) & 15 != 5 or p[12] != 32:
        return
    pairs = p[13:45]
    if all(65 <= b <= 80 for b in pairs):
        name = bytes(((pairs[k] - 65) << 4) | (pairs[k + 1] - 65) for k in range(0, 30, 2)).decode("ascii", "replace").rstrip(" \x00")
        if name:
            yield src, name


def hostname_events(packets: DataFrame) -> DataFrame:
    """pkt_id, ts, ip, name of every packet that tells a name."""
    udp = packets.where((F.col("proto") == 17) & (F.col("src_port").isin(67, 68, 137, 5353, 5355) | F.col("dst_port").isin(67, 68, 137, 5353, 5355)) & (F.length("payload_hex") > 0))
    rows = udp.select("pkt_id", "ts", "src_ip", "src_port", "dst_port", "payload_hex")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, ips, names = [], [], []
            for i, r in enumerate(batch.to_pylist()):
                ports, p = {r["src_port"], r["dst_port"]}, bytes.fromhex(r["payload_hex"])
                found = _dhcp(p) if ports & {67, 68} else _answers(p, True) if 5353 in ports else _answers(p, False) if 5355 in ports else _netbios(p, r["src_ip"])
                for ip, name in found:
                    at.append(i)
                    ips.append(ip)
                    names.append(name)
            index = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("pkt_id").take(index), batch.column("ts").take(index), pa.array(ips, pa.string()), pa.array(names, pa.string())], names=["pkt_id", "ts", "ip", "name"])

    return rows.mapInArrow(run, f"pkt_id {rows.schema['pkt_id'].dataType.simpleString()}, ts timestamp_ntz, ip string, name string")


def hostnames(packets: DataFrame) -> DataFrame:
    """ip, name: the last name told for each address."""
    return hostname_events(packets).groupBy("ip").agg(F.max_by("name", F.struct("ts", "pkt_id")).alias("name"))
