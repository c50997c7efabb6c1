"""Per-capture, per-host and per-conversation aggregates of a packet table.

Every operator is one or two partial aggregations; "first" is the smallest (ts, pkt_id), never the
order of arrival in a task.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import net

FLOW_KEY = ["src_ip", "dst_ip", "dst_port", "proto"]


def _order() -> Column:
    return F.struct("ts", "pkt_id")


def capture_totals(packets: DataFrame) -> DataFrame:
    """One row: packets, bytes (of payload), first and last by order, earliest and latest, and whether time ever runs back."""
    totals = packets.agg(
        F.count("*").alias("packets"),
        F.coalesce(F.sum("payload_len"), F.lit(0)).alias("bytes"),
        F.min_by("ts", "pkt_id").alias("first_ts"),
        F.max_by("ts", "pkt_id").alias("last_ts"),
        F.min("ts").alias("min_ts"),
        F.max("ts").alias("max_ts"),
        F.coalesce(F.sum(net.mac_is_group(F.col("dst_mac")).cast("long")), F.lit(0)).alias("broadcast_frames"),
    )
    return totals


def steps_back(packets: DataFrame, by: str | None = None, order: str = "pkt_id") -> DataFrame:
    """by, steps: packets earlier than the one before them in the same capture (in all, without by).

    Packets are range-sorted; every range is looked at on its own, and then the ends of neighbouring ranges.
    """
    capture = F.col(by) if by else F.lit(0)
    rows = packets.select(capture.alias("_by"), F.col(order).alias("_at"), "ts").repartitionByRange("_by", "_at").withColumn("_part", F.spark_partition_id())
    before = F.lag("ts").over(Window.partitionBy("_part", "_by").orderBy("_at"))
    parts = rows.withColumn("_before", before).groupBy("_by", "_part").agg(F.count_if(F.col("ts") < F.col("_before")).alias("steps"), F.min("_at").alias("_from"), F.min_by("ts", "_at").alias("_first"), F.max_by("ts", "_at").alias("_last"))
    last = F.lag("_last").over(Window.partitionBy("_by").orderBy("_from"))  # one row a range
    out = parts.withColumn("_before", last).groupBy("_by").agg((F.sum("steps") + F.count_if(F.col("_first") < F.col("_before"))).alias("steps"))
    return out.select(F.col("_by").alias(by), "steps") if by else out.select("steps")


def mac_frames(packets: DataFrame) -> DataFrame:
    """mac, frames: a frame counts for its source and its destination, once if they are equal."""
    both = F.array_distinct(F.filter(F.array("src_mac", "dst_mac"), lambda m: m.isNotNull() & (m != "00:00:00:00:00:00")))
    return packets.select(F.explode(both).alias("mac")).groupBy("mac").agg(F.count("*").alias("frames"))


def hosts(packets: DataFrame, ot: Iterable[str] | None = None) -> DataFrame:
    """One row per address, as source or destination: traffic, protocols, first MAC, all MACs, times, in_ot."""
    label = net.port_label(F.col("proto"), F.col("src_port"), F.col("dst_port"))
    side = lambda ip, mac: F.struct(F.col(ip).alias("ip"), F.col(mac).alias("mac"))
    rows = packets.select(F.explode(F.array(side("src_ip", "src_mac"), side("dst_ip", "dst_mac"))).alias("h"), "ts", "pkt_id", "payload_len", label.alias("label"))
    known = F.col("h.mac").isNotNull() & (F.col("h.mac") != "00:00:00:00:00:00")
    out = rows.groupBy(F.col("h.ip").alias("ip")).agg(
        F.count("*").alias("packets"),
        F.sum("payload_len").alias("bytes"),
        F.array_sort(F.collect_set("label")).alias("protocols"),
        F.min_by(F.when(known, F.col("h.mac")), F.when(known, F.struct("ts", "pkt_id"))).alias("mac"),
        F.array_sort(F.collect_set(F.when(known, F.col("h.mac")))).alias("macs"),
        F.min_by("ts", _order()).alias("first_seen"),
        F.max_by("ts", _order()).alias("last_seen"),
    )
    return out.withColumn("in_ot", net.in_ot(F.col("ip"), ot))


def flows(packets: DataFrame) -> DataFrame:
    """One row per (source, destination, destination port, protocol); the source port is not in the key."""
    label = net.port_label(F.col("proto"), F.col("src_port"), F.col("dst_port"))
    rows = packets.select(*FLOW_KEY, "ts", "pkt_id", "payload_len", "src_port", label.alias("label"))
    return rows.groupBy(*FLOW_KEY).agg(
        F.count("*").alias("packets"),
        F.sum("payload_len").alias("bytes"),
        F.min_by("ts", _order()).alias("first_seen"),
        F.max_by("ts", _order()).alias("last_seen"),
        F.min_by("label", F.when(F.col("label").isNotNull(), _order())).alias("label"),
        F.count_distinct("src_port").alias("connections"),
    )


def external_flows(flow_table: DataFrame, ot: Iterable[str] | None = None) -> DataFrame:
    return flow_table.where(net.in_ot(F.col("src_ip"), ot) & net.is_public(F.col("dst_ip")))


def sent_received(flow_table: DataFrame) -> DataFrame:
    """ip, sent, received in packets."""
    side = flow_table.select(F.explode(F.array(F.struct(F.col("src_ip").alias("ip"), F.col("packets").alias("sent"), F.lit(0).cast("long").alias("received")), F.struct(F.col("dst_ip").alias("ip"), F.lit(0).cast("long").alias("sent"), F.col("packets").alias("received")))).alias("s"))
    return side.groupBy(F.col("s.ip").alias("ip")).agg(F.sum("s.sent").alias("sent"), F.sum("s.received").alias("received"))


def flow_index(flow_table: DataFrame) -> DataFrame:
    """flow_table with flow_index, dense from 0 in the order of addresses, port and protocol."""
    from .privacy import numbered

    by = [c for ip in ("src_ip", "dst_ip") for c in (net.ip_num(F.col(ip)), net.v6_hex(F.col(ip)))]
    return numbered(flow_table, [*by, F.col("dst_port"), F.col("proto")], "flow_index", 0)


def comms_matrix(flow_table: DataFrame, n: int = 25) -> DataFrame:
    """The n flows with most bytes."""
    return flow_table.orderBy(F.desc("bytes"), *FLOW_KEY).limit(n)


def slice_packets(packets: DataFrame, hosts_: Iterable[str] = (), flows_: Iterable[tuple[str, str, int]] = ()) -> DataFrame:
    """Packets from or to one of hosts_, or of one of the flows (source, destination, destination port)."""
    chosen = F.lit(False)
    if hosts_ := list(hosts_):
        chosen = chosen | F.col("src_ip").isin(hosts_) | F.col("dst_ip").isin(hosts_)
    for src, dst, port in flows_:
        chosen = chosen | ((F.col("src_ip") == src) & (F.col("dst_ip") == dst) & (F.col("dst_port") == port))
    return packets.where(chosen)


def write_slice(packets: DataFrame, path: str, hosts_: Iterable[str] = (), flows_: Iterable[tuple[str, str, int]] = ()) -> dict[str, int]:
    """Write slice_packets to a new Parquet folder; the packets scanned and matched, counted in the pass that writes."""
    scanned, matched = Observation("scanned"), Observation("matched")
    seen = packets.observe(scanned, F.count(F.lit(1)).alias("n"))
    slice_packets(seen, hosts_, flows_).observe(matched, F.count(F.lit(1)).alias("n")).write.parquet(path)
    return {"scanned": scanned.get["n"], "matched": matched.get["n"]}
