"""Column types of the tables that jobs exchange."""

from pyspark.sql import types as T

#: One row per captured IP packet. payload_hex is upper case; proto is 6 (TCP), 17 (UDP) or 0. Operators only order by
#: pkt_id, so it may be a decimal where numbers of 64 bits do not hold the ids.
PACKETS = T.StructType(
    [
        T.StructField("pkt_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("src_mac", T.StringType()),
        T.StructField("dst_mac", T.StringType()),
        T.StructField("src_ip", T.StringType()),
        T.StructField("dst_ip", T.StringType()),
        T.StructField("proto", T.IntegerType()),
        T.StructField("src_port", T.LongType()),
        T.StructField("dst_port", T.LongType()),
        T.StructField("payload_hex", T.StringType()),
        T.StructField("payload_len", T.LongType()),
    ]
)
ZONES = "zone string, level string"
MEMBERS = "zone string, cidr string"
CONDUITS = "conduit int, from_zone string, to_zone string, direction string, proto int, ports array<struct<lo:int,hi:int>>"
TRUSTED = "rule int, src string, dst string, proto string"
OUIS = "prefix string, vendor string"
#: The order of packets: every first, last and previous is by it.
ORDER = ("ts", "pkt_id")
EXTERNAL = "EXTERNAL"
LEVEL_RANK = {"L0": 0, "L1": 1, "L2": 2, "L3": 3, "IDMZ": 4, "L4": 5, "L5": 6}
SEVERITY_RANK = {"info": 0, "medium": 1, "high": 2, "critical": 3}
