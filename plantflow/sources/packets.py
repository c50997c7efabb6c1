"""Packet tables: as stored, or derived from the order tables for tests and benchmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import PACKETS
from .staging import staged

_WIRE = [
    (6, 502, "0001000000060103006B0003"), (6, 502, "000100000006010500010000"), (6, 502, "000100000006010800040000"),
    (6, 44818, "6F0010000000000000000000000000000000000000000000000000000000020000000000B20002000520"),
    (6, 102, "0300001902F08032010000000100080000F00001000101E000"), (6, 102, "0300001902F08032010000000100080000290001000101E000"),
    (6, 20000, "056408C40A000100FFFFC0C005"), (17, 20000, "056408C40A000100FFFFC0C001"), (6, 21, "5553455220616E6F6E796D6F75730D0A"), (6, 23, "6C6F67696E3A20"),
    (6, 80, "474554202F20485454502F312E310D0A417574686F72697A6174696F6E3A204261736963205957527461573436595752746157343D0D0A"), (17, 161, "302602010104067075626C6963A019"),
    (6, 445, "00000040FF534D4272000000"),
    (6, 443, "16030100310100002D030100000000000000000000000000000000000000000000000000000000000000000000040005003501000000"),
    (6, 389, "3012020101600D0201030404636E3D6180027077"), (6, 3389, "030000130ED000001234000200080000000000"), (17, 53, ""), (17, 123, ""), (6, 5938, ""), (6, 50001, ""),
]


#: Negotiations of NTLM, by their flags: version 1, and version 2.
_NTLM = ["000000404E544C4D535350000100000000020000", "000000404E544C4D535350000100000000020800"]


#: Type of pkt_id where ids leave 64 bits: no id of 64-bit order keys is longer.
WIDE = T.DecimalType(38, 0)


def derived_sql(lineitem: str = "lineitem", orders: str = "orders", wide: bool = False) -> str:
    """SQL of a packet relation over the order tables; the same text runs on Spark and on DuckDB. wide: ids are decimals, which no sum overflows."""
    key = f"CAST({{}} AS {WIDE.simpleString()})" if wide else "{}"
    wire = ", ".join(f"({k}, {p}, {d}, '{h}')" for k, (p, d, h) in enumerate(_WIRE))
    return f"""
WITH wire(k, proto, dst_port, payload_hex) AS (VALUES {wire}), base AS (
 SELECT l.l_orderkey AS ok, l.l_linenumber AS ln, l.l_partkey AS pk, l.l_suppkey AS sk, o.o_custkey AS ck, l.l_shipdate AS ts, CAST(l.l_quantity AS BIGINT) AS q,
        CASE WHEN o.o_custkey % 7 = 0 THEN l.l_suppkey ELSE o.o_custkey % 5 + l.l_linenumber % 3 END AS dk,
        CASE WHEN o.o_custkey % 11 = 0 THEN l.l_partkey % 20 ELSE (o.o_custkey + l.l_linenumber % 3) % 20 END AS wk
 FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey
), fwd AS (
 SELECT b.ok AS ok, b.wk AS wk, (({key.format('b.ok')} * 10 + b.ln) * 1000000 + b.pk) * 10000 + b.sk AS pkt_id, b.ts,
  concat(CASE b.ck % 3 WHEN 0 THEN '00:1B:1B' WHEN 1 THEN '00:00:BC' ELSE 'AA:BB:CC' END, ':00:', lpad(hex(b.ck % 256), 2, '0'), ':', lpad(hex(b.ck % 200), 2, '0')) AS src_mac,
  CASE WHEN b.dk % 17 = 0 THEN 'FF:FF:FF:FF:FF:FF' ELSE concat('00:0E:8C:01:00:', lpad(hex(b.dk % 256), 2, '0')) END AS dst_mac,
  CASE WHEN b.ck % 20 = 0 THEN concat('172.32.', cast(b.ck % 4 as varchar(10)), '.', cast(b.ck % 200 + 1 as varchar(10)))
       ELSE concat('10.10.', cast(b.ck % 8 as varchar(10)), '.', cast(b.ck % 250 + 1 as varchar(10))) END AS src_ip,
  CASE WHEN b.dk % 17 = 0 THEN '239.1.1.1' WHEN b.dk % 13 = 5 THEN concat('8.8.0.', cast(b.dk % 250 + 1 as varchar(10)))
       ELSE concat('10.20.', cast(b.dk % 4 as varchar(10)), '.', cast(b.dk % 250 + 1 as varchar(10))) END AS dst_ip,
  w.proto, 49152 + b.ok % 16000 AS src_port, w.dst_port,
  CASE WHEN w.k = 0 AND b.ck % 3 = 0 THEN concat('000100000006', lpad(hex(b.ok % 97), 2, '0'), '03006B0003')
       WHEN w.k = 12 AND b.ok % 5 = 1 THEN '{_NTLM[0]}' WHEN w.k = 12 AND b.ok % 5 = 2 THEN '{_NTLM[1]}' ELSE w.payload_hex END AS payload_hex, b.q
 FROM base b JOIN wire w ON b.wk = w.k
), sized AS (SELECT ok, wk, pkt_id, ts, src_mac, dst_mac, src_ip, dst_ip, proto, src_port, dst_port, payload_hex, CASE WHEN payload_hex = '' THEN q ELSE cast(length(payload_hex) / 2 as bigint) END AS payload_len FROM fwd)
SELECT pkt_id, ts, src_mac, dst_mac, src_ip, dst_ip, proto, src_port, dst_port, payload_hex, payload_len FROM sized
UNION ALL
SELECT 4000000000000000000 + pkt_id, ts, dst_mac, src_mac, dst_ip, src_ip, proto, dst_port, src_port,
 CASE wk WHEN 0 THEN '0001000000050103020000' WHEN 1 THEN '000100000006010500010000' ELSE '300C02010178070A010004000400' END, CASE wk WHEN 0 THEN 11 WHEN 1 THEN 12 ELSE 14 END
FROM sized WHERE ok % 3 = 0 AND wk IN (0, 1, 14) AND dst_ip <> '239.1.1.1'
UNION ALL
SELECT 5000000000000000000 + {key.format('o_orderkey')}, o_orderdate, concat('AA:BB:CC:00:01:', lpad(hex(o_custkey % 256), 2, '0')), 'FF:FF:FF:FF:FF:FF', src_ip, '239.1.1.1', 17, port, port, payload_hex, cast(length(payload_hex) / 2 as bigint)
FROM (SELECT *, CASE port
  WHEN 5353 THEN concat('00008400000000010000000008', hex(name), '056C6F63616C0000018001000000780004', ip_hex)
  WHEN 5355 THEN concat('0000', CASE WHEN o_orderkey % 16 = 1 THEN '0000' ELSE '8000' END, '000100010000000008', hex(name), '000001000108', hex(name), '0000010001000000780004', ip_hex)
  WHEN 67 THEN concat(repeat('00', 16), ip_hex, repeat('00', 216), '638253630C08', hex(name), 'FF')
  ELSE concat('00002910000100000000000120', hex(translate(concat(hex(rpad(name, 15, ' ')), '00'), '0123456789ABCDEF', 'ABCDEFGHIJKLMNOP')), '0000200001') END AS payload_hex
 FROM (SELECT o_orderkey, o_orderdate, o_custkey, concat('node-', lpad(cast(o_orderkey % 1000 as varchar(10)), 3, '0')) AS name,
   concat('0A0A', lpad(hex(o_custkey % 8), 2, '0'), lpad(hex(o_custkey % 250 + 1), 2, '0')) AS ip_hex,
   concat('10.10.', cast(o_custkey % 8 as varchar(10)), '.', cast(o_custkey % 250 + 1 as varchar(10))) AS src_ip,
   CASE (o_custkey + cast(floor(o_orderkey / 8.0) as bigint)) % 4 WHEN 0 THEN 5353 WHEN 1 THEN 5355 WHEN 2 THEN 67 ELSE 137 END AS port
  FROM {orders} WHERE o_orderkey % 8 = 1) told) names
UNION ALL
SELECT -{key.format('o_orderkey')}, o_orderdate, NULL, '00:0E:8C:01:00:FF', concat('203.', cast(cast(floor(o_orderkey / 65536.0) as bigint) % 200 as varchar(10)), '.', cast(cast(floor(o_orderkey / 256.0) as bigint) % 256 as varchar(10)), '.', cast(o_orderkey % 256 as varchar(10))),
 '10.20.1.200', 6, 1024 + o_orderkey % 30000, 50001, '', 0
FROM {orders} WHERE o_orderkey % 10 = 0
"""


def _ids_fit(lineitem: DataFrame, orders: DataFrame) -> bool:
    """Whether the largest keys are too small for any id to leave 64 bits."""
    largest = lambda df, *names: [int(v or 0) for v in df.agg(*(F.max(F.abs(F.col(n).cast(WIDE))).alias(n) for n in names)).first()]
    order, line, part, supplier = largest(lineitem, "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    told = largest(orders, "o_orderkey")[0]
    return max(4 * 10**18 + ((order * 10 + line) * 10**6 + part) * 10**4 + supplier, 5 * 10**18 + told) < 2**63


def derived_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets derived from lineitem and orders by a fixed rule, one or two for each line, and host names told for some orders.

    pkt_id is a long where the keys are too small for a larger id, else WIDE: its values and their order are those of the rule.
    """
    lineitem, orders = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("lineitem", "orders"))
    wide = not _ids_fit(lineitem, orders)
    made = spark.sql(derived_sql("{lineitem}", "{orders}", wide), lineitem=lineitem, orders=orders)
    return made.select(*(made[f.name].cast(WIDE if wide and f.name == "pkt_id" else f.dataType).alias(f.name) for f in PACKETS))


_tables: dict[tuple[str, str], DataFrame] = {}


def packets_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived packets as a written table, as captures are ingested once and then queried; made once a session.

    pkt_id is a long, or WIDE if there are ids of more than 64 bits.
    """
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _tables:
        made = derived_packets(spark, sf_dir)
        # even files, as many as tasks run at once or the input has parts: a join on few files would leave one
        files = max(spark.sparkContext.defaultParallelism, made.rdd.getNumPartitions())
        _tables[key] = _narrowed(staged(made.repartition(files), "packets"))
    return _tables[key]


def _narrowed(packets: DataFrame) -> DataFrame:
    """packets with pkt_id as a long if all ids are."""
    if packets.schema["pkt_id"].dataType != WIDE:
        return packets
    least, most = packets.agg(F.min("pkt_id"), F.max("pkt_id")).first()
    fits = least is None or -(2**63) <= least and most < 2**63
    return packets.withColumn("pkt_id", F.col("pkt_id").cast("long")) if fits else packets


def forget_packets(spark: SparkSession) -> None:
    """Derive packets anew from now on, as their input has changed; tables already written stay where they are."""
    for key in [k for k in _tables if k[0] == spark.sparkContext.applicationId]:
        del _tables[key]
