"""Asset inventory, capture quality and draft zones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import net

#: A small start; users bring the registry as a table (prefix, vendor).
SEED_OUIS = [
    ("00:1B:1B", "Siemens"), ("00:0E:8C", "Siemens"), ("00:00:BC", "Rockwell/Allen-Bradley"), ("00:80:F4", "Schneider Electric"), ("00:60:35", "Dallas Semiconductor"),
    ("00:30:DE", "WAGO"), ("00:01:05", "Beckhoff"), ("00:80:63", "Hirschmann"), ("00:90:E8", "Moxa"), ("00:00:0C", "Cisco"),
]
#: Vendors of controllers and of network equipment, and industrial protocols.
PLC_VENDORS = ("Siemens", "Rockwell/Allen-Bradley", "Schneider Electric", "ABB", "GE", "Mitsubishi", "Omron", "B&R Industrial Automation", "Beckhoff", "WAGO")
NETWORK_VENDORS = ("Cisco", "Hirschmann", "Moxa")
ICS_PROTOCOLS = ("modbus", "enip", "s7comm", "dnp3", "opcua", "bacnet", "fox-niagara")


def oui_table(spark: SparkSession, rows=None) -> DataFrame:
    return spark.createDataFrame(rows or SEED_OUIS, "prefix string, vendor string")


def role(protocols: Column, vendor: Column) -> Column:
    """The role a host's protocols and vendor suggest; the first rule that holds."""
    speaks = lambda *names: F.arrays_overlap(protocols, F.array(*map(F.lit, names)))
    ics = F.array(*map(F.lit, ICS_PROTOCOLS))
    only = (F.size(protocols) > 0) & (F.size(F.array_except(protocols, ics)) == 0)
    plc_vendor = F.coalesce(vendor.isin(*PLC_VENDORS), F.lit(False))
    return (
        F.when(speaks("s7comm", "enip", "dnp3") | (speaks("modbus") & plc_vendor) | only, "plc")
        .when(speaks("modbus") & speaks("http", "rdp", "smb"), "hmi")
        .when(speaks("smb", "rdp", "netbios") & speaks("modbus", "enip", "s7comm"), "engineering_workstation")
        .when(speaks("modbus") & speaks("https"), "historian")
        .when(F.coalesce(vendor.isin(*NETWORK_VENDORS), F.lit(False)), "network_infra")
        .when(speaks("smb", "rdp", "netbios", "https"), "it_endpoint")
        .otherwise("unknown")
    )


def assets(hosts: DataFrame, ouis: DataFrame, hostnames: DataFrame | None = None) -> DataFrame:
    """hosts with vendor, role, hostname and label. ouis is a vendor registry (tens of thousands of rows)."""
    out = hosts.join(F.broadcast(ouis.select("prefix", "vendor")), F.substring("mac", 1, 8) == F.col("prefix"), "left").drop("prefix")
    out = out.join(hostnames.select("ip", F.col("name").alias("hostname")), "ip", "left") if hostnames is not None else out.withColumn("hostname", F.lit(None).cast("string"))
    label = F.when(F.col("hostname").isNotNull(), F.concat("hostname", F.lit(" ("), "ip", F.lit(")"))).otherwise(F.col("ip"))
    return out.withColumn("role", role(F.col("protocols"), F.col("vendor"))).withColumn("host_label", label)


def top_assets(asset_table: DataFrame, n: int = 100) -> DataFrame:
    """The n assets with most packets, ties by address."""
    return asset_table.orderBy(F.desc("packets"), F.coalesce(net.ip_num(F.col("ip")), F.lit(1 << 33)), "ip").limit(n)


def omitted_assets(asset_table: DataFrame, n: int = 100) -> DataFrame:
    """One row: assets, those that top_assets shows and those that it leaves out."""
    out = asset_table.agg(F.count("*").alias("assets"))
    shown = F.least(F.col("assets"), F.lit(n).cast("long"))
    return out.withColumns({"shown": shown, "omitted": F.col("assets") - shown})


def capture_sanity(totals: DataFrame, steps: DataFrame) -> DataFrame:
    """epoch_zero (no second after the epoch), else sub_second (two packets or more in under a second); non_monotonic.

    steps: one row of observe.steps_back, or none without packets.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    epoch = F.coalesce(F.floor(micros("max_ts") / 1_000_000) <= 0, F.lit(False))
    short = F.coalesce(~epoch & (F.col("packets") >= 2) & (micros("max_ts") - micros("min_ts") < 1_000_000), F.lit(False))
    back = steps.agg(F.coalesce(F.sum("steps"), F.lit(0)).alias("steps"))
    return totals.crossJoin(back).select("packets", epoch.alias("epoch_zero"), short.alias("sub_second"), (F.col("steps") > 0).alias("non_monotonic"))  # one row each


def map_coverage(host_table: DataFrame, scrub_map: DataFrame) -> DataFrame:
    """One row: hosts, those whose address a map holds, their share, and whether it is so low that the map may be of another capture."""
    known = scrub_map.select(F.col("real").alias("ip")).distinct().withColumn("mapped", F.lit(1))
    out = host_table.select("ip").join(known, "ip", "left").agg(F.count("*").alias("hosts"), F.count("mapped").alias("mapped"))
    share = F.when(F.col("hosts") > 0, F.col("mapped") / F.col("hosts"))
    return out.withColumns({"share": F.round(share, 6), "low": F.coalesce(share < 0.5, F.lit(False))})


def capture_source(mac_frames: DataFrame, totals: DataFrame, declared: str | None = None) -> DataFrame:
    """One row: source (tap, host_side, span, ambiguous), confidence, distinct_macs, top_share; conflict with a declared source.

    Only the three largest MACs and a count are gathered.
    """
    top = mac_frames.orderBy(F.desc("frames"), "mac").limit(3).agg(F.sort_array(F.collect_list("frames"), asc=False).alias("top"))
    rows = totals.select("packets", "broadcast_frames").crossJoin(top).crossJoin(mac_frames.agg(F.count("*").alias("distinct_macs")))  # one row each
    share = [F.coalesce(F.get("top", k) / F.col("packets"), F.lit(0.0)) for k in range(3)]
    tap = (F.col("distinct_macs") >= 2) & (share[0] >= 0.95) & (share[1] >= 0.95) & (share[2] < 0.10)
    near = (F.col("distinct_macs") >= 1) & (share[1] < 0.30)
    span = (F.col("distinct_macs") >= 10) & (share[0] < 0.60) & (F.col("broadcast_frames") > 0)
    some = F.col("packets") > 0
    source = F.when(~some, "ambiguous").when(tap, "tap").when(near & (share[0] >= 0.80), "host_side").when(span, "span").otherwise("ambiguous")
    sure = F.when(F.col("packets") >= 1000, "high").otherwise("medium")
    confidence = F.when(F.col("source") == "ambiguous", "low").when((F.col("source") == "host_side") & (F.col("top_share") < 0.95), "medium").otherwise(sure)
    out = rows.select("packets", "distinct_macs", F.round(share[0], 6).alias("top_share"), source.alias("source")).withColumn("confidence", confidence)
    return out.withColumn("conflict", F.lit(declared is not None) & (F.col("source") != "ambiguous") & (F.col("source") != F.lit(declared or "")))


def suggest_zones(asset_table: DataFrame) -> DataFrame:
    """A zone per subnet: the level most of its assets have (ties to the lower), and a text of its roles."""
    rows = asset_table.select(net.subnet_of(F.col("ip")).alias("cidr"), "role", net.role_level(F.col("role")).alias("level"))
    by_role = rows.groupBy("cidr", "level", "role").agg(F.count("*").alias("n"))
    by_level = by_role.groupBy("cidr", "level").agg(F.sum("n").alias("n"), F.collect_list(F.struct("n", "role")).alias("roles"))
    most = by_level.groupBy("cidr").agg(F.min_by("level", F.struct(-F.col("n"), F.col("level"))).alias("level"), F.sum("n").alias("assets"), F.flatten(F.collect_list("roles")).alias("roles"))
    ordered = F.array_sort(F.transform("roles", lambda r: F.struct((-r["n"]).alias("n"), r["role"].alias("role"))))
    text = F.array_join(F.transform(ordered, lambda r: F.concat((-r["n"]).cast("string"), F.lit(" "), r["role"])), ", ")
    return most.select(net.zone_slug(F.col("cidr")).alias("zone"), "cidr", "level", "assets", text.alias("roles"))
