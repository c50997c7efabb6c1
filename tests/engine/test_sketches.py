import datetime

from plantflow.schemas import PACKETS
from plantflow.streaming import windows

UNIT = "0001000000060{:X}03006B0003"


def packet(k, src, dst, port, minute, payload=""):
    ts = datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minute)
    row = {"pkt_id": k, "ts": ts, "src_mac": None, "dst_mac": None, "src_ip": src, "dst_ip": dst, "proto": 6, "src_port": 40000, "dst_port": port, "payload_hex": payload, "payload_len": len(payload) // 2}
    return tuple(row[f.name] for f in PACKETS)


def test_slow_scans_and_sweeps_across_windows_captures_and_a_restart(spark, tmp_path):
    """Four destinations a window stay below the bound; two captures and ten windows together do not."""
    slow = lambda a: [packet(a + k, "10.0.0.1", f"10.1.{k // 200}.{k % 200 + 1}", 80, (k // 4) * 6) for k in range(a, a + 400)]
    units = [packet(5000 + k, "10.0.0.2", "10.1.0.9", 502, k * 6, UNIT.format(k % 12)) for k in range(36)]
    busy = [packet(6000 + k, "10.0.0.3", "10.1.0.9", 80, k) for k in range(300)]
    folder = tmp_path / "in"
    for part in (slow(0) + units, slow(400) + busy):
        spark.createDataFrame(part, PACKETS).coalesce(1).write.mode("append").parquet(str(folder))
        for name, sketch in (("scans", windows.scan_sketches), ("units", windows.unit_sketches)):
            stream = sketch(windows.read_packets(spark, str(folder), PACKETS), late="30 days")
            sink = lambda df, _, name=name: df.write.mode("overwrite").parquet(str(tmp_path / name))
            windows.run_available(stream, sink, str(tmp_path / f"state-{name}"), "complete")
    table = spark.read.parquet(str(tmp_path / "scans"))
    assert windows.scans_of_sketches(table.where("window.start < '2024-01-01 00:20:00'"), 20).count() == 0
    found = windows.scans_of_sketches(table, 20).collect()
    assert [r.src_ip for r in found] == ["10.0.0.1"]
    assert abs(found[0].hosts - 800) < 3 * 0.0163 * 800 and found[0].ports == 1 and found[0].packets == 800
    swept = windows.sweeps_of_sketches(spark.read.parquet(str(tmp_path / "units"))).collect()
    assert [(r.src_ip, r.dst_ip, r.units, r.requests) for r in swept] == [("10.0.0.2", "10.1.0.9", 12, 36)]
    assert windows.sweeps_of_sketches(spark.read.parquet(str(tmp_path / "units")), 13).count() == 0


def test_sketches_of_tables_merge_like_one(spark):
    rows = spark.createDataFrame([packet(k, f"10.0.0.{k % 3}", f"10.1.{k % 7}.{k % 50}", k % 90, k % 60) for k in range(4000)] + [packet(9000, None, None, 80, 1)], PACKETS)
    parts = windows.scan_sketches(rows.where("pkt_id % 2 = 0")).unionByName(windows.scan_sketches(rows.where("pkt_id % 2 = 1")))
    key = lambda df: sorted((str(r.src_ip), r.packets, r.hosts, r.ports) for r in windows.scans_of_sketches(df, 10).collect())
    assert key(parts) == key(windows.scan_sketches(rows, "1 day")) != []
