import datetime

import pytest

from plantflow.operators import extract
from plantflow.schemas import PACKETS
from plantflow.streaming import windows

BIND, REPLY = "3012020101600D0201030404636E3D6180027077", "300C02010178070A010004000400"


def packet(k, second, reply=False, client="10.0.0.1"):
    ts = datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=second)
    ends = ("10.0.0.9", client, 389, 4000) if reply else (client, "10.0.0.9", 4000, 389)
    payload = REPLY if reply else BIND
    row = {"pkt_id": k, "ts": ts, "src_mac": None, "dst_mac": None, "src_ip": ends[0], "dst_ip": ends[1], "proto": 6, "src_port": ends[2], "dst_port": ends[3], "payload_hex": payload, "payload_len": len(payload) // 2}
    return tuple(row[f.name] for f in PACKETS)


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(name)


def test_late_replies_idle_connections_and_a_restart(rocks, tmp_path):
    """A reply that comes a batch after a later bind counts; an idle connection starts anew; a restart goes on from its state."""
    spark, got = rocks, []
    batches = [
        [packet(1, 0), packet(3, 20), packet(4, 30, client="10.0.0.2")],
        [packet(2, 10, reply=True)],  # before packet 3, a batch later
        [packet(5, 1200)],  # of the same connection, within the hour
        [packet(6, 9000)],  # after more than an hour
        [packet(7, 20000, client="10.0.0.3")],
    ]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, PACKETS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = windows.settled_binds(windows.read_packets(spark, str(tmp_path / "in"), PACKETS, 1))
        windows.run_available(stream, lambda df, _: got.extend(df.collect()), str(tmp_path / "state"))
        if k == 1:
            assert got == []  # the watermark has passed none of them
    assert sorted((r.pkt_id, r.used_starttls) for r in got) == [(1, False), (3, True), (4, False), (5, True), (6, False)]
    assert {r.pkt_id: r.ts for r in got}[3] == datetime.datetime(2024, 1, 1, 0, 0, 20) and all(r.version == 3 for r in got)


def test_streams_without_idle_connections_tell_what_tables_tell(rocks, tmp_path):
    rows = [packet(k, (k * 37) % 1500, reply=k % 11 == 3, client=f"10.0.0.{k % 5 + 1}") for k in range(200)]
    table = rocks.createDataFrame(rows, PACKETS)
    want = sorted((r.pkt_id, r.used_starttls) for r in extract.ldap_binds(table).collect())
    got = []
    for part in (rows[:90], rows[90:], [packet(999, 50000, client="10.0.9.9")]):
        rocks.createDataFrame(part, PACKETS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = windows.settled_binds(windows.read_packets(rocks, str(tmp_path / "in"), PACKETS, 1), late="1 hour")
        windows.run_available(stream, lambda df, _: got.extend(df.collect()), str(tmp_path / "state"))
    assert sorted((r.pkt_id, r.used_starttls) for r in got) == want and len({u for _, u in want}) == 2
