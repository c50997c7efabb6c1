"""Streaming forms of the aggregates; extensions, since captures are bounded."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..functions import net
from ..operators import conformance, extract


def read_packets(spark: SparkSession, path: str, schema: T.StructType, files_at_once: int = 100) -> DataFrame:
    """A packet stream of a folder that rotated captures are written to as Parquet."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def windowed_flows(packets: DataFrame, length: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Flows by window of event time; state is dropped when the watermark passes."""
    rows = packets.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    window = F.window("ts", length, slide or length)
    return rows.groupBy(window, "src_ip", "dst_ip", "dst_port", "proto").agg(F.count("*").alias("packets"), F.sum("payload_len").alias("bytes"))


def windowed_scans(packets: DataFrame, length: str = "5 minutes", late: str = "10 minutes", least: int = 10) -> DataFrame:
    """Sources with about so many destinations or ports in a window, by mergeable sketches."""
    rows = packets.withColumn("ts", F.col("ts").cast("timestamp")).where(~net.is_group_address(F.col("dst_ip"))).withWatermark("ts", late)
    out = rows.groupBy(F.window("ts", length), "src_ip").agg(F.approx_count_distinct("dst_ip", 0.02).alias("hosts"), F.approx_count_distinct(F.struct("dst_port", "proto"), 0.02).alias("ports"))
    return out.where((F.col("hosts") >= least) | (F.col("ports") >= least))


def scan_sketches(packets: DataFrame, length: str = "5 minutes", late: str = "10 minutes", bits: int = 12) -> DataFrame:
    """window, src_ip, packets, hosts and ports: sketches of the destinations and the (port, protocol) of a source.

    Written as a table, sketches of any windows, captures and sensors merge in scans_of_sketches; each has 2^bits registers at
    most, whatever a source reaches.
    """
    rows = packets.withColumn("ts", F.col("ts").cast("timestamp")).where(~net.is_group_address(F.col("dst_ip"))).withWatermark("ts", late)
    port = F.concat_ws("/", F.col("dst_port").cast("string"), F.col("proto").cast("string"))
    return rows.groupBy(F.window("ts", length), "src_ip").agg(F.count("*").alias("packets"), F.hll_sketch_agg("dst_ip", bits).alias("hosts"), F.hll_sketch_agg(port, bits).alias("ports"))


def scans_of_sketches(sketches: DataFrame, least: int = 10, by: tuple[str, ...] = ("src_ip",)) -> DataFrame:
    """by, packets, hosts and ports of what reaches about so many destinations or ports over all the sketches given.

    Slow scans, below the bound in every window, are found. The relative error is 1.04 / sqrt(2^bits), 1.6 per cent at 12 bits.
    """
    told = lambda c: F.hll_sketch_estimate(F.hll_union_agg(c)).alias(c)
    return sketches.groupBy(*by).agg(F.sum("packets").alias("packets"), told("hosts"), told("ports")).where((F.col("hosts") >= least) | (F.col("ports") >= least))


def unit_sketches(packets: DataFrame, length: str = "5 minutes", late: str = "10 minutes", bits: int = 9) -> DataFrame:
    """window, src_ip, dst_ip, requests and units: sketches of the Modbus unit ids that a source asks for."""
    rows = extract.marks(packets, ("units",)).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", length), "src_ip", "dst_ip").agg(F.count("*").alias("requests"), F.hll_sketch_agg("code", bits).alias("units"))


def sweeps_of_sketches(sketches: DataFrame, least: int = 5) -> DataFrame:
    """src_ip, dst_ip, requests and units of pairs with about so many units over all the sketches given; up to 256 ids, so nearly exact."""
    out = sketches.groupBy("src_ip", "dst_ip").agg(F.sum("requests").alias("requests"), F.hll_sketch_estimate(F.hll_union_agg("units")).alias("units"))
    return out.where(F.col("units") >= least)


def host_sessions(packets: DataFrame, gap: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    rows = packets.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(F.session_window("ts", gap), "src_ip").agg(F.count("*").alias("packets"), F.sum("payload_len").alias("bytes"))


def first_credentials(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """A credential event once per (source, destination, port, kind) within the watermark."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.dropDuplicatesWithinWatermark(["src_ip", "dst_ip", "dst_port", "kind"])


def windowed_verdicts(packets: DataFrame, policy: conformance.Policy, length: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Flows by window with their verdicts; the policy is joined as static tables of its own size."""
    return conformance.verdicts(windowed_flows(packets, length, late=late), policy)


def starttls_binds(packets: DataFrame, idle: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """extract.ldap_binds of a stream: whether a StartTLS reply was seen is kept for each connection until it is idle so long in event time.

    Rows of a batch are taken in the order of ts and pkt_id; a reply that comes in a later batch than a
    bind does not change it.
    """
    end = lambda c: F.concat_ws(" ", F.col(c)["ip"], F.col(c)["port"].cast("string"))
    marks = extract.ldap_marks(packets).withColumns({"client": end("client"), "server": end("server"), "ts": F.col("ts").cast("timestamp")})
    marks = marks.withColumn("millis", F.unix_millis("ts")).withWatermark("ts", late)
    out = T.StructType([*(f for f in marks.schema if f.name not in ("client", "server", "reply", "bind", "millis")), T.StructField("used_starttls", T.BooleanType())])
    wait = int(pd.Timedelta(idle).total_seconds() * 1000)

    def run(_key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        started = state.exists and state.get[0]
        rows = pd.concat(parts).sort_values(["ts", "pkt_id"])
        seen = rows["reply"].cummax() | started
        rows["used_starttls"] = seen.shift(fill_value=started).astype(bool)
        state.update((bool(seen.iloc[-1]),))
        state.setTimeoutTimestamp(int(rows["millis"].max()) + wait)
        yield rows.loc[rows["bind"], out.names]

    return marks.groupBy("client", "server").applyInPandasWithState(run, out, "started boolean", "append", "EventTimeTimeout")


class SettledBinds(StatefulProcessor):
    """Marks of a connection wait until the watermark has passed them and are then taken in order; names are the columns of a bind."""

    def __init__(self, names: list[str], kept: T.StructType, wait: int) -> None:
        self.names, self.kept, self.wait = names, kept, wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", self.kept)
        self.settled = handle.getValueState("settled", "started boolean, last long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        times = set()
        for some in iter(lambda: list(itertools.islice(rows, 10_000)), []):
            self.pending.appendList([tuple(r[n] for n in self.kept.names) for r in some])
            times |= {r["at"] // 1_000_000 for r in some}
        for second in times:  # a timer a second, however many marks
            self.handle.registerTimer((second + 1) * 1000)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        kept = self.kept.names
        at, number, reply, bind = (kept.index(n) for n in ("at", "pkt_id", "reply", "bind"))
        rows = [tuple(r) for r in self.pending.get()]
        due = sorted((r for r in rows if r[at] < now), key=lambda r: (r[at], r[number]))
        started, last = self.settled.get() if self.settled.exists() else (False, None)
        for r in due:
            if last is not None and r[at] - last > self.wait:
                started = False
            if r[bind]:
                yield Row(**{n: r[kept.index(n)] for n in self.names}, used_starttls=bool(started))
            started, last = started or r[reply], r[at]
        if due:
            self.pending.put(rest) if (rest := [r for r in rows if r[at] >= now]) else self.pending.clear()
            self.settled.update((bool(started), last))
            self.handle.registerTimer((last + self.wait) // 1000 + 1)
        elif not rows and last is not None and last + self.wait < now:
            self.settled.clear()

    def close(self) -> None:
        pass


def settled_binds(packets: DataFrame, idle: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """extract.ldap_binds of a stream, each told once the watermark has passed it, so that a reply in a later batch counts for the binds after it.

    A connection starts anew after so long without a reply or bind, whatever the batches. State is a list of what the
    watermark has not passed and a flag, and goes when the connection is idle. Needs the RocksDB state store:
    spark.sql.streaming.stateStore.providerClass.
    """
    end = lambda c: F.concat_ws(" ", F.col(c)["ip"], F.col(c)["port"].cast("string"))
    marks = extract.ldap_marks(packets).where("reply OR bind").withColumns({"client": end("client"), "server": end("server"), "ts": F.col("ts").cast("timestamp")})
    marks = marks.withWatermark("ts", late).withColumn("at", F.unix_micros("ts"))
    kept = T.StructType([f for f in marks.schema if f.name not in ("client", "server", "ts")])
    names = [n for n in kept.names if n not in ("reply", "bind")]
    out = T.StructType([*(kept[n] for n in names), T.StructField("used_starttls", T.BooleanType())])
    found = marks.groupBy("client", "server").transformWithState(SettledBinds(names, kept, int(pd.Timedelta(idle).total_seconds() * 1_000_000)), out, "append", "EventTime")
    return found.select(F.timestamp_micros("at").alias("ts"), *(n for n in out.names if n != "at"))


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Process all that is there, once, and stop; a rerun goes on from the checkpoint."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start()
    query.awaitTermination()
