"""Packet captures (classic and next-generation formats) as tables and streams.

read_captures yields the packet table with capture_id and capture_seq. Files are cut into spans of bytes, a task
each: every task looks for a record near the begin of its span and follows the headers from there. A span is right if
it starts where the one before it ended; spans that are not are followed again from there, so the rows are those of one
reader whatever the payloads hold. spark.read.format("captures") reads each file in one task, without a job before.
Captures are meant to be ingested once into Parquet. Only Ethernet is decoded; frames that are not IP are dropped, and IP that is neither TCP nor
UDP has protocol 0, no ports and no payload.
"""

from __future__ import annotations

import datetime
import itertools
import os
import re
import struct
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from ..schemas import PACKETS
from .staging import staged

ETHERNET = 1
#: Link type, units a second and most bytes of packets whose interface no block declares.
UNDECLARED = (ETHERNET, 1_000_000, 0)
SCHEMA = T.StructType([*PACKETS.fields, T.StructField("capture_id", T.StringType()), T.StructField("capture_seq", T.IntegerType())])
_BATCH = 4096
#: First bytes of the classic format with byte order and units a second, of the format of blocks; kinds of blocks; where records start.
CLASSIC = {b"\xd4\xc3\xb2\xa1": ("<", 10**6), b"\xa1\xb2\xc3\xd4": (">", 10**6), b"\x4d\x3c\xb2\xa1": ("<", 10**9), b"\xa1\xb2\x3c\x4d": (">", 10**9)}
BLOCKS = b"\x0a\x0d\x0d\x0a"
SECTION, INTERFACE = 0x0A0D0D0A, 1
FIRST_RECORD = 24
#: Bytes of a span, headers that make a guessed record, and most bytes that a record is guessed to have.
SPAN, SURE, LONGEST = 128 << 20, 4, 1 << 18


class CaptureError(ValueError):
    """A capture that cannot be read; the message names the file."""


def _exactly(f, size: int) -> bytes:
    data = f.read(size) if size >= 0 else b""
    if size < 0 or len(data) < size:
        raise CaptureError(f"{f.name}: truncated or damaged file")
    return data


@dataclass(frozen=True)
class Span:
    """Records of a file from byte start to before byte end; known are the places of the blocks before it that it depends on."""

    start: int | None = None
    end: float = float("inf")
    known: tuple[int, ...] = ()


def _classic(f, order: str, per_second: int, span: Span) -> Iterator[tuple[int, int, bytes]]:
    """link type, microseconds and frame of each record."""
    link = struct.unpack(order + "HHiIII", _exactly(f, 20))[5]
    at = FIRST_RECORD if span.start is None else span.start
    f.seek(at)
    while at < span.end and (head := f.read(16)):
        seconds, part, size, _ = struct.unpack(order + "IIII", head + _exactly(f, 16 - len(head)))
        yield link, seconds * 1_000_000 + part * 1_000_000 // per_second, _exactly(f, size)
        at += 16 + size


def _options(data: bytes, order: str) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at + 4 <= len(data):
        code, size = struct.unpack_from(order + "HH", data, at)
        if code == 0:
            return
        yield code, data[at + 4 : at + 4 + size]
        at += 4 + size + (-size) % 4


def _block(f, order: str, skip: bool = False) -> tuple[int, str, int, bytes] | None:
    """Kind, byte order, whole size and body (none if skipped) of the block that f is at; None at the end. Sections have their own byte order."""
    if not (head := f.read(8)):
        return None
    head += _exactly(f, 8 - len(head))
    kind, body = struct.unpack(order + "I", head[:4])[0], b""
    if kind == SECTION:
        order, at = "<" if _exactly(f, 4) == b"\x4d\x3c\x2b\x1a" else ">", 12
    else:
        at = 8
    size = struct.unpack(order + "I", head[4:])[0]
    if size < 12:
        raise CaptureError(f"{f.name}: truncated or damaged file")
    if skip:
        f.seek(size - at, os.SEEK_CUR)
    else:
        rest = _exactly(f, size - at)
        body = rest[:-4] if at == 8 else b""
    return kind, order, size, body


def _blocks(f, span: Span) -> Iterator[tuple[int, int, bytes]]:
    """The same of a file of blocks; every section has its own byte order and interfaces."""
    order, links = "<", []
    for at in (*span.known, None):
        f.seek((span.start or 0) if at is None else at)
        while (at is not None or f.tell() < span.end) and (block := _block(f, order)):
            kind, order, _, body = block
            if kind == SECTION:
                links = []
            elif kind == INTERFACE and len(body) >= 8:
                unit = 1_000_000
                for code, value in _options(body[8:], order):
                    if code == 9 and value:
                        unit = 2 ** (value[0] & 0x7F) if value[0] & 0x80 else 10 ** value[0]
                links.append((struct.unpack_from(order + "H", body)[0], unit, struct.unpack_from(order + "I", body, 4)[0]))
            elif kind == 6 and len(body) >= 20:
                which, high, low, kept, _ = struct.unpack_from(order + "IIIII", body)
                link, unit, _ = links[which] if which < len(links) else UNDECLARED
                yield link, ((high << 32) | low) * 1_000_000 // unit, body[20 : 20 + kept]
            elif kind == 3 and len(body) >= 4:  # a simple packet has no time
                link, _, most = links[0] if links else UNDECLARED
                kept = struct.unpack_from(order + "I", body)[0]
                yield link, 0, body[4 : 4 + (min(kept, most) if most else kept)]
            if at is not None:
                break


def records(path: str, span: Span = Span()) -> Iterator[tuple[int, int, bytes]]:
    with open(path, "rb") as f:
        magic = f.read(4)
        if magic in CLASSIC:
            yield from _classic(f, *CLASSIC[magic], span)
        elif magic == BLOCKS:
            yield from _blocks(f, span)
        else:
            raise CaptureError(f"{path}: not a packet capture")


def _guessed(f, begin: int, end: int, magic: bytes, order: str, per_second: int) -> int | None:
    """The first place from begin to end where SURE headers follow each other, as it seems; sought as far as one record goes."""
    f.seek(begin)
    data = f.read((SURE + 1) * (LONGEST + 32))
    size = os.fstat(f.fileno()).st_size - begin

    def next_(at: int) -> int | None:
        if magic == BLOCKS:
            if at + 8 > len(data):
                return None
            whole = struct.unpack_from(order + "I", data, at + 4)[0]
            after = at + whole
            fine = whole >= 12 and whole % 4 == 0 and after <= len(data) and data[after - 4 : after] == data[at + 4 : at + 8]
        else:
            if at + 16 > len(data):
                return None
            _, part, kept, long = struct.unpack_from(order + "IIII", data, at)
            after = at + 16 + kept
            fine = part < per_second and 0 < kept <= min(long, LONGEST) and long <= LONGEST
        return after if fine else None

    step = 4 if magic == BLOCKS else 1
    for at in range(-begin % step, min(end - begin, LONGEST + 32, len(data)), step):
        place: int | None = at
        for _ in range(SURE):
            place = next_(place)
            if place is None or place >= min(size, len(data)):
                break
        if place is not None and place <= size:
            return begin + at
    return None


def follow(path: str, begin: int, end: int, start: int | None = None) -> tuple[int | None, int | None, int, list[int]]:
    """Where the first record of a span of bytes starts (sought if not given) and the first after it, records between, and blocks that later ones depend on.

    A damaged file ends at the damage for all spans but the one that holds it.
    """
    with open(path, "rb") as f:
        size, magic = os.fstat(f.fileno()).st_size, f.read(4)
        if magic not in CLASSIC and magic != BLOCKS:
            return begin if start is None else start, size, 0, []
        if magic in CLASSIC:
            order, per_second = CLASSIC[magic]
        else:
            f.seek(8)
            order, per_second = "<" if f.read(4) == b"\x4d\x3c\x2b\x1a" else ">", 0
        if start is None:
            start = (FIRST_RECORD if magic in CLASSIC else 0) if begin == 0 else _guessed(f, begin, end, magic, order, per_second)
            if start is None:
                return None, None, 0, []
        at, n, known = start, 0, []
        try:
            while at < min(end, size):
                f.seek(at)
                if magic in CLASSIC:
                    after = at + 16 + struct.unpack(order + "IIII", _exactly(f, 16))[2]
                    n += 1
                else:
                    kind, order, whole, _ = _block(f, order, skip=True)
                    after = at + whole
                    known += [at] if kind in (SECTION, INTERFACE) else []
                    n += (kind == 6 and whole >= 32) or (kind == 3 and whole >= 16)
                at = after
        except CaptureError:
            return start, size, n, known
        return start, min(at, size), n, known


def decode(frame: bytes) -> tuple | None:
    """src_mac, dst_mac, src_ip, dst_ip, proto, src_port, dst_port, payload of an Ethernet frame; None if it holds no IP."""
    import ipaddress

    if len(frame) < 14:
        return None
    kind, at = struct.unpack_from(">H", frame, 12)[0], 14
    while kind in (0x8100, 0x88A8) and len(frame) >= at + 4:
        kind, at = struct.unpack_from(">H", frame, at + 2)[0], at + 4
    if kind == 0x0800 and len(frame) >= at + 20:
        start, end = at + 4 * (frame[at] & 15), at + struct.unpack_from(">H", frame, at + 2)[0]
        proto, source, target = frame[at + 9], frame[at + 12 : at + 16], frame[at + 16 : at + 20]
        whole = struct.unpack_from(">H", frame, at + 6)[0] & 0x1FFF == 0
    elif kind == 0x86DD and len(frame) >= at + 40:
        start, end = at + 40, at + 40 + struct.unpack_from(">H", frame, at + 4)[0]
        proto, source, target, whole = frame[at + 6], frame[at + 8 : at + 24], frame[at + 24 : at + 40], True
    else:
        return None
    body = frame[start : max(start, end)]
    ports, payload = (0, 0), b""
    if whole and proto == 6 and len(body) >= 20:
        ports, payload = struct.unpack_from(">HH", body), body[4 * (body[12] >> 4) :]
    elif whole and proto == 17 and len(body) >= 8:
        ports, payload = struct.unpack_from(">HH", body), body[8:]
    else:
        proto = 0
    macs = [m.hex(":").upper() if any(m) else None for m in (frame[6:12], frame[:6])]
    return (*macs, str(ipaddress.ip_address(source)), str(ipaddress.ip_address(target)), proto, *ports, payload)


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def packet_batches(path: str, seq: int, span: Span = Span(), first: int = 0) -> Iterator[pa.RecordBatch]:
    """Packets of a span of a file, whose records are numbered from first."""
    schema = to_arrow_schema(SCHEMA)
    start = datetime.datetime(1970, 1, 1)
    name, rows = os.path.basename(path), []
    for n, (link, micros, frame) in enumerate(records(path, span), first):
        if link != ETHERNET:
            raise CaptureError(f"{path}: link type {link} is not Ethernet")
        if (got := decode(frame)) is None:
            continue
        src_mac, dst_mac, src, dst, proto, src_port, dst_port, payload = got
        rows.append(((seq << 40) | n, start + datetime.timedelta(microseconds=micros), src_mac, dst_mac, src, dst, proto, src_port, dst_port, payload.hex().upper(), len(payload), name, seq))
        if len(rows) == _BATCH:
            yield _batch(rows, schema)
            rows = []
    if rows:
        yield _batch(rows, schema)


def capture_files(path: str) -> list[str]:
    """The files of a capture, a folder of them, or several joined by commas."""
    return [p for part in path.split(",") for p in ([part] if os.path.isfile(part) else sorted(os.path.join(part, n) for n in os.listdir(part) if not n.startswith((".", "_"))))]


class CapturePartition(InputPartition):
    def __init__(self, path: str, seq: int) -> None:
        self.path, self.seq = path, seq


class CaptureReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[CapturePartition]:
        return [CapturePartition(p, k) for k, p in enumerate(capture_files(self.path))]

    def read(self, partition: CapturePartition) -> Iterator[pa.RecordBatch]:
        return packet_batches(partition.path, partition.seq)


class CaptureStreamReader(DataSourceStreamReader):
    """Rotated captures of a folder, whose names sort by time; each file arrives once.

    An offset is the last name and how many files there are up to it, so it stays small, and a file
    that turns up later but sorts before it is an error and not lost. Files that were read may be
    deleted. Files changed within `quiet` seconds wait.
    """

    def __init__(self, path: str, quiet: float) -> None:
        self.path, self.quiet = path, quiet

    def _names(self) -> list[str]:
        return sorted(n for n in os.listdir(self.path) if not n.startswith((".", "_")))

    def initialOffset(self) -> dict:
        return {"name": "", "files": 0}

    def latestOffset(self) -> dict:
        before = time.time() - self.quiet
        names = list(itertools.takewhile(lambda n: os.path.getmtime(os.path.join(self.path, n)) <= before, self._names()))
        return {"name": names[-1], "files": len(names)} if names else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[CapturePartition]:
        names = [n for n in self._names() if n <= end["name"]]
        if (late := sum(n <= start["name"] for n in names) - start["files"]) > 0:
            raise CaptureError(f"{self.path}: {late} files came after {start['name']} but sort before it; names of rotated captures must sort by time")
        return [CapturePartition(os.path.join(self.path, n), k) for k, n in enumerate(names) if n > start["name"]]

    def read(self, partition: CapturePartition) -> Iterator[pa.RecordBatch]:
        return CaptureReader(self.path).read(partition)


class CaptureSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "captures"

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return CaptureReader(self.options["path"])

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return CaptureStreamReader(self.options["path"], float(self.options.get("quiet", 0)))


def declared_link(path: str) -> int | None:
    """The link type of a file's global header or first interface; None where packets or the end come before one, or the file cannot be read so far."""
    try:
        with open(path, "rb") as f:
            magic = f.read(4)
            if magic in (b"\xd4\xc3\xb2\xa1", b"\x4d\x3c\xb2\xa1", b"\xa1\xb2\xc3\xd4", b"\xa1\xb2\x3c\x4d"):
                return struct.unpack(("<" if magic[0] in (0xD4, 0x4D) else ">") + "I", _exactly(f, 20)[16:])[0]
            if magic != b"\x0a\x0d\x0d\x0a":
                return None
            head = _exactly(f, 8)
            order = "<" if head[4:] == b"\x4d\x3c\x2b\x1a" else ">"
            f.seek(struct.unpack(order + "I", head[:4])[0])
            while True:
                kind, size = struct.unpack(order + "II", _exactly(f, 8))
                if kind == 1:
                    return struct.unpack(order + "H", _exactly(f, 2))[0]
                if kind in (3, 6) or size < 12:
                    return None
                f.seek(size - 8, os.SEEK_CUR)
    except (OSError, CaptureError):
        return None


class HeaderReader(CaptureReader):
    """One row a file, from its first bytes."""

    def read(self, partition: CapturePartition) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([partition.seq], pa.int32()), pa.array([os.path.basename(partition.path)]), pa.array([declared_link(partition.path)], pa.int64())], names=["seq", "name", "link"])


class HeaderSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "capture_headers"

    def schema(self) -> str:
        return "seq int, name string, link long"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return HeaderReader(self.options["path"])


def capture_headers(spark: SparkSession, path: str) -> DataFrame:
    """seq, name and declared link type (null where it is not known) of each file; no packet is read."""
    spark.dataSource.register(HeaderSource)
    return spark.read.format("capture_headers").load(path)


def one_link_type(headers: DataFrame) -> DataFrame:
    """One row: true, or an error that names two files whose declared link types differ."""
    low, high = (f(F.struct("link", "name")) for f in (F.min, F.max))
    told = F.concat_ws("", F.lit("link types differ: "), low["name"], F.lit(": "), low["link"].cast("string"), F.lit(", "), high["name"], F.lit(": "), high["link"].cast("string"))
    return headers.where("link IS NOT NULL").agg(F.when(low["link"] != high["link"], F.raise_error(told).cast("boolean")).otherwise(True).alias("one"))


def check_link_types(spark: SparkSession, paths: list[str]) -> None:
    """CaptureError if the declared link types of the files differ; files that declare none are not its concern."""
    try:
        one_link_type(capture_headers(spark, ",".join(paths))).collect()  # one row
    except Exception as error:
        found = re.search(r"link types differ: [^\n]*?(?=\.? SQLSTATE|\n|$)", str(error))
        if not found:
            raise
        raise CaptureError(found[0]) from error


def _per_task(spans: DataFrame) -> DataFrame:
    """Each span in a task of its own."""
    return spans.repartitionById(max(1, spans.count()), F.col("id").cast("int"))


_SPANS = "id long, seq int, path string, begin long, end long, start long, reached long, records long, known array<long>"


def _followed(spans: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r | dict(zip(("start", "reached", "records", "known"), follow(r["path"], r["begin"], r["end"], r["start"]), strict=True)) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist(rows, schema=batch.schema)

    return _per_task(spans).mapInArrow(run, _SPANS)


def capture_spans(spark: SparkSession, path: str, size: int = SPAN) -> DataFrame:
    """id, seq, path, start, reached, first (number of its first record) and known (places of blocks before it) of each span of the files.

    A row a span meets in windows by file. Guessed spans that do not start where the one before them ends are followed
    again from there, until all do.
    """
    rows, files = [], capture_files(path)
    for seq, name in enumerate(files):
        for begin in range(0, max(1, os.path.getsize(name)), size):
            rows.append((len(rows), seq, name, begin, begin + size, None, None, None, None))
    spans = staged(_followed(spark.createDataFrame(rows, _SPANS)), "spans")
    before = Window.partitionBy("seq").orderBy("id")
    while True:
        chained = spans.withColumn("due", F.lag("reached").over(before)).withColumn("bad", (F.col("begin") > 0) & ~F.col("start").eqNullSafe(F.col("due")))
        again = chained.where("bad AND due IS NOT NULL").withColumn("start", F.col("due")).select(*spans.columns)
        if again.isEmpty():
            break
        spans = staged(chained.where("NOT bad OR due IS NULL").select(*spans.columns).unionByName(_followed(again)), "spans")
    earlier = before.rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("records").over(earlier), F.lit(0).cast("long"))
    places = F.flatten(F.collect_list("known").over(earlier))
    return spans.select("id", "seq", "path", "start", "reached", "records", first.alias("first"), places.alias("known"))


def read_captures(spark: SparkSession, path: str, span: int = SPAN) -> DataFrame:
    """Packets of a capture, a folder of them, or several joined by commas, in that order; a task reads a span of bytes of one file.

    The plan first looks at the headers of all files, a task each, and fails if their link types differ. Files that
    are longer than a span are followed once before, by their headers.
    """
    one = one_link_type(capture_headers(spark, path)).scalar()
    if all(os.path.getsize(p) <= span for p in capture_files(path)):
        spark.dataSource.register(CaptureSource)
        return spark.read.format("captures").load(path).where(one)
    spans = capture_spans(spark, path, span)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                yield from packet_batches(r["path"], r["seq"], Span(r["start"], r["reached"], tuple(r["known"])), r["first"])

    return _per_task(spans).mapInArrow(run, SCHEMA).where(one)


def stream_captures(spark: SparkSession, path: str, quiet: float = 0) -> DataFrame:
    """The packets of captures that rotate into a folder, as a stream; files changed within quiet seconds wait."""
    spark.dataSource.register(CaptureSource)
    return spark.readStream.format("captures").option("quiet", str(quiet)).load(path)
