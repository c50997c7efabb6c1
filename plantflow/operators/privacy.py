"""Stable pseudonyms for addresses and names in text, and leak checks before anything is written."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import net
from ..sources.staging import staged

IPV4 = r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"
IPV6 = r"\b(?:[0-9A-Fa-f]{1,4}:){2,7}[0-9A-Fa-f]{1,4}\b"
MAC = r"\b(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}\b"
#: Words begin and end by the letters of all scripts.
PSEUDONYM = r"\b(?:host|mac|name)_[0-9]+\b"


class LeakError(RuntimeError):
    """Text that was to be written still holds real values."""


def numbered(df: DataFrame, order: list, name: str = "n", start: int = 1) -> DataFrame:
    """df with dense numbers from start in the order: a range sort, a count for each range, no single task.

    The ranges are written, so that both readings see the same ones.
    """
    own = Window.partitionBy("_part").orderBy("_at")
    rows = df.withColumn("_at", F.struct(*(c if isinstance(c, Column) else F.col(c) for c in order))).repartitionByRange("_at").withColumn("_part", F.spark_partition_id())
    ranked = staged(rows.withColumn("_k", F.row_number().over(own)), "ranked")
    sizes = ranked.groupBy("_part").agg(F.count("*").alias("_size"))  # one row a range
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranked.join(F.broadcast(sizes.select("_part", before.alias("_before"))), "_part").withColumn(name, F.col("_before") + F.col("_k") + (start - 1)).drop("_at", "_part", "_k", "_before")


def build_scrub_map(values: DataFrame, prefix: str, order: list | None = None, start: int = 0) -> DataFrame:
    """family, pseudonym, real of the distinct values (real), numbered from start + 1 in the order."""
    rows = numbered(values.select("real").where("real IS NOT NULL").distinct(), order or ["real"])
    number = (F.col("n") + start).cast("string")
    width = F.greatest(F.lit(3), F.length(number))
    return rows.select(F.lit(prefix).alias("family"), F.concat(F.lit(f"{prefix}_"), F.lpad(number, width, "0")).alias("pseudonym"), "real")


def merge_scrub_map(base: DataFrame, values: DataFrame, prefix: str, order: list | None = None) -> DataFrame:
    """base with the values it lacks, numbered after its largest index of the family."""
    last = base.where(F.col("family") == prefix).agg(F.coalesce(F.max(F.regexp_extract("pseudonym", "_([0-9]+)$", 1).cast("long")), F.lit(0))).first()[0]
    fresh = values.select("real").join(base.select("real"), "real", "left_anti")
    return base.unionByName(build_scrub_map(fresh, prefix, order, last))


def map_problems(scrub_map: DataFrame) -> DataFrame:
    """problem, value of entries that make a map unusable: empty sides, odd pseudonyms, a real value or pseudonym twice."""
    shape = scrub_map.where(F.coalesce(~F.col("pseudonym").rlike(r"^(host|mac|name)_[0-9]+$"), F.lit(True))).select(F.lit("bad_pseudonym").alias("problem"), F.col("pseudonym").alias("value"))
    empty = scrub_map.where("real IS NULL OR real = ''").select(F.lit("empty_real").alias("problem"), F.col("pseudonym").alias("value"))
    twice = [scrub_map.groupBy(c).agg(F.count("*").alias("k")).where("k > 1").select(F.lit(f"repeated_{c}").alias("problem"), F.col(c).alias("value")) for c in ("real", "pseudonym")]
    return shape.unionByName(empty).unionByName(twice[0]).unionByName(twice[1])


def _marked(df: DataFrame) -> DataFrame:
    """df with a number for each row, as a table, so that rows can be found again."""
    return staged(df.withColumn("_row", F.monotonically_increasing_id()), "rows")


#: Text bytes looked at together; a longer text is looked at alone.
_CHUNK = 4 << 20
_PLACE = "_row long, start long, found string"


def _text_slices(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows of about _CHUNK text bytes, the bytes of their texts, and the offsets of the rows in these."""
    texts = batch.column(column).cast(pa.large_binary()).fill_null(b"")
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + _CHUNK, side="right")) - 1)
        yield batch.slice(first, last - first), raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def _places(rows: DataFrame, column: str, find: Callable[[np.ndarray, np.ndarray], Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]]) -> DataFrame:
    """_row, start (in bytes), found: what find sees, as (numbers of texts, starts in all bytes, found) of a run of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in _text_slices(batch, 1):
                numbers = part.column(0).to_numpy()
                for text, start, found in find(data, offsets):
                    yield pa.RecordBatch.from_arrays([pa.array(numbers[text]), pa.array(start - offsets[text], pa.int64()), found], names=["_row", "start", "found"])

    return rows.select("_row", F.col(column).cast("string")).mapInArrow(run, _PLACE)


class HeadTable:
    """Where values of a map may stand in bytes: a bit for each three bytes that one begins with, then their lengths.

    One lookup a byte whatever the size of the map: 2**24 bits, and the lengths of values by their first bytes.
    """

    def __init__(self, heads: dict[bytes, list[int]]):
        self.bits = np.zeros(1 << 21, np.uint8)
        self.sizes: dict[int, np.ndarray] = {}
        by_size: dict[int, list[int]] = {}
        for head, sizes in heads.items():
            low = int.from_bytes(head.ljust(3, b"\0"), "big")
            span = 1 << 8 * (3 - len(head))  # a value of one or two bytes begins with any third
            codes = np.arange(low, low + span)
            np.bitwise_or.at(self.bits, codes >> 3, (1 << (codes & 7)).astype(np.uint8))
            for size in sizes:
                by_size.setdefault(size, []).extend(codes.tolist())
        self.sizes = {size: np.unique(np.array(codes, np.int64)) for size, codes in by_size.items()}

    def find(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
        if not self.sizes or not data.size:
            return
        wide = np.concatenate([data, np.zeros(2, np.uint8)]).astype(np.int64)
        code = (wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:]
        start = np.flatnonzero((self.bits[code >> 3] >> (code & 7).astype(np.uint8)) & 1)
        code = code[start]
        text = np.searchsorted(offsets, start, side="right") - 1
        limit = offsets[text + 1]
        for size, codes in self.sizes.items():
            k = np.minimum(np.searchsorted(codes, code), codes.size - 1)
            end = start + size
            fits = (codes[k] == code) & (end <= limit)
            # a value ends where a character does
            fits[fits] = (end[fits] == limit[fits]) | (data[np.minimum(end[fits], data.size - 1)] & 0xC0 != 0x80)
            at = start[fits]
            for first in range(0, at.size, max(1, _CHUNK // size)):
                some = at[first : first + max(1, _CHUNK // size)]
                taken = data[(some[:, None] + np.arange(size)).ravel()]
                lengths = np.arange(some.size + 1, dtype=np.int32) * size
                yield text[fits][first : first + some.size], some, pa.StringArray.from_buffers(some.size, pa.py_buffer(lengths), pa.py_buffer(np.ascontiguousarray(taken)))


def _real_places(rows: DataFrame, column: str, scrub_map: DataFrame) -> DataFrame:
    """_row, start, found, pseudonym: everywhere that a real value of the map stands in the text.

    A place is a candidate where three bytes begin a value; what stands there in each length of a value
    meets the map in a shuffle. Sent to tasks are the three bytes, 2**24 at most, and the lengths.
    """
    head = F.hex(F.substring(F.col("real").cast("binary"), 1, 3))
    known = scrub_map.where("real <> ''").groupBy(head.alias("head")).agg(F.array_sort(F.collect_set(F.octet_length("real"))).alias("sizes")).collect()
    table = HeadTable({bytes.fromhex(r["head"]): r["sizes"] for r in known})
    sent = rows.sparkSession.sparkContext.broadcast(table)
    return _places(rows, column, lambda data, offsets: sent.value.find(data, offsets)).join(scrub_map.select(F.col("real").alias("found"), F.col("pseudonym").alias("to")).where("found <> ''"), "found")


def _pseudonym_places(rows: DataFrame, column: str, scrub_map: DataFrame) -> DataFrame:
    """The same for pseudonyms; to is null for those that the map lacks."""
    shape = re.compile(PSEUDONYM)

    def find(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
        text, start, found = [], [], []
        for k in np.flatnonzero(np.diff(offsets)):
            whole, at, byte = data[offsets[k] : offsets[k + 1]].tobytes().decode(), 0, int(offsets[k])
            for m in shape.finditer(whole):  # over characters, so that words end where any letter does
                byte += len(whole[at : m.start()].encode())
                at = m.start()
                text.append(k)
                start.append(byte)
                found.append(m[0])
        if found:
            yield np.array(text), np.array(start), pa.array(found, pa.string())

    found = _places(rows, column, find)
    return found.join(scrub_map.select(F.col("pseudonym").alias("found"), F.col("real").alias("to")), "found", "left")


def _replaced(df: DataFrame, column: str, places: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """df with what places finds replaced: at each place the longest, from the left, none inside another."""
    rows = _marked(df)
    spans = places(rows).where("to IS NOT NULL").groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("start", (-F.octet_length("found")).alias("size"), "to"))).alias("_spans"))
    at, kind = rows.columns.index(column), rows.schema

    def rebuilt(text: str, spans: list[dict]) -> str:
        data, out, end = text.encode(), [], 0
        for s in spans:
            if s["start"] >= end:
                out += [data[end : s["start"]], s["to"].encode()]
                end = s["start"] - s["size"]
        return b"".join([*out, data[end:]]).decode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(batch.num_columns - 1)
            hit = pc.fill_null(pc.greater(pc.list_value_length(spans), 0), False)
            columns = list(batch.columns[:-1])
            if pc.any(hit).as_py():  # only texts with a hit are made anew
                texts = [rebuilt(t, s) for t, s in zip(columns[at].filter(hit).to_pylist(), spans.filter(hit).to_pylist(), strict=True)]
                columns[at] = pc.replace_with_mask(columns[at].cast(pa.string()), hit, pa.array(texts, pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=kind.names)

    return rows.join(spans, "_row", "left").select(*rows.columns, "_spans").mapInArrow(run, kind).drop("_row")


def scrub(df: DataFrame, column: str, scrub_map: DataFrame) -> DataFrame:
    """df with every real value in column (a string) replaced, in one pass, the longest at each place. Null stays null.

    Maps and texts meet in shuffles, so both may be of any size.
    """
    return _replaced(df, column, lambda rows: _real_places(rows, column, scrub_map))


def unscrub(df: DataFrame, column: str, scrub_map: DataFrame) -> DataFrame:
    """df with known pseudonyms in column replaced by real values; others stay."""
    return _replaced(df, column, lambda rows: _pseudonym_places(rows, column, scrub_map))


def unscrub_report(df: DataFrame, column: str, scrub_map: DataFrame) -> DataFrame:
    """One row: replaced, the pseudonyms that unscrub replaces, and unmapped, the different ones that it leaves."""
    found = _pseudonym_places(df.withColumn("_row", F.monotonically_increasing_id()), column, scrub_map)
    return found.agg(F.count("to").alias("replaced"), F.count_distinct(F.when(F.col("to").isNull(), F.col("found"))).alias("unmapped"))


def pseudonymised(df: DataFrame, columns: list[str], scrub_map: DataFrame, salt: str) -> DataFrame:
    """df with the addresses in columns replaced by their pseudonyms; those the map lacks by a salted label. Null stays null."""
    for c in columns:
        known = scrub_map.select(F.col("real").alias("_real"), F.col("pseudonym").alias("_to"))
        df = df.join(known, F.col(c) == F.col("_real"), "left").withColumn(c, F.coalesce("_to", net.opaque_label(F.col(c), salt))).drop("_real", "_to")
    return df


def pseudonymised_entities(findings: DataFrame, scrub_map: DataFrame, salt: str) -> DataFrame:
    """findings whose entity, an address or a pair `a -> b` or empty, tells pseudonyms."""
    ends = F.split("entity", " -> ", 2)
    rows = findings.withColumns({"_a": F.nullif(ends[0], F.lit("")), "_b": F.get(ends, F.lit(1))})
    rows = pseudonymised(rows, ["_a", "_b"], scrub_map, salt)
    return rows.withColumn("entity", F.concat_ws(" -> ", "_a", "_b")).drop("_a", "_b")


def pseudonyms_in(df: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """keep and each distinct pseudonym of the text."""
    return df.select(*keep, F.explode(F.array_distinct(F.regexp_extract_all(column, F.lit(f"(?U)({PSEUDONYM})"), 1))).alias("pseudonym"))


def leak_scan(df: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """Rows whose text holds an address: keep, kind, offset (in bytes, from 0), length and 4 hex digits of its hash; IPv4 first, then IPv6, then MAC."""
    text = F.col(column)
    tries = []
    for kind, pattern in (("ipv4", IPV4), ("ipv6", IPV6), ("mac", MAC)):
        hit = F.regexp_extract(text, f"({pattern})", 1)
        tries.append(F.when(hit != "", F.struct(F.lit(kind).alias("kind"), F.octet_length(F.regexp_extract(text, f"(?s)^(.*?){pattern}", 1)).cast("long").alias("offset"), F.length(hit).cast("long").alias("length"), F.substring(F.sha2(hit.cast("binary"), 256), 1, 4).alias("hash"))))
    return df.select(*keep, F.coalesce(*tries).alias("leak")).where("leak IS NOT NULL").select(*keep, "leak.*")


def map_leaks(df: DataFrame, column: str, scrub_map: DataFrame, keep: list[str]) -> DataFrame:
    """keep of the rows whose text contains a real value of the map."""
    rows = _marked(df.select(*keep, column) if column not in keep else df.select(*keep))
    return rows.join(_real_places(rows, column, scrub_map).select("_row").distinct(), "_row", "left_semi").select(*keep)


def assert_no_leaks(df: DataFrame, column: str, scrub_map: DataFrame) -> DataFrame:
    """df, or LeakError with counts alone; nothing is written before this passes."""
    shapes, values = leak_scan(df, column, []).count(), map_leaks(df.withColumn("_one", F.lit(1)), column, scrub_map, ["_one"]).count()
    if shapes or values:
        raise LeakError(f"{shapes} texts hold addresses and {values} hold mapped values")
    return df


def write_clean(df: DataFrame, column: str, scrub_map: DataFrame, path: str) -> None:
    """Publish df as a new Parquet folder: written aside, checked as written, then renamed.

    LeakError leaves nothing behind; FileExistsError if path is there.
    """
    spark = df.sparkSession
    jvm, aside = spark.sparkContext._jvm, f"{path}-unchecked-{uuid.uuid4().hex}"
    at, to = (jvm.org.apache.hadoop.fs.Path(p) for p in (aside, path))
    files = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(to):
        raise FileExistsError(path)
    try:
        df.write.parquet(aside)
        assert_no_leaks(spark.read.schema(df.schema).parquet(aside), column, scrub_map)
        if not files.rename(at, to):
            raise FileExistsError(path)
    finally:
        files.delete(at, True)


def audit(df: DataFrame, column: str) -> DataFrame:
    """One row: texts, bytes and a digest of all texts in any order, summed from their SHA-256."""
    part = F.conv(F.substring(F.sha2(F.coalesce(F.col(column), F.lit("")).cast("binary"), 256), 1, 12), 16, 10).cast("decimal(20,0)")
    return df.agg(F.count("*").alias("texts"), F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).alias("bytes"), F.coalesce(F.sum(part), F.lit(0)).cast("string").alias("digest"))


def vet_proposed(proposed: DataFrame, known: DataFrame, found: DataFrame, cap: int = 25) -> DataFrame:
    """Proposed findings (id, confidence, text) that cite known pseudonyms alone and say more than a finding.

    known: pseudonym. found: id, pseudonym of rule findings. A proposal whose pseudonyms are all in one
    finding is dropped; of the others the cap most confident stay, ties by id.
    """
    cited = pseudonyms_in(proposed, "text", ["id"])
    unknown = cited.join(known.select("pseudonym"), "pseudonym", "left_anti").select("id").distinct()
    sets = cited.groupBy("id").agg(F.count("*").alias("cited"))
    pairs = cited.join(found.select(F.col("id").alias("finding"), "pseudonym").distinct(), "pseudonym").groupBy("id", "finding").agg(F.count("*").alias("both"))
    covered = pairs.join(sets, "id").where("both = cited").select("id").distinct()
    return proposed.join(unknown, "id", "left_anti").join(covered, "id", "left_anti").orderBy(F.desc("confidence"), "id").limit(cap)
