"""WARC archives with revisit records in place of repeated payloads.

Archives are written and read by Spark alone, so any file system will do: a record is one row of a
text table whose line separator is the blank line that ends a WARC record, and archives are read back as
binary files of a bounded size, split by their Content-Length. Repeated payloads are found by a
shuffle of headers: per payload digest the newest page is kept as response, and revisit records are
joined to it. Payload bytes never enter a shuffle by digest.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql import types as T

from ..sources.staging import shared_folder
from .tables import written

#: Bytes of payload in one archive, about.
ARCHIVE_BYTES = 32 << 20
#: Pairs of page and payload that may be spread over archives, at most: those are broadcast.
MOST_HOT = 1_000_000
#: Bytes of a record without its payload, about.
HEADER_BYTES = 512
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_END = "\r\n"
RECORD = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("record_id", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("url", T.StringType()), T.StructField("payload_digest", T.StringType()), T.StructField("refers_to", T.StringType()), T.StructField("payload", T.BinaryType())])


def base32_sha1(payload: Column) -> Column:
    """The SHA-1 of a binary column in upper-case base32, as in a WARC-Payload-Digest."""
    digest = F.sha1(payload)
    five = [F.conv(F.substring(digest, 5 * k + 1, 5), 16, 10).cast("long") for k in range(8)]
    letters = [F.substring(F.lit(_ALPHABET), (F.shiftright(n, s).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for n in five for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def _record_id(page_id: Column, digest: Column) -> Column:
    """A stable URN of a page's record with a payload; null pages have one of their own."""
    h = F.md5(F.concat(F.lit("page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(":"), F.coalesce(digest, F.lit(""))).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"), F.substring(h, 13, 4), F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def _header(name: str, value: Column) -> Column:
    return F.when(value.isNull(), F.lit("")).otherwise(F.concat(F.lit(f"{name}: "), value, F.lit(_END)))


def _line(value: Column) -> Column:
    """A header value on one line."""
    return F.regexp_replace(value, r"[\r\n]+", " ")


def write_archives(records: DataFrame, path: str, *, compression: str = "gzip") -> None:
    """Write records (page_id, record_type, url, payload_digest, refers_to, payload as text) as WARC files.

    A revisit has no block of its own. Every partition becomes one archive.
    """
    revisit = F.col("record_type") == "revisit"
    block = F.when(revisit, F.lit("")).otherwise(F.coalesce("payload", F.lit("")))
    kind = F.when(F.col("record_type") == "response", F.lit("text/html")).otherwise(F.lit(None))
    text = F.concat(
        F.lit("WARC/1.1" + _END),
        _header("WARC-Type", F.col("record_type")),
        _header("WARC-Record-ID", _record_id(F.col("page_id"), F.col("payload_digest"))),
        _header("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        _header("WARC-Target-URI", _line(F.col("url"))),
        _header("X-Page-ID", F.col("page_id").cast("string")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        _header("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        _header("WARC-Refers-To", F.col("refers_to")),
        _header("Content-Type", kind),
        _header("Content-Length", F.octet_length(block).cast("string")),
        F.lit(_END),
        block,
    )
    records.select(text.alias("value")).write.option("lineSep", _END * 2).option("compression", compression).text(path)


def _parse(data: bytes) -> Iterator[tuple]:
    """The records of one archive; a damaged one raises ValueError."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/1.", at):
            raise ValueError(f"not a WARC record at byte {at}")
        head = dict(line.split(": ", 1) for line in data[at:end].decode().split(_END)[1:])
        size = int(head["Content-Length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) != size:
            raise ValueError(f"the record at byte {at} is cut short")
        page = head.get("X-Page-ID")
        digest = head.get("WARC-Payload-Digest", "").removeprefix("sha1:") or None
        yield (int(page) if page is not None else None, head["WARC-Record-ID"], head["WARC-Type"], head.get("WARC-Target-URI"), digest, head.get("WARC-Refers-To"), block)
        at = end + 4 + size + 4


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all WARC files of a folder, plain or gzip: page_id, record_id, record_type, url, payload_digest, refers_to, payload."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gzip

        schema = to_arrow_schema(RECORD)
        for batch in batches:
            for value in batch.column(0):
                data = value.as_py()
                data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
                rows, size = [], 0
                for record in _parse(data):
                    rows.append(record)
                    size += len(record[-1])
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return files.mapInArrow(run, RECORD)


def deduplicated_headers(records: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, payload_digest, bytes with record_type and refers_to_page decided by digest.

    Of records with equal payloads of least_bytes or more, the one with the largest page_id is the
    response; smaller ones are all responses. Rows that repeat the largest id are all responses, and
    a null id never revisits nor is referred to.
    """
    large = F.col("bytes") >= least_bytes
    newest = records.where(large & F.col("page_id").isNotNull()).groupBy("payload_digest", "bytes").agg(F.max("page_id").alias("newest"))
    joined = records.join(newest, ["payload_digest", "bytes"], "left")
    again = large & (F.col("page_id") < F.col("newest"))
    return joined.withColumn("record_type", F.when(again, "revisit").otherwise("response")).withColumn("refers_to_page", F.when(again, F.col("newest"))).drop("newest")


def archive_pages(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0, path: str | None = None, archive_bytes: int = ARCHIVE_BYTES, most_hot: int = MOST_HOT) -> DataFrame:
    """Write pages as deduplicated WARC archives, read them back, one row per record.

    Columns: page_id, payload_bytes, payload_digest, record_type, refers_to (a page_id). A null payload
    is empty. Size and digest of a revisit are those of the response it refers to, joined on read. An
    empty table writes one empty archive. Repeated rows are records of their own, and extra columns of
    pages are left out, whatever their names.
    """
    spark = pages.sparkSession
    path = path or f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    base = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("payload"))
    data = F.col("payload").cast("binary")
    headers = base.select("page_id", base32_sha1(data).alias("payload_digest"), F.octet_length("payload").cast("long").alias("bytes"))
    headers = written(headers, "headers")
    decided = written(deduplicated_headers(headers, least_bytes), "decided")
    # Payloads are dealt out once, and what was decided meets them there. The archives are counted from
    # all that is dealt. No id or payload decides an archive: the rows of a (page, digest) of more than
    # one archive are spread over salts. A single row needs none, and as a spread pair holds a most_hot-th
    # of all that is dealt or more, there are most_hot of them at most.
    dealt = decided.groupBy("page_id", "payload_digest").agg(F.sum(F.col("bytes") + HEADER_BYTES).alias("dealt"), F.count("*").alias("rows"), F.first("record_type").alias("record_type"), F.first("refers_to_page").alias("refers_to_page"))
    total = int(decided.agg(F.coalesce(F.sum(F.col("bytes") + HEADER_BYTES), F.lit(0))).first()[0])
    files = max(1, -(-total // archive_bytes))
    share = max(archive_bytes, -(-total // most_hot))
    facts = written(dealt.withColumn("salts", F.least("rows", F.ceil(F.col("dealt") / share))).drop("rows"), "facts")
    hot = facts.where("salts > 1").select(F.col("page_id").alias("hot"), F.col("payload_digest").alias("hot_digest"), "salts")
    key = F.xxhash64(F.coalesce("page_id", F.lit(-(1 << 63))), "payload_digest", "salt")
    facts = facts.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).withColumn("k", key)
    facts = facts.repartition(files, "k").select("k", F.col("page_id").alias("of"), F.col("payload_digest").alias("of_digest"), F.col("salt").alias("of_salt"), "record_type", "refers_to_page")
    digested = base.withColumn("payload_digest", base32_sha1(data)).withColumn("row", F.monotonically_increasing_id())
    is_hot = F.col("page_id").eqNullSafe(F.col("hot")) & (F.col("payload_digest") == F.col("hot_digest"))
    salted = digested.join(F.broadcast(hot), is_hot, "left").withColumn("salt", F.pmod("row", F.coalesce("salts", F.lit(1).cast("long")))).select("page_id", "url", "payload", "payload_digest", "salt")
    salted = salted.withColumn("k", key).repartition(files, "k")
    same = F.col("page_id").eqNullSafe(F.col("of")) & (F.col("payload_digest") == F.col("of_digest")) & (F.col("salt") == F.col("of_salt"))
    records = salted.join(facts.hint("merge"), "k").where(same).select("page_id", "url", "payload", "payload_digest", "record_type", F.when(F.col("refers_to_page").isNotNull(), _record_id(F.col("refers_to_page"), F.col("payload_digest"))).alias("refers_to"))
    write_archives(records, path)
    return resolve_revisits(read_archives(spark, path))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row per archived record, revisits joined to the responses they refer to."""
    rows = written(records.select("page_id", "record_id", "record_type", "payload_digest", "refers_to", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("digest")), "records")
    responses = rows.where("record_type = 'response'").groupBy("record_id", "payload_digest").agg(F.first("page_id").alias("of"), F.first("payload_bytes").alias("of_bytes"), F.first("digest").alias("of_digest"))
    revisits = rows.where("record_type = 'revisit'").join(responses.withColumnRenamed("record_id", "refers_to"), ["refers_to", "payload_digest"], "left").select("page_id", F.col("of_bytes").alias("payload_bytes"), F.col("of_digest").alias("payload_digest"), "record_type", F.col("of").alias("refers_to"))
    own = rows.where("record_type <> 'revisit'").select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    return own.unionByName(revisits)
