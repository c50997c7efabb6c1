"""Best-fit packing of documents into sequences in bulk-synchronous rounds.

Round: unplaced documents and the gaps of open sequences are range-sorted together by size, largest
first, into partitions of equally many documents. A gap goes to the partition of the largest
documents that it can be the successor of, as one sweep over the counts by size tells; where more
rows of a size compete than a partition needs, their rank (of a hash) decides. Every partition then
sweeps from its largest document to its smallest: a document takes the smallest gap that holds it,
and what is left of the gap goes on in the sweep. What finds no partner goes into the next round
with the updated gaps. New sequences are opened in the sweep for the largest documents, as many as
best fit over the counts by size of all that is left, documents and gaps, would open.

A round is one job that writes one table of the shared folder, and one count by size: at most two
numbers for each size up to the capacity reach the driver, however many documents there are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .tables import read_stored, remove, stored
from .textarrays import splitmix, with_struct
from .wordbpe import WordBpe

CAPACITY = 4096
END_ID = 1
#: A partition of a round has documents for so many sequences at least, as far as there are two of them: each costs a task and a file.
PART_SEQUENCES = 64

_PIECE = [T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
PIECES = T.StructType([T.StructField("pieces", T.ArrayType(T.StructType(_PIECE)))])


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _cut(texts: pa.Array, path: str, capacity: int, end_id: int) -> list:
    flat, counts = WordBpe.at(path).ids(texts)
    pieces: list[list] = [[], [], [], []]
    offsets, at = [0], 0
    end = np.array([end_id], "<u4")
    for n in counts.tolist():
        ids = np.concatenate([flat[at : at + n].astype("<u4", copy=False), end])
        at += n
        for k, start in enumerate(range(0, ids.size, capacity)):
            part = ids[start : start + capacity]
            for column, value in zip(pieces, (k, start, part.size, zlib.crc32(part.tobytes())), strict=True):
                column.append(value)
        offsets.append(len(pieces[0]))
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    one = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(pieces, kinds, strict=True)], names=[f.name for f in _PIECE])
    return [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), one)]


def token_pieces(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each text's ids and an end id, cut where longer than capacity."""
    path = path or tokenizer_path()
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    cut = with_struct(base, "text", "p", PIECES, lambda: lambda t: _cut(t, path, capacity, end_id), 1 << 20)
    return cut.select("doc_id", F.explode("p.pieces").alias("p")).select("doc_id", "p.*")


@dataclass
class Deal:
    """Which partition of a round a document or a gap goes to."""

    partitions: int
    #: New sequences of each partition.
    fresh: np.ndarray
    #: Rank of the first document of each size from the largest one, documents of each size, of a partition.
    first: np.ndarray
    count: np.ndarray
    each: int
    #: Runs of gaps by size plus rank (0 to 1): where a run begins and ends, its first partition and how many it is spread over.
    begin: np.ndarray
    end: np.ndarray
    part: np.ndarray
    width: np.ndarray

    def documents(self, size: np.ndarray, rank: np.ndarray) -> np.ndarray:
        at = self.first[size] + np.minimum((rank * self.count[size]).astype(np.int64), self.count[size] - 1)
        return at // self.each

    def gaps(self, size: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """-1 for a gap that is too small for any document left."""
        if not self.begin.size:
            return np.full(size.size, -1, np.int64)
        key = size + rank
        run = np.maximum(np.searchsorted(self.begin, key, side="right") - 1, 0)
        part = self.part[run] + (np.clip((key - self.begin[run]) / (self.end[run] - self.begin[run]), 0, 0.999999) * self.width[run]).astype(np.int64)
        return np.where((key >= self.begin[run]) & (key < self.end[run]), part, -1)


def _runs(documents: np.ndarray, each: int, partitions: int) -> tuple[np.ndarray, ...]:
    """first rank by size; largest size, documents and tokens of each partition."""
    first = (np.cumsum(documents[::-1]) - documents[::-1])[::-1]
    largest, many, tokens = (np.zeros(partitions, np.int64) for _ in range(3))
    for size in np.flatnonzero(documents)[::-1].tolist():
        a, b = int(first[size]), int(first[size] + documents[size])
        for p in range(a // each, (b - 1) // each + 1):
            n = min(b, (p + 1) * each) - max(a, p * each)
            largest[p] = largest[p] or size
            many[p] += n
            tokens[p] += n * size
    return first, largest, many, tokens


def opened(documents: np.ndarray, gaps: np.ndarray) -> int:
    """How many sequences best fit opens for so many documents of each size, the largest first, beside so many gaps.

    Documents of a size take the gaps of a size together, so the steps grow with pairs of sizes, not with documents.
    """
    capacity = documents.size - 1
    left = gaps.tolist()
    open_ = sum(1 << size for size in np.flatnonzero(gaps).tolist())  # bit k: there is a gap of size k
    fresh = 0
    for size in np.flatnonzero(documents)[::-1].tolist():
        want = int(documents[size])
        while want:
            if fitting := open_ >> size:
                gap = size + (fitting & -fitting).bit_length() - 1
                many = left[gap]
            else:
                gap, many = capacity, want
            # what is left of a gap is smaller than the gap, so it takes documents of this size until none fits
            holds = min(gap // size, want)
            many = min(many, want // holds)
            if fitting:
                left[gap] -= many
                if not left[gap]:
                    open_ ^= 1 << gap
            else:
                fresh += many
            want -= many * holds
            if rest := gap - holds * size:
                left[rest] += many
                open_ |= 1 << rest
    return fresh


def deal(documents: np.ndarray, gaps: np.ndarray, partitions: int, open_more: bool = False) -> Deal:
    """The deal of a round from the numbers of documents and of gaps by size.

    Sweeping from the largest documents down with a stack of gap sizes, each partition gets the smallest
    gaps that hold its largest document, until they have room for its documents. Gaps that are left over
    are spread. As many sequences are opened as best fit over the counts opens, or with open_more one at
    least.
    """
    capacity = documents.size - 1
    sizes = np.arange(capacity + 1)
    total = int((documents * sizes).sum())
    partitions = int(min(partitions, max(2, total // (PART_SEQUENCES * capacity))))
    each = max(1, -(-int(documents.sum()) // partitions))
    first, largest, many, tokens = _runs(documents, each, partitions)
    least = int(np.flatnonzero(documents)[0])
    need = max(opened(documents, gaps), int(open_more))
    fresh, left = np.zeros(partitions, np.int64), gaps.copy()
    shares: dict[int, list[tuple[int, int, int]]] = {}
    stack, after = [], capacity
    for p in np.flatnonzero(many).tolist():
        while after >= largest[p]:
            if left[after]:
                stack.append(after)
            after -= 1
        mean, want = tokens[p] / many[p], int(many[p])
        while want > 0 and stack:
            holds = max(1, int(stack[-1] / mean))
            n = min(int(left[stack[-1]]), -(-want // holds))
            shares.setdefault(stack[-1], []).append((n, p, 1))
            left[stack[-1]] -= n
            want -= n * holds
            if not left[stack[-1]]:
                stack.pop()
        if want > 0 and need > 0:
            holds = max(1, int(capacity / mean))
            fresh[p] = min(need, -(-want // holds))
            need -= int(fresh[p])
    used = np.flatnonzero(many)
    for size in np.flatnonzero(left[least:]).tolist():
        size += least
        fits = used[largest[used] <= size]
        p = int(fits[0]) if fits.size else int(used[-1])
        shares.setdefault(size, []).append((int(left[size]), p, int(used[-1]) - p + 1))
    begin, end, part, width = [], [], [], []
    for size, runs in sorted(shares.items()):
        done = 0
        for n, p, w in runs:
            begin.append(size + done / gaps[size])
            done += n
            end.append(size + done / gaps[size])
            part.append(p)
            width.append(w)
    return Deal(partitions, fresh, first, documents, each, *(np.array(x) for x in (begin, end)), *(np.array(x, np.int64) for x in (part, width)))


def _state(row: T.DataType) -> T.StructType:
    """Rows of a round's table: state 0 is a placed document, 1 one that is left, 2 an open sequence and its gap."""
    return T.StructType([T.StructField("state", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("size", "salt", "sequence_id", "offset")), T.StructField("row", row)])


def _ranks(salt: np.ndarray, round_: int) -> np.ndarray:
    """Numbers from 0 to 1 of a hash, other ones each round."""
    with np.errstate(over="ignore"):
        return (splitmix(splitmix(salt.view(np.uint64) + np.uint64(round_ + 1))) >> np.uint64(11)) / float(1 << 53)


def _dealt(state: DataFrame, plan: Deal, round_: int) -> DataFrame:
    """What is left of a round's table, with its partition in the next round."""
    schema = T.StructType([T.StructField("part", T.IntegerType()), *state.schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for batch in batches:
            kind, size = batch.column("state").to_numpy(), batch.column("size").to_numpy()
            rank = _ranks(batch.column("salt").to_numpy(), round_)
            part = np.full(kind.size, -1, np.int64)
            part[kind == 1] = plan.documents(size[kind == 1], rank[kind == 1])
            part[kind == 2] = plan.gaps(size[kind == 2], rank[kind == 2])
            out = pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), *(c.cast(f.type) for c, f in zip(batch.columns, list(arrow)[1:], strict=True))], schema=arrow)
            yield out.filter(pa.array(part >= 0))

    return state.where("state > 0").mapInArrow(run, schema)


def _sweep(dealt: DataFrame, plan: Deal, round_: int, capacity: int) -> DataFrame:
    """One sweep of each partition: its gaps first, then its documents from the largest one."""
    schema = T.StructType(dealt.schema.fields[1:])
    fresh = plan.fresh.tolist()  # all that the tasks need of the plan

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        gaps: dict[int, list[int]] = {}
        over: dict[int, list[int]] = {}  # gaps of parts that were swept before in this task
        open_ = 0  # bit k: there is a gap of size k

        def put(size: int, sequences: list[int]) -> None:
            nonlocal open_
            if size and sequences:
                gaps.setdefault(size, []).extend(sequences)
                open_ |= 1 << size

        last = -1
        for batch in batches:
            parts, kinds, sizes, ids = (batch.column(c).to_pylist() for c in ("part", "kind", "size", "sequence_id"))
            states, sequences, offsets, at = [], [], [], []
            for i, size in enumerate(sizes):
                if parts[i] != last:
                    for left, some in gaps.items():
                        over.setdefault(left, []).extend(some)
                    gaps.clear()
                    last, open_ = parts[i], 0
                    put(capacity, [(round_ << 53) | (last << 33) | k for k in range(fresh[last])])
                if kinds[i] == 2:
                    put(size, [ids[i]])
                    continue
                at.append(i)
                fitting = open_ >> size
                if not fitting:
                    states.append(1)
                    sequences.append(None)
                    offsets.append(None)
                    continue
                gap = size + (fitting & -fitting).bit_length() - 1
                sequence = gaps[gap].pop()
                if not gaps[gap]:
                    open_ ^= 1 << gap
                states.append(0)
                sequences.append(sequence)
                offsets.append(capacity - gap)
                put(gap - size, [sequence])
            if at:
                kept = batch.take(pa.array(at))
                columns = [pa.array(states, pa.int32()), kept.column("size"), kept.column("salt"), pa.array(sequences, pa.int64()), pa.array(offsets, pa.int64()), kept.column("row").cast(arrow.field("row").type)]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)
        for size, some in [*over.items(), *gaps.items()]:
            for a in range(0, len(some), 50_000):
                ids = np.array(some[a : a + 50_000], np.int64)
                n = ids.size
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, 2, np.int32)), pa.array(np.full(n, size, np.int64)), pa.array(ids), pa.array(ids), pa.nulls(n, pa.int64()), pa.nulls(n, arrow.field("row").type)], schema=arrow)

    rows = dealt.withColumnRenamed("state", "kind").repartitionById(plan.partitions, "part").sortWithinPartitions("part", F.desc("kind"), F.desc("size"), "salt")
    return rows.mapInArrow(run, schema)


def _counts(state: DataFrame, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents left and gaps by size."""
    out = np.zeros((3, capacity + 1), np.int64)
    for r in state.where("state > 0").groupBy("state", "size").agg(F.count("*").alias("n")).collect():  # capacity + 1 sizes at most
        out[r["state"], r["size"]] = r["n"]
    return out[1], out[2]


def pack(pieces: DataFrame, *, capacity: int = CAPACITY, partitions: int | None = None) -> DataFrame:
    """pieces with sequence_id and offset (within its sequence, gapless from 0).

    pieces has a length of 1 to capacity and any other columns but these two. Rows may repeat, and
    equal lengths are placed by a hash of the rows' order. An empty table gives an empty table. Sequence
    ids are any numbers. Every round needs two partitions at least.
    """
    spark = pieces.sparkSession
    partitions = max(2, partitions or int(spark.conf.get("spark.sql.shuffle.partitions")))
    none = F.lit(None).cast("long")
    start = pieces.select(F.lit(1).alias("state"), F.col("length").cast("long").alias("size"), F.xxhash64(F.monotonically_increasing_id()).alias("salt"), none.alias("sequence_id"), none.alias("offset"), F.struct(*(F.col(c) for c in pieces.columns)).alias("row"))
    schema = _state(start.schema["row"].dataType)
    tables = [stored(start, "pieces")]
    documents, gaps = _counts(read_stored(spark, schema, tables), capacity)
    open_more = False
    while before := int(documents.sum()):
        round_ = len(tables)
        plan = deal(documents, gaps, partitions, open_more)
        dealt = _dealt(read_stored(spark, schema, tables[-1:]), plan, round_)
        tables.append(stored(_sweep(dealt, plan, round_, capacity), "round"))
        if round_ == 1:
            remove(spark, tables[0])
        documents, gaps = _counts(read_stored(spark, schema, tables[-1:]), capacity)
        open_more = int(documents.sum()) == before  # a round always places something, or the next one opens a sequence
    done = read_stored(spark, schema, tables[1:]) if len(tables) > 1 else spark.createDataFrame([], schema)
    return done.where("state = 0").select("row.*", "sequence_id", "offset")


def pack_documents(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, **options) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is its end id alone. A repeated row is packed again; null ids are kept.
    """
    return pack(token_pieces(docs, doc_id=doc_id, text=text, path=path, capacity=capacity, end_id=end_id), capacity=capacity, **options)
