"""Numpy helpers that run inside Spark tasks: words of a whole Arrow text column at once.

Texts stay one byte buffer with offsets. Words are found by a byte class table, hashed by
differences of one running polynomial sum, and never become Python strings.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Text bytes handled at once in a task; a longer document is handled alone.
CHUNK_BYTES = 2 << 20
_SEGMENT = 1 << 17


def splitmix(x: np.ndarray) -> np.ndarray:
    """The public splitmix64 finaliser over uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeded(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random uint64 of a seed."""
    step = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        return splitmix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed * 1_000_003)) * step)


def _folded() -> np.ndarray:
    table = seeded(256, 11)
    table[65:91] = table[97:123]
    return table


#: A value per byte; A-Z share those of a-z.
BYTE_VALUES = _folded()
#: The same without folding.
CASED_VALUES = seeded(256, 11)
_BASE = 0xD6E8FEB86659FD93  # odd, so it has an inverse modulo 2**64
_UNBASE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or have.size < n:
        steps = np.full(max(n, _SEGMENT), base, dtype=np.uint64)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def byte_class(word: Callable[[int], bool]) -> np.ndarray:
    return np.array([word(b) for b in range(256)], dtype=bool)


#: Words are runs of anything but blanks (0x20, 0x09-0x0D).
BLANK_SPLIT = byte_class(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: Words are runs of ASCII letters, digits and non-ASCII characters.
ALNUM_SPLIT = byte_class(lambda b: 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows in them; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(data: np.ndarray, offsets: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word; a word never crosses rows."""
    inside = np.frombuffer(data.tobytes().translate(word.tobytes()), bool)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    heads = offsets[:-1][offsets[:-1] < data.size]
    first[heads] = inside[heads]
    tails = offsets[1:][offsets[1:] > 0] - 1
    last[tails] = inside[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.repeat(np.arange(offsets.size - 1), np.diff(np.searchsorted(starts, offsets)))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = BYTE_VALUES) -> np.ndarray:
    """A 64-bit hash of each span's bytes, A-Z folded to a-z by default; the spans are in order and disjoint."""
    out = np.empty(starts.size, np.uint64)
    i = 0
    with np.errstate(over="ignore"):
        while i < starts.size:
            low = int(starts[i])
            j = max(i + 1, int(np.searchsorted(ends, low + _SEGMENT, side="right")))
            part = data[low : ends[j - 1]]
            sums = np.zeros(part.size + 1, np.uint64)
            np.cumsum(values[part] * _power(_BASE, part.size), out=sums[1:])
            a, b = starts[i:j] - low, ends[i:j] - low
            out[i:j] = splitmix((sums[b] - sums[a]) * _power(_UNBASE, part.size + 1)[a] + (b - a).astype(np.uint64))
            i = j
    return out


def words(texts: pa.Array, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each word of the column, in order."""
    data, offsets = text_bytes(texts)
    starts, ends, row = spans(data, offsets, word)
    return span_hashes(data, starts, ends), row


def slices(batch: pa.RecordBatch, text: int, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows with at most so many text bytes; each has a row at least."""
    n = batch.num_rows
    if n == 0:
        return
    column = batch.column(text)
    sizes = np.zeros(n, np.int64) if pa.types.is_null(column.type) else np.diff(text_bytes(column)[1])
    total, i = np.cumsum(sizes), 0
    while i < n:
        before = total[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(total, before + most, side="right")))
        yield batch.slice(i, j - i)
        i = j


def fresh_name(df: DataFrame, base: str) -> str:
    """base, with underscores until no column has that name in any case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def give_back() -> None:
    """Return freed memory to the system, so that a Python worker does not keep a past task's peak."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL(None).malloc_trim(0)


def with_struct(df: DataFrame, text: str, name: str, fields: T.StructType, start: Callable[[], Callable[[pa.Array], list]], most: int = CHUNK_BYTES) -> DataFrame:
    """df with a struct column computed from a text column.

    start() runs once in each task and gives the function from a slice of the column to the arrays
    of fields. The rows pass through Arrow as they are, so there is no shuffle and no join.
    """
    at = df.columns.index(text)
    schema = T.StructType([*df.schema.fields, T.StructField(name, fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        of = start()
        kinds = [arrow.field(len(arrow) - 1).type.field(i) for i in range(len(fields))]
        for batch in batches:
            for part in slices(batch, at, most):
                made = [a if isinstance(a, pa.Array) else pa.array(a, k.type) for a, k in zip(of(part.column(at)), kinds, strict=True)]
                made = [a if a.type == k.type else a.cast(k.type) for a, k in zip(made, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.StructArray.from_arrays(made, fields=kinds)], names=arrow.names)
            give_back()

    return df.mapInArrow(run, schema)


def list_array(values: np.ndarray, row: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    """Lists of n rows from values sorted by row."""
    offsets = np.zeros(n + 1, np.int32)
    np.cumsum(np.bincount(row, minlength=n), out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
