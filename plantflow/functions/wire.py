"""Bytes of a payload kept as upper-case hex text: two characters a byte, offsets from 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def size(h: Column) -> Column:
    return (F.length(h) / 2).cast("long")


def hex_at(h: Column, at: int | Column, n: int = 1) -> Column:
    """n bytes as hex; at may be a column."""
    if isinstance(at, int):
        return F.substring(h, 2 * at + 1, 2 * n)
    return h.substr((at * 2 + 1).cast("int"), F.lit(2 * n))


def be(h: Column, at: int | Column, n: int = 1) -> Column:
    """n bytes as a big-endian number; null beyond the end."""
    piece = hex_at(h, at, n)
    if n == 1:  # no part of a byte can be left, so the piece is read once
        return F.conv(F.nullif(piece, F.lit("")), 16, 10).cast("long") if isinstance(at, int) else F.conv(piece, 16, 10).cast("long")
    return F.when(F.length(piece) == 2 * n, F.conv(piece, 16, 10).cast("long"))


def le(h: Column, at: int | Column, n: int) -> Column:
    """n bytes as a little-endian number."""
    total = None
    for k in range(n):
        byte = be(h, at + k) * (256**k)
        total = byte if total is None else total + byte
    return total


def find(h: Column, needle: str) -> Column:
    """The offset of the first occurrence at a byte boundary, -1 where there is none."""
    first = F.locate(needle, h)
    pairs = F.regexp_replace(h, "(..)", "$1 ")  # needed only where the first occurrence is between bytes
    spaced = " ".join(needle[k : k + 2] for k in range(0, len(needle), 2))
    between = F.floor((F.locate(spaced, pairs) + 2) / 3).cast("long") - 1
    return F.when(first == 0, F.lit(-1).cast("long")).when(first % 2 == 1, ((first - 1) / 2).cast("long")).otherwise(between)


def text(h: Column) -> Column:
    """The payload as text, one character a byte."""
    return F.decode(F.unhex(h), "ISO-8859-1")


def first_line(h: Column, most: int) -> Column:
    """The first line, cut to most bytes."""
    return F.regexp_extract(F.substring(text(h), 1, most), r"^[^\r\n]*", 0)
