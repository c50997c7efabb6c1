"""Token ids of whole text columns by a public word BPE tokenizer, each distinct word encoded once.

The tokenizer lower-cases, drops blanks, splits texts into runs of letters, single digits, runs of
other signs and English contractions, and encodes every such piece on its own. For texts of ASCII
and accented Latin letters that split is done here on bytes; a piece met before is looked up. All
other texts go to the tokenizer as they are, so the ids are always the tokenizer's own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .textarrays import span_hashes, text_bytes

_LETTER, _DIGIT, _BLANK, _SIGN = 0, 1, 2, 3
_CLASS = np.full(256, _SIGN, np.uint8)
_CLASS[[*range(97, 123), *range(65, 91), *range(128, 256)]] = _LETTER
_CLASS[48:58] = _DIGIT
_CLASS[[9, 10, 11, 12, 13, 32]] = _BLANK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_QUOTE = ord("'")
#: Distinct words a task remembers before it starts afresh.
REMEMBERED = 400_000
_ENCODED = 5_000


def _simple_rows(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows of ASCII and U+00C0 to U+00FF letters alone, without the tokenizer's special strings."""
    before = np.zeros_like(data)
    before[1:] = data[:-1]
    odd = (data >= 128) & (data != 0xC3) & ~((before == 0xC3) & (data != 0x97) & (data != 0xB7))
    special = np.flatnonzero((data == ord("|")) & (before == ord("<")))
    bad = np.concatenate([np.flatnonzero(odd), special])
    out = np.ones(offsets.size - 1, bool)
    out[np.searchsorted(offsets, bad, side="right") - 1] = False
    return out


def _lowered(data: np.ndarray) -> np.ndarray:
    out = _LOWER[data]
    accented = np.flatnonzero((data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[:-1] == 0xC3)) + 1
    out[accented] += 0x20
    return out


def _pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of the pieces of lowered text."""
    kind = _CLASS[data]
    edge = np.ones(data.size, bool)
    edge[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    edge[offsets[:-1][offsets[:-1] < data.size]] = True
    starts = np.flatnonzero(edge)
    ends = np.append(starts[1:], data.size)
    solid = kind[starts] != _BLANK
    starts, ends = starts[solid], ends[solid]
    row = np.searchsorted(offsets, starts, side="right") - 1
    if starts.size > 1:
        quote = np.flatnonzero((data[starts[:-1]] == _QUOTE) & (ends[:-1] - starts[:-1] == 1) & (starts[1:] == ends[:-1]) & (row[1:] == row[:-1]) & (kind[starts[1:]] == _LETTER))
        for i in quote.tolist():
            word = data[starts[i + 1] : min(ends[i + 1], starts[i + 1] + 2)].tobytes()
            take = 1 if word[:1] in (b"s", b"t", b"m", b"d") else 2 if word in (b"re", b"ve", b"ll") else 0
            ends[i] += take
            starts[i + 1] += take
        left = ends > starts
        starts, ends, row = starts[left], ends[left], row[left]
    return starts, ends, row


class WordBpe:
    """Ids of texts; keeps what it learned about words for the life of the Python worker."""

    _open: dict[str, WordBpe] = {}

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        words = self.tokenizer.get_vocab(with_added_tokens=False)
        self.last = np.zeros(max(words.values()) + 1, bool)
        for word, i in words.items():
            self.last[i] = word.endswith("</w>")
        self._forget()

    @classmethod
    def at(cls, path: str) -> WordBpe:
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def _forget(self) -> None:
        # hashes of known words in order, and where each word's ids stand in the pool
        self.known = np.zeros(0, np.uint64)
        self.first, self.size = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def _encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _word_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and how many each has."""
        ids = np.array(self._encode(" ".join(words)), np.uint32)
        ends = np.flatnonzero(self.last[ids]) + 1 if ids.size and ids.max() < self.last.size else np.zeros(0, np.int64)
        if ends.size != len(words) or ends[-1] != ids.size:
            each = [np.array(self._encode(w), np.uint32) for w in words]
            return np.concatenate(each), np.array([e.size for e in each], np.int64)
        return ids, np.diff(ends, prepend=0)

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        """Add words not known yet; hashes are in order."""
        sizes = []
        before = self.used
        for a in range(0, len(words), _ENCODED):
            ids, size = self._word_ids(words[a : a + _ENCODED])
            while self.pool.size < self.used + ids.size:
                self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
            self.pool[self.used : self.used + ids.size] = ids
            self.used += ids.size
            sizes.append(size)
        size = np.concatenate(sizes)
        at = np.searchsorted(self.known, hashes)
        self.known = np.insert(self.known, at, hashes)
        self.first = np.insert(self.first, at, before + np.cumsum(size) - size)
        self.size = np.insert(self.size, at, size)

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the column one after another, and how many each row has."""
        raw, offsets = text_bytes(texts)
        n = offsets.size - 1
        if self.known.size > REMEMBERED:
            self._forget()
        simple = _simple_rows(raw, offsets)
        data = _lowered(raw)
        starts, ends, row = _pieces(data, offsets)
        if not simple.all():
            keep = simple[row]
            starts, ends, row = starts[keep], ends[keep], row[keep]
        distinct, where, inverse = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.known, distinct), max(self.known.size - 1, 0))
        new = np.flatnonzero(self.known[at] != distinct) if self.known.size else np.arange(distinct.size)
        if new.size:
            whole = data.tobytes()
            self._learn(distinct[new], [whole[a:b].decode() for a, b in zip(starts[where[new]].tolist(), ends[where[new]].tolist(), strict=True)])
        slots = np.searchsorted(self.known, distinct)[inverse]
        sizes = self.size[slots].astype(np.int64)
        shift = np.repeat(self.first[slots] - (np.cumsum(sizes) - sizes), sizes)
        flat = self.pool[shift + np.arange(shift.size)]
        counts = np.bincount(row, weights=sizes, minlength=n).astype(np.int64)
        if simple.all():
            return flat, counts
        parts = np.split(flat, np.cumsum(counts)[:-1])
        for i in np.flatnonzero(~simple).tolist():
            parts[i] = np.array(self._encode(raw[offsets[i] : offsets[i + 1]].tobytes().decode()), np.uint32)
            counts[i] = parts[i].size
        return np.concatenate(parts), counts
