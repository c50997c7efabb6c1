"""Word-piece counts of texts by a linear longest-match automaton.

Greedy longest-match-first segmentation, without building pieces: a trie of the vocabulary has a
failure link and a count of popped pieces at each node. Reading a byte without a child adds the count and
follows the link, so a word costs time linear in its length. The distinct words of a slice of the
column run through the automaton side by side in numpy; each word's count is then added to its
texts. What is left of a very long word goes through alone, byte by byte over a dictionary. A word is
preceded by one blank, as the vocabulary's word-initial pieces are.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textarrays import BLANK_SPLIT, CASED_VALUES, span_hashes, spans, splitmix, text_bytes, with_struct

#: Bytes of a word that are read side by side with others.
SIDE_BY_SIDE = 512
COUNTS = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())])


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def read_vocabulary(path: str) -> list[bytes]:
    """The pieces of a file with a base64 piece and a rank on each line."""
    with open(path, "rb") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines if line.strip()]


@dataclass
class _Edges:
    """Children of trie nodes in an open-addressing table: key node * 256 + byte."""

    keys: np.ndarray
    nodes: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, nodes: np.ndarray) -> _Edges:
        size = 1 << int(np.ceil(np.log2(4 * keys.size + 4)))
        table, child = np.full(size, -1, np.int64), np.zeros(size, np.int64)
        left = np.arange(keys.size)
        at = (splitmix(keys.astype(np.uint64)) % np.uint64(size)).astype(np.int64)
        while left.size:
            free = table[at[left]] < 0
            want = left[free]
            table[at[want]] = keys[want]
            child[at[want]] = nodes[want]
            left = left[table[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & (size - 1)
        return cls(table, child)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The children, or -1."""
        size = self.keys.size
        at = (splitmix(keys.astype(np.uint64)) % np.uint64(size)).astype(np.int64)
        out = np.where(self.keys[at] == keys, self.nodes[at], -1)
        open_ = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] >= 0))
        while open_.size:
            at[open_] = (at[open_] + 1) & (size - 1)
            found = self.keys[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.nodes[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out


class LongestMatch:
    """Node 0 is the root. fail and pops hold where a node without the next child goes on, and the pieces it then has behind it."""

    _open: dict[str, LongestMatch] = {}

    def __init__(self, pieces: list[bytes]) -> None:
        children: list[dict[int, int]] = [{}]
        whole = [False]
        for piece in pieces:
            node = 0
            for b in piece:
                if b not in children[node]:
                    children[node][b] = len(children)
                    children.append({})
                    whole.append(False)
                node = children[node][b]
            whole[node] = True
        self.fail, self.pops = self._links(children, whole)
        # pieces of a word that ends at the node
        self.rest = np.zeros(len(children), np.int64)
        for node in self._by_depth(children)[1:]:
            self.rest[node] = self.pops[node] + (self.rest[self.fail[node]] if self.fail[node] > 0 else 0)
        edges = [(node * 256 + b, child) for node, own in enumerate(children) for b, child in own.items()]
        keys = np.array(edges, np.int64).reshape(-1, 2)
        self.edges = _Edges.of(keys[:, 0], keys[:, 1])
        self._lists: tuple | None = None

    @staticmethod
    def _by_depth(children: list[dict[int, int]]) -> list[int]:
        order = [0]
        for node in order:
            order.extend(children[node].values())
        return order

    def _links(self, children: list[dict[int, int]], whole: list[bool]) -> tuple[np.ndarray, np.ndarray]:
        """fail is -1 where no segmentation goes on: such a word has a byte outside the vocabulary."""
        fail, pops = [0] * len(children), [0] * len(children)
        fail[0] = -1
        for node in self._by_depth(children):
            for b, child in children[node].items():
                if whole[child]:
                    fail[child], pops[child] = 0, 1
                    continue
                to, count = fail[node], pops[node]
                while to >= 0 and b not in children[to]:
                    count += pops[to]
                    to = fail[to]
                fail[child], pops[child] = (children[to][b], count) if to >= 0 else (-1, count)
        return np.array(fail, np.int64), np.array(pops, np.int64)

    @classmethod
    def at(cls, path: str) -> LongestMatch:
        if path not in cls._open:
            cls._open[path] = cls(read_vocabulary(path))
        return cls._open[path]

    def _alone(self, node: int, rest: np.ndarray) -> tuple[int, int]:
        """The node after the rest of a word, -1 if it has none, and the pieces popped on the way."""
        if self._lists is None:
            have = self.edges.keys >= 0
            self._lists = dict(zip(self.edges.keys[have].tolist(), self.edges.nodes[have].tolist(), strict=True)), self.fail.tolist(), self.pops.tolist()
        edges, fail, pops = self._lists
        count = 0
        for a in range(0, rest.size, 1 << 20):
            for byte in rest[a : a + (1 << 20)].tobytes():
                while (child := edges.get(node * 256 + byte)) is None:
                    count += pops[node]
                    node = fail[node]
                    if node < 0:
                        return -1, count
                node = child
        return node, count

    def counts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Pieces of each word, with a blank before it; 1 for a word the vocabulary cannot spell."""
        n = starts.size
        out = np.zeros(n, np.int64)
        blank = int(self.edges.get(np.array([32]))[0])
        node = np.full(n, max(blank, 0), np.int64)
        active, step = np.arange(n), 0
        while active.size:
            at = starts[active] + step
            byte = data[at].astype(np.int64)
            todo = active
            while todo.size:
                child = self.edges.get(node[todo] * 256 + byte)
                stuck = child < 0
                node[todo[~stuck]] = child[~stuck]
                todo, byte = todo[stuck], byte[stuck]
                out[todo] += self.pops[node[todo]]
                node[todo] = self.fail[node[todo]]
                lost = node[todo] < 0
                out[todo[lost]] = -1
                todo, byte = todo[~lost], byte[~lost]
            step += 1
            active = active[(starts[active] + step < ends[active]) & (node[active] >= 0)]
            if step == SIDE_BY_SIDE:
                for i in active.tolist():
                    node[i], more = self._alone(int(node[i]), data[starts[i] + step : ends[i]])
                    out[i] += more
                break
        good = node >= 0
        out[good] += self.rest[node[good]]
        out[~good] = 1
        return out


def _counted(texts: pa.Array, path: str) -> list:
    data, offsets = text_bytes(texts)
    starts, ends, row = spans(data, offsets, BLANK_SPLIT)
    n = len(texts)
    _, where, inverse = np.unique(span_hashes(data, starts, ends, CASED_VALUES), return_index=True, return_inverse=True)
    each = LongestMatch.at(path).counts(data, starts[where], ends[where])[inverse]
    return [pa.array(np.bincount(row, minlength=n).astype(np.int64)), pa.array(np.bincount(row, weights=each, minlength=n).astype(np.int64))]


def token_counts(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_tokens.

    Words are runs of non-blanks of the whole text, of any length. Null, empty and blank texts have
    none of either. Repeated rows and null ids are counted like any other; other columns are left out.
    An empty table gives no rows. One pass without a shuffle.
    """
    path = path or vocabulary_path()
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return with_struct(base, "text", "c", COUNTS, lambda: lambda t: _counted(t, path)).select("doc_id", "c.*")
