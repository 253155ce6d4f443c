"""Byte-level BPE by a monoid tree reduction.

Encoded texts form a monoid: two neighbours are joined by encoding a window around their boundary again, which grows
until its outer tokens are compatible with the tokens next to it. Two tokens are compatible if encoding their bytes
together gives just these two; a sequence of tokens is the encoding of its bytes exactly if all neighbours in it are
compatible, so the tokens outside the window are proven stable. Every match of the pattern is encoded half by half down to
single bytes and joined up the tree; matches are never merged with each other, so joining them is concatenation. Decoding
concatenates bytes up the same tree. What a worker remembers (windows of two tokens, nodes of a few bytes, whole matches)
are values of such nodes, none of them found in another way.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memory, release_memory

#: Bytes up to which merging by a scan for the least rank beats a heap, and nodes of the tree are remembered.
SCAN, NODE = 48, 6
#: Tokens that decoding concatenates at once.
FLAT = 8
#: Texts whose ids are handed on together.
ROWS = 2_000


class ByteBPE:
    """Encoder and decoder for a table of ranks (bytes -> id) and a pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.token = {v: k for k, v in ranks.items()}
        self.decimal = {x: str(x).encode() for x in self.token}
        self.joins = 0
        self._windows, self._nodes, self._leaves = Memory(self._window), Memory(self._node), Memory(self._leaf)

    def merge(self, data: bytes) -> tuple[int, ...]:
        """The merges one after the other, lowest rank first, leftmost among equals: the definition of the encoding."""
        ranks, n = self.ranks, len(data)
        if n <= SCAN:
            parts = [data[i : i + 1] for i in range(n)]
            far = len(ranks)
            rank = [ranks.get(data[i : i + 2], far) for i in range(n - 1)]
            while rank and (least := min(rank)) < far:
                i = rank.index(least)
                parts[i] += parts[i + 1]
                del parts[i + 1], rank[i]
                if i:
                    rank[i - 1] = ranks.get(parts[i - 1] + parts[i], far)
                if i < len(rank):
                    rank[i] = ranks.get(parts[i] + parts[i + 1], far)
            return tuple([ranks[x] for x in parts])
        end = list(range(1, n + 1))  # end[i]: where the part that starts at i ends; 0: no part starts there
        back = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, stop = heappop(heap)
            j = end[i]
            if not j or j >= n or end[j] != stop:
                continue  # one of the two parts has changed since
            end[i], end[j] = stop, 0
            if stop < n:
                back[stop] = i
                if (r := ranks.get(data[i : end[stop]])) is not None:
                    heappush(heap, (r, i, end[stop]))
            if (p := back[i]) >= 0 and (r := ranks.get(data[p:stop])) is not None:
                heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : end[i]]])
            i = end[i]
        return tuple(out)

    def _window(self, ids: tuple[int, ...]) -> tuple[int, ...]:
        """The encoding of neighbours' bytes; nothing if it is these tokens, which are compatible then."""
        found = self.merge(self.decode(ids))
        return () if found == ids else found

    def window(self, ids: tuple[int, ...]) -> tuple[int, ...]:
        found = self._windows.known(ids)
        if found is None:
            found = self._windows.find(ids) if len(ids) <= FLAT else self._window(ids)
        return found

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """The encoding of the bytes of ``left`` followed by those of ``right``."""
        if not left or not right:
            return left + right
        self.joins += 1
        found = self.window((left[-1], right[0]))
        if not found:
            return left + right
        i = j = 1
        while True:
            grow_left = i < len(left) and self.window((left[-i - 1], found[0]))
            grow_right = j < len(right) and self.window((found[-1], right[j]))
            if not grow_left and not grow_right:
                return left[: len(left) - i] + found + right[j:]
            i, j = min(len(left), 2 * i) if grow_left else i, min(len(right), 2 * j) if grow_right else j
            held = left[len(left) - i :] + right[:j]
            found = self.window(held) or held

    def tree(self, data: bytes) -> tuple[int, ...]:
        """The encoding of ``data``: that of its halves, joined; of a single byte, its token."""
        if len(data) <= NODE:
            return self._nodes.known(data) or self._nodes.find(data)
        half = len(data) // 2
        return self.join(self.tree(data[:half]), self.tree(data[half:]))

    def _node(self, data: bytes) -> tuple[int, ...]:
        half = len(data) // 2
        return self.join(self.tree(data[:half]), self.tree(data[half:])) if half else (self.ranks[data],)

    def encode_match(self, data: bytes) -> tuple[int, ...]:
        """The ids of a match. A match that is a token as a whole is this token, even if no merges lead to it."""
        ids = self.tree(data) if data else ()
        return ids if len(ids) < 2 or (whole := self.ranks.get(data)) is None else (whole,)

    def decode(self, ids: tuple[int, ...]) -> bytes:
        if len(ids) <= FLAT:
            return b"".join([self.token[x] for x in ids])
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])

    def _leaf(self, match: str) -> tuple[int, bytes, bytes]:
        """(number of ids, ids as decimal text, bytes decoded from the ids) of one match."""
        ids = self.encode_match(match.encode())
        return len(ids), b",".join([self.decimal[x] for x in ids]), self.decode(ids)

    def leaves(self, text: str) -> list[tuple[int, bytes, bytes]]:
        """What each match of the text gives, in order; long matches are not remembered."""
        known, find, leaf = self._leaves.known, self._leaves.find, self._leaf
        return [known(m) or (find(m) if len(m) <= SCAN else leaf(m)) for m in self.find(text)]

    def forget(self) -> None:
        """Gives up all that is remembered, so that a worker that lives on holds no more than the vocabulary."""
        for memory in (self._windows, self._nodes, self._leaves):
            memory.clear()

    def encode(self, text: str) -> list[int]:
        return [int(x) for leaf in self.leaves(text) for x in leaf[1].split(b",")]


@lru_cache(maxsize=4)
def tokenizer(path: str, pattern: str) -> ByteBPE:
    """The tokenizer of a tiktoken vocabulary file (a base64 token and its rank on each line)."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}
    return ByteBPE(ranks, pattern)


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with the ids of every whole text in ``out`` (replaced if it is there). ``path`` is a vocabulary file that every
    executor has. Null and empty texts have no ids; rows may repeat; an empty table gives an empty result; other columns pass."""
    return docs.withColumn(out, _arrow_udf(lambda b, t: [b.encode(x) if x else [] for x in t], "array<int>", path, pattern)(F.col(f"`{text_col}`")))


def decode(tokens: DataFrame, path: str, pattern: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``tokens`` with the bytes that the ids stand for in ``out`` (replaced if it is there). Null and empty lists give no
    bytes; an id that the vocabulary lacks, or a null one, is an error; rows may repeat; an empty table gives an empty result."""
    return tokens.withColumn(
        out,
        _arrow_udf(lambda b, t: [b.decode(tuple(x)) if x else b"" for x in t], "binary", path, pattern)(F.col(f"`{ids_col}`")),
    )


def _arrow_udf(f, kind: str, path: str, pattern: str):
    @F.pandas_udf(kind)
    def run(column: pd.Series) -> pd.Series:
        return pd.Series(f(tokenizer(path, pattern), [None if x is None else x if isinstance(x, str) else list(x) for x in column]))

    return run


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Per row: id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of the bytes decoded from the
    ids), and the ids themselves if asked.

    A null text is empty: no tokens, and both digests are of no bytes. Rows may repeat, other columns are not read, and
    an empty table gives an empty result. Texts are encoded whole, however long.
    """

    return digests(docs, lambda: tokenizer(path, pattern), id_col, text_col, with_ids)


def digests(docs: DataFrame, load, id_col: str, text_col: str, with_ids: bool = False) -> DataFrame:
    """The rows of ``round_trip`` by the tokenizer that ``load`` gives in a worker: its ``leaves`` cut a text into matches and tell
    of each how many ids it has, the ids in decimal and the bytes decoded from them; ``forget`` gives up what it remembers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load()
        gc.disable()  # nothing here makes cycles, and what is remembered would be walked again and again
        try:
            for b in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
                n, ids, decoded, told = [], [], [], []
                for t in b.column(1):
                    found = bpe.leaves(t.as_py() or "")
                    n.append(sum([x[0] for x in found]))
                    decimal = b",".join([x[1] for x in found])
                    ids.append(hashlib.sha256(decimal).hexdigest())
                    if with_ids:
                        told.append(np.fromstring(decimal, np.int32, sep=",") if decimal else np.empty(0, np.int32))
                    decoded.append(hashlib.sha256(b"".join([x[2] for x in found])).hexdigest())
                made = [b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(
                    made + [pa.array(told, pa.list_(pa.int32()))] * with_ids,
                    names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids,
                )
        finally:  # also after an error or where no more rows are asked for: the worker lives on
            gc.enable()
            bpe.forget()
            release_memory()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(
        run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids,
    )
