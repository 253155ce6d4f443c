"""BPE encoding by dynamic programming over prefixes, and decoding.

The encoding of a prefix ends with one certain token. A token that is a suffix of the prefix is that token exactly if it may
follow the last token of what stands before it, that is if encoding the bytes of both together gives just these two. So one
pass over the bytes, with the vocabulary's matches from a suffix automaton, stores the last token of every prefix, and the
back-pointers from the end give the ids; no merge is carried out on a text.

Whether two tokens may follow each other is read from how they are merged. Until a certain merge, the last part of the left
token and the first part of the right one stay as they are; the two are torn apart if some pair of such parts has a merge
that comes while both are there. Among equal merges the leftmost comes first.
"""

from __future__ import annotations

import json
from array import array
from functools import lru_cache

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import SCAN, digests
from .common import Memory

#: The place in the order of merges of what is never merged any more.
NEVER = 1 << 60
#: Matches, and pairs of tokens, that a worker remembers in each of two generations (some 300 bytes each).
HELD = 200_000


def alphabet() -> dict[str, int]:
    """The byte of each character in which byte-level vocabularies are written: visible Latin-1 characters stand for
    themselves, other bytes in order for the characters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}


class PrefixBPE:
    """Encoder and decoder for a byte-level BPE tokenizer as the tokenizers library describes it in JSON."""

    def __init__(self, spec: dict, pattern: str):
        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        if model["type"] != "BPE" or not plain or spec.get("normalizer") or split.get("type") != "ByteLevel" or split["add_prefix_space"]:
            raise ValueError("only byte-level BPE without normalizer, prefix space, dropout and word ends is supported")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that take in what stands beside them are not supported")
        byte = alphabet()
        self.token = {i: bytes([byte[c] for c in t]) for t, i in model["vocab"].items()}
        self.made: dict[int, tuple[int, int, int]] = {}  # id -> left part, right part, place of the merge
        self.merge: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            left, right, whole = model["vocab"][a], model["vocab"][b], model["vocab"][a + b]
            if whole in self.made or len(a) > 1 and left not in self.made or len(b) > 1 and right not in self.made:
                raise ValueError("each token must come from one merge, of parts that earlier merges made")
            self.made[whole], self.merge[left, right] = (left, right, rank), rank
        self.matches = ahocorasick.Automaton()
        for i, t in self.token.items():
            self.matches.add_word(t.decode("latin-1"), (i, len(t)))
        self.matches.make_automaton()
        self.decimal = {i: str(i).encode() for i in self.token}
        self.size = {i: len(t) for i, t in self.token.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token |= {i: t.encode() for t, i in self.special.items()}
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or "(?!)").finditer
        self.find = regex.compile(pattern).findall
        self._edges: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self._pairs, self._wholes, self._leaves = Memory(self._follows, HELD), Memory(self._stands), Memory(self._leaf, HELD)

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The parts that stand at one side of a token while it is made (0: left, 1: right), each with the merge that ends it."""
        found = self._edges.get((token, side))
        if found is None:
            found, part, ends = [], token, NEVER
            while part in self.made:
                found.append((part, ends))
                ends, part = self.made[part][2], self.made[part][side]
            found.append((part, ends))
            self._edges[token, side] = found  # two for each token of the vocabulary at most
        return found

    def _torn(self, a: int, b: int, but: tuple[int, int] | None = None) -> bool:
        """Whether encoding the bytes of both tokens together merges a part of one with a part of the other (``but`` aside)."""
        first, merge = self._edge(b, 0), self.merge.get
        for x, x_ends in self._edge(a, 1):
            for y, y_ends in first:
                rank = merge((x, y))
                if rank is not None and rank < x_ends and rank <= y_ends and (x, y) != but:
                    return True
        return False

    def _follows(self, pair: int) -> bool:
        """Whether encoding the bytes of two tokens (the left one in the high bits) together gives just these two."""
        return not self._torn(pair >> 32, pair & 0xFFFFFFFF)

    def _stands(self, token: int) -> bool:
        """Whether encoding the bytes of a token gives this token."""
        if token not in self.made:
            return True
        a, b, _ = self.made[token]
        return self.stands(a) and self.stands(b) and not self._torn(a, b, (a, b))

    def stands(self, token: int) -> bool:
        found = self._wholes.known(token)
        return self._wholes.find(token) if found is None else found

    def encode_match(self, data: bytes) -> list[int]:
        """The ids of one match of the pattern."""
        n = len(data) + 1
        last = array("i", [-1]) * n if n > SCAN else [-1] * n  # last[i]: the last token of the encoding of the first i bytes
        known, find = self._pairs.known, self._pairs.find
        for end, (token, size) in self.matches.iter(data.decode("latin-1")):
            end += 1
            if last[end] >= 0:
                continue
            if start := end - size:
                pair = last[start] << 32 | token
                fits = known(pair)
                if fits is None:
                    fits = find(pair)
            else:
                fits = self.stands(token)
            if fits:
                last[end] = token
        ids, at, size = [], len(data), self.size
        while at:
            ids.append(token := last[at])
            at -= size[token]
        return ids[::-1]

    def _leaf(self, match: str) -> tuple[int, bytes, bytes]:
        """(number of ids, ids as decimal text, bytes decoded from the ids) of one match."""
        ids = self.encode_match(match.encode())
        return len(ids), b",".join([self.decimal[x] for x in ids]), self.bytes_of(ids)

    def leaves(self, text: str) -> list[tuple[int, bytes, bytes]]:
        """What each match of the text gives, in order, special tokens among them; long matches are not remembered."""
        known, find, leaf, out, at = self._leaves.known, self._leaves.find, self._leaf, [], 0
        for m in self.cut(text) if self.special else ():
            out += [known(x) or (find(x) if len(x) <= SCAN else leaf(x)) for x in self.find(text, at, m.start())]
            i = self.special[m.group()]
            out.append((1, str(i).encode(), self.token[i]))
            at = m.end()
        return out + [known(x) or (find(x) if len(x) <= SCAN else leaf(x)) for x in self.find(text[at:] if at else text)]

    def encode(self, text: str) -> list[int]:
        return [int(x) for leaf in self.leaves(text) for x in leaf[1].split(b",")]

    def bytes_of(self, ids) -> bytes:
        """The bytes of ids in order; ids that the vocabulary lacks give none, as in the library."""
        return b"".join([self.token.get(x, b"") for x in ids])

    def forget(self) -> None:
        """Gives up all that is remembered, so that a worker that lives on holds no more than the vocabulary."""
        for memory in (self._pairs, self._wholes, self._leaves, self._edges):
            memory.clear()


@lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str) -> PrefixBPE:
    """The tokenizer of a JSON file of the tokenizers library; ``pattern`` is the one that its byte-level splitting stands for."""
    with open(path, encoding="utf-8") as f:
        return PrefixBPE(json.load(f), pattern)


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with the ids of every whole text in ``out`` (replaced if it is there). ``path`` is a tokenizer file that every
    executor has; special tokens in a text become their ids. Null and empty texts have no ids; rows may repeat; an empty
    table gives an empty result; other columns pass."""

    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        bpe = tokenizer(path, pattern)
        return pd.Series([bpe.encode(t) if t else [] for t in texts])

    return docs.withColumn(out, run(F.col(f"`{text_col}`")))


def decode(tokens: DataFrame, path: str, pattern: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``tokens`` with the text that the ids stand for in ``out`` (replaced if it is there), special tokens included. Null and
    empty lists give an empty text, null ids and ids that the vocabulary lacks nothing, bytes that are no UTF-8 U+FFFD; rows may
    repeat; an empty table gives an empty result."""

    @F.pandas_udf("string")
    def run(lists: pd.Series) -> pd.Series:
        bpe = tokenizer(path, pattern)
        return pd.Series([bpe.bytes_of([] if x is None else x).decode("utf-8", "replace") for x in lists])

    return tokens.withColumn(out, run(F.col(f"`{ids_col}`")))


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Per row: id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of the UTF-8 of the text decoded
    from the ids), and the ids themselves if asked.

    A null text is empty: no tokens, and both digests are of no bytes. Rows may repeat, other columns are not read, and
    an empty table gives an empty result. Texts are encoded whole, however long.
    """
    return digests(docs, lambda: tokenizer(path, pattern), id_col, text_col, with_ids)
