"""Importance resampling of documents towards a target distribution.

Documents and targets are bags of hashed features (runs of words), counted over whole tables in a fixed number of buckets. A
bucket's gain is the log ratio of its shares in both; a document's weight is the mean gain of its features, looked up in an
array; Gumbel noise that depends on the id alone turns taking the highest scores into sampling without replacement.

The cutoff among the scores is found by weighted medians of medians, without a sort: every partition gives the median of the keys
it still has in play, and how many these are. The weighted median of these medians has at least a quarter of all keys in play on
each side, so whichever side the cutoff is not on goes. A pass counts both sides of a pivot and takes the medians of both, so
that the next pivot is known from the same pass. Only the winners are sorted.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused, written

#: Buckets, bits of the fixed unit of gains (thousandths), words that a document needs to be drawn.
BUCKETS, UNIT, LEAST_WORDS = 10_000, 1000, 20
#: Bytes of text whose words are held at once.
BLOCK = 1 << 20
#: A row that no key follows: the place of null ids behind all others.
LAST = (1 << 63) - 1

#: Words of lower-cased UTF-8: digits, a-z and all bytes of characters outside ASCII.
_words = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
#: What ends a word, in bytes that are not lower-cased yet.
_gap = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]").search
_lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def _blocks(data: bytes) -> Iterator[bytes]:
    """The text in blocks that end where no word goes on."""
    at = 0
    while at < len(data):
        cut = _gap(data, at + BLOCK)
        end = cut.end() if cut else len(data)
        yield data[at:end].translate(_lower)
        at = end


def _hashes(data: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """For each block of a text its number of words and the buckets of its words and of its pairs of neighbouring words."""
    before = None  # the hash of the last word so far, with the space behind it
    for block in _blocks(data):
        words = _words(block)
        if not words:
            continue
        single = list(map(crc32, words))
        spaced = list(map(crc32, repeat(b" "), single))
        leads = spaced[:-1] if before is None else [before, *spaced[:-1]]
        double = list(map(crc32, words[1:] if before is None else words, leads))
        before = spaced[-1]
        yield len(words), np.array(single + double, np.int64) % BUCKETS


def _texts(column: pa.Array) -> Iterator[bytes]:
    for t in column.cast(pa.binary()):
        yield t.as_py() or b""


def feature_counts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """How many features of all texts fall into each bucket: bucket int, n long (buckets of none are absent).

    Each task counts its own rows into one array, so at most BUCKETS rows of a task move. Null and empty texts have no features,
    whole texts are read in blocks, repeated rows count each time, and an empty table gives an empty result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for data in _texts(b.column(0)):
                for _, buckets in _hashes(data):
                    seen += np.bincount(buckets, minlength=BUCKETS)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[at])], names=["bucket", "n"])

    counts = texts.select(F.col(f"`{text_col}`")).mapInArrow(run, "bucket int, n long")
    return counts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text_col: str = "text", target_col: str = "text") -> np.ndarray:
    """The gain of every bucket in thousandths: the log of its smoothed share in ``target`` over that in ``docs``.

    BUCKETS numbers a table reach the driver, whatever the tables hold. Two empty tables give no gains."""
    held = []
    for counts in (feature_counts(docs, text_col), feature_counts(target, target_col)):
        n = np.zeros(BUCKETS, np.int64)
        for bucket, many in counts.collect():
            n[bucket] = many
        held.append(n.tolist())
    (s, t), (all_s, all_t) = held, map(sum, held)
    ratio = [(b + 1.0) * (all_s + BUCKETS) / ((a + 1.0) * (all_t + BUCKETS)) for a, b in zip(s, t)]
    return np.array([math.floor(UNIT * math.log(r)) for r in ratio], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, text_col: str = "text", out: tuple[str, str, str] = ("n_words", "n_features", "weight")) -> DataFrame:
    """``docs`` with each text's number of words and of features and the floored mean of its features' gains (0 if it has none),
    in columns ``out``. The text itself does not pass; rows are handled one by one as in ``feature_counts``."""
    rest = [c for c in docs.columns if c != text_col]
    given = docs.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text_col}`"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, features, weights = [], [], []
            for data in _texts(b.column(len(rest))):
                n = m = total = 0
                for many, buckets in _hashes(data):
                    n, m, total = n + many, m + len(buckets), total + int(gain[buckets].sum())
                words.append(n)
                features.append(m)
                weights.append(total // m if m else 0)
            made = [pa.array(x, pa.int64()) for x in (words, features, weights)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(rest)], *made], names=[*rest, *out])

    schema = docs.select(*[F.col(f"`{c}`") for c in rest]).schema
    for c in out:
        schema = schema.add(c, "long")
    return given.mapInArrow(run, schema)


def noise(id_col: str, seed: int) -> Column:
    """Gumbel noise in thousandths that depends on the seed and the id alone (a null id counts as an empty one)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-UNIT * F.log(-F.log((h + 0.5) / 4294967296.0)))


def _median(keys: np.ndarray) -> tuple[int, int] | None:
    """The upper median of keys (two columns) in their order, found by selection on the first column and then on the second."""
    if not len(keys):
        return None
    k = len(keys) // 2
    first = np.partition(keys[:, 0], k)[k]
    second = keys[keys[:, 0] == first, 1]
    k -= int((keys[:, 0] < first).sum())
    return int(first), int(np.partition(second, k)[k])


def _pass(keys: DataFrame, low, high, pivot):
    """One row a partition: of the keys in play, how many come before the pivot, are the pivot and come after it, and the
    medians of those before and of those after. Keys in play are greater than ``low`` and less than ``high``."""

    def order(k: np.ndarray, than: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
        same = k[:, 0] == than[0]
        return (k[:, 0] < than[0]) | same & (k[:, 1] < than[1]), same & (k[:, 1] == than[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for b in batches:
            k = np.column_stack([b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)])
            if low is not None:
                before, same = order(k, low)
                k = k[~(before | same)]
            if high is not None:
                k = k[order(k, high)[0]]
            held.append(k)
        k = np.concatenate(held) if held else np.empty((0, 2), np.int64)
        if pivot is None:
            sides = k, k[:0]
            same = 0
        else:
            before, equal = order(k, pivot)
            sides, same = (k[before], k[~(before | equal)]), int(equal.sum())
        row = [len(sides[0]), same, len(sides[1])]
        for side in sides:
            row += _median(side) or (None, None)
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in row], names=["b", "e", "a", "b1", "b2", "a1", "a2"])

    # rows that lie outside by their scores alone need not reach Python, and Parquet skips the groups that hold no others
    if low is not None:
        keys = keys.where(F.col("k1") >= low[0])
    if high is not None:
        keys = keys.where(F.col("k1") <= high[0])
    return keys.mapInArrow(run, "b long, e long, a long, b1 long, b2 long, a1 long, a2 long")


def cutoff(keys: DataFrame, rank: int) -> tuple[int, int] | None:
    """The key of the given rank (from 1) among ``keys`` (k1, k2 long, none null), or None if there are fewer.

    ``keys`` is read about log(n) times, so it should be a written table. A pass brings one row a partition to the driver."""

    def middle(rows, side: str) -> tuple[int, int] | None:
        """The weighted median of the partitions' medians on one side of the pivot."""
        found = sorted(((r[side + "1"], r[side + "2"]), r[side]) for r in rows if r[side])
        half, total = 0, sum(n for _, n in found)
        for key, n in found:
            half += n
            if 2 * half >= total:
                return key
        return None

    low = high = None
    rows = _pass(keys, None, None, None).collect()
    if rank < 1 or rank > sum(r["b"] for r in rows):
        return None
    pivot = middle(rows, "b")
    while True:
        rows = _pass(keys, low, high, pivot).collect()
        before, same = sum(r["b"] for r in rows), sum(r["e"] for r in rows)
        if rank <= before:
            high, pivot = pivot, middle(rows, "b")
        elif rank <= before + same:
            return pivot
        else:
            low, rank, pivot = pivot, rank - before - same, middle(rows, "a")


def drawn(scored: DataFrame, percent: int, id_col: str = "doc_id", out: str = "rank") -> DataFrame:
    """``scored`` (id, n_words, score) with the rank of each drawn row in ``out``: of the N rows of LEAST_WORDS words or more the
    floor of ``percent`` N/100 highest scores, ties to the smaller id (null last); null for all others.

    Rows that share score and id are drawn until the number is full. ``scored`` should be a written table."""
    k1, k2 = -F.col("score"), F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LAST))
    able = F.col("n_words") >= LEAST_WORDS
    keys = scored.where(able).select(k1.alias("k1"), k2.alias("k2"))
    most = percent * keys.count() // 100
    cut = cutoff(keys, most)
    none = scored.withColumn(out, F.lit(None).cast("long"))
    if cut is None:
        return none
    wins = able & ((k1 < cut[0]) | (k1 == cut[0]) & (k2 <= cut[1]))
    place, task = unused(scored.columns, "place", "task")
    # a global sort deals ranges of keys to tasks; a row's rank is its place in its task behind all rows of earlier tasks
    winners = scored.where(wins).orderBy(k1, k2, *[F.col(f"`{c}`") for c in scored.columns]).withColumn(place, F.monotonically_increasing_id())
    winners = written(winners, "winners").withColumn(task, F.shiftright(place, 33))
    upto, starts = 0, []
    for t, n in sorted(winners.groupBy(task).count().collect()):  # one row for each task of the sort
        starts.append((t, upto))
        upto += n
    starts = scored.sparkSession.createDataFrame(starts, f"{task} long, start long")
    rank = F.col("start") + F.col(place).bitwiseAND((1 << 33) - 1) + 1
    ranked = winners.join(F.broadcast(starts), task).withColumn(out, F.when(rank <= most, rank)).select(*none.columns)
    return none.where(~wins).unionByName(ranked)


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 25, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
) -> DataFrame:
    """Every document's id, n_words, n_features, weight, score and rank, all long but the id: the rank is that among the rows
    drawn towards the texts of ``target``, best first, and null for rows not drawn.

    Null and empty texts have no features and weight 0 and are never drawn; nor are texts of under LEAST_WORDS words. Ids are
    whole numbers; ties go to the smaller, nulls last. Rows may repeat, each stands for itself; other columns are not read; whole
    texts count, however long. Without documents the result is empty; without target texts all gains are those of smoothing.
    """
    weight = weighed(docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")), gains(docs, target, text_col, target_col), text_col)
    scored = written(weight.withColumn("score", F.col("weight") + noise(id_col, seed)), "scored")
    return drawn(scored, percent, id_col)
