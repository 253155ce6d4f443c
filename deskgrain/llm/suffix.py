"""Removal of long byte strings that repeat anywhere, by a sparse, partitioned suffix array.

Of all suffixes only anchors are kept: the rightmost smallest k-gram hash of every window of ``length`` bytes. Equal
windows choose the same anchor, so every repeated string shows as two anchors with equal leading k bytes, and an anchor
whose leading bytes occur once proves that all windows over it are unique. What is left is sorted: sampled splitters
range-partition the anchors' suffixes by their leading bytes, each bucket sorts its suffixes by multikey quicksort on
eight-byte characters, forwards from the anchor and backwards before it, and compares neighbours. Two windows at the same
offset from their anchors are equal exactly if their classes in both orders are equal, so no pair of a group is ever
listed. Before they are sorted, equal texts and, within a task, equal suffixes are combined: one of them stands for all.

Suffixes of one anchor share a bucket up to a number. A larger group is split where it lies: windows of the offsets from lo
to hi all hold the bytes that lie between the last start and the first end among them, so halving the range of offsets
lengthens these bytes, and suffixes that differ in them part. Halves go on until they are small enough for a bucket or
only one offset is left, and then the group has a single string.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, meet, release_memory, sampled, small, unused, written

#: Leading bytes of an anchor that must repeat; a power of two.
K = 32
#: Suffixes of one anchor that share a bucket at most; suffixes in a bucket, about.
GROUP, BUCKET = 20_000, 50_000
#: Texts that splitters are taken from, and leads of each.
SPLIT_TEXTS, SPLIT_LEADS = 2_000, 32
#: Bytes of a text that are looked at together.
CHUNK = 1 << 21
#: Bytes of suffixes that a task combines before it sends them on.
COMBINE = 16 << 20
#: Rows up to which a part of a quicksort is sorted at once.
CUTOFF = 2_048

LOW = np.uint64((1 << 24) - 1)
ALL = (1 << 31) - 1
_rng = np.random.default_rng(20_200)
BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.int64).astype(np.uint64)
STEP = [np.uint64(int(x) | 1) for x in _rng.integers(0, 1 << 62, 16)]


def kgram_hashes(x: np.ndarray, k: int = K) -> np.ndarray:
    """Hash of the k bytes from each position on (last axis), by doubling."""
    h, s, level = BYTE[x], 1, 0
    while s < k:
        h = h[..., :-s] * STEP[level] + h[..., s:]
        h ^= h >> np.uint64(29)
        s, level = 2 * s, level + 1
    return h


def anchors(x: np.ndarray, length: int, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a text: positions and k-gram hashes of the anchors, and the first and last window (by its start) that chose each.

    None if the text is shorter than ``length``. What a window chooses depends on its own bytes only.
    """
    n, found = len(x), []
    for c in range(0, n - length + 1, CHUNK):
        part = x[c : min(n, c + CHUNK + length - 1)]
        h = kgram_hashes(part, k)
        m = (h & ~LOW) | (LOW - np.arange(len(h), dtype=np.uint64))  # the position breaks ties: rightmost
        span, s = length - k + 1, 1
        while 2 * s <= span:
            m, s = np.minimum(m[:-s], m[s:]), 2 * s
        if span > s:
            m = np.minimum(m[: len(m) - (span - s)], m[span - s :])
        at = (LOW - (m & LOW)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        found.append((at[first] + c, h[at[first]], first + c, np.concatenate((first[1:], [len(at)])) - 1 + c))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(f) for f in zip(*found))


def _bytes(t: str | None) -> np.ndarray:
    return np.frombuffer((t or "").encode("utf-8", "surrogatepass"), np.uint8)


def multikey_order(words: np.ndarray, group: np.ndarray | None = None) -> np.ndarray:
    """Order of the rows of ``words`` (characters of eight bytes), within ``group`` if given, by multikey quicksort.

    Rows are parted by one character into those below, at and above a pivot; those at it go on to the next character.
    """
    if group is not None:
        words = np.concatenate((group.astype(np.uint64)[:, None], words), 1)
    done, open_ = [], [(np.arange(len(words)), 0)]
    while open_:
        rows, d = open_.pop()
        if len(rows) <= CUTOFF or d == words.shape[1]:
            done.append(_sorted_part(words, rows, d))
            continue
        char = words[rows, d]
        some = np.sort(char[:: max(1, len(char) // 33)])
        pivot = some[len(some) // 2]
        below, above = char < pivot, char > pivot
        open_ += [(rows[above], d), (rows[~below & ~above], d + 1), (rows[below], d)]
    return np.concatenate(done) if done else np.empty(0, np.int64)


def _sorted_part(words: np.ndarray, rows: np.ndarray, d: int) -> np.ndarray:
    """``rows`` in order of their characters from ``d`` on; only rows that tie with a neighbour look at the next one."""
    if len(rows) < 2 or d == words.shape[1]:
        return rows
    rows = rows[np.argsort(words[rows, d], kind="stable")]
    char = words[rows, d]
    seg = np.concatenate(([0], np.cumsum(char[1:] != char[:-1])))
    for e in range(d + 1, words.shape[1]):
        tied = np.concatenate(([False], seg[1:] == seg[:-1]))
        tied[:-1] |= tied[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        rows[at] = rows[at][np.lexsort((words[rows[at], e], seg[at]))]
        char = words[rows[at], e]
        cut = np.zeros(len(rows), bool)
        cut[at[1:]] = (char[1:] != char[:-1]) & (seg[at][1:] == seg[at][:-1])
        seg = seg + np.cumsum(cut)
    return rows


def _padded(data: np.ndarray, start: np.ndarray, size: np.ndarray, width: int, step: int) -> np.ndarray:
    """Row i: ``size[i]`` bytes from ``start[i]`` on (backwards for step -1), then zeros, in all ``width``."""
    at = np.arange(width)
    held = at < size[:, None]
    out = np.zeros((len(start), width), np.uint8)
    out[held] = data[(start[:, None] + step * at)[held]]
    return out


def _common(rows: np.ndarray, order: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each row with the one before it in ``order`` (0 for the first)."""
    out = np.zeros(len(order), np.int64)
    for i in range(1, len(order), 65_536):
        a, b = order[i - 1 : i + 65_535][: min(65_536, len(order) - i)], order[i : i + 65_536]
        differ = rows[a] != rows[b]
        out[i : i + len(b)] = np.minimum(np.where(differ.any(1), differ.argmax(1), rows.shape[1]), np.minimum(size[a], size[b]))
    return out


def repeats(
    data: np.ndarray, start: np.ndarray, size: np.ndarray, left: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: int,
    k: int = K,
) -> tuple[np.ndarray, np.ndarray]:
    """For each context (bytes of ``data``; ``left`` of them before the anchor) the smallest and largest offset from ``lo`` to
    ``hi``, from the start of a window to the anchor, of windows of ``length`` bytes that occur in another context too;
    (length, -1) if none. A context stands once for each offset at most."""
    n = len(start)
    lowest, highest = np.full(n, length), np.full(n, -1)
    if n < 2:
        return lowest, highest
    right = size - left
    fore = _padded(data, start + left, right, -(-length // 8) * 8, 1)
    order = multikey_order(fore.view(">u8").astype(np.uint64))
    ahead = _common(fore, order, right)
    group = np.empty(n, np.int64)
    group[order] = np.cumsum(ahead < k)
    rear = _padded(data, start + left - 1, left, -(-(length - k) // 8) * 8, -1)
    back = multikey_order(rear.view(">u8").astype(np.uint64), group)
    behind = _common(rear, back, left)
    behind[1:][group[back][1:] != group[back][:-1]] = -1
    behind[0] = -1
    shared = np.bincount(group, minlength=n + 1)[group] > 1
    cls_r, cls_l = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(length - k + 1):
        rows = np.flatnonzero(shared & (left >= o) & (right >= length - o) & (lo <= o) & (o <= hi))
        if len(rows) < 2:
            continue
        cls_r[order] = np.cumsum(ahead < length - o)
        cls_l[back] = np.cumsum(behind < o)
        key = cls_r[rows] * (n + 1) + cls_l[rows]
        by = np.argsort(key)
        key = key[by]
        same = np.concatenate(([False], key[1:] == key[:-1]))
        same[:-1] |= same[1:]
        hit = rows[by[same]]
        lowest[hit] = np.minimum(lowest[hit], o)
        highest[hit] = o
    return lowest, highest


def _anchor_rows(texts: DataFrame, length: int) -> DataFrame:
    """(kh, t, pos) of all anchors of ``texts`` (t1, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hs, ts, ps = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for t, text in zip(b.column(0).to_pylist(), b.column(1)):
                p, h, _, _ = anchors(_bytes(text.as_py()), length)
                hs.append(h), ps.append(p), ts.append(np.full(len(p), t))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(hs).view(np.int64)), pa.array(np.concatenate(ts)), pa.array(np.concatenate(ps).astype(np.int32))],
                names=["kh", "t", "pos"],
            )
        release_memory()

    return texts.select(F.col("t1").alias("t"), "text").mapInArrow(run, "kh long, t long, pos int")


SHIPPED = "kind int, bucket int, t1 long, t2 long, a int, b int, lo int, hi int, ctx binary"
COVER, CONTEXT, LARGE = 0, 1, 2


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    names = [f.split(" ")[0] for f in SHIPPED.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def _lead(raw: bytes, p: int) -> int:
    return int.from_bytes(raw[p : p + 8], "big")


def _contexts(length: int, splitters: np.ndarray, buckets: int):
    """Maps (t1, t2, text, common, large) to what must be compared: contexts with the bucket of their lead, those of anchors
    with too many, both combined within the task, and cover that is already certain."""

    def flush(held: dict) -> Iterator[pa.RecordBatch]:
        out = []
        for (ctx, left), (t1, t2, p, single, large) in held.items():
            bucket = t1 % buckets if large else int(np.searchsorted(splitters, np.uint64(_lead(ctx, left)), "right"))
            out.append((LARGE if large else CONTEXT, bucket, t1, t2, p, left if single else -1 - left, 0, length - K, ctx))
            if len(out) >= 10_000:
                yield _rows(out)
                out = []
        if out:
            yield _rows(out)
        held.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[bytes, int], list] = {}
        size = 0
        for batch in batches:
            sure: list[tuple] = []
            for t1, t2, text, common, large in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), *batch.columns[2:]):
                x = _bytes(text.as_py())
                pos, _, first, last = anchors(x, length)
                many, raw = set(large.as_py()), x.tobytes()

                def cover(t1, t2, a, b):
                    sure.append((COVER, t1 % buckets, t1, t2, a, b, 0, 0, None))

                # a context holds the windows that chose the anchor: an equal window has chosen an equal anchor
                for i in np.flatnonzero(np.isin(pos, np.asarray(common.values))):
                    p, a, b = int(pos[i]), int(first[i]), int(last[i]) + length
                    key = raw[a:b], p - a
                    if (v := held.get(key)) is None:
                        held[key] = [t1, t2, p, True, p in many]
                        size += b - a
                    else:  # at least two occurrences here: all are certain, and only the context goes on
                        if v[3]:
                            cover(v[0], v[1], v[2] - key[1], v[2] - key[1] + b - a)
                            v[3] = False
                        cover(t1, t2, a, b)
                    if len(sure) >= 10_000:
                        yield _rows(sure)
                        sure.clear()
                    if size > COMBINE:
                        yield from flush(held)
                        size = 0
            if sure:
                yield _rows(sure)
        yield from flush(held)
        release_memory()

    return run


def _buckets(length: int):
    """Compares the contexts of a bucket; all else passes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for b in batches:
            is_context = np.asarray(b.column(0)) == CONTEXT
            if not is_context.all():
                yield b.filter(pa.array(~is_context))
            if is_context.any():
                held.append(b.filter(pa.array(is_context)))
        if not held:
            return
        c = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        t1, t2, pos, b, lo, hi = (np.asarray(c.column(i)).astype(np.int64) for i in (2, 3, 4, 5, 6, 7))
        single, left = b >= 0, np.where(b >= 0, b, -1 - b)
        ctx = c.column(8).chunk(0)
        bounds = np.frombuffer(ctx.buffers()[1], np.int32)[ctx.offset : ctx.offset + len(ctx) + 1].astype(np.int64)
        lowest, highest = repeats(np.frombuffer(ctx.buffers()[2], np.uint8), bounds[:-1], np.diff(bounds), left, lo, hi, length)
        hit = np.flatnonzero(single & (highest >= 0))
        n = len(hit)
        made = [np.full(n, COVER), np.zeros(n), t1[hit], t2[hit], (pos - highest)[hit], (pos - lowest + length)[hit], np.zeros(n), np.zeros(n)]
        cast = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
        yield pa.RecordBatch.from_arrays(
            [*[pa.array(x.astype(k.to_pandas_dtype())) for x, k in zip(made, cast)], pa.nulls(n, pa.binary())],
            names=c.schema.names,
        )
        release_memory()

    return run


def _halves(length: int):
    """Contexts with the range of their offsets cut in two: k1 and k2 name the bytes that all windows of a half hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, lows, highs, k1, k2 = [], [], [], [], []
            left = np.asarray(batch.column(5))
            left = np.where(left >= 0, left, -1 - left).tolist()
            for i, (lo, hi, ctx) in enumerate(zip(batch.column(6).to_pylist(), batch.column(7).to_pylist(), batch.column(8).to_pylist())):
                mid = (lo + hi) // 2
                for low, high in ((lo, mid), (mid + 1, hi)):
                    start, end = left[i] - low, left[i] - high + length
                    if low > high or start < 0 or end > len(ctx):
                        continue  # no window of the half lies within the context
                    d = hashlib.blake2b(low.to_bytes(4, "big") + ctx[start:end], digest_size=16).digest()
                    row.append(i), lows.append(low), highs.append(high)
                    k1.append(int.from_bytes(d[:8], "big", signed=True)), k2.append(int.from_bytes(d[8:], "big", signed=True))
            took = batch.take(pa.array(row, pa.int64()))
            cols = [
                *[took.column(i) for i in range(6)], pa.array(lows, pa.int32()), pa.array(highs, pa.int32()), took.column(8),
                pa.array(k1, pa.int64()), pa.array(k2, pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names, "k1", "k2"])

    return run


def _split(large: DataFrame, length: int, group: int, buckets: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """(contexts in groups of at most ``group``, cover) of contexts that are too many for a bucket."""
    fit, cover = [], []
    while True:
        parts = written(large.mapInArrow(_halves(length), SHIPPED + ", k1 long, k2 long"), "halved-suffixes")
        sizes = written(parts.groupBy("k1", "k2").agg(F.count("*").alias("n")).where("n > 1"), "half-sizes")
        few = parts.join(small(sizes.where(F.col("n") <= group).select("k1", "k2")), ["k1", "k2"], "left_semi")
        fit.append(few.withColumn("kind", F.lit(CONTEXT)).withColumn("bucket", F.pmod("k1", F.lit(buckets)).cast("int")).drop("k1", "k2"))
        many = parts.join(small(sizes.where(F.col("n") > group).select("k1", "k2")), ["k1", "k2"], "left_semi").drop("k1", "k2")
        # one offset left: all windows of the group are the same string
        same = F.col("lo") == F.col("hi")
        left = F.when(F.col("b") >= 0, F.col("b")).otherwise(-1 - F.col("b"))
        cover.append(
            many.where(same & (F.col("b") >= 0)).select(
                "t1", "t2", (F.col("a") - F.col("lo")).alias("a"), (F.col("a") - F.col("lo") + length).alias("b"),
            )
        )
        large = many.where(~same)
        if not sizes.where(F.col("n") > group).limit(1).count():
            return fit, cover


def _splitters(texts: DataFrame, place: DataFrame, buckets: int) -> np.ndarray:
    """Leads that part the anchors of ``place`` evenly, from those of a bounded sample of texts."""
    some = sampled(place, F.xxhash64("t1", F.lit(3)), place.count(), SPLIT_TEXTS).orderBy(F.xxhash64("t1", F.lit(3))).limit(SPLIT_TEXTS)
    held = texts.join(F.broadcast(some.select("t1", "common")), "t1").groupBy("t1").agg(
        F.any_value("text").alias("text"), F.any_value("common").alias("common"),
    )

    def leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for text, common in zip(b.column(0), b.column(1)):
                raw, at = (text.as_py() or "").encode("utf-8", "surrogatepass"), sorted(common.as_py())
                found += [_lead(raw, p) - (1 << 63) for p in at[:: -(-len(at) // SPLIT_LEADS)]]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["lead"])

    found = held.select("text", "common").mapInArrow(leads, "lead long").toArrow().column(0).to_numpy()
    found = np.sort(found.astype(np.int64).view(np.uint64) + np.uint64(1 << 63))
    return found[(np.arange(1, buckets) * len(found)) // buckets] if len(found) else np.empty(0, np.uint64)


def covered(texts: DataFrame, length: int, group: int = GROUP) -> DataFrame:
    """(t1, t2, spans): for each text, named by two hashes, the byte spans (a, b) under a string of ``length`` bytes that
    starts elsewhere too. ``texts`` has t1, t2 and text."""
    spark = texts.sparkSession
    rows = written(_anchor_rows(texts, length), "anchors")
    # copies of a text have their anchors at the same places: only different places count
    v = F.xxhash64("t", "pos")
    common = rows.groupBy("kh").agg(F.min(v).alias("lo"), F.max(v).alias("hi"), F.count("*").alias("n")).where("lo != hi").select("kh", "n")
    common = written(common, "common-anchors")
    found = meet(rows, common, "kh", "n", rows.count())
    place = found.groupBy(F.col("t").alias("t1")).agg(
        F.collect_set("pos").alias("common"), F.collect_set(F.when(F.col("n") > group, F.col("pos"))).alias("large"),
    )
    place = written(place, "anchor-places")
    total = place.agg(F.coalesce(F.sum(F.size("common")), F.lit(0))).first()[0]
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET))
    splitters = _splitters(texts, place, buckets)
    distinct = texts.groupBy("t1", "t2").agg(F.any_value("text").alias("text"), F.count("*").alias("n"))
    shipped = distinct.join(place, "t1").select("t1", "t2", "text", "common", "large").mapInArrow(_contexts(length, splitters, buckets), SHIPPED)
    compared = written(shipped.repartitionById(buckets, "bucket").mapInArrow(_buckets(length), SHIPPED), "compared-suffixes")
    cover = [compared.where(f"kind = {COVER}").select("t1", "t2", "a", "b")]
    large = compared.where(f"kind = {LARGE}")
    if large.limit(1).count():
        fit, sure = _split(large, length, group, buckets)
        again = reduce(DataFrame.unionByName, fit).select(*[f.split(" ")[0] for f in SHIPPED.split(", ")])
        more = written(again.repartitionById(buckets, "bucket").mapInArrow(_buckets(length), SHIPPED), "compared-suffixes")
        cover += [*sure, more.select("t1", "t2", "a", "b")]
    copies = texts.groupBy("t1", "t2").agg(F.count("*").alias("n")).where("n > 1").select("t1", "t2", F.lit(0).alias("a"), F.lit(ALL).alias("b"))
    return reduce(DataFrame.unionByName, [*cover, copies]).groupBy("t1", "t2").agg(F.collect_set(F.struct("a", "b")).alias("spans"))


def merge_spans(spans: np.ndarray, n: int, length: int) -> np.ndarray:
    """Maximal runs of the union of ``spans`` in a text of n bytes, in order. The span (0, ALL) stands for a whole text."""
    if n < length or not len(spans):
        return np.empty((0, 2), np.int64)
    spans = np.minimum(spans[np.argsort(spans[:, 0], kind="stable")], n)
    end = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate(([True], spans[1:, 0] > end[:-1]))
    return np.stack((spans[new, 0], end[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(end) - 1]))]), 1)


def _names(text) -> list:
    """Two hashes that together stand for a text (128 bits); copies share both."""
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]


def _with_spans(docs: DataFrame, text_col: str, length: int, group: int) -> tuple[DataFrame, str]:
    """(``docs`` with the spans of every text, the name of their column)."""
    text = F.col(f"`{text_col}`")
    texts = docs.where(F.octet_length(text) >= length).select(*_names(text), text.alias("text"))
    spans, t1, t2 = unused(docs.columns, "spans", "t1", "t2")
    found = covered(texts, length, group).select(F.col("t1").alias(t1), F.col("t2").alias(t2), F.col("spans").alias(spans))
    own = docs.select(*columns(docs), *[c.alias(n) for c, n in zip(_names(text), (t1, t2))])
    return own.join(found, [t1, t2], "left").drop(t1, t2), spans


def _cut(text: str | None, spans, length: int) -> tuple[bytes, int, np.ndarray]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    flat = np.array([(s["a"], s["b"]) for s in spans], np.int64).reshape(-1, 2) if spans is not None and len(spans) else np.empty((0, 2), np.int64)
    runs = merge_spans(flat, len(raw), length)
    if not len(runs):
        return raw, len(raw), runs
    edge = [0, *runs.ravel().tolist(), len(raw)]
    return b"".join(raw[edge[i] : edge[i + 1]] for i in range(0, len(edge), 2)), len(raw), runs


def dedup_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, group: int = GROUP) -> DataFrame:
    """One row for each row of ``docs``: id, n_bytes, n_removed, n_spans, kept_sha256.

    Removed is every byte under a string of ``length`` bytes that also starts anywhere else, in the same text or another,
    judged on the input. Null texts are empty; texts shorter than ``length`` lose nothing; rows may repeat (then each is
    a copy of the other and loses all); an empty table gives an empty result; other columns are not read. Texts are told
    apart by hashes of 128 bits together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, gone, spans, sha = [], [], [], []
            for text, s in zip(b.column(1), b.column(2)):
                kept, size, runs = _cut(text.as_py(), s.as_py(), length)
                n.append(size), gone.append(size - len(kept)), spans.append(len(runs)), sha.append(hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())],
                names=[id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )
        release_memory()

    kind = docs.schema[id_col].dataType.simpleString()
    rows, found = _with_spans(docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")), text_col, length, group)
    return rows.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), found).mapInArrow(
        run, f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string",
    )


def dedup(docs: DataFrame, text_col: str = "text", length: int = 200, group: int = GROUP) -> DataFrame:
    """``docs`` with the repeated strings cut from ``text_col``; characters that a cut splits are dropped.

    Null stays null; shorter texts than ``length`` stay as they are; rows that repeat are copies of each other and lose all; a
    text may become empty; an empty table stays empty; all other columns pass, whatever their names."""

    @F.pandas_udf("string")
    def kept(text, spans):
        import pandas as pd

        made = pd.Series([None if t is None else _cut(t, s, length)[0].decode("utf-8", "ignore") for t, s in zip(text, spans)])
        release_memory()
        return made

    rows, found = _with_spans(docs, text_col, length, group)
    return rows.select(*[(kept(c, F.col(found)) if n == text_col else c).alias(n) for n, c in zip(docs.columns, columns(docs))])
