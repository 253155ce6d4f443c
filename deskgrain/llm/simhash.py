"""SimHash near-duplicates: fingerprints of word shingles, compared exactly tile against tile.

Distinct fingerprints are dealt into tiles by their number of set bits. Two fingerprints that differ in at most R bits
have bit counts that differ by at most R, so only tiles of such counts meet; a tile pair is compared whole with
exclusive-or and bit counts in numpy, again skipping pairs of sub-tiles whose counts in the upper and the lower half
differ too much. A tile pair returns a spanning forest of the links it found, never all its links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import meet, release_memory, written
from .graph import connected_components, union

SEED = 42
#: Fingerprints in a tile: at least, at most.
TILE = (8_192, 65_536)
SUB = 512
#: Tile pairs that a task compares, about.
PAIRS = 16


def fingerprint(text: bytes, words: int = 4) -> int:
    """64-bit SimHash of the shingles of ``words`` words, repeats included; 0 without a word."""
    found = text.lower().split()  # bytes: A-Z only, and exactly the six ASCII white-space characters
    if not found:
        return 0
    if len(found) <= words:
        h = np.array([xxhash.xxh64_intdigest(b" ".join(found), SEED)], np.uint64)
    else:
        line = b" ".join(found)
        end = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
        start = np.concatenate(([0], end[:-words])).tolist()
        digest = xxhash.xxh64_intdigest
        h = np.array([digest(line[s:e], SEED) for s, e in zip(start, (end[words - 1 :] - 1).tolist())], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 65_536):
        ones += np.unpackbits(h[i : i + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(id, fp long) of every document; a null text has no words, so its fingerprint is 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.encode("utf-8", "surrogatepass"), words) if t else 0 for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])
        release_memory()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"id {kind}, fp long")


def near(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest (values, roots) of the links between ``a`` and ``b`` (of ``a`` with itself if ``same``)."""
    a = _ordered(a)
    b = a if same else _ordered(b)
    both = a if same else np.concatenate((a, b))
    shift = 0 if same else len(a)
    label = np.arange(len(both))
    boxes_a, boxes_b = _boxes(a), _boxes(b)
    for k, i in enumerate(range(0, len(a), SUB)):
        gap = sum(np.maximum(0, np.maximum(boxes_b[0][d] - boxes_a[1][d][k], boxes_a[0][d][k] - boxes_b[1][d])) for d in (0, 1))
        for m in np.flatnonzero(gap <= radius):
            if same and m < k:
                continue
            j = m * SUB
            x, y = np.nonzero(np.bitwise_count(a[i : i + SUB, None] ^ b[None, j : j + SUB]) <= radius)
            if len(x):
                union(label, x + i, y + j + shift)
    moved = np.flatnonzero(label != np.arange(len(label)))
    return both[moved], both[label[moved]]


def _ordered(x: np.ndarray) -> np.ndarray:
    return x[np.argsort(np.bitwise_count(x >> np.uint64(32)), kind="stable")]


def _boxes(x: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Smallest and largest bit counts of the upper and lower halves of each sub-tile."""
    at = np.arange(0, len(x), SUB)
    halves = [np.bitwise_count(x >> np.uint64(32)).astype(np.int64), np.bitwise_count(x & np.uint64(0xFFFFFFFF)).astype(np.int64)]
    return [np.minimum.reduceat(h, at) for h in halves], [np.maximum.reduceat(h, at) for h in halves]


def links(distinct: DataFrame, radius: int = 4) -> DataFrame:
    """(src, dst): a spanning forest, tile pair by tile pair, of all links between the fingerprints of ``distinct`` (fp, pc)."""
    counts = {r["pc"]: r["n"] for r in distinct.groupBy("pc").agg(F.count("*").alias("n")).collect()}  # 65 rows at most
    if not counts:
        return distinct.select(F.col("fp").alias("src"), F.col("fp").alias("dst")).limit(0)
    tile = min(max(sum(counts.values()) // 64, TILE[0]), TILE[1])
    blocks = [-(-counts.get(p, 0) // tile) for p in range(65)]
    held = F.array(*[F.lit(n) for n in blocks])
    many = F.get(held, F.col("pc").cast("int"))
    tiles = distinct.withColumn(
        "block", F.pmod(F.xxhash64("fp"), many).cast("int"),
    ).groupBy("pc", "block").agg(F.collect_list("fp").alias("fps"))  # bounded by the tile size
    reach = F.sequence(F.greatest(F.lit(0), F.col("pc") - radius), F.least(F.lit(64), F.col("pc") + radius))
    # tiles (p, q) within reach; the lower of the two comes first in the pair's key
    others = F.flatten(
        F.transform(
            reach,
            lambda p: F.when(
                F.get(held, p) > 0,
                F.transform(F.sequence(F.lit(0), F.get(held, p) - 1), lambda q: F.struct(p.alias("p"), q.alias("q"))),
            ).otherwise(F.array().cast("array<struct<p:int,q:int>>")),
        )
    )
    own, other = F.struct(F.col("pc").alias("p"), F.col("block").alias("q")), F.col("other")
    dealt = tiles.select("pc", "block", "fps", F.explode(others).alias("other")).select(
        F.least(own, other).alias("lo"), F.greatest(own, other).alias("hi"), (own == F.greatest(own, other)).alias("last"), "fps",
    )
    pairs = sum(blocks[p] * blocks[q] for p in range(65) for q in range(p, min(65, p + radius + 1)))
    tasks = max(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), pairs // PAIRS)
    # the number of tasks follows the pairs, not their bytes: a pair is little to read and much to compare
    met = dealt.repartition(tasks, "lo", "hi").groupBy("lo", "hi").agg(F.collect_list(F.struct("last", "fps")).alias("t"))  # one or two tiles

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pair in batch.column(0):
                parts = [np.asarray(x["fps"].values).view(np.uint64) for x in pair]
                src, dst = near(parts[0], parts[-1], radius, len(parts) == 1)
                yield pa.RecordBatch.from_arrays([pa.array(src.view(np.int64)), pa.array(dst.view(np.int64))], names=["src", "dst"])

    return met.select("t").mapInArrow(run, "src long, dst long")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4) -> DataFrame:
    """One row for each row of ``docs``: id, fingerprint (16 hex digits), component_id (smallest id reachable by links).

    Documents without a word (null and empty texts) have fingerprint zero and link like any other. Copies share a
    fingerprint, which is compared once; rows of one id may repeat. An empty table gives an empty result, and other
    columns of ``docs`` are not read.
    """
    fps = written(fingerprints(docs, id_col, text_col, words), "fingerprints")
    distinct = written(
        fps.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")).withColumn("pc", F.bit_count("fp")),
        "distinct-fingerprints",
    )
    found = connected_components(links(distinct.select("fp", "pc"), radius))
    rooted = distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = written(rooted.join(named, "root").select("fp", "n", "component_id"), "fingerprint-components")
    # texts without words and copies share a fingerprint, be it a third of all rows
    out = meet(fps, by_fp, "fp", "n", fps.count())
    return out.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
