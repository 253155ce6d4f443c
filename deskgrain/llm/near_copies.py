"""Near copies of texts: pairs whose shingle sets have a Jaccard similarity of at least 0.8, found by SimHash.

Texts of equal shingle sets are one node. Nodes are dealt into tiles by the size of their set, since sets that similar
differ in size by a quarter at most; tiles of such sizes are compared whole by fingerprints of 128 bits, and every pair
found is checked by its exact Jaccard similarity before it links. A similarity of 0.8 gives about 19 differing bits
(deviation 4), so a radius of 32 misses less than one such pair in a hundred; unrelated texts differ in 64.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release_memory, small, written
from .graph import connected_components, union
from .simhash import SEED

#: Differing bits of 128, and of the first 64, up to which a pair is checked.
RADIUS = (32, 20)
#: Least similarity of a link, as a fraction.
LEAST = (4, 5)
#: Nodes in a tile: at least, at most.
TILE = (1_024, 65_536)
SUB = (512, 4_096)
#: Pairs of a node and tile that the first round checks; it links large groups, whose other pairs need no check then.
FEW = 4
#: Bytes of the shingle sets of a block whose pairs are checked together, about, and pairs at most.
SET_BYTES, MOST_PAIRS = 2 << 20, 200_000
#: Texts whose sets are handed on together.
ROWS = 1_000
#: Tile pairs that a task compares, about.
PAIRS = 16
NODE = "sid long, s2 long, n int, a long, b long"


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """Hashes of the shingles of ``words`` words, repeats included; a shorter text is one shingle, one without words none."""
    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not found:
        return np.zeros(0, np.uint64)
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), SEED)], np.uint64)
    line = b" ".join(found)
    end = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    start = np.concatenate(([0], end[:-words])).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[s:e], SEED) for s, e in zip(start, (end[words - 1 :] - 1).tolist())], np.uint64)


def _text(value: pa.StringScalar) -> str | None:
    return value.as_py()


def node(h: np.ndarray) -> tuple[int, int, int, int, int]:
    """(two digests of the set, its size, two fingerprints) of shingle hashes."""
    data = np.unique(h).tobytes()
    return xxhash.xxh64_intdigest(data, SEED), xxhash.xxh64_intdigest(data, SEED + 1), len(data) // 8, _majority(h), _majority(_mixed(h))


def _majority(h: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 65_536):
        ones += np.unpackbits(h[i : i + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def _mixed(h: np.ndarray) -> np.ndarray:
    """Other hashes made of hashes (the finaliser of splitmix64)."""
    h = h + np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def nodes(docs: DataFrame, keep: list[str], text_col: str = "text", words: int = 5) -> DataFrame:
    """Columns ``keep`` of every row with its node: sid and s2 (digests of the shingle set), n (size), a and b (fingerprints)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([node(shingles(t, words)) for t in map(_text, batch.column(batch.num_columns - 1))], np.uint64).reshape(-1, 5)
            sid, s2, n, a, b = (np.ascontiguousarray(found[:, i]).view(np.int64) for i in range(5))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(sid), pa.array(s2), pa.array(n.astype(np.int32)), pa.array(a), pa.array(b)],
                names=[*keep, "sid", "s2", "n", "a", "b"],
            )
        release_memory()

    kept = docs.select(*keep)
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema)
    return docs.select(*keep, F.col(text_col).alias("_text")).mapInArrow(run, kinds + NODE)


def apart(found: DataFrame) -> DataFrame:
    """``found`` (a written table of ``nodes``) without s2, where different sets have different sids: the few whose first digests
    are equal and whose second are not take a name made of both, so that sets count as equal by 128 bits."""
    shared = found.groupBy("sid").agg(F.min("s2").alias("s2"), F.max("s2").alias("last")).where("s2 <> last")
    shared = small(written(shared.select("sid", F.lit(True).alias("shared")), "shared-names"))
    named = F.when(F.col("shared"), F.xxhash64("sid", "s2")).otherwise(F.col("sid"))
    return found.join(shared, "sid", "left").withColumn("sid", named).select(*[c for c in found.columns if c != "s2"])


def near(x: dict, y: dict, same: bool, few: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Places (in x, in y) of the pairs within the radius and of unequal labels; at most ``few`` of each place in x if given."""
    out = []
    for i in range(0, len(x["a"]), SUB[0]):
        held = []
        for j in range(0, len(y["a"]), SUB[1]):
            if same and j + SUB[1] <= i:
                continue
            p, q = np.nonzero(np.bitwise_count(x["a"][i : i + SUB[0], None] ^ y["a"][None, j : j + SUB[1]]) <= RADIUS[1])
            p, q = p + i, q + j
            apart = np.bitwise_count(x["a"][p] ^ y["a"][q]).astype(np.int64) + np.bitwise_count(x["b"][p] ^ y["b"][q])
            m, n = x["n"][p].astype(np.int64), y["n"][q].astype(np.int64)
            ok = (apart <= RADIUS[0]) & (LEAST[1] * np.minimum(m, n) >= LEAST[0] * np.maximum(m, n)) & (x["label"][p] != y["label"][q])
            if same:
                ok &= p < q
            held.append(_few(p[ok], q[ok], x, y, few))
        if held:
            out.append(_few(*(np.concatenate(z) for z in zip(*held)), x, y, few))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(z) for z in zip(*out))


def _few(p: np.ndarray, q: np.ndarray, x: dict, y: dict, few: int | None) -> tuple[np.ndarray, np.ndarray]:
    """At most ``few`` pairs of each p, by a hash of the pair: of large groups, an even choice without a centre."""
    if few is None or not len(p):
        return p, q
    at = np.lexsort((_mixed(x["sid"][p].view(np.uint64) ^ _mixed(y["sid"][q].view(np.uint64))), p))
    p, q = p[at], q[at]
    first = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1])))
    nth = np.arange(len(p)) - np.repeat(first, np.diff(np.append(first, len(p))))
    return p[nth < few], q[nth < few]


def candidates(labelled: DataFrame, few: int | None) -> DataFrame:
    """(pair, src, dst): pairs of nodes (sid, n, a, b, label) within the radius, of sizes that allow a link, of unequal labels; a
    row has those between two blocks of nodes, src[i] with dst[i]."""
    step, reach = math.log(LEAST[1] / LEAST[0]) / 4, 5  # four size classes a quarter; one more for rounding
    # sets of three shingles or less are similar only if they are equal
    sized = labelled.where("n >= 4").withColumn("size", F.floor(F.log("n") / step).cast("int"))
    counts = {r["size"]: r["c"] for r in sized.groupBy("size").agg(F.count("*").alias("c")).collect()}  # some hundreds at most
    if not counts:
        return labelled.select(F.lit("").alias("pair"), F.array("sid").alias("src"), F.array("sid").alias("dst")).limit(0)
    tile = min(max(sum(counts.values()) // 64, TILE[0]), TILE[1])
    blocks = [-(-counts.get(p, 0) // tile) for p in range(max(counts) + reach + 1)]
    held = F.array(*[F.lit(c) for c in blocks])
    item = F.struct("sid", "n", "a", "b", "label")
    tiles = sized.withColumn(
        "block", F.pmod(F.xxhash64("sid"), F.get(held, F.col("size"))).cast("int"),
    ).groupBy("size", "block").agg(F.collect_list(item).alias("items"))  # bounded by the tile size
    sizes = F.sequence(F.greatest(F.lit(0), F.col("size") - reach), F.col("size") + reach)
    none = F.array().cast("array<struct<p:int,q:int>>")
    others = F.flatten(
        F.transform(
            sizes,
            lambda p: F.when(
                F.get(held, p) > 0,
                F.transform(F.sequence(F.lit(0), F.get(held, p) - 1), lambda q: F.struct(p.alias("p"), q.alias("q"))),
            ).otherwise(none),
        )
    )
    own, other = F.struct(F.col("size").alias("p"), F.col("block").alias("q")), F.col("other")
    dealt = tiles.select("size", "block", "items", F.explode(others).alias("other")).select(
        F.least(own, other).alias("lo"), F.greatest(own, other).alias("hi"), "items",
    )
    pairs = sum(blocks[p] * sum(blocks[p : p + reach + 1]) for p in range(len(blocks)))
    tasks = max(int(labelled.sparkSession.conf.get("spark.sql.shuffle.partitions")), pairs // PAIRS)
    met = dealt.repartition(tasks, "lo", "hi").groupBy("lo", "hi").agg(
        F.collect_list("items").alias("t"),
    )  # one or two tiles

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, pair in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                same = lo == hi
                if not same and len(pair) < 2:  # a block that its hash left empty
                    continue
                sides = [{k: np.asarray(side.values.field(k)) for k in ("sid", "n", "a", "b", "label")} for side in pair]
                sides = [s | {k: s[k].view(np.uint64) for k in ("a", "b")} for s in sides]
                p, q = near(sides[0], sides[-1], same, few)
                # blocks of as many nodes as their sets may take bytes
                per = min(max(SET_BYTES // (8 * int(max(s["n"].max() for s in sides))), 32), SUB[1])
                at = np.lexsort((q // per, p // per))
                p, q = p[at], q[at]
                cut = np.flatnonzero((np.diff(p // per) != 0) | (np.diff(q // per) != 0)) + 1
                for n, (i, j) in enumerate(zip(np.split(p, cut), np.split(q, cut))):
                    for k in range(0, len(i), MOST_PAIRS):
                        name = f"{lo['p']}.{lo['q']}-{hi['p']}.{hi['q']}-{n}-{k}"
                        arrays = [pa.array([sides[e]["sid"][x[k : k + MOST_PAIRS]]], pa.list_(pa.int64())) for e, x in ((0, i), (-1, j))]
                        yield pa.RecordBatch.from_arrays([pa.array([name]), *arrays], names=["pair", "src", "dst"])
        release_memory()

    return met.select("lo", "hi", "t").mapInArrow(run, "pair string, src array<long>, dst array<long>")


def checked(pairs: DataFrame, each: DataFrame, docs: DataFrame, key: list[str], text_col: str = "text", words: int = 5) -> DataFrame:
    """(src, dst): a spanning forest, block by block, of the ``pairs`` (pair, src, dst) whose shingle sets have a Jaccard similarity of
    0.8 or more, by the texts of ``docs``; ``each`` (sid, key) says which row has a node's text. A node's set goes once to each
    pair of blocks that asks for it, however many partners it has there."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            found = [np.unique(shingles(t, words)).view(np.int64) for t in map(_text, batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["sid", "s"])
        release_memory()

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for src, dst, held in zip(*batch.columns):
                ids, each = np.asarray(held.values.field("sid")), held.values.field("s")
                hashes, ends = np.asarray(each.flatten()).view(np.uint64), np.cumsum([len(x) for x in each])
                own = [hashes[e - n : e] for e, n in zip(ends, np.diff(ends, prepend=0))]
                order = np.argsort(ids)
                p, q = (order[np.searchsorted(ids[order], np.asarray(x.values))] for x in (src, dst))
                at = np.argsort(p, kind="stable")
                p, q = p[at], q[at]
                label = np.arange(len(ids))
                for group in np.split(np.arange(len(p)), np.flatnonzero(np.diff(p)) + 1):
                    one, others = own[p[group[0]]], q[group]
                    n = np.array([len(own[x]) for x in others])
                    both = np.concatenate([own[x] for x in others])
                    here = one[np.minimum(np.searchsorted(one, both), len(one) - 1)] == both
                    common = np.add.reduceat(here, np.cumsum(n) - n, dtype=np.int64)
                    like = LEAST[1] * common >= LEAST[0] * (len(one) + n - common)
                    union(label, p[group][like], others[like])
                moved = np.flatnonzero(label != np.arange(len(label)))
                yield pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[label[moved]])], names=["src", "dst"])
        release_memory()

    asked = pairs.select("pair", F.explode(F.array_distinct(F.concat("src", "dst"))).alias("sid"))
    rows = written(each.select("sid", *key).join(asked.select("sid").distinct(), "sid", "left_semi"), "asked-nodes")
    # the same join at every size: the nodes that are asked for grow with the texts
    found = docs.select(*key, F.col(text_col).alias("_text")).join(rows.hint("merge"), key).select("sid", "_text").mapInArrow(sets, "sid long, s array<long>")
    found = written(found.dropDuplicates(["sid"]), "shingle-sets")  # equal rows share a key
    held = asked.join(found, "sid").groupBy("pair").agg(F.collect_list(F.struct("sid", "s")).alias("held"))  # bounded by the blocks
    return pairs.join(held, "pair").select("src", "dst", "held").mapInArrow(similar, "src long, dst long")


def roots(found: DataFrame, docs: DataFrame, key: list[str], text_col: str = "text", words: int = 5) -> DataFrame:
    """(sid, root) of every node of ``found`` (``key``, sid, n, a, b of each row): root is the smallest sid reachable by links.

    ``key`` leads to a row of ``docs`` and its text; only equal rows may share it. The first round checks a few pairs of each
    node, which joins large groups; the second checks all pairs between nodes that the first left apart.
    """
    # rows of one node have equal sets; their fingerprints may differ by repeats
    each = found.groupBy("sid").agg(F.min(F.struct("n", "a", "b", *key)).alias("r")).select("sid", "r.*")
    labelled = written(each.withColumn("label", F.col("sid")), "labelled")
    for few in (FEW, None):
        pairs = written(candidates(labelled, few), "candidates")
        links = written(checked(pairs, labelled, docs, key, text_col, words), "links")
        found = small(connected_components(links if few else groups_linked(links, labelled)))
        joined = labelled.join(found, F.col("label") == F.col("node"), "left")
        labelled = written(joined.withColumn("label", F.coalesce("root", "label")).drop("node", "root"), "labelled")
    return labelled.select("sid", F.col("label").alias("root"))


def groups_linked(links: DataFrame, labelled: DataFrame) -> DataFrame:
    """The ``links`` (src, dst) of nodes as links of their groups: a group is one node, named by its label, which is its smallest sid."""
    for end in ("src", "dst"):
        label = labelled.select(F.col("sid").alias(end), F.col("label").alias("group"))
        links = links.join(label, end).drop(end).withColumnRenamed("group", end)
    return links
