"""Approximate nearest neighbours: inverted lists scanned by an adaptive number of dimensions.

Vectors are dealt to the list of their nearest k-means centre; a query probes its nearest lists. How many is measured: a
bounded sample of queries is compared with all vectors, and as many lists are probed as hold most of their neighbours, few
where vectors cluster and many where they are spread evenly. Within a list vectors
are rotated at random and stored by blocks of columns. After each block the partial distance, scaled to all dimensions,
is tested against the distance of the best k so far: a candidate that is farther even with the tolerance of the test
(which shrinks as more dimensions are seen) is abandoned. Survivors get their exact distance from the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import sampled, written
from .vectors import distances, kmeans, nearest, sample, takes_part, to_matrix

#: Vectors of a list, and queries at a list, that one task compares.
BLOCK, QUERIES = 8_192, 512
#: Most lists; vectors for each list, about; how many lists a query probes at least.
LISTS, PER_LIST, LEAST_PROBED = 4_096, 200, 4
#: Queries that the number of probes is measured on, and the share of their neighbours that it must reach.
SAMPLE_QUERIES, RECALL = 200, 0.97
#: Queries of which a task keeps the best before it hands them on.
KEPT = 50_000
#: Tolerance of the test, columns in a block, candidates scanned together.
EPS, COLUMNS, TOGETHER = 2.1, 16, 256


def rotation(d: int, seed: int = 5) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


def scan(
    query: np.ndarray, turned: np.ndarray, columns: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int,
    so_far: tuple[np.ndarray, np.ndarray] | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """(ids, squared distances) of the k nearest of a list and of those found ``so_far``: ``columns`` holds the list's
    rotated vectors, dimension by candidate, ``rows`` the originals."""
    d, n = columns.shape
    best_id, best = so_far or (np.empty(0, np.int64), np.empty(0))
    for s in range(0, n, TOGETHER):
        alive = np.arange(s, min(n, s + TOGETHER))
        partial = np.zeros(len(alive))
        bound = best[-1] if len(best) == k else np.inf
        for c in range(0, d, COLUMNS):
            e = min(d, c + COLUMNS)
            partial = partial + ((columns[c:e, alive] - turned[c:e, None]) ** 2).sum(0)
            if e < d and bound < np.inf:
                keep = partial <= bound * (e / d) * (1 + EPS / np.sqrt(e)) ** 2
                alive, partial = alive[keep], partial[keep]
        if not len(alive):
            continue
        exact = ((rows[alive] - query) ** 2).sum(1)
        best_id, best = np.concatenate((best_id, ids[alive])), np.concatenate((best, exact))
        top = np.lexsort((best_id, best))[:k]
        best_id, best = best_id[top], best[top]
    return best_id, best


def probes_for(indexed: DataFrame, asked: DataFrame, centres: np.ndarray, k: int, recall: float) -> int:
    """Lists to probe so that a sample of queries finds the share ``recall`` of its k nearest in ``indexed`` (id, v, cell)."""
    h = F.xxhash64("id", F.lit(7))
    some = sampled(asked, h, asked.count(), SAMPLE_QUERIES).orderBy(h).limit(SAMPLE_QUERIES).select("id", "v").toArrow().combine_chunks()
    if not some.num_rows:
        return LEAST_PROBED
    ids, q = some.column(0).to_numpy(), to_matrix(some.column(1).combine_chunks())

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, cells = np.full((len(q), k), np.inf), np.zeros((len(q), k), np.int32)
        for b in (b.slice(i, BLOCK) for b in batches for i in range(0, b.num_rows, BLOCK)):
            x = to_matrix(b.column(1))
            d = (q * q).sum(1)[:, None] + (x * x).sum(1) - 2 * (q @ x.T)
            d[ids[:, None] == np.asarray(b.column(0))[None]] = np.inf
            d, c = np.concatenate((near, d), 1), np.concatenate((cells, np.broadcast_to(np.asarray(b.column(2)), d.shape)), 1)
            at = np.argpartition(d, k - 1, axis=1)[:, :k]
            near, cells = np.take_along_axis(d, at, 1), np.take_along_axis(c, at, 1)
        row, col = np.nonzero(np.isfinite(near))
        yield pa.RecordBatch.from_arrays(
            [pa.array(row.astype(np.int32)), pa.array(cells[row, col]), pa.array(near[row, col])], names=["q", "cell", "d"],
        )

    found = indexed.select("id", "v", "cell").mapInArrow(best, "q int, cell int, d double")
    w = Window.partitionBy("q").orderBy("d", "cell")
    true = found.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).select("q", "cell").collect()  # k for each query of the sample
    if not true:
        return LEAST_PROBED
    place = distances(q, centres).argsort(1, kind="stable").argsort(1)
    return max(LEAST_PROBED, 1 + int(np.quantile([place[r["q"], r["cell"]] for r in true], recall, method="higher")))


def search(
    vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding",
    recall: float = RECALL,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its k nearest found among ``vectors``, without the query's own id.

    score is the Euclidean distance of the original vectors in double precision; nearest first, ties to the smaller id;
    all candidates if there are fewer than k. Vectors that are null, zero or hold null or non-finite components take no part,
    as candidates or as queries; rows with a null id neither. Vectors of one length are compared: those of the commonest in
    lists, those of another in one list for each length. Copies are candidates each; rows of one id are one query, the
    smallest of their vectors. Centres are fitted on a bounded sample; every vector is indexed.
    """
    def usable(df: DataFrame) -> DataFrame:
        return df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).where(F.col("id").isNotNull() & takes_part(F.col("v")))

    base, asked = usable(vectors), usable(queries).groupBy("id").agg(F.min("v").alias("v"))
    lengths = [
        (r["d"], r["n"]) for r in base.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").collect()
    ]  # a few lengths
    kind = dict(base.dtypes)["v"]
    if not lengths:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d, n = lengths[0]
    main = F.size("v") == d
    centres = kmeans(sample(base.where(main), "id", "v"), min(LISTS, -(-n // PER_LIST)), spherical=False)
    extra = {other: len(centres) + i for i, (other, _) in enumerate(lengths[1:])}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.asarray(pc.list_value_length(b.column(1)))
            for size in np.unique(sizes):
                part = b.filter(pa.array(sizes == size))
                cell = nearest(to_matrix(part.column(1)), centres) if size == d else np.full(part.num_rows, extra[int(size)])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32))], names=["id", "v", "cell"])

    indexed = written(base.mapInArrow(place, f"id long, v {kind}, cell int"), "ann-lists")
    held = np.zeros(len(centres) + len(extra), np.int64)
    for r in indexed.groupBy("cell").agg(F.count("*").alias("n")).collect():  # at most LISTS rows, and one for each other length
        held[r["cell"]] = r["n"]
    own = held[: len(centres)]
    least = min(len(centres), probes_for(indexed.where(F.col("cell") < len(centres)), asked.where(main), centres, k, recall))
    turns = {size: rotation(size) for size, _ in lengths}

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.asarray(pc.list_value_length(b.column(1)))
            for size in np.unique(sizes):
                part = b.filter(pa.array(sizes == size))
                if size == d:
                    order = distances(to_matrix(part.column(1)), centres).argsort(1, kind="stable")
                    # the nearest lists, and more of them until they hold k candidates beside the query
                    before = np.cumsum(own[order], 1) - own[order]
                    row, at = np.nonzero((np.arange(len(centres)) < least) | (before <= k))
                    part, cell = part.take(pa.array(row)), order[row, at]
                elif int(size) in extra:
                    cell = np.full(part.num_rows, extra[int(size)])
                else:
                    continue
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cell.astype(np.int32))], names=["id", "v", "cell"])

    probes = written(asked.mapInArrow(probe, f"id long, v {kind}, cell int"), "ann-probes")
    wanted = {r["cell"]: r["n"] for r in probes.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    blocks = F.array(*[F.lit(int(-(-x // BLOCK))) for x in held])
    rounds = F.array(*[F.lit(int(-(-wanted.get(c, 0) // QUERIES))) for c in range(len(held))])

    def packed(df: DataFrame, own, other, is_query: bool) -> DataFrame:
        """Rows in blocks, each block once for every block of the other side at its list."""
        mine, theirs = F.get(own, F.col("cell")), F.get(other, F.col("cell"))
        made = df.where(theirs > 0).withColumn(
            "block", F.pmod(F.xxhash64("id"), mine).cast("int"),
        ).groupBy("cell", "block").agg(F.collect_list(F.struct("id", "v")).alias("items"))
        met = made.withColumn("other", F.explode(F.sequence(F.lit(0), theirs - 1)))
        b, q = ("other", "block") if is_query else ("block", "other")
        return met.select("cell", F.col(b).alias("b"), F.col(q).alias("q"), F.lit(is_query).alias("is_query"), "items")

    met = packed(
        indexed, blocks, rounds, False,
    ).unionByName(packed(probes, rounds, blocks, True)).groupBy("cell", "b", "q").agg(
        F.array_sort(F.collect_list(F.struct("is_query", "items"))).alias("t")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # of the lists that this task has scanned

        def told() -> pa.RecordBatch:
            n = [len(v[0]) for v in best.values()]
            a, b, c = np.repeat(np.array(list(best), np.int64), n), *(np.concatenate(x) for x in zip(*best.values()))
            best.clear()
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.sqrt(c))], names=["query_id", "vec_id", "score"])

        for batch in batches:
            for pair in batch.column(0):
                if len(pair) < 2:
                    continue
                (ids, rows), (qids, qs) = ((np.asarray(s["items"].values.field("id")), to_matrix(s["items"].values.field("v"))) for s in pair)
                turn = turns[rows.shape[1]]
                columns = np.ascontiguousarray((rows @ turn).T)
                for i, q in zip(qids.tolist(), qs):
                    own = ids != i
                    some = (columns, rows, ids) if own.all() else (columns[:, own], rows[own], ids[own])
                    best[i] = scan(q, q @ turn, *some, k, best.get(i))
                if len(best) > KEPT:
                    yield told()
        if best:
            yield told()

    best = met.select("t").mapInArrow(compare, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
