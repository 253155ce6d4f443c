"""Stored vector lists: cells are fitted once, batches are dealt to them without a new fit, searches read probed cells only.

    <folder>/centres/fit=F            cell, centre
    <folder>/lists/batch=B/bucket=N   cell, chunk_id, embedding (of length one), far: squared distance from the cell's centre
    <folder>/stats/batch=B            vectors of the batch and the sum of their distances
    <folder>/manifest/version=V       the fit, its mean distance and probes, and the live batches; written last

Later batches may lie elsewhere than what the cells were fitted on. The mean distance of all live vectors, which the stats give
without reading one of them, is held against that of the fit: where it has grown by DRIFT, cells are fitted anew.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deskgrain.functions.frames import small, written

from .retrieval import _meet, dense_topk, normalised, usable

#: Cells at most (vectors in a cell grow beyond that), vectors fitted on at least and for each cell.
MOST_CELLS, FIT_ON, FIT_CELL = 4_096, 20_000, 32
#: Folders that cells are dealt into; questions searched exactly to choose the probes; growth of the mean distance that asks for a new fit.
BUCKETS, SAMPLE, DRIFT = 64, 200, 1.25
#: Distances a worker holds at once.
HELD = 4 << 20


@dataclass(frozen=True)
class Index:
    """What the manifest says: the version, its batches, the fit with its mean distance, and how many cells hold a question's neighbours."""

    version: int = 0
    batches: tuple[str, ...] = ()
    fit: str | None = None
    spread: float = 0.0
    probes: int = 1


_MANIFEST = "batch string, fit string, spread double, probes int"


def opened(spark: SparkSession, folder: str) -> Index:
    """The newest version of the index; version 0 where there is none."""
    try:
        rows = spark.read.schema(_MANIFEST + ", version int").parquet(f"{folder}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return Index()
    newest = rows.agg(F.max("version")).first()[0] or 0
    held = rows.where(F.col("version") == newest).collect()  # a row for each batch
    if not held:
        return Index()
    return Index(newest, tuple(sorted(r["batch"] for r in held)), held[0]["fit"], held[0]["spread"], held[0]["probes"])


def _publish(spark: SparkSession, folder: str, index: Index) -> Index:
    rows = [(b, index.fit, index.spread, index.probes) for b in index.batches]
    spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.parquet(f"{folder}/manifest/version={index.version}")
    return index


def _lists(spark: SparkSession, folder: str, batches: tuple[str, ...], kind: str) -> DataFrame:
    schema = f"cell int, chunk_id {kind}, embedding array<double>, far double, batch string, bucket int"
    return spark.read.schema(schema).parquet(f"{folder}/lists").where(F.col("batch").isin(*batches))


def _centres(spark: SparkSession, folder: str, fit: str) -> np.ndarray:
    """Centres of a fit, MOST_CELLS at most."""
    rows = spark.read.schema("cell int, centre array<double>").parquet(f"{folder}/centres/fit={fit}").orderBy("cell").collect()
    return np.array([r["centre"] for r in rows])


def _placed(df: DataFrame, id_col: str, centres: np.ndarray, probes: int) -> DataFrame:
    """(cell, id, embedding, nth, far) of usable vectors: a row for each of the ``probes`` nearest cells, the nearest first, equally near
    ones by number. Vectors of a length that the centres have not are in the cell of their length, -length."""
    given = normalised(df.where(usable(F.col("embedding"))).select(id_col, "embedding"), "embedding")
    own, width = (centres**2).sum(axis=1), centres.shape[1]
    most = max(1, HELD // len(centres))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                vecs = part.column(1)
                lengths = pc.list_value_length(vecs).to_numpy()
                fits = np.flatnonzero(lengths == width)
                x = vecs.take(pa.array(fits)).flatten().to_numpy().reshape(len(fits), width)
                far = np.maximum((x**2).sum(axis=1)[:, None] - 2 * (x @ centres.T) + own, 0.0)
                near = np.argsort(far, axis=1, kind="stable")[:, :probes]
                others = np.flatnonzero(lengths != width)
                rows = np.concatenate([np.repeat(fits, near.shape[1]), others])
                cells = np.concatenate([near.ravel(), -lengths[others]]).astype(np.int32)
                nth = np.concatenate([np.tile(np.arange(1, near.shape[1] + 1), len(fits)), np.ones(len(others))]).astype(np.int32)
                fars = np.concatenate([np.take_along_axis(far, near, axis=1).ravel(), np.zeros(len(others))])
                held = part.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cells), held.column(0), held.column(1), pa.array(nth), pa.array(fars)], names=["cell", id_col, "embedding", "nth", "far"],
                )

    kind = dict(df.dtypes)[id_col]
    return given.mapInArrow(run, f"cell int, {id_col} {kind}, embedding array<double>, nth int, far double")


def _fit(chunks: DataFrame, folder: str, cells: int | None, seed: int) -> str:
    """Fits cells on a bounded sample (the vectors of the smallest hashes, of the sample's most frequent length), stores and names them."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    ok = chunks.where(usable(F.col("embedding"))).select("chunk_id", "embedding")
    cells = cells or min(MOST_CELLS, max(8, round(ok.count() ** 0.5 / 4)))
    sample = ok.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(max(FIT_ON, FIT_CELL * cells))
    sample = written(normalised(sample, "embedding").withColumn("width", F.size("embedding")), "lists-sample")
    width = sample.groupBy("width").count().orderBy(F.desc("count"), "width").first()["width"]
    fitted = sample.where(F.col("width") == width).withColumn("f", array_to_vector("embedding"))
    centres = KMeans(k=cells, seed=seed, maxIter=10, featuresCol="f").fit(fitted).clusterCenters()
    name, spark = uuid.uuid4().hex, chunks.sparkSession
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(centres)]
    spark.createDataFrame(rows, "cell int, centre array<double>").coalesce(1).write.parquet(f"{folder}/centres/fit={name}")
    return name


def _write(chunks: DataFrame, folder: str, fit: str) -> str:
    """Deals ``chunks`` to the cells of ``fit`` as a new batch, which no manifest names yet."""
    spark, batch = chunks.sparkSession, uuid.uuid4().hex
    placed = _placed(chunks, "chunk_id", _centres(spark, folder, fit), 1).drop("nth").withColumn("bucket", F.pmod("cell", F.lit(BUCKETS)).cast("int"))
    placed.hint("rebalance", "bucket").sortWithinPartitions("bucket", "cell").write.partitionBy("bucket").parquet(f"{folder}/lists/batch={batch}")
    held = _lists(spark, folder, (batch,), dict(chunks.dtypes)["chunk_id"])
    held.where("cell >= 0").agg(F.count("*").alias("n"), F.sum("far").alias("far")).write.parquet(f"{folder}/stats/batch={batch}")
    return batch


def _spread(spark: SparkSession, folder: str, batches: tuple[str, ...]) -> float:
    stats = spark.read.schema("n long, far double, batch string").parquet(f"{folder}/stats").where(F.col("batch").isin(*batches))
    return stats.agg(F.sum("far") / F.sum("n")).first()[0] or 0.0


def _probes(held: DataFrame, centres: np.ndarray, k: int, recall: float) -> int:
    """How many cells of a vector hold the share ``recall`` of its ``k`` neighbours, measured on SAMPLE vectors searched exactly."""
    tried = held.where("cell >= 0").orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(SAMPLE)
    tried = written(tried.select(F.col("chunk_id").alias("question_id"), "embedding"), "lists-tried")
    order = _placed(tried, "question_id", centres, len(centres)).select("question_id", "cell", "nth")
    found = written(dense_topk(held, tried, k), "lists-exact").join(held.where("cell >= 0").select("chunk_id", "cell"), "chunk_id")
    return ceil(found.join(order, ["question_id", "cell"]).agg(F.percentile("nth", F.lit(recall))).first()[0] or len(centres))


def _fitted(chunks: DataFrame, folder: str, version: int, cells: int | None, k: int, recall: float, seed: int) -> Index:
    spark = chunks.sparkSession
    fit = _fit(chunks, folder, cells, seed)
    batch = _write(chunks, folder, fit)
    held = _lists(spark, folder, (batch,), dict(chunks.dtypes)["chunk_id"])
    probes = _probes(held, _centres(spark, folder, fit), k, recall)
    return _publish(spark, folder, Index(version, (batch,), fit, _spread(spark, folder, (batch,)), probes))


def add(
    chunks: DataFrame, folder: str, cells: int | None = None, k: int = 10, recall: float = 0.97, drift: float = DRIFT, seed: int = 7,
) -> Index:
    """Adds ``chunks`` (chunk_id, embedding) to the lists in ``folder``. The first batch with a usable vector fits the cells and
    measures how many of them hold the share ``recall`` of the ``k`` neighbours; later batches are dealt to the nearest cells, and
    all is fitted anew if the mean distance of all vectors has then grown by ``drift``.

    Ids must be new to the index. Vectors that are null, empty or hold null or non-finite components are left out; those of another
    length than the centres are kept in a list of their own. Without usable vectors nothing changes. A batch counts only once its
    manifest is there; one writer at a time."""
    spark = chunks.sparkSession
    now = opened(spark, folder)
    if chunks.where(usable(F.col("embedding"))).isEmpty():
        return now
    if not now.fit:
        return _fitted(chunks, folder, 1, cells, k, recall, seed)
    batches = (*now.batches, _write(chunks, folder, now.fit))
    index = _publish(spark, folder, Index(now.version + 1, batches, now.fit, now.spread, now.probes))
    if _spread(spark, folder, batches) <= drift * now.spread:
        return index
    return reindex(spark, folder, dict(chunks.dtypes)["chunk_id"], cells, k, recall, seed)


def reindex(
    spark: SparkSession, folder: str, id_type: str, cells: int | None = None, k: int = 10, recall: float = 0.97, seed: int = 7,
) -> Index:
    """Fits the cells anew on all live vectors and deals these to them; the older version stays readable until the next takes its place."""
    now = opened(spark, folder)
    if not now.batches:
        return now
    return _fitted(_lists(spark, folder, now.batches, id_type).select("chunk_id", "embedding"), folder, now.version + 1, cells, k, recall, seed)


def search(questions: DataFrame, folder: str, k: int = 10, probes: int | None = None, id_type: str = "string") -> DataFrame:
    """(question_id, chunk_id, score, rank): the best ``k`` by cosine among the vectors in the ``probes`` cells nearest to each question
    (by default as many as the fit measured; all of them give the rows of ``dense_topk``).

    Questions of another length than the centres search the list of their length whole. A question does not find its own id.
    ``id_type`` is the type of the chunks' ids. A folder without an index gives an empty result."""
    spark = questions.sparkSession
    index = opened(spark, folder)
    if not index.fit:
        kind = dict(questions.dtypes)["question_id"]
        return spark.createDataFrame([], f"question_id {kind}, chunk_id {id_type}, score double, rank int")
    probed = _placed(questions, "question_id", _centres(spark, folder, index.fit), probes or index.probes)
    probed = written(probed.select("cell", "question_id", "embedding").withColumn("bucket", F.pmod("cell", F.lit(BUCKETS)).cast("int")), "lists-probed")
    held = _lists(spark, folder, index.batches, id_type).select("bucket", "cell", "chunk_id", "embedding")
    asked = held.join(small(probed.select("bucket", "cell").distinct()), ["bucket", "cell"], "left_semi")
    return _meet(asked.drop("bucket"), probed.drop("bucket"), k)
