"""Stored lists against the exact search."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from deskgrain.functions.frames import new_folder
from deskgrain.operators import lists, retrieval


def rows(df):
    return sorted((r["question_id"], r["rank"], r["chunk_id"], round(r["score"], 5)) for r in df.collect())


def share(found, exact):
    a, b = ({(r[0], r[2]) for r in rows(x)} for x in (found, exact))
    return len(a & b) / len(b)


@pytest.fixture
def vectors(spark, sf):
    return spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), "embedding")


def test_recall_before_and_after_an_insert_without_a_new_fit(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), "embedding")
    tenth = F.col("chunk_id") % 10 == 3
    asked = e.where("chunk_id % 40 = 0").select(F.col("chunk_id").alias("question_id"), "embedding")
    folder = new_folder(spark, "lists")
    first = lists.add(e.where(~tenth), folder)
    assert share(lists.search(asked, folder, 10, id_type="bigint"), retrieval.dense_topk(e.where(~tenth), asked, 10)) >= 0.95
    second = lists.add(e.where(tenth), folder)
    assert second.fit == first.fit and len(second.batches) == 2 and second.probes == first.probes
    assert share(lists.search(asked, folder, 10, id_type="bigint"), retrieval.dense_topk(e, asked, 10)) >= 0.95


def test_all_cells_give_the_exact_result_and_few_are_read_otherwise(spark, vectors):
    folder = new_folder(spark, "lists")
    index = lists.add(vectors, folder, cells=8)
    asked = vectors.where("chunk_id % 25 = 0").withColumnRenamed("chunk_id", "question_id")
    assert rows(lists.search(asked, folder, 5, probes=8, id_type="bigint")) == rows(retrieval.dense_topk(vectors, asked, 5))
    one = rows(lists.search(asked, folder, 5, probes=1, id_type="bigint"))
    held = lists._lists(spark, folder, index.batches, "bigint").select("chunk_id", "cell").collect()
    cell = {r["chunk_id"]: r["cell"] for r in held}
    assert len(cell) == vectors.count() and one and all(cell[q] == cell[c] for q, _, c, _ in one)
    centres = lists._centres(spark, folder, index.fit)
    for r in vectors.limit(20).collect():
        v = np.array(r["embedding"], float)
        assert cell[r["chunk_id"]] == ((centres - v / np.linalg.norm(v)) ** 2).sum(axis=1).argmin()


def test_vectors_that_lie_elsewhere_ask_for_a_new_fit(spark):
    rng = random.Random(5)

    def near(axis, n, first):
        return [(first + i, [rng.gauss(3.0 * (j == axis), 0.2) for j in range(8)]) for i in range(n)]

    schema = "chunk_id long, embedding array<double>"
    start, same, far = near(0, 200, 0), near(0, 30, 1000), near(5, 200, 2000)
    folder = new_folder(spark, "lists")
    one = lists.add(spark.createDataFrame(start, schema), folder, cells=4)
    two = lists.add(spark.createDataFrame(same, schema), folder, cells=4)
    three = lists.add(spark.createDataFrame(far, schema), folder, cells=4)
    assert one.fit == two.fit != three.fit and len(three.batches) == 1 and three.version == 4
    asked = spark.createDataFrame([(-1, [0.0] * 5 + [1.0, 0.0, 0.0])], "question_id long, embedding array<double>")
    every = spark.createDataFrame(start + same + far, schema)
    found = lists.search(asked, folder, 20, probes=4, id_type="bigint")
    assert rows(found) == rows(retrieval.dense_topk(every, asked, 20))


def test_odd_vectors(spark):
    schema = "chunk_id string, embedding array<double>"
    folder = new_folder(spark, "lists")
    asked = spark.createDataFrame([("q", [1.0, 0.1]), ("w", [1.0, 0.0, 2.0]), ("n", None)], "question_id string, embedding array<double>")
    unusable = [("null", None), ("none", []), ("nan", [float("nan"), 1.0]), ("inf", [float("inf"), 1.0])]
    assert lists.search(asked, folder).count() == 0
    for bad in (unusable, []):
        assert lists.add(spark.createDataFrame(bad, schema), folder).fit is None
    assert lists.search(asked, folder).count() == 0
    good = [(f"c{i}", [1.0, float(i)]) for i in range(6)] + [("c0 again", [1.0, 0.0]), ("zero", [0.0, 0.0]), ("wide", [1.0, 0.0, 2.0])]
    lists.add(spark.createDataFrame(good + unusable, schema), folder, cells=2)
    found = lists.search(asked, folder, 20, probes=2)
    assert rows(found) == rows(retrieval.dense_topk(spark.createDataFrame(good, schema), asked, 20))
    assert [r[2] for r in rows(found) if r[0] == "w"] == ["wide"]


def test_a_batch_that_failed_half_way_is_never_read(spark, vectors, monkeypatch):
    folder = new_folder(spark, "lists")
    even = F.col("chunk_id") % 2 == 0
    lists.add(vectors.where(even), folder, cells=4)
    asked = vectors.where("chunk_id % 25 = 0").withColumnRenamed("chunk_id", "question_id")
    publish = lists._publish
    monkeypatch.setattr(lists, "_publish", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        lists.add(vectors.where(~even), folder)
    monkeypatch.setattr(lists, "_publish", publish)
    assert rows(lists.search(asked, folder, 5, probes=4, id_type="bigint")) == rows(retrieval.dense_topk(vectors.where(even), asked, 5))
    lists.add(vectors.where(~even), folder)
    assert rows(lists.search(asked, folder, 5, probes=4, id_type="bigint")) == rows(retrieval.dense_topk(vectors, asked, 5))
