"""The stored index against the search that reads all texts."""

import random

import pytest
from pyspark.sql import functions as F

from deskgrain.functions.frames import new_folder
from deskgrain.operators import inverted, retrieval

WORDS = ["the", "of", "and"] * 30 + ["login", "reset", "invoice", "É", "x1"] * 4 + [f"w{i}" for i in range(300)]


def chunk_rows(rng, n, scopes=("a", "b")):
    rows = [(f"c{i}", " ".join(rng.choices(WORDS, k=rng.randint(1, 60))), rng.choice(scopes)) for i in range(n)]
    return rows + [("dup1", "the same text", "a"), ("dup2", "the same text", "a"), ("Upper", "LOGIN\tReset\n\nlogin", "b")]


def same(got, want):
    def rows(df):
        return sorted((r["question_id"], r["rank"], r["chunk_id"], round(r["score"], 5)) for r in df.collect())

    assert rows(got) == rows(want)
    return rows(got)


@pytest.mark.parametrize("block, first, scope", [(256, 3, None), (7, 1, None), (16, 2, "lang")])
def test_search_equals_reading_all_texts(spark, monkeypatch, block, first, scope):
    rng = random.Random(block)
    monkeypatch.setattr(inverted, "FIRST", first)
    monkeypatch.setattr(inverted, "BLOCK", block)
    chunks = spark.createDataFrame(chunk_rows(rng, 700), "chunk_id string, text string, lang string").repartition(3)
    asked = [" ".join(rng.choices(WORDS, k=rng.randint(1, 8))) for _ in range(20)] + ["the same text", "the the login", "nowhere", "", "the"]
    questions = spark.createDataFrame([(i, q, "ab"[i % 2]) for i, q in enumerate(asked)], "question_id long, question string, lang string")
    folder, parts = new_folder(spark, "index"), (F.col("chunk_id") < "c4", F.col("chunk_id") >= "c4")
    inverted.add(chunks.where(parts[0]), folder, scope)
    same(inverted.search(questions, folder, k=5, scope=scope), retrieval.bm25(chunks.where(parts[0]), questions, k=5, scope=scope))
    inverted.add(chunks.where(parts[1]), folder, scope)  # statistics and bounds now follow both batches
    found = same(inverted.search(questions, folder, k=5, scope=scope), retrieval.bm25(chunks, questions, k=5, scope=scope))
    assert len(found) > 60
    same(inverted.search(questions, folder, k=2, k1=0.9, b=0.3, scope=scope), retrieval.bm25(chunks, questions, k=2, k1=0.9, b=0.3, scope=scope))


def test_blocks_that_cannot_reach_the_best_are_not_scored(spark, monkeypatch):
    monkeypatch.setattr(inverted, "BLOCK", 10)
    rows = [(f"c{i:04d}", "the common words " * 3 + ("needle thread" if i == 777 else f"filler{i}"), "a") for i in range(1000)]
    chunks = spark.createDataFrame(rows, "chunk_id string, text string, lang string").repartition(2)
    folder = new_folder(spark, "index")
    inverted.add(chunks, folder)
    seen, scored = [], inverted._scored
    monkeypatch.setattr(inverted, "_scored", lambda pairs, *a: seen.append(pairs.count()) or scored(pairs, *a))
    q = spark.createDataFrame([(1, "needle thread the")], "question_id long, question string")
    (r,) = inverted.search(q, folder, k=1).collect()
    assert r["chunk_id"] == "c0777" and seen == [inverted.FIRST, 0]


def test_a_batch_that_failed_half_way_is_never_read(spark, monkeypatch):
    chunks = spark.createDataFrame(chunk_rows(random.Random(1), 60), "chunk_id string, text string, lang string")
    q = spark.createDataFrame([(1, "login the")], "question_id long, question string")
    folder = new_folder(spark, "index")
    inverted.add(chunks.where("lang = 'a'"), folder)
    terms = inverted._terms
    monkeypatch.setattr(inverted, "_terms", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        inverted.add(chunks.where("lang = 'b'"), folder)  # its postings are written, its manifest is not
    monkeypatch.setattr(inverted, "_terms", terms)
    same(inverted.search(q, folder, k=9), retrieval.bm25(chunks.where("lang = 'a'"), q, k=9))
    inverted.add(chunks.where("lang = 'b'"), folder)
    same(inverted.search(q, folder, k=9), retrieval.bm25(chunks, q, k=9))


def test_nothing_to_search_or_to_ask(spark):
    none = spark.createDataFrame([], "chunk_id long, text string, lang string")
    q = spark.createDataFrame([(1, "login")], "question_id long, question string")
    folder = new_folder(spark, "index")
    assert inverted.search(q, folder, id_type="bigint").count() == 0
    inverted.add(none, folder)
    assert inverted.search(q, folder, id_type="bigint").count() == 0
    inverted.add(spark.createDataFrame([(7, "login here", "a"), (8, None, "a"), (9, "a b c", None)], none.schema), folder, "lang")
    lang = q.withColumn("lang", F.lit("a"))
    assert [r["chunk_id"] for r in inverted.search(lang, folder, scope="lang", id_type="bigint").collect()] == [7]
    assert inverted.search(lang.limit(0), folder, scope="lang", id_type="bigint").count() == 0
