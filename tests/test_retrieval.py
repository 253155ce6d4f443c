from math import log

import pytest
from pyspark.sql import functions as F

from deskgrain.functions import dims
from deskgrain.operators import evidence as E
from deskgrain.operators import retrieval as R


def test_bm25_by_hand(spark):
    chunks = spark.createDataFrame([("a", "cat dog"), ("b", "cat cat fish"), ("c", "bird"), ("d", "fish bird bird")], "chunk_id string, text string")
    q = spark.createDataFrame([(1, "Cat cat"), (2, "absent")], "question_id int, question string")
    got = {r["chunk_id"]: r["score"] for r in R.bm25(chunks, q).collect()}
    docs = {r["chunk_id"]: r["text"].split() for r in chunks.collect()}
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    df = {t: sum(t in d for d in docs.values()) for t in {x for d in docs.values() for x in d}}
    idf = {t: log((n - f + 0.5) / (f + 0.5)) for t, f in df.items()}
    low = 0.25 * sum(idf.values()) / len(idf)
    w = low if idf["cat"] < 0 else idf["cat"]
    for k in ("a", "b"):
        tf, dl = docs[k].count("cat"), len(docs[k])
        assert got[k] == pytest.approx(2 * w * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg)), abs=1e-6)
    assert set(got) == {"a", "b"}


def test_fusion_and_ties(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "question_id int, chunk_id string, rank int")
    b = spark.createDataFrame([(1, "y", 1), (1, "x", 2), (1, "z", 3)], "question_id int, chunk_id string, rank int")
    assert [(r["chunk_id"], r["rank"]) for r in R.fuse([a, b], 3).orderBy("rank").collect()] == [("x", 1), ("y", 2), ("z", 3)]


def test_metadata_filter_keeps_all_when_none_pass(spark):
    c = spark.createDataFrame([(1, "a", "pro"), (1, "b", "free"), (2, "c", "free")], "question_id int, chunk_id string, t string")
    assert sorted(r["chunk_id"] for r in R.metadata_filter(c, F.col("t") == "pro").collect()) == ["a", "c"]


def test_merge_reserves_critical_types(spark):
    rows = [(1, f"k{i}", "knowledge_base", "bug", False, 0.9 - i / 100, "") for i in range(5)] + [
        (1, "n", "known_issue", "bug", False, 0.1, "s"), (1, "r", "release_note", "bug", True, 0.2, "s"),
    ]
    c = spark.createDataFrame(
        rows,
        "question_id int, chunk_id string, source_type string, route string, stale boolean, policy_score double, parent_section_id string",
    )
    assert [r["chunk_id"] for r in R.merge_by_source_type(c, 4).orderBy("rank").collect()] == ["n", "r", "k0", "k1"]


def test_neighbours_skip_dead_chunks(spark):
    chunks = spark.createDataFrame(
        [(1, i, f"c{i}", i != 3, False) for i in range(6)],
        "article_id int, chunk_index int, chunk_id string, is_active boolean, disabled boolean",
    )
    picked = spark.createDataFrame(
        [(9, "c2", 1, 2, 0.5, True)],
        "question_id int, chunk_id string, article_id int, chunk_index int, policy_score double, has_conditions boolean",
    )
    assert sorted(r["chunk_id"] for r in R.expand_neighbours(picked, chunks).collect()) == ["c0", "c1", "c4"]


def test_raw_types_never_gain_authority(spark):
    a = {r["source_type"]: r["authority"] for r in dims.source_authority(spark, {"raw_ticket_history": 0.9, "policy": 0.8}).collect()}
    assert a["raw_ticket_history"] == 0.0 and a["policy"] == 0.8 and a["knowledge_base"] == 1.0


def test_ivf_recall(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    c, q = e.select(F.col("vec_id").alias("chunk_id"), "embedding"), e.where("vec_id % 25 = 0").select(
        F.col("vec_id").alias("question_id"), "embedding",
    )
    exact = {(r["question_id"], r["chunk_id"]) for r in R.dense_topk(c, q, 10).collect()}
    found = {(r["question_id"], r["chunk_id"]) for r in R.ivf_topk(c, q, 10, cells=8, probes=6).collect()}
    assert len(exact & found) / len(exact) >= 0.8


def test_confidence_bands(spark):
    s = spark.createDataFrame([(1, 8.0, 4.0, 3, 3, 2, 0, 0, 0, 0, 0, False, 0), (2, 8.0, 1.0, 3, 3, 0, 1, 0, 0, 0, 0, False, 0), (3, 3.0, 0.5, 1, 2, 1, 0, 0, 0, 0, 1, False, 0)],
                              "question_id int, top double, gap double, positive int, n int, approved int, blocked int, stale int, conflicts int, high_conflicts int, missing int, validator_failed boolean, warnings int")
    got = {r["question_id"]: (r["confidence_score"], r["confidence_band"], r["recommended_action"]) for r in E.confidence(s).collect()}
    assert got == {1: (1.0, "green", "answer"), 2: (0.2, "red", "refuse"), 3: (0.56, "yellow", "ask_clarifying_question")}


def test_conflict_kinds(spark):
    rows = [
        (1, 1, "p", "policy", "", "allowed", "v1.2", "", ""), (1, 2, "f", "faq", "", "denied", "v2.0", "", ""),
        (1, 3, "r", "release_note", "", "", "", "", ""), (1, 4, "k", "knowledge_base", "", "", "", "2024-01-01", ""),
        (1, 5, "i", "known_issue", "open", "", "", "", ""), (1, 6, "j", "known_issue", "fixed", "", "", "", ""),
    ]
    c = spark.createDataFrame(
        rows,
        "question_id int, rank int, source_id string, source_type string, status string, decision string, version_text string, expires_at string, needs_review_at string",
    )
    got = sorted((r["conflict_type"], r["source_a"], r["source_b"]) for r in E.conflicts(c, F.lit("2024-02-01").cast("timestamp")).collect())
    assert got == [
        ("known_issue_status_conflict", "i", "j"), ("policy_vs_faq", "p", "f"), ("stale_kb_vs_release_note", "r", "k"),
        ("version_specific_behavior_conflict", "p", "f"),
    ]


def test_draft_sections_in_any_order(spark):
    d = spark.createDataFrame(
        [("Sources: KB-1\nDiagnosis: it broke\nRoot Cause: rust ",), ("no labels",)], "t string",
    ).select(*E.draft_sections(F.col("t"))).collect()
    assert (d[0]["sources"], d[0]["diagnosis"], d[0]["root_cause"], d[0]["draft_email"]) == ("KB-1", "it broke", "rust", "")
    assert d[1]["diagnosis"] == ""


def test_invalid_citations(spark):
    got = spark.createDataFrame([("ok [KB-1] but see KB #2 and [KB article]",)], "t string").select(E.invalid_citations(F.col("t"))).first()[0]
    assert "[KB article]" in got and any("#2" in x for x in got) and not any("KB-1" in x for x in got)


def test_recall_of_the_registered_ivf_query(spark):
    from deskgrain.plans import retrieval_queries as Q

    sf = "/root/testdata/sf0.1"
    exact = {(r["question_id"], r["chunk_id"]) for r in Q.dense_topk(spark, sf).where("rank <= 10").collect()}
    found = {(r["question_id"], r["chunk_id"]) for r in Q.ivf_dense_topk(spark, sf).collect()}
    share = len(exact & found) / len(exact)
    print("recall", round(share, 4), len(exact))
    assert share >= 0.9


def test_cells_of_no_chunks(spark):
    """An empty chunk table, or one without a usable vector, gives an empty result."""
    chunks = spark.createDataFrame([("c", None)], "chunk_id string, embedding array<float>")
    questions = spark.createDataFrame([("q", [1.0, 0.0])], "question_id string, embedding array<float>")
    for c in (chunks, chunks.limit(0)):
        assert R.ivf_topk(c, questions, k=3, cells=None, probes=None).count() == 0
