import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from deskgrain.operators import evaluation as V
from deskgrain.operators import ingest as I
from deskgrain.operators import retrieval as R
from deskgrain.operators import workbench as B
from deskgrain.operators.percentiles import percentiles


def test_feedback_fills_in_what_is_missing(spark):
    schema = "feedback_id long, ticket_preview string, original_email string, edited_email string, final_sent_text string, edit_distance_tokens int, citations_used array<string>, agent_action string, rating string"
    rows = [
        (1, "p" * 300, "a b c d", "a x c d", "", None, ["1"], None, "thumbs_up"),
        (2, None, "a b", "a", "b", 7, None, "edited", None), (3, "", None, None, None, None, [], "", None),
    ]
    got = {r["feedback_id"]: r for r in B.feedback_rows(spark.createDataFrame(rows, schema)).collect()}
    assert got[1]["edit_distance_tokens"] == 1 and got[1]["edit_distance_ratio"] == 0.25 and len(
        got[1]["ticket_preview"]
    ) == 200 and got[1]["final_sent_text"] == "a x c d"
    assert got[2][
        "edit_distance_tokens"
    ] == 7 and got[2]["final_sent_text"] == "b" and got[2]["citations_used"] == "[]" and got[1]["agent_action"] == "pending"
    assert got[3]["edit_distance_tokens"] == 0 and got[3]["final_sent_text"] == ""


def test_structured_reply_is_rendered(spark):
    row = [(1, "Login", "cause [KB-2]", "", "see [KB-1] [KB-2]", ["plan", "role"], 1, "LOW"), (2, None, None, None, None, [], 0, "HIGH")]
    d = spark.createDataFrame(
        row,
        "id int, issue_classification string, root_cause string, resolution_steps string, draft_email string, missing array<string>, n_conflicts int, confidence string",
    )
    got = {r["id"]: r for r in B.structured_reply(d).collect()}
    assert got[1]["citations"] == ["[KB-1]", "[KB-2]"] and len(got[1]["caveats"]) == 3
    assert got[1]["reply"].split("\n\n") == ["Login", "cause [KB-2]", "Caveats:\n- " + "\n- ".join(got[1]["caveats"]), "Citations: [KB-1], [KB-2]"]
    assert got[2]["reply"] == "" and got[2]["next_steps"] == ""


def test_contract_of_unknown_and_mapped_columns(spark):
    columns = spark.createDataFrame(
        [("a", "x", "body"), ("a", "title", None), ("b", "y", None)], "source_key string, column_name string, mapped_to string",
    )
    contracts = spark.createDataFrame(
        [("a", "content", ["body", "content"], True, True), ("a", "owner", ["owner"], False, True)],
        "source_key string, field string, any_of array<string>, required boolean, customer_facing boolean",
    )
    got = {(r["source_key"], r["level"], r["message"]) for r in B.source_contract(columns, contracts).collect()}
    assert got == {("a", "warning", "Recommended field missing: owner."), ("b", "error", "Unknown source key 'b'.")}


def test_replay_recommendations(spark):
    arms = spark.createDataFrame([("x", "a"), ("x", "b"), ("y", "a"), ("z", "a"), ("z", "b")], "experiment_id string, arm string")
    cases = spark.createDataFrame([("x",), ("y",)], "experiment_id string")
    got = {r["experiment_id"]: r["recommendation"] for r in B.replay_recommendation(arms, cases).collect()}
    assert got == {"x": "promote", "y": "revise", "z": "revise"}
    bad = spark.createDataFrame([("x", True)], "experiment_id string, violated boolean")
    assert {r["recommendation"] for r in B.replay_recommendation(arms, cases, bad).collect()} == {"revise"}


def test_report_sections(spark):
    report = spark.range(1).select(
        F.struct(F.lit(3).alias("total_queries")).alias("usage"),
        F.struct(F.lit(None).cast("double").alias("cost")).alias("costs"),
    )
    assert B.report_section(report, "usage").first().asDict() == {"total_queries": 3}
    assert [r["line"] for r in B.report_markdown(report, "T").orderBy("line_no").collect()] == ["# T", "", "- Total queries: 3", "- Cost: n/a"]
    with pytest.raises(ValueError):
        B.report_section(report, "secrets")


def test_traces_without_json(spark):
    t = spark.createDataFrame(
        [("a", 1, None), ("b", 2, json.dumps({"final_response": {"confidence": "LOW"}, "reranked_results": ["x", "y"]})), ("c", 3, "{broken")],
        "trace_id string, created_at int, trace string",
    )
    got = [(r["trace_id"], r["confidence"], r["retrieved_result_count"]) for r in B.trace_listing(t, 2).collect()]
    assert got == [("c", "", 0), ("b", "LOW", 2)]


def test_percentiles_against_numpy(spark):
    rng = random.Random(4)
    rows = [(g, float(rng.choice([rng.randint(0, 5), rng.gauss(0, 9)]))) for g in ["a", "b", None] for _ in range(700)] + [
        ("one", 4.0), ("c", None),
    ] + [("same", 2.0)] * 500
    d = spark.createDataFrame(rows, "k string, x double").repartition(5)
    ps = [0.0, 0.5, 0.951, 1.0]
    got = {r["k"]: [r[f"p{i}"] for i in range(4)] for r in percentiles(d, ["k"], "x", ps).collect()}
    low = {r["k"]: [r[f"p{i}"] for i in range(4)] for r in percentiles(d, ["k"], "x", ps, lower=True).collect()}
    for g in ("a", "b", None, "one", "same"):
        x = np.array([v for k, v in rows if k == g])
        assert got[g] == pytest.approx(np.quantile(x, ps).tolist()) and low[g] == pytest.approx(np.quantile(x, ps, method="lower").tolist())
    assert set(got) == {"a", "b", None, "one", "same"}
    assert percentiles(d, [], "x", [0.5]).first()["p0"] == pytest.approx(np.median([v for _, v in rows if v is not None]))
    assert percentiles(d.limit(0), ["k"], "x", [0.5]).count() == 0


def test_points_of_any_length_are_found(spark):
    answers = [
        (1, "The quick  brown fox jumps over the lazy dog"), (2, "quickly done"), (3, None), (4, ""),
        (5, "over the LAZY dogma of quick brown foxes"),
    ]
    points = [
        (1, "quick brown fox"), (2, "the lazy dog"), (3, "quick"), (4, "y d"), (5, "lazy dog"), (6, ""), (7, None),
        (8, "uick brown fox jumps over the la"), (9, "nowhere to be found here"), (10, "Quick Brown"),
    ]
    a, p = spark.createDataFrame(answers, "id int, text string"), spark.createDataFrame(points, "item_id int, point string")
    got = {r["item_id"]: (r["answers"], r["hits"]) for r in V.point_hits(a, p, "id", "text").collect()}
    plain = lambda t: " ".join((t or "").lower().split())
    assert got == {i: (5, sum(plain(q) in plain(t) for _, t in answers)) for i, q in points}
    assert V.point_hits(a.limit(0), p, "id", "text").where("hits > 0 or answers > 0").count() == 0


def brute_bm25(chunks, questions, k, k1=1.5, b=0.75, floor=0.25):
    words = {i: t.lower().split() for i, t in chunks}
    n, avg = len(words), sum(map(len, words.values())) / len(words)
    df = {w: sum(w in v for v in words.values()) for v in words.values() for w in v}
    raw = {w: np.log((n - d + 0.5) / (d + 0.5)) for w, d in df.items()}
    low = floor * np.mean(list(raw.values()))
    out = set()
    for q, text in questions:
        terms = text.lower().split()
        score = {}
        for i, v in words.items():
            if set(terms) & set(v):
                score[i] = round(
                    float(
                        sum(
                            (low if raw[t] < 0 else raw[t]) * v.count(t) * (k1 + 1) / (
                                v.count(t) + k1 * (1 - b + b * len(v) / avg)
                            ) for t in terms if t in v
                        )
                    ),
                    6,
                )
        out |= {(q, i, r + 1, s) for r, (i, s) in enumerate(sorted(score.items(), key=lambda x: (-x[1], x[0]))[:k])}
    return out


def test_bm25_in_blocks_against_plain_loops(spark, monkeypatch):
    monkeypatch.setattr(R, "CHUNK_BLOCK", 7)
    monkeypatch.setattr(R, "QUESTION_BLOCK", 3)
    rng = random.Random(1)
    word = lambda: rng.choice(["the"] * 8 + ["a", "b", "c"] + [f"w{i}" for i in range(40)])
    chunks = [(f"c{i:02d}", " ".join(word() for _ in range(rng.randint(1, 25)))) for i in range(50)]
    questions = [(i, " ".join(word() for _ in range(rng.randint(1, 9)))) for i in range(11)] + [(50, "nothing known"), (51, "")]
    c, q = spark.createDataFrame(
        [*chunks, ("empty", "")], "chunk_id string, text string",
    ), spark.createDataFrame(questions, "question_id long, question string")
    got = {(r["question_id"], r["chunk_id"], r["rank"], r["score"]) for r in R.bm25(c.where("text <> ''"), q, k=4).collect()}
    want = brute_bm25(chunks, questions, 4)
    assert {x[:3] for x in got} == {x[:3] for x in want} and {x[:2]: x[3] for x in got} == {x[:2]: pytest.approx(x[3], abs=2e-6) for x in want}
    assert R.bm25(c.limit(0), q).count() == 0 and R.bm25(c, q.limit(0)).count() == 0


def test_dense_search_of_odd_vectors(spark):
    c = spark.createDataFrame(
        [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [float("nan"), 1.0]), (5, [1.0, 1.0, 1.0]), (6, [None, 1.0]), (7, [0.0, 0.0]), (8, [])],
        "chunk_id long, embedding array<double>",
    )
    q = spark.createDataFrame([(1, [1.0, 0.1]), (20, [1.0, 1.0, 0.0]), (21, None)], "question_id long, embedding array<double>")
    got = {(r["question_id"], r["chunk_id"]): r["score"] for r in R.dense_topk(c, q, 5).collect()}
    assert set(got) == {(1, 2), (1, 7), (20, 5)} and got[(1, 7)] == 0.0


def test_rerank_by_a_model(spark):
    rows = [(1, i, i, "a b", t, w, boost) for i, (t, w, boost) in enumerate([("a", 1.0, None), ("a b", None, None), ("a b", -1.0, 0.2), (None, 1.0, 0.9), ("b", 1.0, 3.0)], 1)]
    d = spark.createDataFrame(rows, "question_id int, chunk_id int, rank int, question string, content string, authority double, policy_boost double")
    words = lambda q, c: [len(set(x.split()) & set(y.split())) for x, y in zip(q, c)]
    got = [(r["chunk_id"], r["rerank_score"]) for r in R.rerank(d, F.lit(3), score_fn=words, cap=4).orderBy("rank").collect()]
    assert got == [(2, 2.0), (1, 1.0), (4, 0.9)]


def test_arms(spark):
    q = spark.createDataFrame([(1, "dense_only"), (2, "graphrag_layer"), (3, "odd"), (4, None)], "question_id int, requested_arm string")
    got = {r["question_id"]: (r["active_arm"], r["enabled"]) for r in R.select_arms(q, ["dense_only", "graphrag_layer"]).collect()}
    assert got == {1: ("dense_only", True), 2: ("disabled", False), 3: ("current_hybrid_rag", True), 4: ("current_hybrid_rag", True)}
    lists = [spark.createDataFrame([(i, c, 1) for i in range(1, 5)], "question_id int, chunk_id string, rank int") for c in ("s", "d")]
    found = {(r["question_id"], r["chunk_id"]) for r in R.fuse_by_arm(*lists, R.select_arms(q, ["dense_only", "graphrag_layer"]), 5).collect()}
    assert found == {(1, "d"), (3, "s"), (3, "d"), (4, "s"), (4, "d")}


def test_chunk_type_rules(spark):
    rules = {
        "x": {"priority": 5, "heading": ["pay"], "content": ["card"], "negative": ["refund"]},
        "y": {"priority": 5, "content": ["card"]}, "off": {"priority": 9, "content": ["card"], "enabled": False},
    }
    rows = [("card", "", ""), ("card refund", "", ""), ("none", "PAY now", ""), ("none", "", "release_note"), ("none", "", "faq"), (None, None, None)]
    d = spark.createDataFrame(rows, "c string, t string, d string")
    got = [r[0] for r in d.select(I.chunk_type(F.col("c"), F.col("t"), F.lit(""), F.col("d"), rules)).collect()]
    assert got == ["y", "y", "x", "release_change", "concept", "concept"]


def test_hashed_embeddings_are_counts(spark):
    d = spark.createDataFrame([(1, "a b a"), (2, "B"), (3, None)], "id int, text string")
    got = {r["id"]: np.array(r["embedding"]) for r in I.embed(d, "text", 64).collect()}
    b = got[2]
    assert b.max() == 1 and (b > 0).sum() == 1 and got[3].sum() == 0
    assert got[1].max() == pytest.approx(2 / 5**0.5, abs=1e-6) and got[1][b.argmax()] == pytest.approx(1 / 5**0.5, abs=1e-6)
