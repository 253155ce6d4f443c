"""The support report against plain counting of the same traces."""

import json
import random
from collections import Counter

from pyspark.sql import functions as F

from deskgrain.operators import usage as U

TRACES = "user_id string, team_id string, product string, role string, trace string"


def odd_trace(rng):
    kinds = [{"source_id": "s1", "score": 2}, {"id": "i1", "rerank_score": 0.5}, {"source_id": "", "score": "1.5"}, {"score": 0}, {}]
    stages = {"plan": {"cost_usd": 1}, "draft": {"cost_usd": "2"}, "note": "x"}
    trace = {
        "reranked_results": rng.choice([None, "none", [], rng.choices(kinds, k=rng.randint(1, 4))]),
        "final_response": rng.choice([None, {}, {
            "confidence": rng.choice(["low", "RED", "HIGH", None]), "draft_unavailable_reason": rng.choice(["", "policy", None]),
            "validation": rng.choice([{}, {"review_required": True}, {"other": 1}, None]), "usage_summary": rng.choice([{}, {"total_cost_usd": 0.5}]),
        }]),
        "validation_output": rng.choice([None, {"review_required": True}]),
        "token_usage_by_stage": rng.choice([{}, None, {"cost_usd": 3, "plan": {"cost_usd": 9}}, stages, {"cost_usd": None}]),
    }
    return {k: v for k, v in trace.items() if rng.random() < 0.9}


def amount(x):
    return float(x or 0)


def plain(trace):
    """(sources with scores, no answer, low confidence, review, cost) of a trace."""
    final = trace.get("final_response") or {}
    chunks = trace.get("reranked_results")
    chunks = chunks if isinstance(chunks, list) else []
    validation = final.get("validation") or trace.get("validation_output") or {}
    usage = trace.get("token_usage_by_stage") or {}
    stages = sum(amount(s.get("cost_usd")) for s in usage.values() if isinstance(s, dict))
    cost = amount(usage["cost_usd"]) if "cost_usd" in usage else stages + amount(final.get("usage_summary", {}).get("total_cost_usd"))
    return (
        [(c.get("source_id") or c.get("id") or "unknown", amount(c.get("score")) or amount(c.get("rerank_score"))) for c in chunks],
        not chunks or bool(final.get("draft_unavailable_reason")), str(final.get("confidence", "")).upper() in ("LOW", "RED"),
        bool(validation.get("review_required")), cost,
    )


def test_traces_of_every_shape_and_the_report_over_them(spark):
    rng = random.Random(3)
    made = [odd_trace(rng) for _ in range(400)]
    people = [(rng.choice(["u1", "u2", "", None]), rng.choice(["t1", None]), rng.choice(["p1", "p2", ""]), "agent") for _ in made]
    rows = [(*p, json.dumps(t)) for p, t in zip(people, made)] + [("u3", "t9", "p1", None, None), ("u3", "t9", "p1", None, "{broken")]
    want = [plain(t) for t in made] + [plain({})] * 2
    people += [("u3", "t9", "p1", None)] * 2
    traces = U.read_traces(spark.createDataFrame(rows, TRACES)).cache()
    got = [
        ([(c["source_id"], c["score"]) for c in r["chunks"]], r["no_answer"], r["low_confidence"], r["review_required"], round(r["cost_usd"], 6))
        for r in traces.collect()
    ]
    assert Counter(map(repr, got)) == Counter(map(repr, want))

    feedback = spark.createDataFrame(
        [("thumbs_up", "tone", None), ("thumbs_down", None, "sent"), (None, "wrong_source", "")],
        "rating string, feedback_reason string, agent_action string",
    )
    issues = spark.createDataFrame([("gap", None), ("gap", "closed"), ("", "open")], "issue_type string, status string")
    reviews = spark.createDataFrame([(True, None), (None, "stale")], "needs_escalation boolean, source_issue_type string")
    calls = spark.createDataFrame([(0.5, 10.0), (None, 30.0), (0.25, None)], "cost_usd double, latency_ms double")
    r = U.support_report(traces, feedback, issues, reviews, calls, 7).first()
    total, scores = round(sum(w[4] for w in want), 6), [s for w in want for _, s in w[0]]
    assert r["period_days"] == 7 and r["usage"].asDict() == {"total_queries": 402, "active_users": 3, "active_teams": 2}
    low, none = sum(w[2] for w in want), sum(w[1] for w in want)
    assert r["retrieval"].asDict() == {
        "no_answer_count": none, "no_answer_rate": round(none / 402, 4), "low_confidence_count": low,
        "low_confidence_rate": round(low / 402, 4), "average_top_score": round(sum(scores) / len(scores), 4),
    }
    assert r["evaluation"].asDict() == {
        "total_feedback": 3, "helpful_rate": 0.3333, "negative_feedback_count": 1, "review_required_count": sum(w[3] for w in want),
    }
    assert tuple(r["knowledge_gaps"]) == (2, 0, 1, 0) and tuple(r["escalations"]) == (1, 2)
    assert tuple(r["costs"]) == (total, total, 0.75, round(total / 402, 6), 3, 10.0)

    lists = U.support_lists(traces, feedback, issues, reviews, spark.createDataFrame([(None,)] * 3, "event_type string"), most=2)
    found = {}
    for x in sorted(lists.collect(), key=lambda x: x["place"]):
        found.setdefault(x["list"], []).append((x["name"], x["n"]))

    def top(names, most=2):
        return sorted(Counter(names).items(), key=lambda x: (-x[1], x[0]))[:most]

    assert found == {
        "top_products": top([p[2] or "unknown" for p in people]), "top_roles": [("agent", 400), ("unknown", 2)],
        "top_teams": top([p[1] or "unknown" for p in people]), "most_retrieved_sources": top([s for w in want for s, _ in w[0]]),
        "ratings": [("no_rating", 1), ("thumbs_down", 1), ("thumbs_up", 1)], "agent_actions": [("pending", 2), ("sent", 1)],
        "feedback_reasons": [("tone", 1), ("unspecified", 1)], "issue_types": [("gap", 2), ("unknown", 1)],
        "source_issue_types": [("stale", 1), ("unspecified", 1)], "event_counts": [("unknown", 3)],
    }


def test_report_over_empty_tables(spark):
    none = U.read_traces(spark.createDataFrame([], TRACES))
    empty = spark.createDataFrame([], "rating string, feedback_reason string, agent_action string, issue_type string, status string, "
                                      "needs_escalation boolean, source_issue_type string, cost_usd double, latency_ms double, event_type string")  # fmt: skip
    r = U.support_report(none, empty, empty, empty, empty, 30).first()
    assert {v for s in r if not isinstance(s, int) for v in s} == {0} and U.support_lists(none, empty, empty, empty, empty).count() == 0


def test_lists_read_counts_and_limit_them_before_they_move(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    lists = U.top_lists([(e, {"types": F.col("event_type"), "users": F.col("user_id").cast("string"), "props": F.split("props", " ")})])
    plan = lists._jdf.queryExecution().executedPlan().toString()
    assert "events" not in plan and "named-" in plan  # names were counted once; what is read twice are the counts
    assert "WindowGroupLimit" in plan
