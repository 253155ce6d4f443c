from deskgrain.operators import evaluation as V

GOLDEN = "ticket_id string, expected_route string, expected_confidence_band string, expected_source_ids array<string>, forbidden_source_ids array<string>, review_required_expected boolean"
RESULT = "ticket_id string, route string, confidence_band string, abstained boolean, validation_passed boolean, cited_source_ids array<string>, customer_cited array<string>, retrieved_source_ids array<string>, unapproved int, raw_citations int, unsupported int, latency_ms double, cost_usd double, total_tokens double"


def judged(spark):
    g = spark.createDataFrame([("t1", "bug", "green", ["a", "b"], ["x"], False), ("t2", "access", "red", ["c"], [], True)], GOLDEN)
    r = spark.createDataFrame(
        [
            ("t1", "bug", "green", False, True, ["a", "z"], None, ["a", "q", "b"], 0, 0, 0, 100.0, 0.1, 10.0),
            ("t2", "bug", "red", True, False, [], None, ["q"], 0, 0, 1, 300.0, 0.3, 30.0),
            ("t9", "bug", "red", False, True, ["x"], None, [], 1, 0, 0, 50.0, 0.0, 1.0),
        ],
        RESULT,
    )
    return V.judge(g, r, spark.createDataFrame([("c", "q")], "source_id string, alias string"))


def test_metrics_by_hand(spark):
    s = V.summary(judged(spark)).first()
    assert (s["evaluated"], s["retrieval_recall_at_1"], s["retrieval_recall_at_3"], s["mean_reciprocal_rank"]) == (2, 0.75, 1.0, 1.0)
    assert (s["p50_latency_ms"], s["p95_latency_ms"], s["route_accuracy"], s["fallback_rate"]) == (200.0, 290.0, 0.5, 0.5)
    assert s["citation_precision"] == 0.5 and s["total_cost_usd"] == 0.4


def test_hard_failures(spark):
    f = {r["ticket_id"]: sorted(r["failures"]) for r in judged(spark).collect()}
    assert f["t1"] == ["unallowed source cited"] and f["t2"] == []
    assert f["t9"] == ["no golden case", "red answer not abstained", "unallowed source cited", "unapproved citation"]


def test_gate_and_diff(spark):
    m = spark.createDataFrame([("retrieval_recall_at_3", 0.6), ("avg_latency_ms", 120.0), ("hard_failure_count", 0.0)], "metric string, value double")
    b = spark.createDataFrame([("retrieval_recall_at_3", 0.7), ("avg_latency_ms", 150.0)], "metric string, value double")
    d = V.baseline_diff(m, b)
    got = sorted(
        (r["metric"], r["problem"]) for r in V.gate(m, [("retrieval_recall_at_3", "min", 0.75), ("source_precision", "min", 0.6)], d).collect()
    )
    assert got == [("retrieval_recall_at_3", "below target"), ("retrieval_recall_at_3", "regressed"), ("source_precision", "missing")]


def test_guardrails(spark):
    rows = spark.createDataFrame(
        [("A", "p95_latency_ms", 100.0), ("B", "p95_latency_ms", 115.0), ("A", "recall", 0.5), ("B", "recall", 0.5)],
        "arm string, metric string, value double",
    )
    assert {r["metric"]: r["violated"] for r in V.guard(rows, "A").collect()} == {"p95_latency_ms": True, "recall": False}


def test_queries_read_whole_texts(spark, tmp_path):
    from deskgrain.plans import registry

    text = " ".join(f"w{i}" for i in range(300)) + " [KB-77] end"
    spark.createDataFrame(
        [(1, text, "en", "s", len(text))], "doc_id long, text string, lang string, source string, n_chars long",
    ).write.parquet(f"{tmp_path}/documents.parquet")
    got = {n: registry.queries()[n](spark, str(tmp_path)).first() for n in ("stored_results", "draft_sections", "document_slugs")}
    assert got["stored_results"]["labels"] == "1,2,77"
    assert got["draft_sections"]["diagnosis"] == text and got["draft_sections"]["sources"] == "s"
    assert got["document_slugs"]["slug"].endswith("kb_77__end")


def test_points_tokens_and_triad(spark):
    """Points by text alone, letter case and white space aside; nothing is judged without an answer, and columns may be absent."""
    golden = spark.createDataFrame(
        [
            ("t1", "bug", "green", ["a"], [], False, ["Reset  the PASSWORD", "never there", " "], ["call us", ""]),
            ("t2", "bug", "green", ["a"], [], False, ["x"], ["x"]), ("t3", "bug", "green", ["a"], [], False, None, ["é", "É"]),
            ("t4", "bug", "green", ["a"], [], False, ["due"], None),
        ],
        GOLDEN + ", must_include_points array<string>, must_not_include_points array<string>",
    )
    plain = ("bug", "green", False, True, ["a"], None, ["a"], 0, 0, 0, 1.0, 0.0, 1.0)
    rows = [
        ("t1", *plain, "Please reset the\npassword, then CALL  US.", 10.0, 0.5), ("t2", *plain, "", 30.0, None), ("t3", *plain, "café", None, 1.0),
        ("t4", *plain, "overdue", None, None),
    ]
    results = spark.createDataFrame(rows, RESULT + ", answer_text string, tokens_in double, faithfulness_score double")
    none = spark.createDataFrame([], "source_id string, alias string")
    judged = V.judge(golden, results, none)
    assert {r["ticket_id"]: (r["point_coverage"], r["point_violations"]) for r in judged.collect()} == {
        "t1": (0.5, 1), "t2": (None, 0), "t3": (None, 2), "t4": (1.0, 0),
    }
    s = V.summary(judged).first()
    assert (s["required_point_coverage"], s["forbidden_point_violation_count"], s["avg_tokens_in"], s["avg_tokens_out"]) == (0.75, 3, 20.0, None)
    assert (s["ragas_faithfulness"], s["triad_groundedness"], s["triad_context_relevance"]) == (0.75, 0.75, None)
    assert V.gate(V.metric_rows(V.summary(judged)), V.PRODUCTION_TARGETS).where("metric = 'required_point_coverage'").count() == 0
    bare = V.summary(V.judge(golden.drop("must_include_points", "must_not_include_points"), results.drop("answer_text"), none)).first()
    assert (bare["required_point_coverage"], bare["forbidden_point_violation_count"]) == (None, 0)


def test_report_lines_round_by_binary_values(spark):
    """As the reference's formats do: 37.15 is a little less than it shows, 37.25 is a tie that goes to the even digit."""
    values = [i / 10_000 for i in range(1, 1000)] + [0.3715, 0.3725, 0.3745, 1.0, 0.0]
    rows = [("recall", v) for v in values] + [("cost", v / 10) for v in values] + [("rate", None), ("cost", 12345.67885), ("cost", None)]
    want = [f"| {m} | " + ("n/a" if v is None else f"{v * 100:.1f}%" if m != "cost" else f"{v:.4f}") + " |" for m, v in rows]
    got = V.report_lines(spark.createDataFrame(rows, "metric string, value double")).collect()
    assert sorted(r["line"] for r in got) == sorted(want)


def test_points_have_capitals_one_for_one(spark):
    from deskgrain.plans.evaluation_queries import _upper

    got = spark.createDataFrame([("Straße ﬁn\nçа\U0001F600é",)], "t string").select(_upper("t")).first()[0]
    assert got == "STRAßE ﬁN\nÇА\U0001F600É"
