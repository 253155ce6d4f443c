"""Registered evaluation queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from deskgrain.functions import text as T
from deskgrain.operators import evaluation as V
from deskgrain.operators import retrieval as R
from deskgrain.operators.percentiles import percentiles

from .common import WS, book, pick, table
from .retrieval_queries import CAND, ROUTE_NAMES, _list, candidates

QUERIES, SQL, query = book()


def src(n: int):
    return F.concat(F.lit("src"), ((F.col("ticket_id") + n) % 20).cast("string"))


def aliases(spark):
    return spark.createDataFrame([("src1", "src2"), ("src1", "src3"), ("src8", "src9")], "source_id string, alias string")


def _upper(c):
    """Capital letters one for one, as SQL has them: ß has no single one and stays."""
    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0)), lambda x: F.when(F.length(F.upper(x)) == 1, F.upper(x)).otherwise(x)), "")


def golden(spark, sf):
    q = F.col("ticket_id")
    t = candidates(spark, sf).groupBy(F.col("question_id").alias("ticket_id")).agg(F.min_by("content", "chunk_id").alias("content"))
    band = F.when(q % 3 == 0, "red").when(q % 3 == 1, "yellow").otherwise(F.when(q % 5 == 0, "blue").otherwise("green"))
    return t.select(
        "ticket_id", F.when(q % 25 != 24, pick(ROUTE_NAMES, q % 8)).alias("expected_route"),
        band.alias("expected_confidence_band"), F.array(src(0), src(7)).alias("expected_source_ids"),
        F.array(F.when(q % 10 == 0, src(7)).otherwise(src(1))).alias("forbidden_source_ids"),
        (q % 2 == 0).alias("review_required_expected"), F.array(_upper(F.substring("content", 1, 30)), F.lit(" THE ")).alias("must_include_points"),
        F.array(F.lit("the  the"), F.lit("  "), F.lit("que")).alias("must_not_include_points"),
    )


def results(spark, sf):
    q = F.col("ticket_id")
    r = R.top_k(candidates(spark, sf), 10).groupBy(F.col("question_id").alias("ticket_id")).agg(
        F.array_sort(F.collect_list(F.struct("rank", "source_id"))).alias("r"), F.sum(F.length("content")).alias("chars"),
        F.min_by("content", "rank").alias("answer"),
    )
    ids = F.transform("r", lambda x: x["source_id"])
    return r.select("ticket_id", pick(ROUTE_NAMES, (q + F.when(q % 5 == 0, 1).otherwise(0)) % 8).alias("route"), F.when(q % 3 == 0, "red").when(q % 4 == 0, "yellow").otherwise("green").alias("confidence_band"), (q % 6 == 0).alias("abstained"), (q % 4 != 1).alias("validation_passed"), F.slice(ids, 1, 3).alias("cited_source_ids"), F.when(q % 4 != 0, F.slice(ids, 1, 2)).alias("customer_cited"), ids.alias("retrieved_source_ids"),
                    (q % 11 == 0).cast("int").alias("unapproved"), F.lit(0).alias("raw_citations"), (q % 9 == 0).cast("int").alias("unsupported"), (F.col("chars") % 5000).cast("double").alias("latency_ms"), ((F.col("chars") % 1000) / 100000).alias("cost_usd"), (F.col("chars") / 4).alias("total_tokens"), F.col("answer").alias("answer_text"), (F.col("chars") / 8).alias("tokens_in"), F.when(q % 3 != 0, F.col("chars") / 8).alias("tokens_out"), F.when(q % 3 != 1, (F.col("chars") % 100) / 100).alias("faithfulness_score"), ((F.col("chars") % 8) / 8).alias("context_relevance_score"), ((F.col("chars") % 4) / 4).alias("answer_relevance_score"))


def _norm(c: str) -> str:
    return f"trim(regexp_replace(lower({c}), {WS}, ' ', 'g'))"


RES = f"""{CAND}, al(source_id, alias) AS (VALUES ('src1', 'src2'), ('src1', 'src3'), ('src8', 'src9')),
g AS (SELECT question_id AS t, upper(arg_min(content, chunk_id)[1:30]) AS point, 'src' || (question_id % 20) AS e1, 'src' || ((question_id + 7) % 20) AS e2,
  CASE WHEN question_id % 25 <> 24 THEN ({_list(ROUTE_NAMES)})[1 + question_id % 8] END AS xr,
  CASE WHEN question_id % 3 = 0 THEN 'red' WHEN question_id % 3 = 1 THEN 'yellow' WHEN question_id % 5 = 0 THEN 'blue' ELSE 'green' END AS xb,
  CASE WHEN question_id % 10 = 0 THEN 'src' || ((question_id + 7) % 20) ELSE 'src' || ((question_id + 1) % 20) END AS fb, question_id % 2 = 0 AS rv
  FROM cand GROUP BY question_id),
gg AS (SELECT g.*, [e1] || coalesce((SELECT list(alias)
  FROM al
  WHERE source_id = e1), []) AS g1, [e2] || coalesce((SELECT list(alias)
  FROM al
  WHERE source_id = e2), []) AS g2
  FROM g),
r AS (SELECT question_id AS t, list(source_id ORDER BY rank) AS ids, sum(length(content)) AS chars, coalesce(arg_min(content, rank), '') AS answer FROM ranked WHERE rank <= 10 GROUP BY question_id),
rr AS (SELECT t, ids, chars, answer, ({_list(ROUTE_NAMES)})[1 + (t + CASE WHEN t % 5 = 0 THEN 1 ELSE 0 END) % 8] AS route,
  CASE WHEN t % 3 = 0 THEN 'red' WHEN t % 4 = 0 THEN 'yellow' ELSE 'green' END AS band, t % 6 = 0 AS ab, t % 4 <> 1 AS ok,
  CAST(chars % 5000 AS DOUBLE) AS lat, (chars % 1000) / 100000.0::DOUBLE AS cost, chars / 4.0::DOUBLE AS tok,
  CASE WHEN t % 6 = 0 THEN [] WHEN t % 4 <> 0 THEN list_distinct(ids[1:2]) ELSE list_distinct(ids[1:3]) END AS cited
  FROM r),
j0 AS (SELECT rr.*, gg.* EXCLUDE (t), gg.xr IS NOT NULL AS known, g1 || g2 AS allowed FROM rr LEFT JOIN gg USING (t)),
j AS (SELECT *, (list_has_any(g1, ids[1:1])::INT + list_has_any(g2, ids[1:1])::INT) / 2.0::DOUBLE AS r1, (list_has_any(g1, ids[1:3])::INT + list_has_any(g2, ids[1:3])::INT) / 2.0::DOUBLE AS r3, (list_has_any(g1, ids[1:5])::INT + list_has_any(g2, ids[1:5])::INT) / 2.0::DOUBLE AS r5, (list_has_any(g1, ids)::INT + list_has_any(g2, ids)::INT) / 2.0::DOUBLE AS ra,
 coalesce(1.0::DOUBLE / list_min(list_filter(range(1, len(ids) + 1), lambda i: list_contains(allowed, ids[i]))), 0) AS rrk, len(list_intersect(list_distinct(ids), allowed)) / len(list_distinct(ids))::DOUBLE AS sp, (list_has_any(g1, cited)::INT + list_has_any(g2, cited)::INT) / 2.0::DOUBLE AS cr,
 CASE WHEN len(cited) > 0 THEN len(list_intersect(cited, allowed)) / len(cited)::DOUBLE WHEN t % 4 <> 0 THEN 1.0 END AS cp,
 CASE WHEN NOT known THEN 1 ELSE 0 END + CASE WHEN list_contains(cited, fb) THEN 1 ELSE 0 END + CASE WHEN t % 11 = 0 THEN 1 ELSE 0 END + CASE WHEN t % 9 = 0 AND NOT ab THEN 1 ELSE 0 END + CASE WHEN band = 'red' AND NOT ab THEN 1 ELSE 0 END + CASE WHEN len(list_filter(cited, lambda s: NOT list_contains(coalesce(allowed, []), s))) > 0 THEN 1 ELSE 0 END AS nf,
 CASE WHEN answer <> '' THEN CASE WHEN trim(point) <> '' THEN (contains({_norm('answer')}, {_norm('point')})::INT + contains({_norm('answer')}, 'the')::INT) / 2.0::DOUBLE ELSE contains({_norm('answer')}, 'the')::INT::DOUBLE END END AS cov,
 contains({_norm('answer')}, 'the the')::INT + contains({_norm('answer')}, 'que')::INT AS viol
  FROM j0)"""
avg = lambda c: f"round(avg({c}), 4)"
SUMMARY = f"""sm AS (SELECT count(*) AS evaluated, {avg('r1')} AS retrieval_recall_at_1, {avg('r3')} AS retrieval_recall_at_3, {avg('r5')} AS retrieval_recall_at_5, {avg('ra')} AS retrieval_recall, {avg('rrk')} AS mean_reciprocal_rank, {avg('sp')} AS source_precision, {avg('cr')} AS citation_recall, {avg('cp')} AS citation_precision, {avg('(route = xr)::INT')} AS route_accuracy, {avg('(band = xb)::INT')} AS confidence_band_accuracy,
 {avg("(ab = (rv AND xb = 'red'))::INT")} AS abstention_accuracy, {avg('ab::INT')} AS fallback_rate, {avg('ok::INT')} AS validation_pass_rate, {avg('lat')} AS avg_latency_ms, round(quantile_cont(lat, 0.5), 4) AS p50_latency_ms, round(quantile_cont(lat, 0.95), 4) AS p95_latency_ms, {avg('tok')} AS avg_total_tokens, round(sum(cost), 6) AS total_cost_usd, {avg('cost')} AS avg_cost_usd,
 {avg('cov')} AS required_point_coverage, CAST(sum(viol) AS BIGINT) AS forbidden_point_violation_count, {avg('CASE WHEN t % 3 <> 1 THEN (chars % 100) / 100.0::DOUBLE END')} AS ragas_faithfulness, {avg('(chars % 8) / 8.0::DOUBLE')} AS triad_context_relevance, {avg('CASE WHEN t % 3 <> 1 THEN (chars % 100) / 100.0::DOUBLE END')} AS triad_groundedness, {avg('(chars % 4) / 4.0::DOUBLE')} AS triad_answer_relevance, {avg('chars / 8.0::DOUBLE')} AS avg_tokens_in, {avg('CASE WHEN t % 3 <> 0 THEN chars / 8.0::DOUBLE END')} AS avg_tokens_out,
 CAST(sum((NOT ok AND NOT (rv OR xb = 'red'))::INT) AS BIGINT) AS validation_failure_count, CAST(sum(nf) AS BIGINT) AS hard_failure_count FROM j WHERE known)"""


def _judged(spark, sf):
    return V.judge(golden(spark, sf), results(spark, sf), aliases(spark))


@query(f"""WITH {CAND}, g AS (SELECT DISTINCT question_id AS t FROM cand)
SELECT t AS ticket_id, 'missing expected_route' AS error FROM g WHERE t % 25 = 24
UNION ALL SELECT t, 'unknown confidence band' FROM g WHERE t % 3 = 2 AND t % 5 = 0
UNION ALL SELECT t, 'a source is both expected and forbidden' FROM g WHERE t % 10 = 0""")
def golden_contract(spark, sf):
    """G1: defects of golden cases."""
    return V.golden_errors(golden(spark, sf), ["ticket_id", "expected_route", "expected_confidence_band"])


@query(f"""WITH {RES} SELECT t AS ticket_id, r1 AS recall_1, r3 AS recall_3, r5 AS recall_5, ra AS recall,
  round(rrk, 6) AS rr,
  round(sp, 6) AS source_precision, cr AS citation_recall,
  round(cp, 6) AS citation_precision
  FROM j
  WHERE known""")
def retrieval_metrics(spark, sf):
    """Recall over alias groups, reciprocal rank and precision of every case."""
    return _judged(spark, sf).where("known").select(
        "ticket_id", "recall_1", "recall_3", "recall_5", "recall", F.round("rr", 6).alias("rr"),
        F.round("source_precision", 6).alias("source_precision"), "citation_recall",
        F.round("citation_precision", 6).alias("citation_precision"),
    )


@query(f"WITH {RES} SELECT t AS ticket_id, CAST(nf AS INT) AS n_failures FROM j WHERE nf > 0")
def hard_failures(spark, sf):
    """Results with hard failures."""
    return _judged(spark, sf).select("ticket_id", F.size("failures").alias("n_failures")).where("n_failures > 0")


@query(f"WITH {RES}, {SUMMARY} SELECT * FROM sm")
def evaluation_summary(spark, sf):
    """The whole report."""
    return V.summary(_judged(spark, sf))


METRICS = ["retrieval_recall_at_3", "retrieval_recall_at_5", "source_precision", "required_point_coverage", "hard_failure_count", "validation_failure_count", "avg_latency_ms"]
#: All figures of a report, in order.
REPORT = """evaluated route_accuracy confidence_band_accuracy abstention_accuracy fallback_rate validation_pass_rate retrieval_recall retrieval_recall_at_1
retrieval_recall_at_3 retrieval_recall_at_5 mean_reciprocal_rank source_precision citation_recall citation_precision required_point_coverage
forbidden_point_violation_count ragas_faithfulness triad_context_relevance triad_groundedness triad_answer_relevance avg_latency_ms p50_latency_ms
p95_latency_ms avg_total_tokens avg_tokens_in avg_tokens_out total_cost_usd avg_cost_usd validation_failure_count hard_failure_count""".split()
ROWS = "mr AS (" + " UNION ALL ".join(f"SELECT '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM sm" for m in METRICS) + ")"


def _rows(spark, sf, metrics=METRICS):
    return V.metric_rows(V.summary(_judged(spark, sf)).select(*metrics))


@query(f"WITH {RES}, {SUMMARY}, {ROWS} SELECT metric, value AS current, 0.5::DOUBLE AS baseline, round(value - 0.5, 6) AS delta FROM mr")
def baseline_diff(spark, sf):
    """Difference to a stored baseline, metric by metric."""
    rows = _rows(spark, sf)
    return V.baseline_diff(rows, rows.select("metric", F.lit(0.5).alias("value")))


@query(f"""WITH {RES}, {SUMMARY}, {ROWS}, t(metric, kind, bound) AS (VALUES ('retrieval_recall_at_3', 'min', 0.75), ('retrieval_recall_at_5', 'min', 0.75), ('source_precision', 'min', 0.6), ('required_point_coverage', 'min', 0.5), ('validation_failure_count', 'max', 4.0), ('hard_failure_count', 'max', 0.0))
SELECT metric,
  CASE WHEN value IS NULL THEN 'missing' WHEN kind = 'min' THEN 'below target' ELSE 'above budget' END AS problem
  FROM t
  LEFT JOIN mr USING (metric)
  WHERE (value IS NULL AND kind = 'min') OR (kind = 'min' AND value < bound) OR (kind = 'max' AND value > bound)""")
def release_gate(spark, sf):
    """What blocks a production release."""
    return V.gate(_rows(spark, sf), V.PRODUCTION_TARGETS)


@query(f"""WITH {RES}, b AS (SELECT CASE WHEN len(list_filter(cited, lambda s: NOT list_contains(coalesce(allowed, []), s))) > 0 THEN 'customer_over_citation' WHEN len(list_filter(ids, lambda s: NOT list_contains(coalesce(allowed, []), s))) > 0 THEN 'context_only_over_breadth' WHEN known AND NOT list_has_any(ids, allowed) THEN 'missing_expected_retrieval' ELSE 'clean' END AS bucket
  FROM j)
SELECT bucket, count(*) AS n FROM b GROUP BY bucket""")
def safety_triage(spark, sf):
    """Source-safety buckets."""
    return V.triage(_judged(spark, sf)).groupBy("bucket").agg(F.count("*").alias("n"))


@query(f"""WITH {RES}, u AS (SELECT unnest(list_filter(cited, lambda s: NOT list_contains(coalesce(allowed, []), s))) AS source_id FROM j)
SELECT source_id, count(*) AS n FROM u GROUP BY source_id ORDER BY n DESC, source_id LIMIT 25""")
def unallowed_sources(spark, sf):
    """The 25 sources cited most without being allowed."""
    return V.triage(_judged(spark, sf)).select(F.explode("unallowed").alias("source_id")).groupBy("source_id").agg(F.count("*").alias("n")).orderBy(
        F.desc("n"), "source_id",
    ).limit(25)


@query(f"""WITH d AS (SELECT trim(regexp_replace(lower(text), {WS}, ' ', 'g')) AS t FROM documents),
b AS (SELECT item_id, trim(regexp_replace(lower(text), {WS}, ' ', 'g')) AS p FROM benchmark)
SELECT item_id, (SELECT count(*) FROM documents) AS answers, (SELECT count(*) FROM d WHERE contains(t, p)) AS hits FROM b""")
def point_coverage(spark, sf):
    """In how many answers (documents) each required point (benchmark text) is found."""
    points = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("point"))
    return V.point_hits(table(spark, sf, "documents"), points, "doc_id", "text")


@query("""SELECT doc_id,
  array_to_string(list_sort(list_distinct(regexp_extract_all(text || ' [KB-' || (doc_id % 5) || '] and [KB-2]', '\\[KB-(\\d+)\\]', 1))), ',') AS labels,
  CAST(n_chars // 4 AS BIGINT) AS total_tokens, n_chars % 7 = 0 AS abstained
  FROM documents""")
def stored_results(spark, sf):
    """Stored answers as result rows: labels cited, tokens and abstention, from their JSON."""
    d = table(spark, sf, "documents")
    blob = F.to_json(
        F.struct(
            F.concat(F.col("text"), F.lit(" [KB-"), (F.col("doc_id") % 5).cast("string"), F.lit("] and [KB-2]")).alias("answer"),
            F.expr("n_chars div 4").alias("tokens"), (F.col("n_chars") % 7 == 0).alias("abstained"),
        )
    )
    a = d.select("doc_id", F.from_json(blob, "answer string, tokens long, abstained boolean").alias("a"))
    return a.select(
        "doc_id",
        F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all("a.answer", F.lit(r"\[KB-(\d+)\]"), F.lit(1)))), ",").alias("labels"),
        F.col("a.tokens").alias("total_tokens"), "a.abstained",
    )


ARMS = """ar AS (SELECT l_returnflag AS arm,
  round(quantile_cont(l_quantity, 0.95), 4) AS p95_latency_ms,
  round(avg(l_discount), 4) AS avg_cost_usd,
  round(avg((l_tax < 0.04)::INT), 4) AS recall,
  CAST(count(*) FILTER (WHERE l_quantity > 49) AS DOUBLE) AS hard_failures
  FROM lineitem
  GROUP BY 1),
am AS (SELECT arm, 'p95_latency_ms' AS metric, p95_latency_ms AS value FROM ar
UNION ALL SELECT arm, 'avg_cost_usd', avg_cost_usd FROM ar
UNION ALL SELECT arm, 'recall', recall FROM ar
UNION ALL SELECT arm, 'hard_failures', hard_failures FROM ar),
ad AS (SELECT a.arm, a.metric, a.value, round(a.value - b.value, 6) AS delta FROM am a JOIN am b ON a.metric = b.metric AND b.arm = 'A')"""


def _arms(spark, sf):
    l = table(spark, sf, "lineitem")
    r = l.groupBy(F.col("l_returnflag").alias("arm")).agg(
        F.round(F.avg("l_discount"), 4).alias("avg_cost_usd"),
        F.round(F.avg((F.col("l_tax") < 0.04).cast("int")), 4).alias("recall"),
        F.count_if(F.col("l_quantity") > 49).cast("double").alias("hard_failures"),
    )
    p = percentiles(l.withColumnRenamed("l_returnflag", "arm"), ["arm"], "l_quantity", [0.95])
    return V.metric_rows(r.join(p.select("arm", F.round("p0", 4).alias("p95_latency_ms")), "arm"), ["arm"])


@query(f"WITH {ARMS} SELECT * FROM ad")
def arm_comparison(spark, sf):
    """Metrics of arms with differences to the first."""
    return V.arm_deltas(_arms(spark, sf), "A")


@query(f"""WITH {ARMS} SELECT metric,
  max(CASE WHEN arm = 'A' THEN value END) AS a,
  max(CASE WHEN arm = 'N' THEN value END) AS n,
  max(CASE WHEN arm = 'R' THEN value END) AS r
  FROM am
  GROUP BY metric""")
def arm_table(spark, sf):
    """Arms as columns."""
    return _arms(spark, sf).groupBy("metric").pivot("arm", ["A", "N", "R"]).agg(F.max("value")).select(
        "metric", F.col("A").alias("a"), F.col("N").alias("n"), F.col("R").alias("r"),
    )


@query(f"""WITH {ARMS} SELECT arm, metric,
  CASE WHEN metric = 'recall' THEN delta < 0 ELSE delta > abs(value - delta) * CASE metric WHEN 'p95_latency_ms' THEN 0.10 WHEN 'avg_cost_usd' THEN 0.15 ELSE 0 END END AS violated
  FROM ad
  WHERE arm <> 'A'""")
def guardrails(spark, sf):
    """Guardrails of every arm."""
    return V.guard(_arms(spark, sf), "A")


@query(f"""WITH {CAND}, o AS (SELECT question_id, list_sort(list(chunk_id)) AS ids FROM ranked WHERE rank <= 5 GROUP BY 1),
n AS (SELECT question_id, list_sort(list(chunk_id)) AS ids
  FROM (SELECT question_id, chunk_id,
  row_number() OVER (PARTITION BY question_id ORDER BY length(content) DESC, chunk_id) AS rank
  FROM cand)
  WHERE rank <= 5
  GROUP BY 1)
SELECT o.question_id AS trace_id,
  CAST(len(list_filter(n.ids, lambda x: NOT list_contains(o.ids, x))) AS INT) AS n_added,
  CAST(len(list_filter(o.ids, lambda x: NOT list_contains(n.ids, x))) AS INT) AS n_removed, o.question_id % 4 = 0 AS band_changed
  FROM o JOIN n USING (question_id)""")
def replay_diff(spark, sf):
    """What a replay of traces changes."""
    def trace(ranked, band):
        return ranked.groupBy(F.col("question_id").alias("trace_id")).agg(F.collect_set("chunk_id").alias("ids")).withColumns(
            {"band": band, "passed": F.lit(True), "response": F.lit("x"), "latency_ms": F.lit(1)}
        )
    c = candidates(spark, sf)
    old = trace(R.top_k(c, 5), F.lit("green"))
    new = trace(R.top_k(c.withColumn("score", F.length("content").cast("double")), 5), F.when(F.col("trace_id") % 4 == 0, "red").otherwise("green"))
    return V.replay_diff(old, new).select("trace_id", F.size("added").alias("n_added"), F.size("removed").alias("n_removed"), "band_changed")


ALL_ROWS = "mr AS (" + " UNION ALL ".join(f"SELECT '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM sm" for m in REPORT) + ")"


@query(f"""WITH {RES}, {SUMMARY}, {ALL_ROWS} SELECT metric, '| ' || metric || ' | ' || CASE WHEN regexp_matches(metric, 'recall|precision|accuracy|rate|coverage') THEN printf('%.1f', value * 100) || '%' ELSE printf('%.4f', value) END || ' |' AS line
  FROM mr""")
def report_lines(spark, sf):
    """Every metric row of a report rendered."""
    return V.report_lines(_rows(spark, sf, REPORT))


@query()
def turn_edit_distance(spark, sf):
    """Token edit distance between consecutive turns of a conversation (a fold of folds: no SQL)."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf, "conversations").withColumn("before", F.lag("text").over(w)).where("before IS NOT NULL")
    d = T.token_edit_distance(F.col("before"), F.col("text"))
    return c.select("conv_id", "turn", d.alias("distance")).select("conv_id", "turn", "distance")
