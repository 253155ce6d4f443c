"""Evaluation of stored answers against golden cases, release gates and comparisons of arms."""

from __future__ import annotations

import pandas as pd
from pyspark.ml.feature import NGram
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskgrain.functions import text as T
from deskgrain.functions.frames import small
from deskgrain.operators.percentiles import percentiles

BANDS = ("green", "yellow", "red")
#: Targets of the production profile: metric, kind of bound, bound.
PRODUCTION_TARGETS = [
    ("retrieval_recall_at_3", "min", 0.75), ("retrieval_recall_at_5", "min", 0.75), ("source_precision", "min", 0.60),
    ("required_point_coverage", "min", 0.50), ("validation_failure_count", "max", 4.0),
]
#: Guardrails of an experiment arm against the first arm: metric, largest relative increase (latency, cost) or 0 drop.
GUARDRAILS = [("p95_latency_ms", "increase", 0.10), ("avg_cost_usd", "increase", 0.15), ("recall", "drop", 0.0), ("hard_failures", "increase", 0.0)]
RISES_ARE_BAD = (
    "avg_latency_ms", "p50_latency_ms", "p95_latency_ms", "total_cost_usd", "avg_cost_usd", "validation_failure_count",
    "hard_failure_count", "forbidden_point_violation_count",
)


def golden_errors(golden: DataFrame, required: list[str]) -> DataFrame:
    """(ticket_id, error) for every defect of a golden case."""
    blank = [F.when(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "", F.concat(F.lit("missing "), F.lit(c))) for c in required]
    both = F.size(F.array_intersect("expected_source_ids", "forbidden_source_ids")) > 0
    errors = F.array_compact(
        F.array(
            *blank, F.when(~F.col("expected_confidence_band").isin(*BANDS), "unknown confidence band"),
            F.when(both, "a source is both expected and forbidden"),
        )
    )
    return golden.select("ticket_id", F.explode(errors).alias("error"))


def expected_groups(golden: DataFrame, aliases: DataFrame) -> DataFrame:
    """``golden`` with groups: for each expected source the array of names it may come under (aliases: source_id, alias)."""
    a = small(aliases.groupBy("source_id").agg(F.collect_set("alias").alias("names")))
    g = golden.select("ticket_id", F.posexplode("expected_source_ids").alias("i", "source_id")).join(a, "source_id", "left")
    groups = g.groupBy("ticket_id").agg(
        F.array_sort(
            F.collect_list(
                F.struct("i", F.array_distinct(F.concat(F.array("source_id"), F.coalesce("names", F.array().cast("array<string>")))).alias("names"))
            )
        ).alias("g")
    )
    return golden.join(groups.select("ticket_id", F.transform("g", lambda x: x["names"]).alias("groups")), "ticket_id", "left")


def recall(groups: Column, found: Column) -> Column:
    return F.when(F.size(groups) > 0, F.size(F.filter(groups, lambda g: F.arrays_overlap(g, found))) / F.size(groups))


def reciprocal_rank(groups: Column, ranked: Column) -> Column:
    hits = F.filter(F.transform(ranked, lambda s, i: F.when(F.array_contains(F.flatten(groups), s), i + 1)), lambda p: p.isNotNull())
    return F.coalesce(1 / F.array_min(hits), F.lit(0.0))


def overlap_share(found: Column, allowed: Column) -> Column:
    f = F.array_distinct(found)
    return F.when((F.size(f) > 0) & (F.size(allowed) > 0), F.size(F.array_intersect(f, allowed)) / F.size(f))


def normal(c: Column) -> Column:
    return T.collapse(F.lower(c))


def points_found(answer: Column, points: Column) -> Column:
    """How many points are in the answer, letter case and white space aside."""
    text = normal(answer)
    return F.size(F.filter(points, lambda p: F.contains(text, normal(p))))


#: Whole words that lead a point's key.
KEY_WORDS = 4


def point_hits(answers: DataFrame, points: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, answers, hits): of each of ``points`` (item_id, point) how many answers there are and how many hold it,
    letter case and white space aside.

    No answer meets a point that it shares no key with: all words of a point but the first and the last stand in an answer
    as they are, so its key is the first few of these, and answers give their word sequences of such lengths. Points of one
    or two words have their last word as key, and answers the parts of their words of such lengths. Candidates are checked
    by the whole texts. A null or empty point is in every answer; a null answer is empty.
    """
    p = points.select("item_id", F.coalesce(normal(F.col("point")), F.lit("")).alias("point")).distinct()
    w = F.filter(F.split("point", " "), lambda x: x != "")
    inner = F.slice(w, 2, F.least(F.lit(KEY_WORDS), F.size(w) - 2))
    p = p.withColumn("words", F.greatest(F.least(F.size(w) - 2, F.lit(KEY_WORDS)), F.lit(0)))
    p = p.withColumn("key", F.when(F.col("words") > 0, F.array_join(inner, " ")).when(F.size(w) > 0, F.element_at(w, -1)))
    shapes = [
        (r["words"], r["n"]) for r in p.where("key IS NOT NULL").select(
            "words", F.when(F.col("words") == 0, F.length("key")).alias("n"),
        ).distinct().collect()
    ]  # few: key lengths
    a = answers.select(F.col(id_col).alias("_id"), normal(F.col(text_col)).alias("_text"))
    total = a.agg(F.count("*").alias("answers"))
    none = F.array().cast("array<string>")
    a = a.withColumn("_said", F.split("_text", " "))
    for k in sorted({k for k, _ in shapes if k}):
        a = NGram(n=k, inputCol="_said", outputCol=f"_run{k}").transform(a)

    def parts(n: int) -> Column:
        return F.flatten(
            F.transform(
                F.array_distinct("_said"),
                lambda x: F.when(
                    F.length(x) >= n,
                    F.transform(F.sequence(F.lit(1), F.length(x) - n + 1), lambda i: F.substring(x, i, F.lit(n))),
                ).otherwise(none),
            )
        )

    held = F.flatten(F.array(none, *[F.col(f"_run{k}") if k else parts(n) for k, n in sorted(shapes, key=str)]))
    keys = p.where("key IS NOT NULL")
    met = a.select(
        "_id", F.explode(F.array_distinct(held)).alias("key"),
    ).join(keys.select("item_id", "key"), "key").select("_id", "item_id").distinct()
    found = met.join(a.select("_id", "_text"), "_id").join(p.select("item_id", "point"), "item_id").where(F.contains("_text", "point"))
    hits = found.groupBy("item_id").agg(F.count("*").alias("_hits"))
    # one row of totals: the number of answers
    out = points.select("item_id").distinct().join(hits, "item_id", "left").join(
        p.where("key IS NULL").select("item_id", F.lit(True).alias("_all")), "item_id", "left",
    ).join(F.broadcast(total), F.lit(True))
    return out.select(
        "item_id", "answers",
        F.when(F.col("_all"), F.col("answers")).otherwise(F.coalesce("_hits", F.lit(0))).cast("long").alias("hits"),
    )


#: Columns that results may have beyond those every result has.
OPTIONAL = {
    "answer_text": "string", "tokens_in": "double", "tokens_out": "double", "faithfulness_score": "double",
    "context_relevance_score": "double", "answer_relevance_score": "double",
}


def judge(golden: DataFrame, results: DataFrame, aliases: DataFrame) -> DataFrame:
    """One row for each result with its metrics and hard failures.

    golden: ticket_id, expected_route, expected_confidence_band, expected_source_ids, forbidden_source_ids,
    review_required_expected, and, if there are any, must_include_points and must_not_include_points. results: ticket_id, route,
    confidence_band, abstained, validation_passed, cited_source_ids, customer_cited (may be null), retrieved_source_ids, unapproved,
    raw_citations, unsupported, latency_ms, cost_usd, total_tokens, and, if there are any, the columns of ``OPTIONAL``.

    Blank points are none. Points are judged only where there is an answer: coverage is null without one or without points.
    """
    for c, kind in OPTIONAL.items():
        results = results if c in results.columns else results.withColumn(c, F.lit(None).cast(kind))
    for c in ("must_include_points", "must_not_include_points"):
        golden = golden if c in golden.columns else golden.withColumn(c, F.lit(None).cast("array<string>"))
    g = expected_groups(golden, aliases)
    j = results.join(g, "ticket_id", "left").withColumn("known", F.col("expected_route").isNotNull())
    none = F.array().cast("array<string>")
    cited = F.when(F.col("abstained"), none).otherwise(F.array_distinct(F.coalesce("customer_cited", "cited_source_ids")))
    j = j.withColumn("cited", cited).withColumn("allowed", F.flatten("groups"))
    r = F.col("retrieved_source_ids")
    fail = F.array_compact(F.array(
        F.when(~F.col("known"), "no golden case"),
        F.when(F.arrays_overlap("cited", "forbidden_source_ids"), "forbidden source cited"),
        F.when(F.col("unapproved") > 0, "unapproved citation"), F.when(F.col("raw_citations") > 0, "raw ticket citation"),
        F.when((F.col("unsupported") > 0) & ~F.col("abstained"), "unsupported claim"),
        F.when((F.col("confidence_band") == "red") & ~F.col("abstained"), "red answer not abstained"),
        F.when(F.size(F.array_except("cited", F.coalesce("allowed", none))) > 0, "unallowed source cited"),
    ))
    red = F.col("expected_confidence_band") == "red"
    answered = F.coalesce(F.col("answer_text") != "", F.lit(False))

    def points(c: str) -> Column:
        return F.filter(F.coalesce(F.col(c), none), lambda p: normal(p) != "")

    must, never = points("must_include_points"), points("must_not_include_points")
    return j.select(
        "ticket_id", "known", F.col("retrieved_source_ids"), "cited", "allowed", "latency_ms", "cost_usd", "total_tokens",
        "abstained", "validation_passed",
        recall(F.col("groups"), F.slice(r, 1, 1)).alias("recall_1"), recall(F.col("groups"), F.slice(r, 1, 3)).alias("recall_3"),
        recall(F.col("groups"), F.slice(r, 1, 5)).alias("recall_5"), recall(F.col("groups"), r).alias("recall"),
        reciprocal_rank(F.col("groups"), r).alias("rr"), overlap_share(r, F.col("allowed")).alias("source_precision"),
        recall(F.col("groups"), F.col("cited")).alias("citation_recall"),
        F.coalesce(
            overlap_share(F.col("cited"), F.col("allowed")),
            F.when((F.size("cited_source_ids") > 0) & F.col("customer_cited").isNotNull(), F.lit(1.0)),
        ).alias("citation_precision"),
        (F.col("route") == F.col("expected_route")).alias("route_hit"),
        (F.col("confidence_band") == F.col("expected_confidence_band")).alias("band_hit"),
        (F.col("abstained") == (F.col("review_required_expected") & red)).alias("abstention_hit"),
        (~F.col("validation_passed") & ~(F.col("review_required_expected") | red)).alias("validation_failure"), fail.alias("failures"),
        F.when(answered & (F.size(must) > 0), points_found(F.col("answer_text"), must) / F.size(must)).alias("point_coverage"),
        F.when(answered, points_found(F.col("answer_text"), never)).otherwise(0).alias("point_violations"),
        *[c for c in OPTIONAL if c != "answer_text"],
    )


def summary(judged: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Metrics of all judged rows, or of each group ``by``; means leave out what is null."""
    k = judged.where("known")
    avg = lambda c: F.round(F.avg(F.col(c).cast("double")), 4)
    by = by or []
    rows = k.groupBy(*by).agg(
        F.count("*").alias("evaluated"), avg("recall_1").alias("retrieval_recall_at_1"),
        avg("recall_3").alias("retrieval_recall_at_3"), avg("recall_5").alias("retrieval_recall_at_5"),
        avg("recall").alias("retrieval_recall"), avg("rr").alias("mean_reciprocal_rank"),
        avg("source_precision").alias("source_precision"),
        avg("citation_recall").alias("citation_recall"), avg("citation_precision").alias("citation_precision"),
        avg("route_hit").alias("route_accuracy"), avg("band_hit").alias("confidence_band_accuracy"),
        avg("abstention_hit").alias("abstention_accuracy"), avg("abstained").alias("fallback_rate"),
        avg("validation_passed").alias("validation_pass_rate"),
        avg("latency_ms").alias("avg_latency_ms"), avg("total_tokens").alias("avg_total_tokens"),
        F.round(F.sum("cost_usd"), 6).alias("total_cost_usd"), avg("cost_usd").alias("avg_cost_usd"),
        avg("point_coverage").alias("required_point_coverage"), F.sum("point_violations").alias("forbidden_point_violation_count"),
        avg("faithfulness_score").alias("ragas_faithfulness"), avg("context_relevance_score").alias("triad_context_relevance"),
        avg("faithfulness_score").alias("triad_groundedness"), avg("answer_relevance_score").alias("triad_answer_relevance"),
        avg("tokens_in").alias("avg_tokens_in"), avg("tokens_out").alias("avg_tokens_out"),
        F.sum(F.col("validation_failure").cast("long")).alias("validation_failure_count"), F.sum(F.size("failures")).alias("hard_failure_count"),
    )
    p = percentiles(k, by, "latency_ms", [0.5, 0.95])
    p = p.select(*[F.col(c).alias(f"_{c}") for c in by], F.round("p0", 4).alias("p50_latency_ms"), F.round("p1", 4).alias("p95_latency_ms"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return rows.join(p, same, "left").drop(*[f"_{c}" for c in by])


def metric_rows(report: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """A one-row report as (metric, value)."""
    keys = keys or []
    names = [c for c in report.columns if c not in keys]
    return report.select(
        *keys,
        F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names])).alias("m"),
    ).select(*keys, "m.metric", "m.value")


def baseline_diff(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """(metric, current, baseline, delta) of metrics that both know."""
    b = baseline.select("metric", F.col("value").alias("baseline"))
    return current.select("metric", F.col("value").alias("current")).join(b, "metric").where("current IS NOT NULL AND baseline IS NOT NULL").withColumn(
        "delta", F.round(F.col("current") - F.col("baseline"), 6),
    )


def gate(metrics: DataFrame, budgets: list[tuple[str, str, float]], diff: DataFrame | None = None) -> DataFrame:
    """(metric, problem) rows that block a release: bounds broken or missing, hard failures, and regressions if ``diff`` is given."""
    t = metrics.sparkSession.createDataFrame([*budgets, ("hard_failure_count", "max", 0.0)], "metric string, kind string, bound double")
    j = F.broadcast(t).join(metrics, "metric", "left")
    bad = j.where("value IS NULL AND kind = 'min' OR kind = 'min' AND value < bound OR kind = 'max' AND value > bound")
    out = bad.select(
        "metric",
        F.when(F.col("value").isNull(), "missing").when(F.col("kind") == "min", "below target").otherwise("above budget").alias("problem"),
    )
    if diff is not None:
        worse = F.when(F.col("metric").isin(*RISES_ARE_BAD), F.col("delta") > 0).otherwise(F.col("delta") < 0)
        out = out.unionByName(diff.where(worse).select("metric", F.lit("regressed").alias("problem")))
    return out


def triage(judged: DataFrame) -> DataFrame:
    """(ticket_id, bucket, unallowed): where source safety goes wrong; context is what was retrieved."""
    none = F.array().cast("array<string>")
    allowed = F.coalesce("allowed", none)
    over, wide = F.array_except("cited", allowed), F.array_except("retrieved_source_ids", allowed)
    bucket = F.when(F.size(over) > 0, "customer_over_citation").when(F.size(wide) > 0, "context_only_over_breadth").when(
        (F.size(allowed) > 0) & ~F.arrays_overlap("retrieved_source_ids", allowed), "missing_expected_retrieval",
    ).otherwise("clean")
    return judged.select("ticket_id", bucket.alias("bucket"), F.array_sort(F.array_distinct(over)).alias("unallowed"))


def arm_deltas(rows: DataFrame, first: str) -> DataFrame:
    """(arm, metric, value, delta): metric rows of arms with the difference to the first arm."""
    base = rows.where(F.col("arm") == first).select("metric", F.col("value").alias("_base"))
    return rows.join(F.broadcast(base), "metric").select("arm", "metric", "value", F.round(F.col("value") - F.col("_base"), 6).alias("delta"))


def guard(rows: DataFrame, first: str, rails: list[tuple[str, str, float]] = GUARDRAILS) -> DataFrame:
    """(arm, metric, violated): guardrails of every arm but the first."""
    t = F.broadcast(rows.sparkSession.createDataFrame(rails, "metric string, kind string, most double"))
    d = arm_deltas(rows, first).where(F.col("arm") != first).join(t, "metric")
    base = F.col("value") - F.col("delta")
    return d.select(
        "arm", "metric",
        F.when(F.col("kind") == "drop", F.col("delta") < -F.col("most")).otherwise(F.col("delta") > F.col("most") * F.abs(base)).alias("violated"),
    )


def replay_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Per trace: ids added and removed, band, validation and response changes, latency and cost deltas."""
    n = new.select("trace_id", *[F.col(c).alias(f"n_{c}") for c in new.columns if c != "trace_id"])
    j = old.join(n, "trace_id")
    return j.select(
        "trace_id", F.array_except("n_ids", "ids").alias("added"), F.array_except("ids", "n_ids").alias("removed"),
        (~F.col("band").eqNullSafe(F.col("n_band"))).alias("band_changed"),
        (~F.col("passed").eqNullSafe(F.col("n_passed"))).alias("validation_changed"),
        (~F.col("response").eqNullSafe(F.col("n_response"))).alias("response_changed"),
        (F.col("n_latency_ms") - F.col("latency_ms")).alias("latency_delta"),
    )


def fixed(c: Column, digits: int) -> Column:
    """Numbers with so many digits behind the point, rounded by their exact binary values as C and Python do (37.15 is a little less
    and gives 37.1); Java's formats round the shortest decimal half up."""

    @F.pandas_udf("string")
    def run(v: pd.Series) -> pd.Series:
        return v.map(lambda x: f"{x:.{digits}f}", na_action="ignore")

    return run(c)


def report_lines(metrics: DataFrame) -> DataFrame:
    """(metric, line): a table line for each metric; shares as per cent, all else plain."""
    share = F.col("metric").rlike("recall|precision|accuracy|rate|coverage")
    value = F.when(F.col("value").isNull(), "n/a").when(share, F.concat(fixed(F.col("value") * 100, 1), F.lit("%"))).otherwise(fixed(F.col("value"), 4))
    return metrics.select("metric", F.concat(F.lit("| "), "metric", F.lit(" | "), value, F.lit(" |")).alias("line"))
