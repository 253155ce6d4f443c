"""The support report: what is read of stored JSON traces, the figures of each section, and every list of the most frequent names in one pass.

A trace is parsed once, into a variant, and typed paths are read from it; a path that is missing or of another type counts as not there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from deskgrain.functions.frames import written

from .reports import element_p95, rate

# What the traces, ratings and reasons are called.
LOW_CONFIDENCE = ("LOW", "RED")
HELPFUL, NEGATIVE = "thumbs_up", "thumbs_down"
GAP_REASONS = ("missing_source", "wrong_source", "stale_source")
UNKNOWN, NO_RATING, UNSPECIFIED, PENDING = "unknown", "no_rating", "unspecified", "pending"
#: Lists that are given whole (their names are a fixed few in practice); all others end after the most frequent names.
WHOLE_LISTS = ("ratings", "agent_actions")


def _path(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _amount(v: Column, path: str = "$") -> Column:
    return F.coalesce(_path(v, path, "double"), F.lit(0.0))


def trace_cost(v: Column) -> Column:
    """Cost of a trace: that of its token usage as a whole, else of all stages of it and of the usage summary together."""
    usage = _path(v, "$.token_usage_by_stage", "map<string,variant>")
    stages = F.aggregate(F.coalesce(F.map_values(usage), F.array().cast("array<variant>")), F.lit(0.0), lambda a, s: a + _amount(s, "$.cost_usd"))
    whole = F.coalesce(F.map_contains_key(usage, "cost_usd"), F.lit(False))
    return F.when(whole, _amount(v, "$.token_usage_by_stage.cost_usd")).otherwise(stages + _amount(v, "$.final_response.usage_summary.total_cost_usd"))


def read_traces(rows: DataFrame, trace: str = "trace") -> DataFrame:
    """``rows`` with what the report needs of the JSON text ``trace``: chunks (source_id, score), no_answer, low_confidence,
    review_required and cost_usd. A null or malformed trace is one without chunks: no answer, of no confidence and no cost."""
    v = F.col("_v")
    final = "$.final_response"
    chunks = F.transform(
        F.filter(F.coalesce(_path(v, "$.reranked_results", "array<variant>"), F.array().cast("array<variant>")), lambda c: c.isNotNull()),
        lambda c: F.struct(
            F.coalesce(_filled(c, "$.source_id"), _filled(c, "$.id"), F.lit(UNKNOWN)).alias("source_id"),
            F.coalesce(F.nullif(_amount(c, "$.score"), F.lit(0.0)), _amount(c, "$.rerank_score")).alias("score"),
        ),
    )
    own = F.coalesce(F.size(_path(v, f"{final}.validation", "map<string,variant>")) > 0, F.lit(False))
    review = F.when(own, _path(v, f"{final}.validation.review_required", "boolean")).otherwise(_path(v, "$.validation_output.review_required", "boolean"))
    read = rows.withColumn("_v", F.try_parse_json(F.col(trace))).withColumns({"chunks": chunks, "cost_usd": trace_cost(v)})
    return read.withColumns(
        {
            "no_answer": (F.size("chunks") == 0) | _filled(v, f"{final}.draft_unavailable_reason").isNotNull(),
            "low_confidence": F.coalesce(F.upper(_path(v, f"{final}.confidence", "string")).isin(*LOW_CONFIDENCE), F.lit(False)),
            "review_required": F.coalesce(review, F.lit(False)),
        }
    ).drop("_v")


def _filled(v: Column, path: str) -> Column:
    return F.nullif(_path(v, path, "string"), F.lit(""))


def _name(col: str, other: str) -> Column:
    return F.coalesce(F.nullif(F.col(col).cast("string"), F.lit("")), F.lit(other))


def _labelled(name: str):
    return lambda x: F.struct(F.lit(name).alias("list"), x.alias("name"))


def top_lists(tables: list[tuple[DataFrame, dict[str, Column]]], most: int = 10, whole: tuple[str, ...] = WHOLE_LISTS) -> DataFrame:
    """(list, place, name, n): the ``most`` most frequent names of every list, ties by name; lists in ``whole`` without an end.

    Each table comes with its lists: a column of names, or of arrays of names that all count. A table is scanned once, whatever the
    number of its lists; names are counted before they move, and only the first of each list in a task are put in order together."""
    named = None
    for df, lists in tables:
        parts = []
        for name, c in lists.items():
            names = c if df.select(c).schema[0].dataType.typeName() == "array" else F.array(c)
            parts.append(F.transform(names, _labelled(name)))
        one = df.select(F.explode(F.concat(*parts)).alias("x")).select("x.*")
        named = one if named is None else named.unionByName(one)
    counted = written(named.groupBy("list", "name").agg(F.count("*").alias("n")), "named")
    order = Window.partitionBy("list").orderBy(F.desc("n"), "name")
    ranked = counted.where(~F.col("list").isin(*whole)).withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    if whole:
        ranked = ranked.unionByName(counted.where(F.col("list").isin(*whole)).withColumn("place", F.row_number().over(order)))
    return ranked.select("list", "place", "name", "n")


def support_lists(
    traces: DataFrame, feedback: DataFrame, issues: DataFrame, reviews: DataFrame, events: DataFrame, most: int = 10,
) -> DataFrame:
    """Every list of the report (see ``top_lists``). ``traces`` come from ``read_traces`` with product, role and team_id; blanks count under a
    name of their own. ``feedback`` has rating, feedback_reason and agent_action, ``issues`` issue_type, ``reviews`` source_issue_type,
    ``events`` event_type."""
    return top_lists(
        [
            (traces, {
                "top_products": _name("product", UNKNOWN), "top_roles": _name("role", UNKNOWN), "top_teams": _name("team_id", UNKNOWN),
                "most_retrieved_sources": F.col("chunks.source_id"),
            }),
            (feedback, {
                "ratings": _name("rating", NO_RATING), "agent_actions": _name("agent_action", PENDING),
                "feedback_reasons": _name("feedback_reason", UNSPECIFIED),
            }),
            (issues, {"issue_types": _name("issue_type", UNKNOWN)}),
            (reviews, {"source_issue_types": _name("source_issue_type", UNSPECIFIED)}),
            (events, {"event_counts": _name("event_type", UNKNOWN)}),
        ],
        most,
    )


def support_report(
    traces: DataFrame, feedback: DataFrame, issues: DataFrame, reviews: DataFrame, calls: DataFrame, days: int,
) -> DataFrame:
    """One row of six sections (structs): usage, retrieval, evaluation, knowledge_gaps, escalations and costs. Tables as in
    ``support_lists``; ``issues`` also have status (null: open), ``reviews`` needs_escalation, ``calls`` cost_usd and latency_ms. Each
    table is aggregated by itself; empty ones give zeros. Without costs of traces those of calls are the total."""
    n, zero = F.count("*"), F.lit(0.0)
    filled = lambda c: F.nullif(F.col(c).cast("string"), F.lit(""))
    one = lambda xs, f: F.coalesce(F.sum(F.aggregate(xs, zero, f)), zero)
    t = traces.agg(
        n.alias("total_queries"), F.count_distinct(filled("user_id")).alias("active_users"), F.count_distinct(filled("team_id")).alias("active_teams"),
        F.count_if("no_answer").alias("no_answer_count"), F.count_if("low_confidence").alias("low_confidence_count"),
        F.count_if("review_required").alias("review_required_count"), F.coalesce(F.sum("cost_usd"), zero).alias("trace_cost"),
        one(F.col("chunks.score"), lambda a, x: a + x).alias("scores"), F.coalesce(F.sum(F.size("chunks")), F.lit(0)).alias("hits"),
    )
    f = feedback.agg(
        n.alias("total_feedback"), F.count_if(F.col("rating") == HELPFUL).alias("helpful"),
        F.count_if(F.col("rating") == NEGATIVE).alias("negative_feedback_count"),
        *[F.count_if(F.col("feedback_reason") == r).alias(f"{r}_feedback_count") for r in GAP_REASONS],
    )
    i = issues.agg(F.count_if(F.coalesce("status", F.lit("open")) == "open").alias("open_issue_count"))
    r = reviews.agg(F.count_if("needs_escalation").alias("needs_escalation_count"), n.alias("review_queue_count"))
    c = calls.agg(F.coalesce(F.sum("cost_usd"), zero).alias("call_cost"), n.alias("api_call_count"))
    p = element_p95(calls.where("latency_ms is not null"), "latency_ms").select(F.coalesce("value", zero).alias("p95_latency_ms"))
    row = t
    for other in (f, i, r, c, p):  # one row each
        row = row.join(F.broadcast(other), F.lit(True))
    cost = F.round(F.when(F.col("trace_cost") != 0, F.col("trace_cost")).otherwise(F.col("call_cost")), 6)
    queries = F.col("total_queries")
    return row.select(
        F.lit(days).alias("period_days"),
        F.struct("total_queries", "active_users", "active_teams").alias("usage"),
        F.struct(
            "no_answer_count", rate(F.col("no_answer_count"), queries).alias("no_answer_rate"), "low_confidence_count",
            rate(F.col("low_confidence_count"), queries).alias("low_confidence_rate"), rate(F.col("scores"), F.col("hits")).alias("average_top_score"),
        ).alias("retrieval"),
        F.struct(
            "total_feedback", rate(F.col("helpful"), F.col("total_feedback")).alias("helpful_rate"), "negative_feedback_count", "review_required_count",
        ).alias("evaluation"),
        F.struct("open_issue_count", *[f"{g}_feedback_count" for g in GAP_REASONS]).alias("knowledge_gaps"),
        F.struct("needs_escalation_count", "review_queue_count").alias("escalations"),
        F.struct(
            cost.alias("total_cost_usd"), F.round("trace_cost", 6).alias("trace_cost_usd"), F.round("call_cost", 6).alias("api_call_cost_usd"),
            rate(cost, queries, 6).alias("avg_cost_per_query_usd"), "api_call_count", "p95_latency_ms",
        ).alias("costs"),
    )
