"""What reviewers work with: feedback and its consequences, structured replies, source contracts, listings and the
experiment registry. Facts are appended; nothing is looked up row by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deskgrain.functions import text as T
from deskgrain.operators.evidence import VALID_CITATION

# What is suggested for each reason of negative feedback, and for all others.
SUGGESTED_ACTIONS = {
    "wrong_source": "tune_retrieval",
    "stale_source": "mark_source_stale",
    "missing_source": "create_knowledge_issue",
    "unsupported_claim": "update_prompt",
    "unsafe_answer": "update_prompt",
    "unsafe_output": "update_prompt",
    "bad_tone": "update_output_template",
    "tone_issue": "update_output_template",
    "too_verbose": "update_output_template",
    "too_cautious": "update_output_template",
    "missing_context": "no_action",
}
OTHER_ACTION, DEFAULT_ISSUE = "create_knowledge_issue", "wrong_answer"
REVIEW_REASONS, ISSUE_REASONS = ("unsafe_answer", "wrong_source"), ("unsafe_answer", "unsafe_output", "wrong_source")

# Arms of the experiment registry and whether they are enabled.
EXPERIMENT_ARMS = [
    ("control_current_rag", "Current approved pipeline", True),
    ("query_decomposition_v1", "Query decomposition", False),
    ("markdown_canonical_index_v1", "Markdown canonical index", False),
    ("structured_reply_v1", "Structured reply schema", False),
]


def _blank(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def feedback_rows(raw: DataFrame) -> DataFrame:
    """Feedback as it is appended: the final text is the sent one, else the edited, else the original; the edit distance to the
    original is filled in where it is missing; list columns become JSON; the preview is cut to 200 characters.

    Needs feedback_id, ticket_preview, original_email, edited_email, final_sent_text, edit_distance_tokens (may be null),
    citations_used (array), agent_action and rating; all may be null.
    """
    final = F.coalesce(*[F.when(F.col(c) != "", F.col(c)) for c in ("final_sent_text", "edited_email")], _blank("original_email"))
    d = raw.withColumn("final_sent_text", final)
    tokens = F.coalesce("edit_distance_tokens", T.token_edit_distance(F.col("original_email"), F.col("final_sent_text")))
    d = d.withColumn("edit_distance_tokens", tokens)
    longer = F.greatest(T.word_count(F.col("original_email")), T.word_count(F.col("final_sent_text")), F.lit(1))
    return d.withColumns({
        "ticket_preview": F.substring(_blank("ticket_preview"), 1, 200),
        "edit_distance_ratio": F.round(F.col("edit_distance_tokens") / longer, 4),
        "citations_used": F.to_json(F.coalesce("citations_used", F.array().cast("array<string>"))),
        "agent_action": F.coalesce("agent_action", F.lit("pending")),
    })


def review_rows(feedback: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Review items that negative feedback opens, with the columns ``keep`` of it. Needs trace_id, rating, confidence, feedback_reason and ticket_preview."""
    reason = _blank("feedback_reason")
    return feedback.where("rating = 'thumbs_down'").select(
        *keep, "trace_id", F.substring(_blank("ticket_preview"), 1, 240).alias("ticket_preview"),
        F.when(F.col("confidence") == "LOW", "red").otherwise("").alias("confidence_band"),
        F.when(reason.isin(*REVIEW_REASONS), "high").otherwise("medium").alias("severity"),
        F.when(reason == "", "negative feedback").otherwise(reason).alias("gatekeeper_reason"),
        F.when(reason.contains("source"), reason).otherwise("").alias("source_issue_type"), F.lit("open").alias("status"),
    )


def issue_rows(feedback: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Knowledge issues that negative feedback opens, each with a suggested action, and the columns ``keep`` of it. Needs besides reason_code, comment and
    retrieved_chunk_ids (array)."""
    kind = F.coalesce(T.blank_to_null(F.col("reason_code")), T.blank_to_null(F.col("feedback_reason")), F.lit(DEFAULT_ISSUE))
    actions = F.create_map(*[F.lit(x) for kv in SUGGESTED_ACTIONS.items() for x in kv])
    said = F.coalesce(T.blank_to_null(F.col("comment")), T.blank_to_null(F.col("ticket_preview")), F.lit("Negative feedback requires review."))
    d = feedback.where("rating = 'thumbs_down'").withColumn("issue_type", kind)
    return d.select(
        *keep, "trace_id", "issue_type", F.lit("open").alias("status"),
        F.when(F.col("issue_type").isin(*ISSUE_REASONS), "high").otherwise("medium").alias("severity"),
        F.coalesce(F.get("retrieved_chunk_ids", F.lit(0)), F.lit("")).alias("chunk_id"),
        F.concat(F.lit("Feedback: "), F.replace("issue_type", F.lit("_"), F.lit(" "))).alias("title"),
        F.substring(said, 1, 1_000).alias("description"),
        F.coalesce(F.try_element_at(actions, F.col("issue_type")), F.lit(OTHER_ACTION)).alias("suggested_action"),
    )


def stale_reviews(expiring: DataFrame, many: int = 3) -> DataFrame:
    """Review items for stale sources of ``many`` chunks or more, from rows of ``reports.expiring``."""
    return expiring.where((F.col("status") == "stale") & (F.col("chunks") >= many)).select(
        "source_id", F.substring(F.concat(F.lit("Stale source review: "), "source_id"), 1, 240).alias("ticket_preview"),
        F.lit("red").alias("confidence_band"), F.lit("high").alias("severity"), F.lit("source_re_review").alias("sla_marker"),
        F.lit("stale high-impact source").alias("gatekeeper_reason"), F.lit("stale_source").alias("source_issue_type"), F.lit("open").alias("status"),
        F.to_json(F.struct("source_id", "expires_at", "needs_review_at", "chunks", "status")).alias("flags"),
    )


def append(df: DataFrame, path: str) -> None:
    """Facts added to a table; no row that is there is touched."""
    df.write.mode("append").parquet(path)


def structured_reply(d: DataFrame) -> DataFrame:
    """``d`` with acknowledgment, core_answer, caveats, next_steps, citations (arrays) and the rendered reply.

    Needs issue_classification, root_cause, resolution_steps, draft_email, missing (array), n_conflicts and confidence.
    """
    some = lambda c: F.when(c != "", c)
    missing = F.concat(F.lit("Missing context: "), F.array_join(F.slice("missing", 1, 5), ", "))
    caveats = F.array_compact(F.array(
        F.when(F.size("missing") > 0, missing), F.when(F.col("n_conflicts") > 0, "Source conflicts require review before relying on one answer."),
        F.when(F.col("confidence") == "LOW", "Low confidence; human review recommended."),
    ))
    text = F.concat_ws("\n", _blank("root_cause"), _blank("resolution_steps"), _blank("draft_email"))
    d = d.withColumns({
        "acknowledgment": _blank("issue_classification"),
        "core_answer": F.coalesce(some(F.col("resolution_steps")), _blank("root_cause")), "caveats": caveats,
        "next_steps": _blank("resolution_steps"),
        "citations": F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(VALID_CITATION), F.lit(0)))),
    })
    listed = F.array_join(F.transform("caveats", lambda x: F.concat(F.lit("- "), x)), "\n")
    rendered = F.concat_ws(
        "\n\n", some(F.trim("acknowledgment")), some(F.trim("core_answer")), F.when(F.size("caveats") > 0, F.concat(F.lit("Caveats:\n"), listed)),
        F.when(F.size("citations") > 0, F.concat(F.lit("Citations: "), F.array_join("citations", ", "))),
    )
    return d.withColumn("reply", rendered)


def source_contract(columns: DataFrame, contracts: DataFrame) -> DataFrame:
    """(source_key, level, field, message): what the columns of sources miss of their contracts.

    ``columns`` (source_key, column_name, mapped_to: null unless a mapping gives the column another name) and ``contracts``
    (source_key, field, any_of: array of names, required, customer_facing). A group is there if any of its names is a column or
    what a column is mapped to. A source without a contract is an error by itself.
    """
    names = columns.select("source_key", F.explode(F.array_compact(F.array("column_name", "mapped_to"))).alias("name")).distinct()
    asked = contracts.select("source_key", "field", "required", F.explode("any_of").alias("name"))
    held = asked.join(names, ["source_key", "name"], "left_semi").select("source_key", "field").distinct()
    sources = columns.select("source_key").distinct()
    open_ = contracts.join(sources, "source_key", "left_semi").join(held, ["source_key", "field"], "left_anti")
    label = F.array_join("any_of", " or ")
    gaps = open_.select(
        "source_key", F.when(F.col("required"), "error").otherwise("warning").alias("level"), "field",
        F.concat(F.when(F.col("required"), "Missing required field: ").otherwise("Recommended field missing: "), label, F.lit(".")).alias("message"),
    )
    unknown = sources.join(contracts.select("source_key").distinct(), "source_key", "left_anti").select(
        "source_key", F.lit("error").alias("level"), F.lit("").alias("field"),
        F.concat(F.lit("Unknown source key '"), "source_key", F.lit("'.")).alias("message")
    )
    closed = contracts.where("NOT customer_facing").select("source_key").distinct().join(sources, "source_key", "left_semi").select(
        "source_key", F.lit("warning").alias("level"), F.lit("").alias("field"),
        F.concat("source_key", F.lit(" is disabled/future-only and cannot be customer-facing evidence.")).alias("message"),
    )
    return gaps.unionByName(unknown).unionByName(closed)


def trace_listing(traces: DataFrame, most: int = 50) -> DataFrame:
    """Newest traces with fields of their JSON: confidence, why no draft is there, number of results."""
    j = F.from_json("trace", "final_response struct<confidence: string, draft_unavailable_reason: string>, reranked_results array<string>")
    newest = traces.orderBy(F.desc("created_at"), "trace_id").limit(most).withColumn("_t", j)
    return newest.select(
        "trace_id", "created_at", F.coalesce("_t.final_response.confidence", F.lit("")).alias("confidence"),
        F.coalesce("_t.final_response.draft_unavailable_reason", F.lit("")).alias("draft_unavailable_reason"),
        F.greatest(F.coalesce(F.size("_t.reranked_results"), F.lit(0)), F.lit(0)).alias("retrieved_result_count"),
    )


def listing(rows: DataFrame, columns: list[str], tie: str, most: int) -> DataFrame:
    """The newest rows of drafts, review items or issues."""
    return rows.orderBy(F.desc("created_at"), tie).limit(most).select(*columns)


def audit(reviews: DataFrame, traces: DataFrame, most: int = 200) -> DataFrame:
    """(kind, trace_id, created_at, detail): the newest review items and the newest traces side by side."""
    r = listing(reviews, ["trace_id", "created_at", "severity"], "trace_id", most).select(
        F.lit("review").alias("kind"), "trace_id", "created_at", F.col("severity").alias("detail"),
    )
    t = listing(traces, ["trace_id", "created_at", "config_hash"], "trace_id", most).select(
        F.lit("trace").alias("kind"), "trace_id", "created_at", F.col("config_hash").alias("detail"),
    )
    return r.unionByName(t)


def experiment_registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EXPERIMENT_ARMS, "arm string, name string, enabled boolean")


def replay_recommendation(arms: DataFrame, cases: DataFrame, violations: DataFrame | None = None) -> DataFrame:
    """(experiment_id, arms, cases, violations, recommendation): fewer than two arms or no case asks for a revision, as does a
    broken guardrail; else the arm may be promoted. All tables have experiment_id; arms has arm, violations has violated."""
    a = arms.groupBy("experiment_id").agg(F.count_distinct("arm").alias("arms"))
    c = cases.groupBy("experiment_id").agg(F.count("*").alias("cases"))
    j = a.join(c, "experiment_id", "left")
    v = F.lit(0).cast("long")
    if violations is not None:
        j = j.join(violations.groupBy("experiment_id").agg(F.count_if("violated").alias("_v")), "experiment_id", "left")
        v = F.coalesce("_v", F.lit(0))
    j = j.select("experiment_id", "arms", F.coalesce("cases", F.lit(0)).alias("cases"), v.cast("long").alias("violations"))
    bad = (F.col("arms") < 2) | (F.col("cases") == 0) | (F.col("violations") > 0)
    return j.withColumn("recommendation", F.when(bad, "revise").otherwise("promote"))


def report_section(report: DataFrame, section: str) -> DataFrame:
    """The columns of one named section of a one-row report whose columns are structs, one for each section."""
    if section not in report.columns:
        raise ValueError(f"unknown section {section!r}")
    return report.select(f"{section}.*")


def report_markdown(report: DataFrame, title: str) -> DataFrame:
    """(line_no, line): the report as a list of lines, a title and one line for each figure."""
    lines = [F.lit(f"# {title}"), F.lit("")]
    for field in report.schema.fields:
        for f in field.dataType.fields:
            lines.append(
                F.concat(F.lit(f"- {f.name.replace('_', ' ').capitalize()}: "), F.coalesce(F.col(field.name)[f.name].cast("string"), F.lit("n/a")))
            )
    return report.select(F.posexplode(F.array(*lines)).alias("line_no", "line"))
