"""Registered queries of the workbench, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from deskgrain.functions import dims
from deskgrain.operators import evidence as E
from deskgrain.operators import reports as P
from deskgrain.operators import retrieval as R
from deskgrain.operators import workbench as B
from deskgrain.sources import store as S
from deskgrain.streaming import jobs as J

from .common import AS_OF, book, pick, table, words_sql
from .evidence_queries import _answers
from .retrieval_queries import CAND, _list, candidates
from .report_queries import FACTS, facts

QUERIES, SQL, query = book()

REASONS = [*B.SUGGESTED_ACTIONS, "other"]


def _feedback(spark, sf):
    i = F.col("doc_id")
    reason = F.when(i % 5 != 0, pick(REASONS, i % len(REASONS)))
    return table(spark, sf, "documents").select(
        i.alias("feedback_id"), F.concat(F.lit("t"), i.cast("string")).alias("trace_id"),
        F.when(i % 3 == 0, "thumbs_down").otherwise("thumbs_up").alias("rating"),
        F.when(i % 4 == 0, "LOW").otherwise("HIGH").alias("confidence"), reason.alias("feedback_reason"),
        F.when(i % 2 == 0, reason).otherwise("").alias("reason_code"),
        F.when(i % 7 == 0, " ").otherwise(F.col("lang")).alias("comment"), F.col("text").alias("ticket_preview"),
        F.when(i % 6 != 0, F.array(F.concat(F.lit("c"), i.cast("string")))).alias("retrieved_chunk_ids"), F.col("text").alias("original_email"),
        F.lit(None).cast("string").alias("edited_email"), F.concat(F.repeat(F.lit("hello "), (i % 5).cast("int")), F.when(i % 5 != 0, F.col("text")).otherwise("")).alias("final_sent_text"),
        F.when(i % 2 == 0, (i % 10).cast("int")).alias("edit_distance_tokens"),
        F.when(i % 3 == 0, F.array(F.lit("1"), F.lit("2"))).alias("citations_used"),
        F.when(i % 8 == 0, "edited").alias("agent_action"), F.col("lang"),
    )


FEEDBACK = f"""fb0 AS (SELECT doc_id AS feedback_id, 't' || doc_id AS trace_id, text, lang, doc_id AS i,
  CASE WHEN doc_id % 3 = 0 THEN 'thumbs_down' ELSE 'thumbs_up' END AS rating,
  CASE WHEN doc_id % 4 = 0 THEN 'LOW' ELSE 'HIGH' END AS confidence,
  CASE WHEN doc_id % 5 <> 0 THEN ({_list(REASONS)})[1 + doc_id % {len(REASONS)}] END AS reason FROM documents),
fb AS (SELECT *, CASE WHEN i % 2 = 0 THEN reason ELSE '' END AS reason_code, CASE WHEN i % 7 = 0 THEN ' ' ELSE lang END AS comment FROM fb0)"""


@query(f"""WITH {FEEDBACK} SELECT feedback_id, rating, substr(text, 1, 200) AS ticket_preview,
  CASE WHEN i % 2 = 0 THEN CAST(i % 10 AS INT) ELSE CAST(i % 5 AS INT) END AS edit_distance_tokens,
  round(CASE WHEN i % 2 = 0 THEN i % 10 ELSE i % 5 END / greatest(len({words_sql("text")}) + i % 5, 1), 4) AS edit_distance_ratio,
  CASE WHEN i % 3 = 0 THEN '["1","2"]' ELSE '[]' END AS citations_used,
CASE WHEN i % 8 = 0 THEN 'edited' ELSE 'pending' END AS agent_action, sha256(repeat('hello ', CAST(i % 5 AS INT)) || text) AS final_sha256 FROM fb""")
def appended_feedback(spark, sf):
    """Feedback appended in two writes, final texts of up to four words more than the original; defaults filled in, lists as JSON."""
    f = B.feedback_rows(_feedback(spark, sf))
    path = S.new_folder(spark, "feedback")
    for part in (f.where("lang = 'en'"), f.where("lang <> 'en' or lang IS NULL")):
        B.append(part, path)
    rows = spark.read.schema(f.schema).parquet(path)
    return rows.select(
        "feedback_id", "rating", "ticket_preview", "edit_distance_tokens", "edit_distance_ratio", "citations_used", "agent_action",
        F.sha2("final_sent_text", 256).alias("final_sha256"),
    )


@query(f"""WITH {FEEDBACK} SELECT trace_id, substr(text, 1, 240) AS ticket_preview,
  CASE WHEN confidence = 'LOW' THEN 'red' ELSE '' END AS confidence_band,
  CASE WHEN reason IN {B.REVIEW_REASONS} THEN 'high' ELSE 'medium' END AS severity,
coalesce(reason, 'negative feedback') AS gatekeeper_reason,
  CASE WHEN contains(reason, 'source') THEN reason ELSE '' END AS source_issue_type, 'open' AS status
  FROM fb
  WHERE rating = 'thumbs_down'""")
def feedback_reviews(spark, sf):
    """Negative feedback as review items, previews cut to 240 characters."""
    return B.review_rows(_feedback(spark, sf))


ACTIONS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in B.SUGGESTED_ACTIONS.items())


@query(f"""WITH {FEEDBACK}, k AS (SELECT *, coalesce(nullif(trim(reason_code), ''), nullif(trim(reason), ''), '{B.DEFAULT_ISSUE}') AS issue_type
  FROM fb
  WHERE rating = 'thumbs_down')
SELECT trace_id, issue_type, 'open' AS status,
  CASE WHEN issue_type IN {B.ISSUE_REASONS} THEN 'high' ELSE 'medium' END AS severity,
  CASE WHEN i % 6 <> 0 THEN 'c' || i ELSE '' END AS chunk_id, 'Feedback: ' || replace(issue_type, '_', ' ') AS title,
substr(coalesce(nullif(trim(comment), ''), nullif(trim(text), ''), 'Negative feedback requires review.'), 1, 1000) AS description, CASE issue_type {ACTIONS} ELSE '{B.OTHER_ACTION}' END AS suggested_action
  FROM k""")
def feedback_issues(spark, sf):
    """negative feedback as knowledge issues with a suggested action."""
    return B.issue_rows(_feedback(spark, sf))


@query(f"""WITH {FEEDBACK}, k AS (SELECT *, coalesce(nullif(trim(reason_code), ''), nullif(trim(reason), ''), '{B.DEFAULT_ISSUE}') AS issue_type
  FROM fb
  WHERE rating = 'thumbs_down')
SELECT 'review' AS target, feedback_id, trace_id, CASE WHEN reason IN {B.REVIEW_REASONS} THEN 'high' ELSE 'medium' END AS severity,
  coalesce(reason, 'negative feedback') AS what FROM k
UNION ALL SELECT 'issues', feedback_id, trace_id, CASE WHEN issue_type IN {B.ISSUE_REASONS} THEN 'high' ELSE 'medium' END, 'Feedback: ' || replace(issue_type, '_', ' ') FROM k""")
def stream_feedback_fanout(spark, sf):
    """Streamed negative feedback opens a review item and a knowledge issue each; the stream stops and starts again between two
    deliveries, and every tenth fact is delivered twice."""
    folder, f = S.new_folder(spark, "fan-out"), _feedback(spark, sf)
    tables = {"review": lambda b: B.review_rows(b, ("feedback_id",)), "issues": lambda b: B.issue_rows(b, ("feedback_id",))}
    for part in ("feedback_id % 2 = 0", "feedback_id % 2 = 1 or feedback_id % 10 = 0"):
        f.where(part).write.mode("append").parquet(f"{folder}-in")
        J.run_batches(spark.readStream.schema(f.schema).parquet(f"{folder}-in"), f"{folder}-state", J.FanOut(spark, tables, "feedback_id", folder))
    out = J.FanOut(spark, tables, "feedback_id", folder)
    reviews, issues = out.read("review"), out.read("issues")
    shown = [F.lit("review").alias("target"), "feedback_id", "trace_id", "severity", F.col("gatekeeper_reason").alias("what")]
    return reviews.select(*shown).unionByName(issues.select(F.lit("issues").alias("target"), *shown[1:4], F.col("title").alias("what")))


@query(f"""WITH {CAND}, e AS (SELECT source_id, expires_at, needs_review_at,
  count(*) AS chunks
  FROM cand
  WHERE NOT disabled AND (CAST(nullif(expires_at, '') AS TIMESTAMP) <= TIMESTAMP '2024-02-15' OR CAST(needs_review_at AS TIMESTAMP) <= TIMESTAMP '2024-02-15')
  GROUP BY ALL)
SELECT source_id, 'Stale source review: ' || source_id AS ticket_preview, 'high' AS severity, 'stale_source' AS source_issue_type, chunks
  FROM e
  WHERE chunks >= 2 AND CAST(coalesce(nullif(expires_at, ''), needs_review_at) AS TIMESTAMP) < TIMESTAMP '{AS_OF}'""")
def stale_source_reviews(spark, sf):
    """stale sources of two chunks or more queued for review."""
    expiring = P.expiring(candidates(spark, sf), F.lit(AS_OF).cast("timestamp"))
    r = B.stale_reviews(expiring, many=2)
    return r.select(
        "source_id", "ticket_preview", "severity", "source_issue_type",
        F.get_json_object("flags", "$.chunks").cast("long").alias("chunks"),
    )


@query("""WITH a AS (SELECT doc_id AS i, source,
  CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'cause [KB-' || (doc_id % 3 + 1) || ']' END AS rc,
  CASE WHEN doc_id % 5 = 0 THEN 'see KB #7 now' ELSE '' END AS st
  FROM documents),
b AS (SELECT *,
  CASE WHEN st <> '' THEN st ELSE rc END AS core, list_filter([CASE WHEN i % 13 = 0 THEN 'Missing context: plan' END,
  CASE WHEN i % 17 = 0 THEN 'Source conflicts require review before relying on one answer.' END,
  CASE WHEN i % 8 = 0 THEN 'Low confidence; human review recommended.' END], lambda x: x IS NOT NULL) AS cv,
  CASE WHEN rc <> '' THEN '[KB-' || (i % 3 + 1) || ']' ELSE '' END AS cites FROM a)
SELECT i AS doc_id, core AS core_answer, CAST(len(cv) AS INT) AS n_caveats, cites AS citations,
array_to_string(list_filter([source, core,
  CASE WHEN len(cv) > 0 THEN 'Caveats:' || chr(10) || array_to_string(list_transform(cv, lambda x: '- ' || x), chr(10)) ELSE '' END,
  CASE WHEN cites <> '' THEN 'Citations: ' || cites ELSE '' END], lambda x: x <> ''), chr(10) || chr(10)) AS reply
  FROM b""")
def structured_replies(spark, sf):
    """Structured replies of stored answers, and their rendering."""
    a = _answers(spark, sf).join(table(spark, sf, "documents").select("doc_id", F.col("source").alias("issue_classification")), "doc_id")
    r = B.structured_reply(a.withColumn("draft_email", F.lit("")))
    return r.select("doc_id", "core_answer", F.size("caveats").alias("n_caveats"), F.array_join("citations", ", ").alias("citations"), "reply")


@query("""WITH k AS (SELECT p_partkey, 's' || p_partkey AS source_key FROM part)
SELECT source_key, 'error' AS level, 'content' AS field, 'Missing required field: body or content.' AS message FROM k WHERE p_partkey % 4 = 0 AND p_partkey % 9 <> 0
UNION ALL SELECT source_key, 'warning', 'owner', 'Recommended field missing: owner.' FROM k WHERE p_partkey % 3 <> 0 AND p_partkey % 9 <> 0
UNION ALL SELECT source_key, 'error', '', 'Unknown source key ''' || source_key || '''.' FROM k WHERE p_partkey % 9 = 0
UNION ALL SELECT source_key, 'warning', '', source_key || ' is disabled/future-only and cannot be customer-facing evidence.'
  FROM k
  WHERE p_partkey % 10 = 0 AND p_partkey % 9 <> 0""")
def contract_report(spark, sf):
    """What the columns of sources miss of their contracts."""
    i = F.col("p_partkey")
    k = table(spark, sf, "part").select(i, F.concat(F.lit("s"), i.cast("string")).alias("source_key"))
    none = F.lit(None).cast("string")
    cols = F.array_compact(F.array(
        F.struct(F.lit("title").alias("c"), none.alias("m")), F.when(i % 4 == 1, F.struct(F.lit("body").alias("c"), none.alias("m"))),
        F.when(i % 4 > 1, F.struct(F.lit("text_1").alias("c"), F.lit("content").alias("m"))),
        F.when(i % 3 == 0, F.struct(F.lit("owner").alias("c"), none.alias("m"))),
    ))
    columns = k.select("source_key", F.explode(cols).alias("x")).select(
        "source_key", F.col("x.c").alias("column_name"), F.col("x.m").alias("mapped_to"),
    )
    groups = [("title", ["title"], True), ("content", ["body", "content"], True), ("owner", ["owner"], False)]
    asked = F.array(*[F.struct(F.lit(f).alias("field"), F.array(*[F.lit(x) for x in names]).alias("any_of"), F.lit(r).alias("required")) for f, names, r in groups])
    contracts = k.where(i % 9 != 0).select(
        "source_key", F.explode(asked).alias("g"), (i % 10 != 0).alias("customer_facing"),
    ).select("source_key", "g.*", "customer_facing")
    return B.source_contract(columns, contracts)


def _traces(spark, sf):
    q = F.col("question_id")
    t = R.top_k(
        candidates(spark, sf), 6,
    ).groupBy("question_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"].cast("string")).alias("ids")
    )
    final = F.struct(
        F.when(q % 3 == 0, "LOW").otherwise("HIGH").alias("confidence"),
        F.when(q % 5 == 0, "no approved evidence").alias("draft_unavailable_reason"),
    )
    blob = F.when(q % 7 != 0, F.to_json(F.struct(final.alias("final_response"), F.col("ids").alias("reranked_results"))))
    return t.select(
        F.concat(F.lit("t"), F.lpad(q.cast("string"), 6, "0")).alias("trace_id"),
        F.date_add(F.lit("2024-01-01").cast("date"), (q % 40).cast("int")).alias("created_at"),
        F.concat(F.lit("h"), (q % 4).cast("string")).alias("config_hash"), blob.alias("trace"),
    )


TRACES = f"""{CAND}, tr AS (SELECT question_id AS q, count(*) AS n FROM ranked WHERE rank <= 6 GROUP BY 1),
tt AS (SELECT 't' || lpad(CAST(q AS VARCHAR), 6, '0') AS trace_id, DATE '2024-01-01' + CAST(q % 40 AS INT) AS created_at, 'h' || (q % 4) AS config_hash, q, n FROM tr)"""


@query(f"""WITH {TRACES} SELECT trace_id, created_at,
  CASE WHEN q % 7 = 0 THEN '' WHEN q % 3 = 0 THEN 'LOW' ELSE 'HIGH' END AS confidence,
  CASE WHEN q % 7 <> 0 AND q % 5 = 0 THEN 'no approved evidence' ELSE '' END AS draft_unavailable_reason,
  CAST(CASE WHEN q % 7 = 0 THEN 0 ELSE n END AS INT) AS retrieved_result_count
  FROM tt ORDER BY created_at DESC, trace_id LIMIT 50""")
def newest_traces(spark, sf):
    """The newest 50 traces, with fields of their JSON."""
    return B.trace_listing(_traces(spark, sf))


def _reviews(spark, sf):
    r = B.review_rows(_feedback(spark, sf))
    return r.withColumn("created_at", F.date_add(F.lit("2024-01-01").cast("date"), F.length("ticket_preview") % 30))


REVIEWS = f"{FEEDBACK}, rv AS (SELECT trace_id, CASE WHEN reason IN {B.REVIEW_REASONS} THEN 'high' ELSE 'medium' END AS severity, CASE WHEN contains(reason, 'source') THEN reason ELSE '' END AS source_issue_type, DATE '2024-01-01' + CAST(length(substr(text, 1, 240)) % 30 AS INT) AS created_at FROM fb WHERE rating = 'thumbs_down')"


@query(f"WITH {REVIEWS} SELECT trace_id, severity, source_issue_type, created_at FROM rv ORDER BY created_at DESC, trace_id LIMIT 100")
def review_queue(spark, sf):
    """the newest 100 review items."""
    return B.listing(_reviews(spark, sf), ["trace_id", "severity", "source_issue_type", "created_at"], "trace_id", 100)


@query(f"""WITH {TRACES}, {REVIEWS} SELECT 'review' AS kind, trace_id, created_at, severity AS detail FROM (SELECT * FROM rv ORDER BY created_at DESC, trace_id LIMIT 200)
UNION ALL SELECT 'trace', trace_id, created_at, config_hash FROM (SELECT * FROM tt ORDER BY created_at DESC, trace_id LIMIT 200)""")
def audit_export(spark, sf):
    """The newest 200 review items and traces."""
    return B.audit(_reviews(spark, sf), _traces(spark, sf))


@query(f"WITH {TRACES} SELECT trace_id, created_at, config_hash FROM tt ORDER BY created_at DESC, trace_id LIMIT 25")
def exported_traces(spark, sf):
    """The newest 25 traces written as JSON lines, and read back."""
    path = S.new_folder(spark, "traces-jsonl")
    t = _traces(spark, sf).select("trace_id", "created_at", "config_hash")
    S.export_jsonl(t, path, "created_at", "trace_id", 25)
    return S.read_jsonl(spark, path, t.schema)[0]


@query("""WITH a AS (SELECT 'e' || l_linenumber AS experiment_id,
  count(DISTINCT l_returnflag) AS arms,
  count(*) FILTER (WHERE l_quantity > 49 AND l_linenumber > 3) AS violations
  FROM lineitem
  GROUP BY 1),
c AS (SELECT 'e' || (1 + o_orderkey % 5) AS experiment_id, count(*) AS n FROM orders GROUP BY 1)
SELECT experiment_id, arms, coalesce(n, 0) AS cases, violations,
  CASE WHEN arms < 2 OR coalesce(n, 0) = 0 OR violations > 0 THEN 'revise' ELSE 'promote' END AS recommendation
  FROM a
  LEFT JOIN c USING (experiment_id)""")
def replay_recommendations(spark, sf):
    """What offline replays recommend, by experiment."""
    l = table(spark, sf, "lineitem").withColumn("experiment_id", F.concat(F.lit("e"), F.col("l_linenumber").cast("string")))
    cases = table(spark, sf, "orders").select(F.concat(F.lit("e"), (1 + F.col("o_orderkey") % 5).cast("string")).alias("experiment_id"))
    bad = l.select("experiment_id", ((F.col("l_quantity") > 49) & (F.col("l_linenumber") > 3)).alias("violated"))
    return B.replay_recommendation(l.select("experiment_id", F.col("l_returnflag").alias("arm")), cases, bad)


@query(f"""WITH r(arm, enabled) AS (VALUES {', '.join(f'({a!r}, {e})' for a, _, e in B.EXPERIMENT_ARMS)}),
n AS (SELECT ({_list([a for a, _, _ in B.EXPERIMENT_ARMS])})[1 + event_id % 4] AS arm, count(*) AS requests FROM events GROUP BY 1)
SELECT arm, enabled, coalesce(requests, 0) AS requests FROM r LEFT JOIN n USING (arm)""")
def experiment_arms(spark, sf):
    """The experiment registry, and how often each arm was asked for."""
    names = [a for a, _, _ in B.EXPERIMENT_ARMS]
    n = table(spark, sf, "events").groupBy(pick(names, F.col("event_id") % 4).alias("arm")).agg(F.count("*").alias("requests"))
    return B.experiment_registry(spark).join(n, "arm", "left").select("arm", "enabled", F.coalesce("requests", F.lit(0)).alias("requests"))


def _sections(spark, sf):
    f = facts(spark, sf)
    usage = F.struct(F.count("*").alias("total_queries"), F.count_distinct("user_id").alias("active_users"))
    costs = F.struct(F.round(F.sum("cost_usd"), 4).alias("total_cost_usd"), F.round(F.avg("cost_usd"), 6).alias("avg_cost_usd"))
    return f.agg(
        usage.alias("usage"), F.struct(F.count_if(F.col("action") == "rejected").alias("rejected_count")).alias("escalations"),
        costs.alias("costs"),
    )


@query(f"WITH {FACTS} SELECT round(sum(cost_usd), 4) AS total_cost_usd, round(avg(cost_usd), 6) AS avg_cost_usd FROM f")
def cost_section(spark, sf):
    """F8: one section of the report, by name."""
    return B.report_section(_sections(spark, sf), "costs")


@query(f"""WITH {FACTS}, a AS (SELECT count(*) AS q, count(DISTINCT user_id) AS u, count(*) FILTER (WHERE action = 'rejected') AS r FROM f)
SELECT CAST(unnest([0, 1, 2, 3, 4]) AS INT) AS line_no, unnest(['# Usage and knowledge gaps', '', '- Total queries: ' || q, '- Active users: ' || u, '- Rejected count: ' || r]) AS line
  FROM a""")
def report_markdown(spark, sf):
    """F8: the report as lines of Markdown."""
    return B.report_markdown(_sections(spark, sf).select("usage", "escalations"), "Usage and knowledge gaps")
