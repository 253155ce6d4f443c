"""Registered report, store and streaming queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from deskgrain.functions import text as T
from deskgrain.operators import reports as P
from deskgrain.operators import retrieval as R
from deskgrain.operators import usage as U
from deskgrain.sources import lines as L
from deskgrain.sources import store as S
from deskgrain.streaming import jobs as J

from .common import AS_OF, WS, book, collapse_sql, pick, redact_sql, table
from .retrieval_queries import CAND, candidates

QUERIES, SQL, query = book()
JAN20 = "2024-01-20 00:00:00"


def facts(spark, sf):
    i = F.col("event_id")
    action = F.when(
        F.col("event_type") == "view", "sent_as_is",
    ).when(F.col("event_type") == "click", "edited").when(F.col("event_type") == "error", "rejected").when(F.col("event_type") == "signup", "pending")
    return table(spark, sf, "events").select(
        i.alias("id"), F.col("ts").alias("created_at"), "user_id", "event_type", action.alias("action"),
        F.when(i % 3 == 0, "HIGH").when(i % 3 == 1, "MEDIUM").otherwise("").alias("confidence"),
        ((i % 100) / 100).alias("edit_ratio"), F.col("value").alias("latency_ms"), (F.col("value") / 1000).alias("cost_usd"),
        "props",
    )


FACTS = """f AS (SELECT event_id AS id, ts AS created_at, user_id, event_type, CASE event_type WHEN 'view' THEN 'sent_as_is' WHEN 'click' THEN 'edited' WHEN 'error' THEN 'rejected' WHEN 'signup' THEN 'pending' END AS action, CASE event_id % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE '' END AS confidence, (event_id % 100) / 100.0::DOUBLE AS edit_ratio, value AS latency_ms, value / 1000 AS cost_usd, props
  FROM events)"""


@query(f"""WITH {FACTS}, d AS (SELECT CAST(created_at AS DATE) AS metric_date,
  count(*) AS total,
  count(*) FILTER (WHERE action = 'sent_as_is') AS sent_as_is,
  count(*) FILTER (WHERE action = 'edited') AS edited,
  count(*) FILTER (WHERE action = 'rejected') AS rejected,
  count(*) FILTER (WHERE coalesce(action, 'pending') = 'pending') AS pending,
  round(avg(edit_ratio), 4) AS mean_edit_distance,
  count(*) FILTER (WHERE confidence IN ('HIGH', 'MEDIUM')) AS covered,
  round(quantile_cont(latency_ms, 0.5), 4) AS latency_p50_ms,
  round(quantile_cont(latency_ms, 0.95), 4) AS latency_p95_ms,
  round(avg(CASE WHEN event_type = 'purchase' THEN cost_usd END), 6) AS avg_cost_usd
  FROM f
  GROUP BY 1)
SELECT * REPLACE (coalesce(avg_cost_usd, 0) AS avg_cost_usd),
  round(sent_as_is / total, 4) AS send_as_is_rate,
  round(rejected / total, 4) AS reject_rate,
  round(covered / total, 4) AS coverage_rate
  FROM d""")
def daily_metrics(spark, sf):
    """daily feedback metrics with exact percentiles, and the day's average call cost."""
    f = facts(spark, sf)
    return P.daily_metrics(f, f.where("event_type = 'purchase'"))


@query(f"""WITH {FACTS}, n AS (SELECT CAST(created_at AS DATE) AS metric_date, coalesce(nullif(confidence, ''), 'unknown') || '/' || coalesce(action, 'pending') AS k,
  count(*) AS n
  FROM f
  GROUP BY ALL)
SELECT metric_date, string_agg(k || '=' || n, ';' ORDER BY k) AS breakdown FROM n GROUP BY metric_date""")
def action_breakdown(spark, sf):
    """confidence by action of each day."""
    b = P.action_breakdown(facts(spark, sf))
    return b.select(
        "metric_date",
        F.array_join(
            F.transform(F.map_entries("breakdown"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";",
        ).alias("breakdown"),
    )


@query(f"""WITH {FACTS} SELECT event_type,
  count(*) AS calls,
  round(avg(latency_ms), 4) AS avg_latency_ms,
  round(sum(cost_usd), 4) AS total_cost_usd,
  count(*) FILTER (WHERE event_type = 'error') AS errors
  FROM f
  WHERE created_at >= TIMESTAMP '2024-01-13' AND created_at <= TIMESTAMP '2024-01-20'
  GROUP BY event_type""")
def last_week_metrics(spark, sf):
    """latency, cost and errors of seven days."""
    f = P.since(facts(spark, sf), "created_at", F.lit(JAN20).cast("timestamp_ntz"), 7)
    return f.groupBy("event_type").agg(
        F.count("*").alias("calls"), F.round(F.avg("latency_ms"), 4).alias("avg_latency_ms"),
        F.round(F.sum("cost_usd"), 4).alias("total_cost_usd"), F.count_if(F.col("event_type") == "error").alias("errors"),
    )


@query(f"""WITH {FACTS} SELECT coalesce(nullif(confidence, ''), 'unknown') AS confidence, coalesce(action, 'pending') AS action,
  count(*) AS n,
  round(avg(CASE WHEN latency_ms > 50 THEN latency_ms END), 4) AS mean_score
  FROM f
  WHERE created_at >= TIMESTAMP '2024-01-13' AND created_at <= TIMESTAMP '2024-01-20'
  GROUP BY ALL""")
def last_week_distribution(spark, sf):
    """evaluation and feedback distributions of seven days, means over positive scores only."""
    f = P.since(facts(spark, sf), "created_at", F.lit(JAN20).cast("timestamp_ntz"), 7)
    return f.groupBy(
        F.coalesce(T.blank_to_null(F.col("confidence")), F.lit("unknown")).alias("confidence"),
        F.coalesce("action", F.lit("pending")).alias("action"),
    ).agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("latency_ms") > 50, F.col("latency_ms"))), 4).alias("mean_score"))


@query(f"""WITH {FACTS} SELECT CAST(created_at AS DATE) AS metric_date,
  count(*) AS total
  FROM f
  WHERE created_at >= TIMESTAMP '2024-01-05' AND created_at < TIMESTAMP '2024-01-26'
  GROUP BY 1 ORDER BY 1 DESC LIMIT 90""")
def metrics_by_range(spark, sf):
    """daily metrics of a date range, the newest 90."""
    f = facts(spark, sf).where("created_at >= '2024-01-05' and created_at < '2024-01-26'")
    return f.groupBy(F.to_date("created_at").alias("metric_date")).agg(F.count("*").alias("total")).orderBy(F.desc("metric_date")).limit(90)


@query(f"""WITH {FACTS}, t AS (SELECT count(*) AS total_queries,
  count(DISTINCT user_id) AS active_users,
  count(*) FILTER (WHERE event_type = 'error') AS no_answers,
  count(*) FILTER (WHERE confidence = '') AS low_confidences,
  round(avg(latency_ms), 4) AS average_score,
  round(sum(cost_usd), 6) AS total_cost_usd
  FROM f),
o AS (SELECT latency_ms, row_number() OVER (ORDER BY latency_ms) - 1 AS i, count(*) OVER () AS n FROM f WHERE event_type = 'purchase')
SELECT t.*,
  round(no_answers / total_queries, 4) AS no_answer_rate,
  round(low_confidences / total_queries, 4) AS low_confidence_rate, (SELECT count(*)
  FROM o) AS api_calls, (SELECT round(latency_ms, 6)
  FROM o
  WHERE i = CAST(floor(0.95 * (n - 1)) AS BIGINT)) AS p95_latency_ms
  FROM t""")
def usage_report(spark, sf):
    """the support-intelligence report's figures."""
    f = facts(spark, sf)
    t = f.select(
        "user_id", (F.col("event_type") == "error").alias("no_answer"), (F.col("confidence") == "").alias("low_confidence"),
        F.col("latency_ms").alias("score"), "cost_usd",
    )
    return P.usage_report(t, f.where("event_type = 'purchase'"))


def _report_tables(spark, sf):
    """Traces as stored JSON, feedback, issues, review items and calls, all made of the events."""
    i, e = F.col("event_id"), table(spark, sf, "events")
    chunk = lambda j: F.struct(
        F.when((i + j) % 9 != 0, F.concat(F.lit("s"), (i * (j + 1)) % 19)).alias("source_id"), ((i + j) % 10).cast("double").alias("score"),
        F.lit(0.5).alias("rerank_score"),
    )
    chunks = F.transform(F.sequence(F.lit(1), F.lit(3)), chunk)
    stage = lambda c: F.struct(c.alias("cost_usd"))
    review = F.struct((i % 4 < 2).alias("review_required"))
    trace = F.to_json(
        F.struct(
            F.slice(chunks, F.lit(1), (i % 4).cast("int")).alias("reranked_results"),
            F.struct(
                pick(["low", "RED", "HIGH", "MEDIUM", "x"], i % 5).alias("confidence"), F.when(i % 11 == 0, "policy").alias("draft_unavailable_reason"),
                F.when(i % 2 == 0, review).alias("validation"), F.struct(F.lit(0.25).alias("total_cost_usd")).alias("usage_summary"),
            ).alias("final_response"),
            review.alias("validation_output"),
            F.struct(
                F.when(i % 3 == 0, F.col("value")).alias("cost_usd"), F.when(i % 3 == 1, stage(F.col("value"))).alias("plan"),
                F.when(i % 3 != 0, stage(F.lit(0.5))).alias("draft"),
            ).alias("token_usage_by_stage"),
        )
    )
    traces = e.select(
        "user_id", F.when(i % 6 != 0, F.concat(F.lit("team"), i % 23)).otherwise("").alias("team_id"),
        F.when(i % 13 != 0, F.concat(F.lit("p"), i % 17)).alias("product"), pick(["agent", "lead", "admin"], i % 4).alias("role"),
        F.when(i % 29 != 0, trace).otherwise("not json").alias("trace"),
    )
    feedback = e.where("event_type in ('click', 'view')").select(
        pick(["thumbs_up", "thumbs_down"], i % 3).alias("rating"), pick(["missing_source", "wrong_source", "stale_source", "tone"], i % 5).alias("feedback_reason"),
        pick(["sent", "edited"], i % 3).alias("agent_action"),
    )
    issues = e.where("event_type = 'error'").select(pick(["gap", "conflict"], i % 3).alias("issue_type"), pick(["open", "closed"], i % 3).alias("status"))
    reviews = e.where("event_type = 'signup'").select((i % 4 == 0).alias("needs_escalation"), pick(["stale", "wrong"], i % 3).alias("source_issue_type"))
    calls = e.where("event_type = 'purchase'").select((F.col("value") / 1000).alias("cost_usd"), F.when(i % 7 != 0, F.col("value")).alias("latency_ms"))
    return U.read_traces(traces), feedback, issues, reviews, calls, e


REPORT = """t AS (SELECT event_id AS i, user_id, CASE WHEN event_id % 6 <> 0 THEN 'team' || event_id % 23 END AS team_id,
  CASE WHEN event_id % 13 <> 0 THEN 'p' || event_id % 17 END AS product, (['agent', 'lead', 'admin'])[1 + event_id % 4] AS role,
  event_id % 29 <> 0 AS ok, CASE WHEN event_id % 29 = 0 THEN 0 ELSE event_id % 4 END AS hits,
  CASE event_id % 3 WHEN 0 THEN value WHEN 1 THEN value + 0.75 ELSE 0.75 END AS cost, event_type, value FROM events),
h AS (SELECT i, j, CASE WHEN (i + j) % 9 <> 0 THEN 's' || (i * (j + 1)) % 19 ELSE 'unknown' END AS source_id,
  CASE WHEN (i + j) % 10 = 0 THEN 0.5 ELSE (i + j) % 10 END::DOUBLE AS score FROM t, (VALUES (1), (2), (3)) v(j) WHERE j <= hits)"""


@query(f"""WITH {REPORT}, l AS (SELECT 'top_products' AS list, coalesce(product, 'unknown') AS name FROM t UNION ALL SELECT 'top_roles', coalesce(role, 'unknown') FROM t
UNION ALL SELECT 'top_teams', coalesce(team_id, 'unknown') FROM t UNION ALL SELECT 'most_retrieved_sources', source_id FROM h
UNION ALL SELECT 'event_counts', event_type FROM t
UNION ALL SELECT 'ratings', coalesce((['thumbs_up', 'thumbs_down'])[1 + i % 3], 'no_rating') FROM t WHERE event_type IN ('click', 'view')
UNION ALL SELECT 'agent_actions', coalesce((['sent', 'edited'])[1 + i % 3], 'pending') FROM t WHERE event_type IN ('click', 'view')
UNION ALL SELECT 'feedback_reasons', coalesce((['missing_source', 'wrong_source', 'stale_source', 'tone'])[1 + i % 5], 'unspecified') FROM t WHERE event_type IN ('click', 'view')
UNION ALL SELECT 'issue_types', coalesce((['gap', 'conflict'])[1 + i % 3], 'unknown') FROM t WHERE event_type = 'error'
UNION ALL SELECT 'source_issue_types', coalesce((['stale', 'wrong'])[1 + i % 3], 'unspecified') FROM t WHERE event_type = 'signup'),
c AS (SELECT list, name, count(*) AS n FROM l GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY list ORDER BY n DESC, name) AS INT) AS place FROM c)
SELECT list, place, name, n FROM r WHERE place <= 10 OR list IN ('ratings', 'agent_actions')""")
def support_lists(spark, sf):
    """every list of the support report, from traces stored as JSON."""
    traces, feedback, issues, reviews, _, events = _report_tables(spark, sf)
    return U.support_lists(traces, feedback, issues, reviews, events)


@query(f"""WITH {REPORT}, a AS (SELECT count(*) AS total_queries, count(DISTINCT user_id) AS active_users, count(DISTINCT team_id) AS active_teams,
  count(*) FILTER (WHERE hits = 0 OR i % 11 = 0) AS no_answer_count, count(*) FILTER (WHERE ok AND i % 5 < 2) AS low_confidence_count,
  count(*) FILTER (WHERE ok AND i % 4 < 2) AS review_required_count, sum(CASE WHEN ok THEN cost ELSE 0 END) AS cost,
  count(*) FILTER (WHERE event_type IN ('click', 'view')) AS total_feedback, count(*) FILTER (WHERE event_type IN ('click', 'view') AND i % 3 = 0) AS helpful,
  count(*) FILTER (WHERE event_type IN ('click', 'view') AND i % 3 = 1) AS negative_feedback_count,
  count(*) FILTER (WHERE event_type = 'error' AND i % 3 <> 1) AS open_issue_count,
  count(*) FILTER (WHERE event_type IN ('click', 'view') AND i % 5 = 0) AS missing_source_feedback_count,
  count(*) FILTER (WHERE event_type IN ('click', 'view') AND i % 5 = 1) AS wrong_source_feedback_count,
  count(*) FILTER (WHERE event_type IN ('click', 'view') AND i % 5 = 2) AS stale_source_feedback_count,
  count(*) FILTER (WHERE event_type = 'signup' AND i % 4 = 0) AS needs_escalation_count, count(*) FILTER (WHERE event_type = 'signup') AS review_queue_count,
  sum(CASE WHEN event_type = 'purchase' THEN value / 1000 END) AS call_cost, count(*) FILTER (WHERE event_type = 'purchase') AS api_call_count FROM t),
o AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS k, count(*) OVER () AS n FROM t WHERE event_type = 'purchase' AND i % 7 <> 0)
SELECT 30 AS period_days, total_queries, active_users, active_teams, no_answer_count, round(no_answer_count / total_queries, 4) AS no_answer_rate,
  low_confidence_count, round(low_confidence_count / total_queries, 4) AS low_confidence_rate, (SELECT round(avg(score), 4) FROM h) AS average_top_score,
  total_feedback, round(helpful / total_feedback, 4) AS helpful_rate, negative_feedback_count, review_required_count, open_issue_count,
  missing_source_feedback_count, wrong_source_feedback_count, stale_source_feedback_count, needs_escalation_count, review_queue_count,
  round(cost, 6) AS total_cost_usd, round(cost, 6) AS trace_cost_usd, round(call_cost, 6) AS api_call_cost_usd,
  round(round(cost, 6) / total_queries, 6) AS avg_cost_per_query_usd, api_call_count,
  (SELECT round(value, 6) FROM o WHERE k = CAST(floor(0.95 * (n - 1)) AS BIGINT)) AS p95_latency_ms FROM a""")
def support_report(spark, sf):
    """Every figure of the support report, section by section, from traces stored as JSON."""
    traces, feedback, issues, reviews, calls, _ = _report_tables(spark, sf)
    report = U.support_report(traces, feedback, issues, reviews, calls, 30)
    return report.select("period_days", *[f"{s}.*" for s in ("usage", "retrieval", "evaluation", "knowledge_gaps", "escalations", "costs")])


@query("SELECT CAST(user_id AS VARCHAR) AS user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, CAST(user_id AS VARCHAR) LIMIT 10")
def top_users(spark, sf):
    """The ten most active users."""
    return P.counts(table(spark, sf, "events"), F.col("user_id").cast("string"), "user_id", 10)


@query(f"WITH {CAND} SELECT source_id, source_type, is_approved, disabled, count(*) AS chunks FROM cand WHERE NOT disabled GROUP BY ALL")
def source_listing(spark, sf):
    """chunks by source attributes, disabled ones filtered out."""
    return candidates(spark, sf).where("not disabled").groupBy(
        "source_id", "source_type", "is_approved", "disabled",
    ).agg(F.count("*").alias("chunks"))


def _status(spark, sf):
    i = F.col("chunk_id")
    c = candidates(spark, sf).withColumns(
        {
            "source_id": F.concat("source_id", F.lit("/"), (i % 40).cast("string")),
            "updated_at": F.when(i % 4 == 0, "").otherwise(
                F.date_format(F.date_sub(F.lit("2024-02-01").cast("date"), (i % 40 * 3).cast("int")), "yyyy-MM-dd")
            ),
        }
    )
    return P.source_status(
        c.withColumn("needs_review_at", F.when(i % 40 < 3, F.col("needs_review_at")).otherwise("")),
        F.lit(AS_OF).cast("timestamp"),
    )


STATUS = f"""{CAND}, s0 AS (SELECT source_id || '/' || (chunk_id % 40) AS source_id, is_approved, is_customer_facing_allowed, disabled,
  CASE WHEN chunk_id % 4 = 0 THEN '' ELSE strftime(DATE '2024-02-01' - CAST(chunk_id % 40 * 3 AS INT), '%Y-%m-%d') END AS updated_at,
  CASE WHEN chunk_id % 40 < 3 THEN needs_review_at ELSE '' END AS needs_review_at
  FROM cand),
s1 AS (SELECT source_id,
  count(*) AS chunks,
  CAST(sum(is_approved::INT) AS BIGINT) AS approved,
  CAST(sum(is_customer_facing_allowed::INT) AS BIGINT) AS customer_facing,
  CAST(sum(disabled::INT) AS BIGINT) AS disabled_chunks,
  max(updated_at) AS updated_at,
  max(needs_review_at) AS needs_review_at,
  round(count(*) FILTER (WHERE updated_at <> '') / count(*), 4) AS metadata_completeness
  FROM s0
  GROUP BY 1),
st AS (SELECT *,
  CASE WHEN disabled_chunks = chunks THEN 'disabled' ELSE 'loaded' END AS ingestion_status,
  CASE WHEN needs_review_at <> '' AND CAST(nullif(needs_review_at, '') AS TIMESTAMP) < TIMESTAMP '{AS_OF}' THEN 'needs_review' WHEN updated_at = '' THEN 'unknown' WHEN date_diff('day',
  CAST(nullif(updated_at, '') AS DATE), DATE '2024-02-01') >= 90 THEN 'stale' WHEN date_diff('day',
  CAST(nullif(updated_at, '') AS DATE), DATE '2024-02-01') >= 60 THEN 'review_soon' ELSE 'fresh' END AS freshness_status
  FROM s1)"""


@query(f"WITH {STATUS} SELECT * FROM st")
def source_status(spark, sf):
    """counts, completeness, ingestion and freshness of every source."""
    return _status(spark, sf)


@query(f"""WITH {STATUS} SELECT count(*) AS source_count,
  count(*) FILTER (WHERE ingestion_status = 'loaded') AS loaded_count,
  count(*) FILTER (WHERE freshness_status IN ('stale', 'needs_review')) AS needs_review_count,
  count(*) FILTER (WHERE metadata_completeness < 1) AS quality_warning_count
  FROM st""")
def source_dashboard(spark, sf):
    """totals over sources."""
    return P.source_dashboard(_status(spark, sf))


@query(f"""WITH {CAND} SELECT source_id, expires_at, needs_review_at,
  count(*) AS chunks,
  CASE WHEN CAST(coalesce(nullif(expires_at, ''), needs_review_at) AS TIMESTAMP) < TIMESTAMP '{AS_OF}' THEN 'stale' ELSE 'near_review' END AS status,
  count(*) >= 3 AS warning
  FROM cand
  WHERE NOT disabled AND (CAST(nullif(expires_at, '') AS TIMESTAMP) <= TIMESTAMP '2024-02-15' OR CAST(needs_review_at AS TIMESTAMP) <= TIMESTAMP '2024-02-15')
  GROUP BY ALL""")
def expiring_sources(spark, sf):
    """sources that expire or need review within 14 days."""
    return P.expiring(candidates(spark, sf), F.lit(AS_OF).cast("timestamp"))


MODEL = "CASE l_linenumber % 5 WHEN 0 THEN 'gpt-4o' WHEN 1 THEN 'gpt-4o-mini' WHEN 2 THEN 'gpt-4.1' WHEN 3 THEN 'gpt-4.1-mini' ELSE 'other' END"


def _calls(spark, sf):
    n = F.col("l_linenumber") % 5
    return table(spark, sf, "lineitem").select(
        F.col("l_shipdate").alias("created_at"),
        F.when(n == 0, "gpt-4o").when(n == 1, "gpt-4o-mini").when(n == 2, "gpt-4.1").when(n == 3, "gpt-4.1-mini").otherwise("other").alias("model"),
        F.col("l_returnflag").alias("endpoint"), (F.col("l_quantity") * 100).alias("tokens_in"),
        F.col("l_quantity").alias("tokens_out"),
    )


CALLS = f"""c AS (SELECT l_shipdate AS created_at, {MODEL} AS model, l_returnflag AS endpoint, l_quantity * 100 AS tokens_in, l_quantity AS tokens_out FROM lineitem),
k AS (SELECT *, (tokens_in * CASE model WHEN 'gpt-4o' THEN 2.5 WHEN 'gpt-4o-mini' THEN 0.15 WHEN 'gpt-4.1' THEN 2.0 ELSE 0.4 END + tokens_out * CASE model WHEN 'gpt-4o' THEN 10.0 WHEN 'gpt-4o-mini' THEN 0.6 WHEN 'gpt-4.1' THEN 8.0 ELSE 1.6 END)::DOUBLE / 1000000 AS cost_usd
  FROM c)"""


@query(f"WITH {CALLS} SELECT model, endpoint, count(*) AS calls, round(sum(cost_usd), 4) AS cost_usd FROM k GROUP BY ALL")
def call_costs(spark, sf):
    """cost of calls by model and endpoint, unknown models at the default price."""
    return P.call_costs(_calls(spark, sf), P.price_table(spark)).groupBy("model", "endpoint").agg(
        F.count("*").alias("calls"), F.round(F.sum("cost_usd"), 4).alias("cost_usd"),
    )


@query(f"""WITH {CALLS}, d AS (SELECT CAST(created_at AS DATE) AS day, round(sum(cost_usd), 6) AS cost_usd FROM k GROUP BY 1)
SELECT day, cost_usd, round(sum(cost_usd) OVER (ORDER BY day), 6) AS cumulative_usd FROM d""")
def cumulative_cost(spark, sf):
    """daily and cumulative cost."""
    d = P.call_costs(
        _calls(spark, sf), P.price_table(spark),
    ).groupBy(F.to_date("created_at").alias("day")).agg(F.round(F.sum("cost_usd"), 6).alias("cost_usd"))
    return P.cumulative(d, "day", "cost_usd", "cumulative_usd")


@query("SELECT event_id, user_id, event_type, ts FROM events ORDER BY ts DESC, event_id LIMIT 50")
def newest_events(spark, sf):
    """The newest 50 rows."""
    return P.newest(table(spark, sf, "events"), "ts", "event_id", 50).select("event_id", "user_id", "event_type", "ts")


@query("SELECT CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k, arg_max(event_id, (ts, event_id)) AS newest_event FROM events GROUP BY 1")
def trace_lookup(spark, sf):
    """F16: newest row for each value of a JSON field."""
    return table(spark, sf, "events").groupBy(F.get_json_object("props", "$.k").alias("k")).agg(
        F.max_by("event_id", F.struct("ts", "event_id")).alias("newest_event")
    )


@query(f"""WITH {CAND}, t AS (SELECT question_id, list(chunk_id ORDER BY rank) AS ids, list(chunk_id ORDER BY rank) FILTER (WHERE chunk_id % 2 = 0) AS cited
  FROM ranked
  WHERE rank <= 6
  GROUP BY 1)
SELECT question_id,
  CAST(pos + 1 AS INT) AS position, ids[pos + 1] AS chunk_id, coalesce(list_contains(cited, ids[pos + 1]), false) AS cited
  FROM (SELECT *, unnest(range(len(ids))) AS pos
  FROM t)""")
def trace_diagnostics(spark, sf):
    """ranked chunk rows of traces, with whether they were cited."""
    r = R.top_k(
        candidates(spark, sf), 6,
    ).groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"]).alias("ids"))
    r = r.withColumn("cited", F.filter("ids", lambda x: x % 2 == 0))
    return r.select("question_id", "cited", F.posexplode("ids").alias("pos", "chunk_id")).select(
        "question_id", (F.col("pos") + 1).alias("position"), "chunk_id",
        F.array_contains("cited", F.col("chunk_id")).alias("cited"),
    )


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in TABLES))
def table_inventory(spark, sf):
    """Rows of every table."""
    return P.inventory({t: table(spark, sf, t) for t in TABLES})


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_name || ' v3' ELSE s_name END AS s_name FROM supplier
UNION ALL SELECT s_suppkey + 1000000, s_name FROM supplier WHERE s_suppkey % 3 = 0""")
def upserted_suppliers(spark, sf):
    """Last write wins by key, also among new rows of one key."""
    s = table(spark, sf, "supplier").select("s_suppkey", "s_name")
    hit = s.where("s_suppkey % 3 = 0")
    twice = [hit.select("s_suppkey", F.concat("s_name", F.lit(v)).alias("s_name")) for v in (" v2", " v3")]
    new = twice[0].unionByName(twice[1]).unionByName(hit.select((F.col("s_suppkey") + 1000000).alias("s_suppkey"), "s_name"))
    return S.upsert(s, new, ["s_suppkey"])


@query(
    "SELECT min(event_id) AS event_id, user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE ts < TIMESTAMP '2024-01-02') GROUP BY user_id"
)
def inserted_facts(spark, sf):
    """A10: first write wins; keys that the first day holds are left alone."""
    e = table(spark, sf, "events").select("event_id", "user_id", "ts")
    return S.insert_absent(e.where("ts < '2024-01-02'"), e, ["user_id"], [F.col("event_id")]).select("event_id", "user_id")


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE c_mktsegment END AS payload, c_name FROM customer")
def upserted_traces(spark, sf):
    """An existing trace keeps all but its payload."""
    c = table(spark, sf, "customer")
    old = c.select("c_custkey", F.col("c_mktsegment").alias("payload"), "c_name")
    return S.upsert_payload(
        old, c.where("c_custkey % 2 = 0").select("c_custkey", F.lit("new").alias("payload"), F.lit("other").alias("c_name")),
        "c_custkey", ["payload"],
    )


@query(f"""WITH {CAND} SELECT chunk_id, disabled OR chunk_id IN (5, 50) AS disabled,
  CASE WHEN source_id = 'src4' THEN '{AS_OF}' ELSE needs_review_at END AS needs_review_at
  FROM cand""")
def source_commands(spark, sf):
    """A chunk disabled, a source marked stale."""
    commands = spark.createDataFrame([("5", "disable"), ("50", "disable"), ("src4", "stale")], "target string, command string")
    return S.apply_commands(candidates(spark, sf), commands, F.lit(AS_OF)).select("chunk_id", "disabled", "needs_review_at")


@query(
    f"WITH {CAND} SELECT chunk_id, CASE WHEN chunk_id % 2 = 0 THEN needs_review_at WHEN expires_at <> '' THEN expires_at ELSE '{AS_OF}' END AS updated_at FROM cand"
)
def backfilled_dates(spark, sf):
    """Blank dates filled from other columns, else now."""
    c = candidates(spark, sf).withColumn("updated_at", F.when(F.col("chunk_id") % 2 == 0, F.col("needs_review_at")).otherwise(" "))
    return S.backfill(c, "updated_at", ["expires_at"], F.lit(AS_OF)).select("chunk_id", "updated_at")


@query(
    "SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 3 = 0 THEN source ELSE lang END AS title, sha256(text) AS content_sha256 FROM documents WHERE trim(text) <> ''"
)
def csv_articles(spark, sf):
    """A1, A2: documents written as CSV, read back under canonical names; rows without content dropped."""
    d = table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.when(F.col("doc_id") % 3 == 0, F.col("source")).alias("policy_name"),
        F.col("lang").alias("issue_title"), F.regexp_replace("text", "\r", "").alias("body"),
    )
    path = S.new_folder(spark, "articles-csv")
    d.write.option("header", True).option("escape", '"').option("quoteAll", True).option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False,
    ).csv(path)
    a = S.read_articles(spark, path, {"id": ["id"], "title": ["policy_name", "issue_title"], "content": ["body", "symptoms"]})
    docs = S.as_documents(a, "kb")
    return docs.select("id", "title", T.sha256(F.col("body")).alias("content_sha256"))


@query("SELECT conv_id, turn, role FROM conversations")
def jsonl_rows(spark, sf):
    """Rows written as JSON lines and read back, malformed lines apart."""
    from pyspark.sql.types import LongType, StringType, StructType

    path = S.new_folder(spark, "turns-jsonl")
    table(spark, sf, "conversations").select("conv_id", "turn", "role").write.json(path)
    rows, _ = S.read_jsonl(spark, path, StructType().add("conv_id", LongType()).add("turn", LongType()).add("role", StringType()))
    return rows


SHELF = 500


@query(f"""WITH d AS (SELECT doc_id, source, lang, text, row_number() OVER (PARTITION BY doc_id // {SHELF} ORDER BY doc_id) AS n FROM documents)
SELECT n AS row_number, 'row-' || n AS section_id, CAST(n AS VARCHAR) AS row_ref, CAST(doc_id AS VARCHAR) AS url,
  coalesce(trim(source), '') AS title, coalesce(lang, '') AS product, sha256(trim(replace(text, chr(13), ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12))) AS body_sha256
  FROM d""")
def numbered_articles(spark, sf):
    """A2: documents written as CSV files with quoted line breaks, read by split with the row numbers of their files."""
    d = table(spark, sf, "documents").select(
        F.floor(F.col("doc_id") / SHELF).alias("shelf"), "doc_id", F.col("doc_id").cast("string").alias("url"),
        F.when(F.col("doc_id") % 3 == 0, F.col("source")).alias("policy_name"), F.col("source").alias("issue_title"),
        F.col("lang").alias("kind"), F.regexp_replace("text", "\r", "").alias("body"),
    )
    path = S.new_folder(spark, "numbered-csv")
    d.repartition("shelf").sortWithinPartitions("shelf", "doc_id").drop("doc_id").write.option("header", True).option("escape", '"').option(
        "quoteAll", True,
    ).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).partitionBy("shelf").csv(path)
    records, _ = L.csv_records(spark, path)
    docs = L.csv_documents(records, "kb", mapping={"product": "kind"})
    section = F.get("sections", F.lit(0))
    return docs.select(
        "row_number", section["section_id"].alias("section_id"), section["row_ref"].alias("row_ref"), "url", "title", "product",
        T.sha256(F.col("body")).alias("body_sha256"),
    )


@query("""WITH t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id // 200 ORDER BY conv_id, turn, role, text) AS line FROM conversations)
SELECT conv_id // 200 AS shelf, line,
  CASE WHEN (conv_id + turn) % 7 = 0 THEN '{"conv_id": ' || conv_id ELSE '{"conv_id": ' || conv_id || ', "turn": "' || turn || 'th"}' END AS value
  FROM t
  WHERE (conv_id + turn) % 7 = 0 OR (conv_id + turn) % 11 = 0""")
def malformed_lines(spark, sf):
    """Lines of JSON files that are cut off or hold a value of another type, with the line numbers of their files."""
    from pyspark.sql.types import LongType, StructType

    n = F.col("conv_id") + F.col("turn")
    cut, odd = F.format_string('{"conv_id": %d', "conv_id"), F.format_string('{"conv_id": %d, "turn": "%dth"}', "conv_id", "turn")
    good = F.format_string('{"conv_id": %d, "turn": %d}', "conv_id", "turn")
    t = table(spark, sf, "conversations").withColumns(
        {"shelf": F.floor(F.col("conv_id") / 200), "value": F.when(n % 7 == 0, cut).when(n % 11 == 0, odd).otherwise(good)}
    )
    path = S.new_folder(spark, "turn-lines")
    ordered = t.repartition("shelf").sortWithinPartitions("shelf", "conv_id", "turn", "role", "text").select("shelf", "value")
    ordered.write.partitionBy("shelf").text(path)
    bad = L.malformed_json_lines(spark, path, StructType().add("conv_id", LongType()).add("turn", LongType()))
    return bad.select(F.regexp_extract("file", "shelf=([0-9]+)", 1).cast("long").alias("shelf"), "line", "value")


@query("SELECT p.page_id, d.source, d.doc_id IS NULL AS missing FROM pages p LEFT JOIN documents d ON 2 * d.doc_id = p.page_id")
def manifest_files(spark, sf):
    """Files joined to their manifest rows; those without one are an error table."""
    files = table(spark, sf, "pages").select("page_id", F.concat(F.lit("f"), F.col("page_id").cast("string")).alias("file_name"))
    manifest = table(spark, sf, "documents").select(F.concat(F.lit("f"), (2 * F.col("doc_id")).cast("string")).alias("file_name"), "source")
    known, unknown = S.manifest_join(files, manifest)
    return known.select(
        "page_id", "source", F.lit(False).alias("missing"),
    ).unionByName(unknown.select("page_id", F.lit(None).cast("string").alias("source"), F.lit(True).alias("missing")))


@query("""SELECT p_partkey,
  CASE WHEN contains(lower(p_name), 'release_note') THEN 'release_note' ELSE 'knowledge_base' END AS category
  FROM part
  WHERE p_partkey % 3 <> 0 AND p_partkey % 4 <> 0""")
def selected_sources(spark, sf):
    """Enabled sources, custom ones instead of demo ones, never ticket history."""
    s = table(spark, sf, "part").select(
        "p_partkey",
        F.when(F.col("p_partkey") % 3 == 0, "demo_historical_tickets.csv").otherwise(F.col("p_name")).alias("file_name"),
        F.lit(True).alias("enabled"), (F.col("p_partkey") % 4 == 0).alias("is_demo"),
    )
    return S.selected_sources(s).select("p_partkey", "category")


@query(
    "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AND contains(lower(o_orderpriority), 'high')"
)
def new_articles(spark, sf):
    """A5: fetched rows not yet known, of one product."""
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("url_name"), F.col("o_orderpriority").alias("title"))
    known = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").cast("string").alias("url_name"))
    return S.new_articles(o, known, "HIGH").select("o_orderkey")


@query(f"""WITH {CAND}, t AS (SELECT question_id, rank, '- **' || source_id || '** ' || substr({redact_sql(collapse_sql('content'))}, 1, 220) AS line FROM ranked WHERE rank <= 5),
b AS (SELECT question_id, string_agg(line, chr(10) ORDER BY rank) AS md FROM t GROUP BY 1)
SELECT 't' || question_id AS trace_id, 'see [masked] for ' || question_id AS answer, sha256(replace({redact_sql('md')}, 'hunter2', '[masked]')) AS markdown_sha256 FROM b""")
def support_bundles(spark, sf):
    """Support bundle of every question's trace, redacted, secrets masked."""
    from deskgrain.operators import evidence as E

    t = E.traces(R.top_k(candidates(spark, sf), 5)).withColumns(
        {
            "trace_id": F.concat(F.lit("t"), F.col("question_id").cast("string")),
            "answer": F.concat(F.lit("see hunter2 for "), F.col("question_id").cast("string")),
        }
    )
    return S.support_bundle(t, ["hunter2"]).select("trace_id", "answer", T.sha256(F.col("retrieved_markdown")).alias("markdown_sha256"))


def _stream(spark, sf):
    return J.events_stream(spark, f"{sf}/events.parquet")


@query("SELECT event_id, event_type FROM events")
def stream_first_writes(spark, sf):
    """Events deduplicated by id within the watermark."""
    return J.run_to_folder(J.first_writes(_stream(spark, sf), "event_id"), "first-writes").select("event_id", "event_type")


@query("""WITH w AS (SELECT date_trunc('day', ts) AS window_start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1)
SELECT * FROM w WHERE window_start + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)""")
def stream_daily_metrics(spark, sf):
    """Daily tumbling windows that the watermark has closed (later ones come with later data; the batch twin is daily_metrics)."""
    w = J.windowed(_stream(spark, sf), {"n": F.count("*"), "total": F.round(F.sum("value"), 4)}, "1 day")
    return J.run_to_folder(w, "daily").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n", "total")


@query("""WITH d AS (SELECT unnest(generate_series(date_trunc('day', ts) - INTERVAL 6 DAY, date_trunc('day', ts), INTERVAL 1 DAY)) AS window_start, user_id FROM events),
w AS (SELECT window_start, count(*) AS n FROM d GROUP BY 1)
SELECT * FROM w WHERE window_start + INTERVAL 7 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)""")
def stream_weekly_metrics(spark, sf):
    """S3: sliding windows of seven days, every day."""
    w = J.windowed(_stream(spark, sf), {"n": F.count("*")}, "7 days", "1 day")
    return J.run_to_folder(w, "weekly").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n")


@query("SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY event_type")
def retained_facts(spark, sf):
    """Facts of the last 22 days as of 1 February."""
    return J.retained(table(spark, sf, "events"), F.lit(AS_OF).cast("timestamp_ntz"), 22).groupBy("event_type").agg(F.count("*").alias("n"))


def _in_two_runs(spark, sf, what, job):
    """The folder of a job over facts that arrive in two runs, the later half first; the stream stops and starts again between them."""
    folder = S.new_folder(spark, what)
    f = facts(spark, sf).withColumns({"cost_usd": F.when(F.col("event_type") == "purchase", F.col("cost_usd")), "error": F.col("event_type") == "error"})
    for part in ("created_at >= '2024-01-16'", "created_at < '2024-01-16'"):
        f.where(part).write.mode("append").parquet(f"{folder}-in")
        J.run_batches(spark.readStream.schema(f.schema).parquet(f"{folder}-in"), f"{folder}-state", job(folder))
    return job(folder), f


def _rank_off(figures, exact, name, p):
    """Whether the share of values up to the sketch's percentile, or below it, is further from ``p`` than the sketch's error (1.65 %)."""
    upto, below = F.count_if(F.col("v") <= F.col(name)) / F.count("v"), F.count_if(F.col("v") < F.col(name)) / F.count("v")
    pairs = exact.join(F.broadcast(figures.select("metric_date", name)), "metric_date")  # one row a day
    return pairs.groupBy("metric_date").agg(((upto < p - 0.0165) | (below > p + 0.0165)).alias(f"{name}_off"))


def _exact_sql(value, digits, mean=True):
    """Sum or mean of decimals of nine digits, rounded half-up as a decimal."""
    total = f"CAST(sum(CAST({value} AS DECIMAL(28, 9))) AS DOUBLE)" + (f" / count({value})" if mean else "")
    return f"coalesce(CAST(round(CAST({total} AS DECIMAL(28, 9)), {digits}) AS DOUBLE), 0)"


COST = "CASE WHEN event_type = 'purchase' THEN cost_usd END"
DAY_COLUMNS = ["metric_date", "total", "sent_as_is", "edited", "rejected", "pending", "mean_edit_distance", "covered", "send_as_is_rate", "reject_rate", "coverage_rate", "avg_cost_usd", "active_users"]


@query(f"""WITH {FACTS}, n AS (SELECT CAST(created_at AS DATE) AS metric_date, coalesce(nullif(confidence, ''), 'unknown') || '/' || coalesce(action, 'pending') AS k, count(*) AS n FROM f GROUP BY ALL),
b AS (SELECT metric_date, string_agg(k || '=' || n, ';' ORDER BY k) AS breakdown FROM n GROUP BY metric_date),
d AS (SELECT CAST(created_at AS DATE) AS metric_date,
  count(*) AS total,
  count(*) FILTER (WHERE action = 'sent_as_is') AS sent_as_is,
  count(*) FILTER (WHERE action = 'edited') AS edited,
  count(*) FILTER (WHERE action = 'rejected') AS rejected,
  count(*) FILTER (WHERE coalesce(action, 'pending') = 'pending') AS pending,
  {_exact_sql('edit_ratio', 4)} AS mean_edit_distance,
  count(*) FILTER (WHERE confidence IN ('HIGH', 'MEDIUM')) AS covered,
  {_exact_sql(COST, 6)} AS avg_cost_usd,
  count(DISTINCT user_id) AS active_users
  FROM f
  GROUP BY 1)
SELECT d.*, breakdown,
  round(sent_as_is / total, 4) AS send_as_is_rate,
  round(rejected / total, 4) AS reject_rate,
  round(covered / total, 4) AS coverage_rate, false AS latency_p50_ms_off, false AS latency_p95_ms_off
  FROM d JOIN b USING (metric_date)""")
def stream_day_figures(spark, sf):
    """All figures of days from mergeable state, late facts counted; each percentile is told by whether its rank is off the sketch's bound."""
    job, f = _in_two_runs(spark, sf, "day-figures", lambda folder: J.DayFigures(spark, folder, buckets=8))
    d = job.days()
    v = f.select(F.to_date("created_at").alias("metric_date"), F.col("latency_ms").alias("v"))
    entries = F.transform(F.map_entries("breakdown"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    out = d.select(*DAY_COLUMNS, F.array_join(entries, ";").alias("breakdown"))
    for name, p in (("latency_p50_ms", 0.5), ("latency_p95_ms", 0.95)):
        out = out.join(_rank_off(d, v, name, p), "metric_date")
    return out


@query(f"""WITH {FACTS}, days AS (SELECT DISTINCT CAST(created_at AS DATE) AS d FROM f),
e AS (SELECT CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS metric_date FROM days)
SELECT metric_date, count(*) AS total,
  {_exact_sql('latency_ms', 4)} AS avg_latency_ms,
  {_exact_sql(COST, 4, mean=False)} AS total_cost_usd,
  count(*) FILTER (WHERE event_type = 'error') AS errors,
  count(DISTINCT user_id) AS active_users
  FROM e JOIN f ON CAST(created_at AS DATE) BETWEEN metric_date - INTERVAL 6 DAY AND metric_date
  GROUP BY metric_date""")
def stream_week_figures(spark, sf):
    """S3: figures of the seven days up to each day, merged from the state of days; numbers of users are exact."""
    job, _ = _in_two_runs(spark, sf, "week-figures", lambda folder: J.DayFigures(spark, folder, buckets=8))
    return job.rolling(7).select("metric_date", "total", "avg_latency_ms", "total_cost_usd", "errors", "active_users")


@query("SELECT event_id AS id, ts AS created_at FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 20 DAY")
def stream_retained_facts(spark, sf):
    """Facts of the last 20 days before the newest one, days that ended before dropped with their folders."""
    job, _ = _in_two_runs(spark, sf, "retained", lambda folder: J.RetainedFacts(spark, folder, 20, "created_at"))
    return job.read().select("id", "created_at")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(ts) AS ts FROM events GROUP BY user_id")
def stream_latest_state(spark, sf):
    """Latest event of every user, kept by buckets of users; the stream stops and starts again between two halves."""
    folder = S.new_folder(spark, "latest")
    e = table(spark, sf, "events").select("user_id", "event_type", "ts", F.struct("ts", "event_id").alias("o"))
    for part in ("ts >= '2024-01-16'", "ts < '2024-01-16'"):  # the later half comes first
        e.where(part).write.mode("append").parquet(f"{folder}-in")
        stream = spark.readStream.schema(e.schema).parquet(f"{folder}-in")
        J.run_batches(stream, f"{folder}-state", J.LatestState(spark, "user_id", "o", folder, buckets=8))
    return J.LatestState(spark, "user_id", "o", folder).read().select("user_id", "event_type", "ts")


def _n_chunks(t: str) -> str:
    return f"1 + greatest(0, CAST(ceil((len(list_filter(regexp_split_to_array({t}, {WS}), lambda x: x <> '')) - 180) / 150.0) AS INT))"


@query(f"""WITH d AS (SELECT doc_id, {_n_chunks("text")} AS nc,
  CASE WHEN doc_id % 3 = 0 THEN {_n_chunks("text || ' ' || text")} ELSE {_n_chunks("text")} END AS oc
  FROM documents
  WHERE trim(text) <> '')
SELECT doc_id AS article_id,
  CAST(greatest(oc, nc) AS BIGINT) AS chunks,
  CAST(nc AS BIGINT) AS active,
  CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS version,
  CAST(oc - nc AS BIGINT) AS superseded
  FROM d""")
def stream_ingest(spark, sf):
    """Documents of a file stream in two runs; those that shrank leave no active chunk of their first version behind."""
    folder, d = S.new_folder(spark, "ingest"), table(spark, sf, "documents").select("doc_id", "text")
    longer = F.when(F.col("doc_id") % 3 == 0, F.concat_ws(" ", "text", "text")).otherwise(F.col("text"))
    job = lambda: J.IncrementalIngest(
        spark, lambda b: R.word_windows(b, "doc_id", "text"), folder, as_of=F.lit(AS_OF).cast("timestamp"), buckets=8,
    )
    for docs in (d.withColumn("text", longer), d):
        docs.write.mode("append").parquet(f"{folder}-in")
        J.run_batches(spark.readStream.schema(d.schema).parquet(f"{folder}-in"), f"{folder}-state", job())
    c = job().read()
    return c.groupBy("article_id").agg(
        F.count("*").alias("chunks"), F.count_if("is_active").alias("active"),
        F.max(F.when(F.col("is_active"), F.col("document_version"))).alias("version"),
        F.count_if(F.col("superseded_reason") == "document_reingested").alias("superseded"),
    )
