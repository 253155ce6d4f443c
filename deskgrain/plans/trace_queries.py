"""Registered queries over stored JSON traces, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from deskgrain.functions import text as T
from deskgrain.functions.frames import new_folder
from deskgrain.operators import traces as X

from .common import book, table

QUERIES, SQL, query = book()
#: What the queries take for a configured secret: a word that the texts given hold often.
SECRET = "tion"


def stored_traces(spark, sf):
    """A trace of each conversation, its turns the retrieved chunks; JSON text, cut off in every eleventh."""
    c, q = table(spark, sf, "conversations"), F.col("conv_id")
    chunk = F.struct(
        F.format_string("%d/%d", "conv_id", "turn").alias("id"), F.col("role").alias("source_id"), F.col("text").alias("content_preview"),
        F.when(F.col("turn") % 2 == 0, F.col("turn") / 10).alias("score"), F.when(F.col("turn") % 2 == 1, F.col("turn") / 5).alias("rerank_score"),
        F.when(F.col("turn") % 3 == 0, False).alias("used_in_prompt"), F.when(F.col("turn") % 4 == 1, True).alias("is_approved"),
        F.when(F.col("turn") % 5 == 2, "2024-01-05").alias("expires_at"),
    )
    turns = F.array_sort(F.collect_list(F.struct("turn", F.lit(1).alias("one"), chunk.alias("chunk"))))
    g = c.groupBy("conv_id").agg(turns.alias("turns")).withColumn("chunks", F.transform("turns", lambda t: t["chunk"]))
    first = F.col("chunks")[0]
    final = F.struct(
        F.when(q % 4 != 0, F.concat(F.lit("d"), q.cast("string"))).alias("draft_run_id"), F.when(q % 3 == 0, "LOW").otherwise("HIGH").alias("confidence"),
        F.when(q % 2 == 0, "").otherwise("short").alias("draft_email"), first["content_preview"].alias("answer_text"),
        F.when(q % 2 == 0, F.array(F.lit("assistant"))).otherwise(F.array().cast("array<string>")).alias("citations"),
        F.struct(F.lit("later").alias("status")).alias("validation"), F.when(q % 5 == 0, "no approved evidence").alias("draft_unavailable_reason"),
    )
    stages = F.transform("chunks", lambda x: F.struct(F.lit("search").alias("stage"), x["id"].alias("id"), x["content_preview"].alias("note")))
    trace = F.struct(
        F.concat(F.lit("c"), q.cast("string")).alias("trace_id"), F.concat(F.lit("u"), (q % 7).cast("string")).alias("user_id"),
        F.concat(F.lit("h"), (q % 4).cast("string")).alias("config_hash"), F.lit("mail").alias("product"), F.lit("local").alias("model_provider"),
        F.substring(first["content_preview"], 1, 60).alias("redacted_ticket_preview"), F.col("chunks").alias("reranked_results"),
        F.when(q % 5 == 0, F.array(F.lit("late"))).otherwise(F.array().cast("array<string>")).alias("errors"),
        F.when(q % 6 != 0, F.struct(F.lit("passed").alias("status"))).alias("validation_output"),
        F.array(first["id"]).alias("citations_used"), stages.alias("stage_events"), final.alias("final_response"),
    )
    text = F.to_json(trace)
    return g.select(
        F.concat(F.lit("c"), q.cast("string")).alias("trace_id"), F.date_add(F.lit("2024-01-01").cast("date"), (q % 40).cast("int")).alias("created_at"),
        F.when(q % 11 == 0, F.substring(text, 1, 20)).otherwise(text).alias("trace"),
    )


STORED = """k AS (SELECT conv_id AS q, turn, role, text, 'c' || conv_id AS trace_id, conv_id || '/' || turn AS id, conv_id % 11 <> 0 AS good,
  DATE '2024-01-01' + CAST(conv_id % 40 AS INT) AS created_at
  FROM conversations),
g AS (SELECT q, trace_id, good, created_at, arg_min(text, turn) AS first_text, arg_min(id, turn) AS first_id, count(*) AS n,
  string_agg(DISTINCT role, ',' ORDER BY role) AS roles
  FROM k
  GROUP BY ALL),
r AS (SELECT q, trace_id, created_at, good,
  CASE WHEN good AND q % 4 <> 0 THEN 'd' || q ELSE '' END AS draft_run_id,
  CASE WHEN good AND q % 5 = 0 THEN 'error' ELSE 'ok' END AS status,
  CASE WHEN NOT good THEN '' WHEN q % 3 = 0 THEN 'LOW' ELSE 'HIGH' END AS confidence_band,
  CASE WHEN good AND q % 6 <> 0 THEN 'passed' ELSE '' END AS validation_status,
  CASE WHEN NOT good THEN '' WHEN q % 2 = 1 THEN 'short' ELSE first_text END AS answer,
  CASE WHEN NOT good THEN '' WHEN q % 2 = 0 THEN 'assistant' ELSE first_id END AS citations,
  CASE WHEN good THEN roles ELSE '' END AS sources,
  CAST(CASE WHEN good THEN n ELSE 0 END AS INT) AS chunks_retrieved,
  CASE WHEN good THEN substr(first_text, 1, 60) ELSE '' END AS preview,
  CASE WHEN good THEN 'u' || q % 7 ELSE '' END AS user_id, CASE WHEN good THEN 'h' || q % 4 ELSE '' END AS config_hash
  FROM g)"""


@query(f"""WITH {STORED} SELECT coalesce(nullif(draft_run_id, ''), trace_id) AS run_id, draft_run_id, trace_id, user_id, preview, status, confidence_band,
  validation_status, sha256(answer) AS answer_sha256, citations, sources, chunks_retrieved
  FROM r""")
def diagnosed_runs(spark, sf):
    """The run row of every stored trace's diagnosis."""
    r = X.diagnosis_runs(stored_traces(spark, sf))
    return r.select(
        "run_id", "draft_run_id", "trace_id", "user_id", F.col("ticket_preview_redacted").alias("preview"), "status", "confidence_band",
        "validation_status", T.sha256(F.col("answer")).alias("answer_sha256"), F.array_join("citations_used", ",").alias("citations"),
        F.array_join("source_ids", ",").alias("sources"), "chunks_retrieved",
    )


@query(f"""WITH {STORED} SELECT k.trace_id, CAST(row_number() OVER (PARTITION BY q ORDER BY turn) AS INT) AS rank, id AS chunk_id, role AS source_id,
  CASE WHEN turn % 2 = 0 THEN turn / 10.0::DOUBLE ELSE turn / 5.0::DOUBLE END AS score, turn % 3 <> 0 AS used_in_prompt,
  CASE WHEN q % 2 = 0 THEN role = 'assistant' ELSE id = g.first_id END AS citation_used, turn % 4 = 1 AS is_approved,
  CASE WHEN turn % 5 = 2 THEN '2024-01-05' ELSE '' END AS expires_at, true AS is_active
  FROM k JOIN g USING (q)
  WHERE k.good""")
def diagnosed_chunks(spark, sf):
    """the ranked chunks of every stored trace with their safety fields."""
    return X.diagnosis_chunks(stored_traces(spark, sf)).select(
        "trace_id", "rank", "chunk_id", "source_id", "score", "used_in_prompt", "citation_used", "is_approved", "expires_at", "is_active",
    )


@query(f"""WITH {STORED} SELECT trace_id, created_at, preview AS ticket_preview, user_id, config_hash, CASE WHEN good THEN 'mail' ELSE '' END AS product,
  confidence_band AS confidence, CASE WHEN good AND q % 5 = 0 THEN 'no approved evidence' ELSE '' END AS draft_unavailable_reason,
  chunks_retrieved AS retrieved_result_count
  FROM r
  ORDER BY created_at DESC, trace_id
  LIMIT 50""")
def stored_trace_listing(spark, sf):
    """the newest 50 stored traces with preview, user, product and configuration."""
    return X.listing(stored_traces(spark, sf)).drop("platform", "role")


@query(f"""WITH {STORED} SELECT draft_run_id AS id, trace_id, preview AS ticket_preview, confidence_band, validation_status, citations, sources, config_hash, created_at
  FROM r
  ORDER BY created_at DESC, trace_id
  LIMIT 50""")
def newest_drafts(spark, sf):
    """the newest 50 drafts of stored traces."""
    d = X.drafts(stored_traces(spark, sf))
    return d.withColumns({"citations": F.array_join("citations_used", ","), "sources": F.array_join("source_ids", ",")}).drop("citations_used", "source_ids")


@query(f"""WITH {STORED}, m AS (SELECT *, replace(text, '{SECRET}', '{X.SECRET_MARK}') AS safe FROM k),
md AS (SELECT trace_id, string_agg('### ' || id || chr(10) || safe, chr(10) || chr(10) ORDER BY turn) AS value, count(*) AS n FROM m WHERE good GROUP BY 1)
SELECT r.trace_id, 'retrieved_chunks.md' AS part, sha256(coalesce(md.value, '')) AS value_sha256 FROM r LEFT JOIN md USING (trace_id)
UNION ALL SELECT trace_id, 'final_answer.md', sha256(replace(answer, '{SECRET}', '{X.SECRET_MARK}')) FROM r
UNION ALL SELECT trace_id, 'validation_report.json', sha256(CASE WHEN NOT good THEN '{{}}' WHEN q % 6 = 0 THEN '{{"status":"later"}}' ELSE '{{"status":"passed"}}' END) FROM r
UNION ALL SELECT trace_id, 'config_snapshot.json', sha256('{{"config_hash":"' || config_hash || '","model_provider":"' || CASE WHEN good THEN 'local' ELSE '' END || '","workflow_mode":"","product":"' || CASE WHEN good THEN 'mail' ELSE '' END || '","platform":"","role":""}}') FROM r
UNION ALL SELECT r.trace_id, 'logs.jsonl', CAST(coalesce(n, 0) AS VARCHAR) FROM r LEFT JOIN md USING (trace_id)
UNION ALL SELECT trace_id, 'trace.json', CAST(coalesce(any_value(first_safe), '') AS VARCHAR) FROM (SELECT r.trace_id, CASE WHEN r.good THEN sha256(arg_min(m.safe, turn)) END AS first_safe FROM r JOIN m USING (trace_id) GROUP BY r.trace_id, r.good) GROUP BY 1""")
def bundle_files(spark, sf):
    """Six files of every stored trace's bundle, written, read back and told by digest (of the log its lines are counted, of the
    trace the first chunk's text)."""
    path = new_folder(spark, "bundles")
    X.write_bundles(X.bundle(stored_traces(spark, sf), [SECRET]), path)
    v = F.col("value")
    first = F.get_json_object(v, "$.reranked_results[0].content_preview")
    told = F.when(F.col("part") == "logs.jsonl", F.when(v == "", "0").otherwise(F.size(F.split(v, "\n")).cast("string"))).when(
        F.col("part") == "trace.json", F.when(first.isNull(), "").otherwise(T.sha256(first)),
    ).otherwise(T.sha256(v))
    return X.read_bundles(spark, path).select("trace_id", "part", told.alias("value_sha256"))
