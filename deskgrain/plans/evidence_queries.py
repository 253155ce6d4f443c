"""Registered evidence, confidence and validation queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from deskgrain.functions import dims
from deskgrain.functions import text as T
from deskgrain.operators import evidence as E
from deskgrain.operators import retrieval as R

from .common import AS_OF, WS, book, pick, table
from .retrieval_queries import CAND, STALE, _list, candidates

QUERIES, SQL, query = book()


def top(spark, sf, k=5):
    return R.top_k(candidates(spark, sf), k)


def _full(df):
    """Candidates with all fields that a citation needs; some are blank by rule."""
    i = F.col("chunk_id")
    return df.withColumns({"source_category": F.lit("article"), "tier": F.lit("1"), "source_ref": F.concat(F.lit("ref"), i.cast("string")), "lineage_ref": F.lit("l"), "reviewed_by": F.when(i % 19 == 0, "").otherwise("lead"), "approved_at": F.lit("2023-12-01"), "audience_allowed": F.when(i % 31 == 0, F.array(F.lit("Agent"))).otherwise(F.array(F.lit("Customer"), F.lit("Agent"))),
                           "source_url": F.lit("u"), "document_hash": T.sha256(F.col("content")), "updated_at": F.lit("2023-12-02"), "ingested_at": F.lit("2023-12-03"), "loader_version": F.lit("1"), "config_hash": F.lit("c")})


CITE = f"(chunk_id % 19 <> 0 AND NOT disabled AND NOT is_future_only AND NOT is_internal_only AND source_type IN ({', '.join(repr(x) for x in dims.ALLOWED_TYPES)}) AND NOT ({STALE}) AND is_approved AND is_customer_facing_allowed AND chunk_id % 31 <> 0)"
TOP5 = "top5 AS (SELECT * FROM ranked WHERE rank <= 5)"


@query(
    f"WITH {CAND}, {TOP5} SELECT question_id, chunk_id, 'KB-' || row_number() OVER (PARTITION BY question_id ORDER BY rank) AS citation_label, NOT {CITE} AS blocked FROM top5"
)
def evidence_bundle(spark, sf):
    """Citation labels by position, chunks that may not be cited blocked."""
    b = E.bundle(_full(top(spark, sf)), E.citation_allowed(F.lit(AS_OF).cast("timestamp")))
    return b.select("question_id", "chunk_id", "citation_label", F.col("blocked_reason").isNotNull().alias("blocked"))


@query(rf"""WITH {CAND}, {TOP5}, t AS (SELECT question_id, chunk_id, score, trim(regexp_replace(content, {WS}, ' ', 'g')) AS c FROM top5),
s AS (SELECT *, list_filter(list_transform(string_split(regexp_replace(c, '([.!?]) ', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: length(x) BETWEEN 20 AND 240) AS fits
  FROM t)
SELECT question_id, chunk_id,
  CASE WHEN len(fits) > 0 THEN fits[1] ELSE substr(c, 1, 240) END AS claim,
  CASE WHEN score >= 7 THEN 'high' ELSE 'medium' END AS confidence
  FROM s
  WHERE c <> ''""")
def evidence_claims(spark, sf):
    """First fact of every cited chunk."""
    return E.evidence_table(top(spark, sf), "content", "score").select("question_id", "chunk_id", "claim", "confidence")


FLAGS = "CASE chunk_id % 4 WHEN 0 THEN ['requires_role', 'plan_specific'] WHEN 1 THEN ['platform_specific'] WHEN 2 THEN ['policy_exception'] ELSE [] END"


@query(f"""WITH {CAND}, {TOP5}, f AS (SELECT DISTINCT question_id, unnest({FLAGS}) AS flag FROM top5),
n(flag, label) AS (VALUES {', '.join(f"('{k}', '{v}')" for k, v in dims.CONTEXT_REQUIREMENTS.items())})
SELECT question_id, string_agg(DISTINCT label, ';' ORDER BY label) AS missing
  FROM f JOIN n USING (flag)
  WHERE NOT (question_id % 2 = 0 AND label = 'access channel or platform')
  GROUP BY question_id""")
def missing_context(spark, sf):
    """Context that conditions ask for and requests lack."""
    i = F.col("chunk_id") % 4
    arr = lambda *x: F.array(*[F.lit(v) for v in x]).cast("array<string>")
    t = top(spark, sf).withColumn(
        "flags",
        F.when(
            i == 0, arr("requires_role", "plan_specific"),
        ).when(i == 1, arr("platform_specific")).when(i == 2, arr("policy_exception")).otherwise(arr()),
    )
    known = t.select("question_id").distinct().withColumn(
        "fields", F.when(F.col("question_id") % 2 == 0, arr("access channel or platform")).otherwise(arr()),
    )
    return E.missing_fields(t, known).select("question_id", F.array_join("missing", ";").alias("missing"))


def _conflicted(spark, sf):
    i = F.col("chunk_id")
    t = top(spark, sf, 8).withColumns(
        {
            "status": F.when(i % 2 == 0, "Open").otherwise(F.when(i % 5 == 0, "fixed").otherwise("")),
            "decision": F.when(i % 3 == 0, "allowed").otherwise("denied"),
            "version_text": F.concat(F.lit("since v"), (i % 4).cast("string"), F.lit(".1")),
        }
    )
    return E.conflicts(t, F.lit(AS_OF).cast("timestamp"))


CONFLICTS = f"""c AS (SELECT question_id, rank, source_id, source_type,
  CASE WHEN chunk_id % 2 = 0 THEN 'open' WHEN chunk_id % 5 = 0 THEN 'fixed' ELSE '' END AS status,
  CASE WHEN chunk_id % 3 = 0 THEN 'allowed' ELSE 'denied' END AS decision, chunk_id % 4 AS v, coalesce({STALE}, false) AS stale
  FROM ranked
  WHERE rank <= 8),
p AS (SELECT a.question_id, a.source_id AS source_a, b.source_id AS source_b, a.source_type AS ta, b.source_type AS tb, a.status AS sa, b.status AS sb,
  CASE WHEN a.status <> '' THEN a.status ELSE a.decision END AS da,
  CASE WHEN b.status <> '' THEN b.status ELSE b.decision END AS db, a.stale OR b.stale AS stale, a.v AS va, b.v AS vb
  FROM c a JOIN c b ON a.question_id = b.question_id AND a.rank < b.rank),
conf AS (SELECT DISTINCT question_id, source_a, source_b, unnest(list_filter([CASE WHEN ((ta = 'policy' AND tb IN ('faq','knowledge_base','official_help_article')) OR (tb = 'policy' AND ta IN ('faq','knowledge_base','official_help_article'))) AND da <> db THEN 'policy_vs_faq' END,
 CASE WHEN ((ta = 'release_note' AND tb IN ('knowledge_base','official_help_article')) OR (tb = 'release_note' AND ta IN ('knowledge_base','official_help_article'))) AND stale THEN 'stale_kb_vs_release_note' END,
 CASE WHEN ta = 'known_issue' AND tb = 'known_issue' AND sa <> '' AND sb <> '' AND sa <> sb THEN 'known_issue_status_conflict' END,
  CASE WHEN va <> vb THEN 'version_specific_behavior_conflict' END], lambda x: x IS NOT NULL)) AS conflict_type
  FROM p)"""


@query(f"""WITH {CAND}, {CONFLICTS} SELECT question_id, conflict_type, source_a, source_b,
  CASE WHEN conflict_type LIKE 'version%' THEN 'medium' ELSE 'high' END AS severity
  FROM conf""")
def source_conflicts(spark, sf):
    """E5: conflicts between the sources of each question."""
    return _conflicted(spark, sf)


LEVEL = """lv AS (SELECT question_id,
  max(CASE WHEN rank = 1 THEN score END) AS top,
  round(max(CASE WHEN rank = 1 THEN score END) - coalesce(max(CASE WHEN rank = 2 THEN score END), 0), 4) AS gap,
  count(*) FILTER (WHERE score >= 2) AS positive,
  count(DISTINCT CASE WHEN score >= 2 THEN source_id END) AS files
  FROM ranked
  WHERE rank <= 5
  GROUP BY question_id)"""


@query(f"""WITH {CAND}, {LEVEL} SELECT question_id, top, gap, positive, files,
  CASE WHEN top >= 7 AND positive >= 2 AND files >= 2 THEN 'HIGH' WHEN top >= 7 AND gap >= 3 AND positive >= 1 THEN 'HIGH' WHEN top >= 2 AND positive >= 1 THEN 'MEDIUM' ELSE 'LOW' END AS level
  FROM lv""")
def confidence_levels(spark, sf):
    """HIGH, MEDIUM or LOW."""
    return E.level(top(spark, sf).withColumn("source_file", F.col("source_id")))


@query(f"""WITH {CAND}, {LEVEL}, {CONFLICTS}, b AS (SELECT question_id,
  count(*) AS n,
  count(*) FILTER (WHERE {CITE}) AS approved,
  count(*) FILTER (WHERE NOT {CITE}) AS blocked,
  count(*) FILTER (WHERE {STALE}) AS stale
  FROM ranked
  WHERE rank <= 5
  GROUP BY question_id),
x AS (SELECT question_id, count(*) AS conflicts, count(*) FILTER (WHERE conflict_type NOT LIKE 'version%') AS high FROM conf GROUP BY question_id),
s AS (SELECT b.*, top, gap, positive, coalesce(conflicts, 0) AS conflicts, coalesce(high, 0) AS high, b.question_id % 3 AS missing, b.question_id % 7 = 0 AS failed, b.question_id % 5 AS warnings
  FROM b JOIN lv USING (question_id)
  LEFT JOIN x USING (question_id)),
sc AS (SELECT *,
  round(greatest(0, least(CASE WHEN top >= 7 THEN 0.55 WHEN top >= 2 THEN 0.35 WHEN top >= 0.5 THEN 0.15 ELSE 0 END + least(positive, 3) * 0.08 + CASE WHEN gap >= 3 THEN 0.08 ELSE 0 END + CASE WHEN approved > 0 THEN 0.13 ELSE 0 END,
  CASE WHEN approved = 0 THEN 0.20 ELSE 1 END,
  CASE WHEN blocked > 0 THEN 0.60 ELSE 1 END,
  CASE WHEN stale > 0 THEN 0.62 ELSE 1 END,
  CASE WHEN conflicts > 0 THEN 0.55 ELSE 1 END,
  CASE WHEN high > 0 THEN 0.45 ELSE 1 END,
  CASE WHEN missing > 0 THEN 0.62 ELSE 1 END,
  CASE WHEN failed THEN 0.35 ELSE 1 END,
  CASE WHEN warnings > 0 THEN 0.68 ELSE 1 END))::DOUBLE, 3) AS score
  FROM s)
SELECT question_id, score AS confidence_score,
  CASE WHEN score >= 0.72 THEN 'green' WHEN score >= 0.4 THEN 'yellow' ELSE 'red' END AS confidence_band,
  CASE WHEN score >= 0.72 THEN 'answer' WHEN score >= 0.4 THEN CASE WHEN missing > 0 THEN 'ask_clarifying_question' ELSE 'cautious_answer' END ELSE CASE WHEN missing > 0 THEN 'escalate' ELSE 'refuse' END END AS recommended_action,
 CASE WHEN score >= 0.4 THEN '' WHEN approved = 0 THEN 'No approved customer-facing source supports the answer.' WHEN blocked > 0 THEN 'One or more candidate sources were blocked by source safety.' WHEN stale > 0 THEN 'One or more top sources are stale or need review.' WHEN conflicts > 0 THEN 'Potential source conflict detected.' WHEN missing > 0 THEN 'Required product, platform, role, or account context is missing.' WHEN failed THEN 'Validator found unsupported or unsafe output.' WHEN warnings > 0 THEN 'Validator warnings need review.' ELSE 'Retrieval confidence is too low.' END AS abstention_reason
  FROM sc""")
def confidence_scores(spark, sf):
    """Numeric confidence, band, action and reason."""
    as_of = F.lit(AS_OF).cast("timestamp")
    t = _full(top(spark, sf))
    b = t.withColumn("ok", E.citation_allowed(as_of)).groupBy("question_id").agg(
        F.count("*").alias("n"), F.count_if("ok").alias("approved"), F.count_if(~F.col("ok")).alias("blocked"),
        F.count_if(T.stale(F.col("expires_at"), F.col("needs_review_at"), as_of)).alias("stale"),
    )
    c = _conflicted(spark, sf).groupBy("question_id").agg(
        F.count("*").alias("conflicts"), F.count_if(F.col("severity") == "high").alias("high_conflicts"),
    )
    s = b.join(
        E.level(t.withColumn("source_file", F.col("source_id"))), "question_id",
    ).join(c, "question_id", "left").fillna(0, ["conflicts", "high_conflicts"])
    q = F.col("question_id")
    s = s.withColumns({"missing": q % 3, "validator_failed": q % 7 == 0, "warnings": q % 5})
    return E.confidence(s).select("question_id", "confidence_score", "confidence_band", "recommended_action", "abstention_reason")


@query("""WITH e AS (SELECT user_id, event_type, event_id % 20 AS chunk FROM events),
r AS (SELECT user_id, list_distinct(list(chunk)) AS ids FROM e WHERE event_type = 'view' GROUP BY user_id),
g AS (SELECT user_id, list_distinct(list(chunk)) AS gold FROM e WHERE event_type = 'purchase' GROUP BY user_id)
SELECT user_id AS cache_key,
  CASE WHEN gold IS NOT NULL THEN round(len(list_intersect(ids, gold)) / len(ids), 4) END AS precision,
  CASE WHEN gold IS NOT NULL THEN round(len(list_intersect(ids, gold)) / len(gold), 4) END AS recall,
  CAST(coalesce(len(gold), 0) AS INT) AS gold_size
  FROM r
  LEFT JOIN g USING (user_id)""")
def feedback_precision(spark, sf):
    """Precision and recall of viewed items against those that got a purchase."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("cache_key"), "event_type", (F.col("event_id") % 20).alias("chunk"))
    seen = e.where("event_type = 'view'").groupBy("cache_key").agg(F.collect_set("chunk").alias("chunk_ids"))
    liked = e.where("event_type = 'purchase'").select("cache_key", F.lit("thumbs_up").alias("rating"), F.array("chunk").alias("chunk_ids"))
    return E.feedback_precision(seen, liked)


def _drafts(spark, sf):
    i = F.col("doc_id")
    body = F.concat(
        F.lit("Diagnosis: "), T.collapse(F.col("text")), F.lit("\nRoot Cause: see [KB-"), (i % 4 + 1).cast("string"),
        F.lit("]\nSources: "), F.col("source"), F.lit("\nDraft Email: Hi, Subject: x Kind regards"),
    )
    return table(spark, sf, "documents").select("doc_id", "lang", body.alias("draft"))


def _sections_sql() -> str:
    """Every section from behind its label to the next label in the draft, whatever texts hold labels of their own."""
    at = {k: f"instr(lower(draft), '{v.lower()}')" for k, v in E.SECTIONS.items()}
    draft = f"SELECT doc_id, 'Diagnosis: ' || trim(regexp_replace(text, {WS}, ' ', 'g')) || chr(10) || 'Root Cause: see [KB-' || (doc_id % 4 + 1) || ']' || chr(10) || 'Sources: ' || source || chr(10) || 'Draft Email: Hi, Subject: x Kind regards' AS draft FROM documents"
    cut = "regexp_replace(regexp_replace(substr(draft, {a} + {n}, coalesce(list_min(list_filter(places, lambda p: p > {a})), length(draft) + 1) - {a} - {n}), '^[ \t\n\r\f\v]+', ''), '[ \t\n\r\f\v]+$', '')"
    found = ", ".join(f"CASE WHEN at_{k} > 0 THEN {cut.format(a='at_' + k, n=len(v))} ELSE '' END AS {k}" for k, v in E.SECTIONS.items() if k not in ("issue_classification", "confidence"))
    return f"WITH d AS ({draft}), p AS (SELECT doc_id, draft, {', '.join(f'{c} AS at_{k}' for k, c in at.items())} FROM d), q AS (SELECT *, list_filter([{', '.join(f'at_{k}' for k in at)}], lambda p: p > 0) AS places FROM p) SELECT doc_id, {found} FROM q"


@query(_sections_sql())
def draft_sections(spark, sf):
    """Labelled sections of stored drafts."""
    return _drafts(spark, sf).select("doc_id", *E.draft_sections(F.col("draft"))).select(
        "doc_id", "diagnosis", "root_cause", "sources", "draft_email", "resolution_steps",
    )


@query("""SELECT conv_id, turn, upper(CASE conv_id % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'High' ELSE 'medium' END) AS faithfulness,
  CASE WHEN turn % 2 = 0 THEN '' ELSE 'a;b' END AS flags, role AS summary
  FROM conversations""")
def judge_outputs(spark, sf):
    """Fields of stored judge outputs."""
    c = table(spark, sf, "conversations")
    raw = F.concat(
        F.lit("Faithfulness: "),
        F.when(F.col("conv_id") % 3 == 0, "low").when(F.col("conv_id") % 3 == 1, "High").otherwise("medium"), F.lit("\n flags: "),
        F.when(F.col("turn") % 2 == 0, "none").otherwise("a, b"), F.lit("\nSUMMARY: "), F.col("role"),
    )
    return c.select("conv_id", "turn", *E.judge_lines(raw)).select(
        "conv_id", "turn", "faithfulness", F.array_join("flags", ";").alias("flags"), "summary",
    )


@query(rf"""WITH {CAND}, {TOP5}, t AS (SELECT question_id, rank, substr('[KB-' || rank || '] ' || source_id || chr(10) || array_to_string(list_filter(list_transform(string_split(regexp_replace(trim(regexp_replace(content, {WS}, ' ', 'g')), '([.!?]) ', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')[1:4], ' '), 1, 1000) AS t
  FROM top5)
SELECT question_id, sha256(substr(string_agg(t, chr(10) || chr(10) ORDER BY rank), 1, 6000)) AS context_sha256 FROM t GROUP BY question_id""")
def context_packs(spark, sf):
    """Packed context of each question."""
    t = top(spark, sf).withColumn("citation_label", F.concat(F.lit("KB-"), F.col("rank")))
    return E.context_pack(t).select("question_id", T.sha256(F.col("context")).alias("context_sha256"))


@query("""SELECT doc_id,
  CASE WHEN lang IN ('en', 'de') THEN 'Hi, Subject: x Kind regards' ELSE '' END AS draft_email,
  CASE WHEN lang = 'de' THEN '' ELSE source END AS sources, source AS kept_sources
  FROM documents""")
def masked_replies(spark, sf):
    """Sections that an output mode hides, the whole reply kept beside."""
    d = _drafts(spark, sf).select("doc_id", "lang", *E.draft_sections(F.col("draft")))
    m = E.masked_reply(
        d, "lang", {"de": ["draft_email"], "en": ["draft_email", "sources"], "fr": ["sources"], "es": ["sources"]},
        ["draft_email", "sources"],
    )
    return m.select("doc_id", E.clean_email(F.col("draft_email")).alias("draft_email"), "sources", F.col("canonical.sources").alias("kept_sources"))


MODES = [*E.OUTPUT_MODES, "custom"]


def _shown(section: str) -> str:
    hidden = [m for m, shown in E.OUTPUT_MODES.items() if section not in shown]
    return f"mode IN ({', '.join(repr(m) for m in hidden)})" if hidden else "FALSE"


@query(f"""WITH m AS (SELECT doc_id, lang, source, ({_list(MODES)})[1 + doc_id % {len(MODES)}] AS mode FROM documents)
SELECT doc_id,
  CASE WHEN {_shown('diagnosis')} THEN '' ELSE 'one' || chr(10) || 'two' || chr(10) || lang END AS diagnosis,
  CASE WHEN {_shown('resolution_steps')} THEN '' ELSE 'steps [KB-1]' END AS resolution_steps,
CASE WHEN {_shown('draft_email')} THEN '' ELSE 'Hi ,' || chr(10) || chr(10) || 'bye' END AS draft_email,
  CASE WHEN {_shown('sources')} THEN '' ELSE source END AS sources, 'steps [KB-1]' AS kept_steps
  FROM m""")
def output_preferences(spark, sf):
    """Sections of stored replies as output modes show them, the whole reply kept beside."""
    d = table(spark, sf, "documents").select(
        "doc_id", pick(MODES, F.col("doc_id") % len(MODES)).alias("mode"), F.lit("x").alias("issue_classification"),
        F.concat(F.lit("one\n\ntwo\n"), "lang", F.lit("\nfour")).alias("diagnosis"), F.lit("r").alias("root_cause"),
        F.lit("steps [KB-1]").alias("resolution_steps"),
        F.col("source").alias("sources"), F.lit("HIGH").alias("confidence"), F.lit("Hi [customer name],\n\n\n\nbye [Your Name]").alias("draft_email"),
    )
    out = E.apply_preferences(d, "mode")
    return out.select("doc_id", "diagnosis", "resolution_steps", "draft_email", "sources", F.col("canonical.resolution_steps").alias("kept_steps"))


def _answers(spark, sf):
    i = F.col("doc_id")
    arr = lambda *x: F.array(*[F.lit(v) for v in x]).cast("array<string>")
    return table(spark, sf, "documents").select(
        "doc_id",
        F.when(i % 4 == 0, "").otherwise(F.concat(F.lit("cause [KB-"), (i % 3 + 1).cast("string"), F.lit("]"))).alias("root_cause"),
        F.when(i % 5 == 0, F.lit("see KB #7 now")).otherwise("").alias("resolution_steps"),
        F.when(i % 6 == 0, F.lit("Subject: a Hi b Kind regards")).otherwise("").alias("draft_email"),
        F.when(i % 9 == 0, F.lit("General technical knowledge")).otherwise("KB").alias("sources"),
        F.when(i % 7 == 0, arr("1")).otherwise(arr("1", "2", "3")).alias("valid_labels"),
        (i % 11 == 0).cast("int").alias("blocked"), (i % 2).alias("n_facts"),
        F.when(i % 13 == 0, arr("plan")).otherwise(arr()).alias("missing"), (i % 17 == 0).cast("int").alias("n_conflicts"),
        F.lit(0).alias("n_high_conflicts"),
        F.when(i % 8 == 0, "LOW").otherwise("HIGH").alias("confidence"),
        F.when(i % 10 == 0, "red").when(i % 10 == 1, "yellow").otherwise("green").alias("band"), (i % 10 == 0).alias("abstained"),
        F.when(i % 3 == 0, "billing").otherwise("bug").alias("route"),
        F.when(i % 2 == 0, "urgent outage").otherwise("hello").alias("ticket"),
    )


ANSWERS = """a AS (SELECT doc_id AS i,
  CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'cause [KB-' || (doc_id % 3 + 1) || ']' END AS rc,
  CASE WHEN doc_id % 5 = 0 THEN 'see KB #7 now' ELSE '' END AS st, doc_id % 6 = 0 AS mail, doc_id % 9 = 0 AS gen
  FROM documents),
b AS (SELECT i, rc, st, mail, gen, CASE WHEN rc = '' THEN 0 WHEN i % 7 = 0 AND i % 3 <> 0 THEN 1 ELSE 0 END AS mislabelled, i % 10 = 0 AS red FROM a),
v AS (SELECT *, (st <> '')::INT + gen::INT + (red AND mail)::INT + 0 + ((rc <> '' OR st <> '') AND i % 2 > 0 AND NOT red AND rc = '')::INT + (i % 13 = 0)::INT + (i % 17 = 0)::INT AS claims, (i % 11 = 0)::INT + mislabelled AS n_blocked
  FROM b),
w AS (SELECT *, i % 8 = 0 OR i % 13 = 0 OR n_blocked > 0 OR claims > 0 AS flagged FROM v),
val AS (SELECT i AS doc_id, claims, n_blocked, flagged, i % 3 = 0 AND i % 2 = 0 AS needs_escalation, n_blocked = 0 AND claims = 0 AND NOT flagged AS passed, red FROM w)"""


@query(f"""WITH {ANSWERS} SELECT doc_id,
  CAST(claims AS INT) AS n_claims,
  CAST(n_blocked AS INT) AS n_blocked, flagged AS gatekeeper_flagged, needs_escalation, passed,
  CASE WHEN NOT passed AND red THEN 'abstained' WHEN n_blocked > 0 OR claims > 0 THEN 'hard_failure' WHEN doc_id % 10 = 1 OR flagged THEN 'clean_with_caveats' ELSE 'clean' END AS outcome
  FROM val""")
def answer_validation(spark, sf):
    """Validation of stored answers."""
    return E.validate(_answers(spark, sf)).select(
        "doc_id", F.size("unsupported_claims").alias("n_claims"), "n_blocked", "gatekeeper_flagged", "needs_escalation", "passed",
        "outcome",
    )


@query(f"""WITH {ANSWERS}, x AS (SELECT *,
  CASE WHEN NOT passed AND red THEN 'abstained' WHEN n_blocked > 0 OR claims > 0 THEN 'hard_failure' WHEN doc_id % 10 = 1 OR flagged THEN 'clean_with_caveats' ELSE 'clean' END AS outcome
  FROM val),
c(outcome) AS (VALUES ('clean'), ('clean_with_caveats'), ('corrected'), ('abstained'), ('hard_failure'))
SELECT c.outcome, count(x.doc_id) AS n FROM c LEFT JOIN x USING (outcome) GROUP BY c.outcome""")
def outcome_counts(spark, sf):
    """Outcomes of all five classes, zeros kept."""
    classes = spark.createDataFrame([(x,) for x in ("clean", "clean_with_caveats", "corrected", "abstained", "hard_failure")], "outcome string")
    n = E.validate(_answers(spark, sf)).groupBy("outcome").agg(F.count("*").alias("n"))
    return classes.join(n, "outcome", "left").select("outcome", F.coalesce("n", F.lit(0)).alias("n"))


@query("""SELECT doc_id, doc_id % 10 = 0 OR doc_id % 14 = 0 AS abstained,
  CASE WHEN doc_id % 14 = 0 THEN 'no approved evidence' WHEN doc_id % 10 = 0 THEN 'confidence is red' ELSE '' END AS draft_unavailable_reason,
  CASE WHEN doc_id % 10 = 0 OR doc_id % 14 = 0 OR doc_id % 4 = 0 THEN '' ELSE 'cause [KB-' || (doc_id % 3 + 1) || ']' END AS root_cause
  FROM documents""")
def abstentions(spark, sf):
    """Red answers and answers without evidence replaced."""
    a = _answers(spark, sf).withColumn("n_evidence", F.col("doc_id") % 14)
    return E.abstain(a, ["root_cause", "draft_email"]).select("doc_id", "abstained", "draft_unavailable_reason", "root_cause")


@query(f"""WITH {ANSWERS}, r AS (SELECT doc_id, list_sort(list_filter([CASE WHEN doc_id % 8 = 0 THEN 'low confidence' END,
  CASE WHEN red THEN 'red confidence' END,
  CASE WHEN doc_id % 17 = 0 THEN 'source conflict' END,
  CASE WHEN NOT passed THEN 'validator failure' END,
  CASE WHEN doc_id % 3 = 0 THEN 'policy-heavy or sensitive case' END,
  CASE WHEN doc_id % 21 = 0 THEN 'low faithfulness' END,
  CASE WHEN needs_escalation THEN 'escalation path' END], lambda x: x IS NOT NULL)) AS reasons, red OR needs_escalation AS high,
  CASE WHEN doc_id % 17 = 0 THEN 'conflict' WHEN NOT passed THEN 'validation' WHEN n_blocked > 0 THEN 'citation' ELSE '' END AS issue
  FROM val)
SELECT doc_id,
  array_to_string(reasons, '; ') AS reasons,
  CASE WHEN high THEN 'high' ELSE 'medium' END AS severity, issue AS source_issue_type,
  CASE WHEN high THEN 'review_today' ELSE 'standard_review' END AS sla_marker
  FROM r
  WHERE len(reasons) > 0""")
def review_items(spark, sf):
    """Answers that go to human review."""
    v = E.validate(_answers(spark, sf))
    d = v.withColumns(
        {
            "conflict": F.col("n_conflicts") > 0, "blocked": F.col("n_blocked"),
            "faithfulness": F.when(F.col("doc_id") % 21 == 0, "LOW").otherwise("HIGH"), "completeness": F.lit("HIGH"),
        }
    )
    return E.review_items(d).select("doc_id", F.array_join("reasons", "; ").alias("reasons"), "severity", "source_issue_type", "sla_marker")


@query(f"""WITH {CAND} SELECT question_id,
  CAST(count(*) AS INT) AS n_chunks, string_agg(CAST(chunk_id AS VARCHAR), ',' ORDER BY rank) AS chunk_ids
  FROM ranked
  WHERE rank <= 12
  GROUP BY question_id""")
def run_traces(spark, sf):
    """Compact traces of at most twelve chunks."""
    return E.traces(top(spark, sf, 20)).select(
        "question_id", "n_chunks",
        F.array_join(F.transform("chunks", lambda x: x["chunk_id"].cast("string")), ",").alias("chunk_ids"),
    )
