"""Evidence gating, conflicts, confidence, validation and review routing, per question over long tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from deskgrain.functions import dims
from deskgrain.functions import text as T


def citation_allowed(as_of: Column) -> Column:
    """Whether a chunk may be cited to a customer: all required fields, an approved type, fresh, approved, customer audience."""
    filled = F.lit(True)
    for c in dims.REQUIRED_CITATION_FIELDS:
        filled = filled & (F.size("audience_allowed") > 0 if c == "audience_allowed" else F.coalesce(F.col(c).cast("string") != "", F.lit(False)))
    off = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    on = lambda c: F.coalesce(F.col(c), F.lit(False))
    base = F.substring_index("source_type", "/", 1)
    return filled & off("disabled") & off("is_future_only") & off("is_internal_only") & base.isin(*dims.ALLOWED_TYPES) & ~T.stale(F.col("expires_at"), F.col("needs_review_at"), as_of) & on("is_approved") & on("is_customer_facing_allowed") & F.array_contains(
        F.transform("audience_allowed", lambda a: F.lower(a)), "customer",
    )


def bundle(chunks: DataFrame, allowed: Column) -> DataFrame:
    """Chunks with their citation label by position over all of them, and why one is blocked (else null)."""
    n = F.row_number().over(Window.partitionBy("question_id").orderBy("rank", "chunk_id"))
    # fixed value: the sentence that names why
    return chunks.withColumn("citation_label", F.concat(F.lit("KB-"), n)).withColumn(
        "blocked_reason",
        F.when(~allowed, "source is missing metadata, unapproved, disabled, forbidden, stale, or not customer-facing"),
    )


def evidence_table(chunks: DataFrame, text_col: str, score_col: str) -> DataFrame:
    """One claim for each chunk that has any text: its first fact, high confidence from a strong score on."""
    f = chunks.withColumn("claim", T.first_fact(F.col(text_col))).where("claim <> ''")
    return f.withColumn("confidence", F.when(F.coalesce(F.col(score_col), F.lit(0.0)) >= dims.HIGH_SCORE, "high").otherwise("medium"))


def missing_fields(flags: DataFrame, known: DataFrame) -> DataFrame:
    """(question_id, missing): what the conditions of a question's chunks (question_id, flags) ask for and its request
    (question_id, fields) does not say."""
    need = flags.sparkSession.createDataFrame(list(dims.CONTEXT_REQUIREMENTS.items()), "flag string, label string")
    asked = flags.select("question_id", F.explode("flags").alias("flag")).distinct().join(F.broadcast(need), "flag")
    open_ = asked.join(known.select("question_id", F.explode("fields").alias("label")), ["question_id", "label"], "left_anti")
    return open_.groupBy("question_id").agg(F.array_sort(F.collect_set("label")).alias("missing"))


def conflicts(chunks: DataFrame, as_of: Column) -> DataFrame:
    """(question_id, conflict_type, source_a, source_b, severity): disagreements between two sources of one question.

    Chunks need source_id, source_type, status, decision, version_text, expires_at, needs_review_at and rank; a question
    has few of them (its top k), so the self-join on rank stays within k squared.
    """
    c = chunks.where(F.coalesce(F.trim("source_type"), F.lit("")) != "").select(
        "question_id", "rank", "source_id", "source_type", F.lower(F.trim(F.coalesce("status", F.lit("")))).alias("status"),
        F.lower(F.trim(F.coalesce("decision", F.lit("")))).alias("decision"),
        F.array_distinct(
            F.regexp_extract_all(F.coalesce("version_text", F.lit("")), F.lit(r"(?i)\bv(?:ersion)?\s*(\d+\.\d+(?:\.\d+)?)\b"), F.lit(1))
        ).alias("versions"),
        T.stale(F.col("expires_at"), F.col("needs_review_at"), as_of).alias("stale"),
    )
    a, b = (c.select("question_id", *[F.col(x).alias(f"{p}_{x}") for x in c.columns if x != "question_id"]) for p in "ab")
    j = a.join(b, "question_id").where("a_rank < b_rank")
    ta, tb = F.col("a_source_type"), F.col("b_source_type")
    either = lambda left, right: (ta.isin(*left) & tb.isin(*right)) | (tb.isin(*left) & ta.isin(*right))
    said = [F.when(F.col(f"{p}_status") != "", F.col(f"{p}_status")).otherwise(F.col(f"{p}_decision")) for p in "ab"]
    kind = lambda cond, name, severity: F.when(cond, F.struct(F.lit(name).alias("conflict_type"), F.lit(severity).alias("severity")))
    found = F.array_compact(F.array(
        kind(
            either(["policy"], ["faq", "knowledge_base", "official_help_article"]) & (said[0] != "") & (said[1] != "") & (said[0] != said[1]),
            "policy_vs_faq", "high",
        ),
        kind(
            either(["release_note"], ["knowledge_base", "official_help_article"]) & (F.col("a_stale") | F.col("b_stale")),
            "stale_kb_vs_release_note", "high",
        ),
        kind(
            (ta == "known_issue") & (tb == "known_issue") & (F.col("a_status") != "") & (F.col("b_status") != "") & (
                F.col("a_status") != F.col("b_status")
            ),
            "known_issue_status_conflict", "high",
        ),
        kind(
            (F.size("a_versions") > 0) & (F.size("b_versions") > 0) & ~F.arrays_overlap("a_versions", "b_versions"),
            "version_specific_behavior_conflict", "medium",
        ),
    ))
    return j.select(
        "question_id", F.col("a_source_id").alias("source_a"), F.col("b_source_id").alias("source_b"),
        F.explode(found).alias("x"),
    ).select("question_id", "x.conflict_type", "source_a", "source_b", "x.severity").distinct()


def level(cands: DataFrame) -> DataFrame:
    """(question_id, level): HIGH, MEDIUM or LOW by top score, gap, meaningful chunks and distinct files. Needs rank, score, source_file."""
    good = F.col("score") >= dims.MEDIUM_SCORE
    s = cands.groupBy("question_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top"),
        F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"), F.count_if(good).alias("positive"),
        F.count_distinct(F.when(good, F.col("source_file"))).alias("files"),
    )
    gap = F.col("top") - F.coalesce("second", F.lit(0.0))
    strong = F.col("top") >= dims.HIGH_SCORE
    out = F.when(strong & (F.col("positive") >= 2) & (F.col("files") >= 2), "HIGH").when(strong & (gap >= dims.MIN_GAP) & (F.col("positive") >= 1), "HIGH").when(
        (F.col("top") >= dims.MEDIUM_SCORE) & (F.col("positive") >= 1), "MEDIUM",
    ).otherwise("LOW")
    return s.select("question_id", "top", F.round(gap, 4).alias("gap"), "positive", "files", out.alias("level"))


# Caps on the score, in the order in which they name the reason for abstaining.
CAPS = [
    ("no_results", 0.15, "No retrieval results."),
    ("unapproved", 0.20, "No approved customer-facing source supports the answer."),
    ("blocked", 0.60, "One or more candidate sources were blocked by source safety."),
    ("stale", 0.62, "One or more top sources are stale or need review."),
    ("conflict", 0.55, "Potential source conflict detected."), ("high_conflict", 0.45, "High-severity source conflict detected."),
    ("missing_context", 0.62, "Required product, platform, role, or account context is missing."),
    ("validator_failed", 0.35, "Validator found unsupported or unsafe output."),
    ("warnings", 0.68, "Validator warnings need review."),
]


def confidence(s: DataFrame) -> DataFrame:
    """Numeric confidence, band, action and reason, from one row of signals a question.

    Needs top, gap, positive, n, approved, blocked, stale, conflicts, high_conflicts, missing (counts), validator_failed
    and warnings. The score is a sum of parts under the least cap that holds; the reason is the first cap that holds.
    """
    base = F.when(F.col("top") >= dims.HIGH_SCORE, 0.55).when(
        F.col("top") >= dims.MEDIUM_SCORE, 0.35,
    ).when(
        F.col("top") >= dims.NOISE_FLOOR, 0.15,
    ).otherwise(0.0) + F.least(F.col("positive"), F.lit(3)) * 0.08 + F.when(
        F.col("gap") >= dims.MIN_GAP, 0.08,
    ).otherwise(0.0) + F.when(F.col("approved") > 0, 0.13).otherwise(0.0)
    holds = {
        "no_results": F.col("n") == 0, "unapproved": F.col("approved") == 0, "blocked": F.col("blocked") > 0,
        "stale": F.col("stale") > 0, "conflict": F.col("conflicts") > 0, "high_conflict": F.col("high_conflicts") > 0,
        "missing_context": F.col("missing") > 0, "validator_failed": F.col("validator_failed"), "warnings": F.col("warnings") > 0,
    }
    cap = F.least(F.lit(1.0), *[F.when(holds[k], v).otherwise(1.0) for k, v, _ in CAPS])
    reason = F.coalesce(*[F.when(holds[k], F.lit(r)) for k, _, r in CAPS], F.lit("Retrieval confidence is too low."))
    score = F.round(F.greatest(F.lit(0.0), F.least(base, cap)), 3)
    d = s.withColumn("confidence_score", score)
    band = F.when(F.col("confidence_score") >= dims.GREEN_MIN, "green").when(F.col("confidence_score") >= dims.YELLOW_MIN, "yellow").otherwise("red")
    d = d.withColumn("confidence_band", band)
    action = F.when(F.col("confidence_band") == "green", "answer").when(
        F.col("confidence_band") == "yellow",
        F.when(F.col("missing") > 0, "ask_clarifying_question").otherwise("cautious_answer"),
    ).otherwise(F.when(F.col("missing") > 0, "escalate").otherwise("refuse"))
    return d.withColumns(
        {
            "uncertainty_score": F.round(1 - F.col("confidence_score"), 3), "recommended_action": action,
            "abstention_reason": F.when(F.col("confidence_band") == "red", reason).otherwise(""),
        }
    )


def feedback_precision(retrieved: DataFrame, feedback: DataFrame) -> DataFrame:
    """(cache_key, precision, recall, gold_size) of retrieved ids against those of thumbs-up feedback; null without any."""
    gold = feedback.where("rating = 'thumbs_up'").select(
        "cache_key", F.explode("chunk_ids").alias("id"),
    ).groupBy("cache_key").agg(F.collect_set("id").alias("gold"))
    j = retrieved.withColumn("ids", F.array_distinct("chunk_ids")).join(gold, "cache_key", "left")
    hit = F.size(F.array_intersect("ids", "gold"))
    ok = F.coalesce(F.size("gold") > 0, F.lit(False)) & (F.size("ids") > 0)
    return j.select(
        "cache_key", F.when(ok, F.round(hit / F.size("ids"), 4)).alias("precision"),
        F.when(ok, F.round(hit / F.size("gold"), 4)).alias("recall"), F.when(ok, F.size("gold")).otherwise(0).alias("gold_size"),
    )


# Labels of a draft's sections and of a judge's lines.
SECTIONS = {
    "issue_classification": "Issue Classification:", "diagnosis": "Diagnosis:", "root_cause": "Root Cause:",
    "resolution_steps": "Resolution Steps:", "sources": "Sources:", "confidence": "Confidence:", "draft_email": "Draft Email:",
}
JUDGE = ("faithfulness", "completeness", "tone", "flags", "summary")


def draft_sections(text: Column, labels: dict[str, str] = SECTIONS) -> list[Column]:
    """One column for each labelled section of a draft, in whatever order they stand; empty where the label is missing."""
    low = F.lower(text)
    at = {k: F.instr(low, v.lower()) for k, v in labels.items()}
    places = F.array_sort(F.filter(F.array(*at.values()), lambda p: p > 0))
    out = []
    for k, v in labels.items():
        here = at[k]
        start, nxt = here + len(v), F.get(F.filter(places, _after(here)), F.lit(0))
        out.append(
            F.when(
                at[k] > 0,
                F.regexp_replace(F.substring(text, start, F.coalesce(nxt, F.length(text) + 1) - start), r"^\s+|\s+$", ""),
            ).otherwise("").alias(k)
        )
    return out


def _after(place: Column):
    return lambda p: p > place


def judge_lines(text: Column) -> list[Column]:
    """Faithfulness, completeness, tone (upper case), flags (array; NONE is empty) and summary of a judge's output."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    def value(name: str) -> Column:
        hit = F.filter(lines, lambda x: F.startswith(F.lower(x), F.lit(f"{name}:")))
        return F.coalesce(F.trim(F.regexp_replace(F.try_element_at(hit, F.lit(-1)), r"^[^:]*:", "")), F.lit(""))
    flags = value("flags")
    return [F.upper(value(n)).alias(n) for n in JUDGE[:3]] + [
        F.when(
            F.upper(flags).isin("NONE", ""), F.array().cast("array<string>"),
        ).otherwise(F.transform(F.split(flags, ","), lambda x: F.trim(x))).alias("flags"),
        value("summary").alias("summary"),
    ]


def context_pack(chunks: DataFrame, points: int = 4, per_chunk: int = 1_000, total: int = 6_000) -> DataFrame:
    """(question_id, context): a header and up to four sentences of each chunk, within character limits, in rank order."""
    body = F.array_join(
        F.slice(F.filter(F.transform(T.sentences(T.collapse(F.col("content"))), lambda x: F.trim(x)), lambda x: x != ""), 1, points),
        " ",
    )
    one = F.substring(F.concat(F.lit("["), F.col("citation_label"), F.lit("] "), F.col("source_id"), F.lit("\n"), body), 1, per_chunk)
    packed = chunks.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", one.alias("t")))).alias("parts"))
    return packed.select("question_id", F.substring(F.array_join(F.transform("parts", lambda x: x["t"]), "\n\n"), 1, total).alias("context"))


def masked_reply(draft: DataFrame, mode_col: str, modes: dict[str, list[str]], fields: list[str]) -> DataFrame:
    """Fields that an output mode does not show become empty; the unmasked reply stays in ``canonical``."""
    shown = F.create_map(*[x for k, v in modes.items() for x in (F.lit(k), F.array(*[F.lit(f) for f in v]))])
    allowed = F.coalesce(F.try_element_at(shown, F.col(mode_col)), F.array(*[F.lit(f) for f in fields]))
    return draft.withColumn(
        "canonical", F.struct(*fields),
    ).withColumns({f: F.when(F.array_contains(allowed, f), F.col(f)).otherwise("") for f in fields})


def clean_email(c: Column) -> Column:
    """A drafted e-mail without bracketed placeholders and doubled blank lines."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\[.*?\]", ""), r"\n{3,}", "\n\n"))


# Sections that each output mode shows.
OUTPUT_MODES = {
    "resolution_full": ["issue_classification", "diagnosis", "root_cause", "resolution_steps", "sources", "confidence", "draft_email"],
    "email_draft_only": ["draft_email"],
    "internal_agent_assist": ["issue_classification", "diagnosis", "root_cause", "resolution_steps", "sources", "confidence"],
    "diagnosis_only": ["issue_classification", "diagnosis", "root_cause", "sources", "confidence"],
}


def apply_preferences(draft: DataFrame, mode_col: str, include: dict[str, bool] | None = None, max_lines: int = 3) -> DataFrame:
    """Sections of stored drafts as a mode shows them (``include`` overrules it, section by section; a mode that is not known
    hides nothing): the diagnosis cut to its first ``max_lines`` lines that are not blank, the e-mail cleaned. The whole reply
    stays in ``canonical``."""
    fields = list(SECTIONS)
    modes = {m: [f for f in fields if (include or {}).get(f, f in shown)] for m, shown in OUTPUT_MODES.items()}
    out = masked_reply(draft, mode_col, modes, [f for f in fields if (include or {}).get(f, True)])
    lines = F.slice(F.filter(F.split("diagnosis", "\n"), lambda x: F.trim(x) != ""), 1, max_lines)
    return out.withColumns({"diagnosis": F.array_join(lines, "\n"), "draft_email": clean_email(F.col("draft_email"))})


# Citation syntax that is not allowed, after valid citations are taken out.
VALID_CITATION = r"\[KB-(\d+)\]"
INVALID_CITATIONS = [r"(?i)\[[^\]]*\bKB\b[^\]]*\]", r"(?i)\bKB\s*(?:#|-|article\s*)\d+\b", r"(?i)\bsource\s*:\s*KB\b", r"(?i)\bsee\s+KB[-#\s]*\d+\b"]
ESCALATION = r"(?i)\b(data loss|outage|all users|everyone|urgent|critical|breach|security|gdpr|compliance|legal)\b"


def invalid_citations(c: Column) -> Column:
    rest = F.regexp_replace(F.coalesce(c, F.lit("")), VALID_CITATION, "")
    return F.array_sort(
        F.array_distinct(
            F.flatten(F.array(*[F.transform(F.regexp_extract_all(rest, F.lit(p), F.lit(0)), lambda x: F.trim(x)) for p in INVALID_CITATIONS]))
        )
    )


def validate(d: DataFrame) -> DataFrame:
    """Validation of stored answers: labels cited and valid, claims without support, gatekeeper, escalation, outcome.

    Needs root_cause, resolution_steps, draft_email, sources (audited texts), valid_labels (array of numbers as text),
    blocked (count), n_facts, missing (array), n_conflicts, n_high_conflicts, confidence, band, abstained, route, ticket.
    """
    text = F.concat_ws("\n", "root_cause", "resolution_steps", "draft_email", "sources")
    low, factual = F.lower(text), F.concat_ws("\n", "root_cause", "resolution_steps")
    d = d.withColumns(
        {"cited": F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(VALID_CITATION), F.lit(1)))), "invalid": invalid_citations(text)}
    )
    d = d.withColumn("missing_labels", F.array_sort(F.array_except("cited", "valid_labels")))
    answered = (F.col("root_cause") != "") | (F.col("resolution_steps") != "")
    red, unsaid = F.col("band") == "red", F.filter("missing", lambda m: ~F.contains(low, F.lower(m)) & ~low.contains("missing"))
    claims = F.array_compact(F.array(
        F.when(F.size("invalid") > 0, "invalid citation syntax"),
        F.when(F.lower(F.trim("sources")) == "general technical knowledge", "general technical knowledge"),
        F.when(red & (F.col("draft_email") != ""), "customer draft despite red confidence"),
        F.when(red & answered & ~F.col("abstained"), "direct answer despite red confidence"),
        F.when(answered & (F.col("n_facts") > 0) & ~F.col("abstained") & ~factual.rlike(VALID_CITATION), "no citation in factual fields"),
        F.when(F.size(unsaid) > 0, "missing context not acknowledged"),
        F.when(
            (F.col("n_conflicts") > 0) & ~(low.contains("conflict") | low.contains("review") | low.contains("uncertain")),
            "conflicts not surfaced",
        ),
    ))
    d = d.withColumn("unsupported_claims", claims).withColumn("n_blocked", F.col("blocked") + F.size("missing_labels"))
    d = d.withColumn(
        "gatekeeper_flagged",
        (F.col("confidence") == "LOW") | (F.size("missing") > 0) | (F.col("n_blocked") > 0) | (
            F.size("unsupported_claims") > 0
        ) | (F.col("n_high_conflicts") > 0),
    )
    d = d.withColumn("needs_escalation", F.col("route").isin("billing", "access") & F.coalesce(F.col("ticket").rlike(ESCALATION), F.lit(False)))
    passed = (F.col("n_blocked") == 0) & (F.size("valid_labels") > 0) & (F.size("unsupported_claims") == 0) & ~F.col("gatekeeper_flagged")
    d = d.withColumn("passed", passed)
    outcome = F.when(~F.col("passed") & red, "abstained").when((F.col("n_blocked") > 0) | (F.size("unsupported_claims") > 0), "hard_failure").when(
        (F.col("band") == "yellow") | F.col("gatekeeper_flagged"), "clean_with_caveats",
    ).otherwise("clean")
    steps = T.word_count(F.col("resolution_steps")) > 10
    return d.withColumns(
        {
            "outcome": outcome, "has_steps": steps,
            "email_complete": F.col("draft_email").contains("Kind regards") & F.col("draft_email").contains("Subject:") & F.col("draft_email").contains("Hi"),
            "review_required": F.col("gatekeeper_flagged") | (F.col("n_blocked") > 0) | (F.size("unsupported_claims") > 0),
        }
    )


def abstain(d: DataFrame, fields: list[str]) -> DataFrame:
    """Answers of red confidence, or without evidence, are replaced by an abstention."""
    off = (F.col("band") == "red") | (F.col("n_evidence") == 0)
    return d.withColumns({f: F.when(off, "").otherwise(F.col(f)) for f in fields}).withColumns(
        {
            "abstained": off,
            "draft_unavailable_reason": F.when(F.col("n_evidence") == 0, "no approved evidence").when(off, "confidence is red").otherwise(""),
        }
    )


def review_items(d: DataFrame) -> DataFrame:
    """Rows that need human review, with sorted reasons, severity, issue type and service marker.

    Needs confidence, band, conflict, passed, blocked, route, faithfulness, completeness, needs_escalation.
    """
    reasons = F.array_sort(
        F.array_compact(
            F.array(
                F.when(F.col("confidence") == "LOW", "low confidence"), F.when(F.col("band") == "red", "red confidence"),
                F.when(F.col("conflict"), "source conflict"), F.when(~F.col("passed"), "validator failure"),
                F.when(F.col("route").isin("billing", "access", "policy"), "policy-heavy or sensitive case"),
                F.when(F.col("faithfulness") == "LOW", "low faithfulness"),
                F.when(F.col("completeness") == "LOW", "low completeness"), F.when(F.col("needs_escalation"), "escalation path"),
            )
        )
    )
    severity = F.when((F.col("band") == "red") | F.col("needs_escalation"), "high").otherwise("medium")
    issue = F.when(F.col("conflict"), "conflict").when(~F.col("passed"), "validation").when(F.col("blocked") > 0, "citation").otherwise("")
    return d.withColumn("reasons", reasons).where(F.size("reasons") > 0).withColumns({"severity": severity, "source_issue_type": issue}).withColumn(
        "sla_marker", F.when(F.col("severity") == "high", "review_today").otherwise("standard_review"),
    )


def traces(cands: DataFrame, most: int = 12, preview: int = 220) -> DataFrame:
    """(question_id, n_chunks, chunks): compact chunk lists of at most twelve with short redacted previews."""
    g = cands.where(F.col("rank") <= most).groupBy("question_id").agg(
        F.array_sort(
            F.collect_list(
                F.struct("rank", "chunk_id", "source_id", "score", F.substring(T.redact(T.collapse(F.col("content"))), 1, preview).alias("preview"))
            )
        ).alias("chunks")
    )
    return g.withColumn("n_chunks", F.size("chunks"))
