"""Policies and word lists as small tables. All are fixed values of the support domain; sizes are a few dozen rows."""

from __future__ import annotations

# Routes in order, each with the pattern that chooses it.
ROUTES = [
    (
        "billing",
        r"(?i)\b(billing|invoice|invoiced|charge|charged|payment|refund|subscription|cost|pricing|overcharged|billing contact|account owner)\b",
    ),
    (
        "access",
        r"(?i)\b(login|log in|log-in|sign in|sign-in|signed out|password|403|401|unauthorized|permission|access denied|locked out|can't access|cannot access|cannot see|credentials|role change|role changed|same browser session|failed a website action)\b",
    ),
    (
        "bug",
        r"(?i)\b(error|crash|broken|not working|fails|failed|exception|500|timeout|freezing|unresponsive|stopped working|stopped|not getting|badge|stale|pending badge|queued reply|not receive push|notifications?)\b",
    ),
    (
        "how_to",
        r"(?i)\b(how do|how can|how to|where is|where do|what is|what are|is it possible|steps to|guide|walkthrough|routing rule|routing rules|default routing|route new conversations|preview whether|before saving|routed to two teams)\b",
    ),
    ("integration", r"(?i)\b(api|webhook|integration|oauth|token|endpoint|sync|sso)\b"),
    (
        "policy",
        r"(?i)\b(policy|terms|eligibility|allowed|not allowed|compliance|export|exports|private notes|trial workspace|trial expired|restore deleted data|delete an account|historical tickets?|customer-facing evidence|source preview|source quality|source freshness|validation blocked|citation|cite|internal-only|pii|redaction|ship with source-safety|hard failures|upload preserves attribution|load anyway|preview confirmation|pdf extraction|html nav|footer content|become evidence)\b",
    ),
    ("release_change", r"(?i)\b(release|changelog|update|version|new feature|recent change)\b"),
]
ROUTE_RERANK_K = {"bug": 7, "how_to": 4, "access": 5, "billing": 5, "integration": 5, "policy": 5, "release_change": 7}
DEFAULT_RERANK_K = 5
ROUTE_SLOTS = {
    "policy": ["policy"], "billing": ["policy"], "access": ["policy", "official_help_article"],
    "bug": ["known_issue", "release_note"], "release_change": ["release_note", "known_issue"],
}

FILLER = [
    "hi", "hello", "hey", "dear", "greetings", "team", "all", "everyone", "guys", "please", "pls", "kindly", "thanks", "thank",
    "you", "regards", "cheers",
    "urgent", "asap", "immediately", "quickly", "i", "we", "my", "our", "me", "us", "am", "is", "are", "was", "were", "be", "been", "being",
    "have", "has", "had", "do", "does", "did", "just", "also", "actually", "basically", "really", "hope", "hoping", "wanted",
    "would", "could", "should", "know", "let", "help", "support",
]
STOP_WORDS = [
    "a", "an", "the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "is", "are", "was", "were",
    "be", "been", "has", "have", "had", "do", "does", "did",
    "will", "would", "could", "should", "may", "might", "can", "this", "that", "these", "those", "it", "its", "if", "as", "so",
    "not", "no", "you", "your", "we", "our", "they", "their", "he", "she", "i", "my", "me", "us", "them",
]
CONDITION_FLAGS = {
    "requires_setting": [
        "only if", "if enabled", "must enable", "requires", "required", "setting", "settings", "configure", "configuration",
        "enabled",
    ],
    "requires_role": ["role", "admin", "administrator", "manager", "employee"],
    "requires_permission": ["permission", "permissions", "access level", "authorized", "privilege"],
    "requires_feature_enabled": ["feature enabled", "feature flag", "enable the feature", "module enabled"],
    "platform_specific": ["web", "website", "browser", "mobile", "ios", "android", "app only", "web only"],
    "plan_specific": ["plan", "tier", "subscription", "package"],
    "version_or_date_specific": ["version", "release", "as of", "starting in", "deprecated"],
    "policy_exception": ["policy", "exception", "eligibility", "eligible", "not eligible"],
    "account_specific": ["account setting", "account configuration", "tenant", "workspace", "location"],
}
DATE_MENTION = r"\b\d{1,2}[./-]\d{1,2}[./-]\d{2,4}\b|\b20\d{2}\b"

FORBIDDEN_TYPES = [
    "raw_ticket_history", "raw_ticket", "raw_chat_transcript", "raw_call_transcript", "raw_email", "raw_ticket_chat_call",
    "similar_resolved_ticket",
]
ALLOWED_TYPES = ["knowledge_base", "official_help_article", "faq", "policy", "release_note", "known_issue"]
REQUIRED_CITATION_FIELDS = [
    "source_id", "source_type", "source_category", "tier", "source_ref", "lineage_ref", "reviewed_by", "approved_at",
    "audience_allowed", "source_url", "document_hash", "updated_at", "ingested_at", "loader_version", "config_hash",
]

SOURCE_TYPES = ["csv", "xlsx", "pdf"]
SOURCE_AUTHORITIES = ["canonical", "approved", "conditional"]
DOC_TYPES = ["faq", "troubleshooting", "policy", "release_note", "known_issue", "api_reference"]
ESCALATION_RISKS = ["low", "medium", "high"]
MANIFEST_COLUMNS = [
    "source_id", "source_title", "source_type", "source_authority", "is_approved", "is_active", "is_customer_facing_allowed",
    "approved_at", "reviewed_by", "needs_review_at", "doc_type", "product_area", "issue_class", "version_scope",
    "escalation_risk", "body",
]

# Scores of a cross-encoder that count as strong, meaningful and above noise; the gap of a dominant result.
HIGH_SCORE, MEDIUM_SCORE, NOISE_FLOOR, MIN_GAP = 7.0, 2.0, 0.5, 3.0
GREEN_MIN, YELLOW_MIN = 0.72, 0.40

# Per route: preferred source types, preferred chunk types, boost, refused source types.
ROUTE_POLICIES = {
    "bug": (
        ["knowledge_base", "official_help_article", "release_note", "known_issue"],
        ["troubleshooting", "known_issue", "release_change", "faq"], 0.15,
        ["raw_ticket_history", "raw_chat_transcript", "raw_call_transcript"],
    ),
    "access": (["knowledge_base", "official_help_article", "policy"], ["permission", "configuration", "how_to"], 0.12, ["raw_ticket_history"]),
    "billing": (["policy", "knowledge_base", "official_help_article"], ["billing", "policy", "faq", "how_to"], 0.15, ["raw_ticket_history"]),
    "how_to": (["knowledge_base", "official_help_article", "faq"], ["how_to", "configuration", "faq", "concept"], 0.10, ["raw_ticket_history"]),
    "integration": (
        ["knowledge_base", "official_help_article", "release_note"], ["integration", "configuration", "troubleshooting"], 0.12,
        ["raw_ticket_history"],
    ),
    "policy": (["policy", "knowledge_base", "official_help_article"], ["policy", "faq", "concept"], 0.12, ["raw_ticket_history"]),
    "release_change": (["release_note", "known_issue"], ["release_change", "known_issue", "concept"], 0.12, ["raw_ticket_history"]),
    "general": (["knowledge_base", "official_help_article", "faq"], ["concept", "faq", "how_to"], 0.08, ["raw_ticket_history"]),
}
SOURCE_AUTHORITY = {
    "official_help_article": 1.0, "knowledge_base": 1.0, "policy": 1.0, "official_internal_doc": 0.95, "release_note": 0.9,
    "known_issue": 0.85, "reviewed_case_learning": 0.7,
    "unreviewed_case_learning": 0.45, "similar_resolved_ticket": 0.3, "raw_ticket_history": 0.1, "raw_chat_transcript": 0.1,
    "raw_call_transcript": 0.1,
}
RAW_TYPES = ["raw_ticket_history", "raw_chat_transcript", "raw_call_transcript", "similar_resolved_ticket"]
# Chunk type: priority, words looked for in heading or title, words looked for in the content.
CHUNK_TYPES = {
    "billing": (70, ["billing", "invoice", "payment", "refund", "subscription"], ["invoice", "card", "charge", "payment method", "receipt"]),
    "permission": (65, ["permission", "role", "access", "admin"], ["permission", "role", "access level", "authorized"]),
    "troubleshooting": (60, ["troubleshoot", "error", "issue", "problem"], ["not working", "failed", "error", "fix"]),
    "how_to": (55, ["how to", "steps", "setup", "configure"], ["click", "select", "open", "choose"]),
    "integration": (50, ["integration", "api", "webhook"], ["api", "webhook", "token", "endpoint"]),
    "policy": (45, ["policy", "terms", "rules"], ["policy", "required", "allowed", "not allowed"]),
    "faq": (40, ["faq", "question"], ["frequently asked", "question"]),
    "warning": (35, ["warning", "important", "note"], ["warning", "important", "note"]),
}
CHUNK_TYPE_RULES = {name: {"priority": p, "heading": h, "content": c} for name, (p, h, c) in CHUNK_TYPES.items()}
DIRECT_PRIORITY = {
    "policy": ["policy", "official_help_article", "knowledge_base", "release_note", "known_issue"],
    "billing": ["policy", "official_help_article", "knowledge_base"],
    "access": ["official_help_article", "knowledge_base", "policy"],
    "bug": ["known_issue", "official_help_article", "knowledge_base", "release_note"],
    "release_change": ["release_note", "known_issue", "official_help_article", "knowledge_base"],
    "how_to": ["official_help_article", "knowledge_base", "faq", "policy"],
    "general": ["official_help_article", "knowledge_base", "policy", "faq"],
}
CONTEXT_REQUIREMENTS = {
    "requires_role": "role or permission level", "requires_permission": "role or permission level",
    "platform_specific": "access channel or platform", "plan_specific": "plan or subscription tier",
    "requires_setting": "relevant setting state", "requires_feature_enabled": "feature enabled state",
    "account_specific": "account or location configuration",
}


def route_policies(spark):
    """(route, preferred, preferred_chunks, boost, refused)."""
    return spark.createDataFrame(
        [(r, *v) for r, v in ROUTE_POLICIES.items()],
        "route string, preferred array<string>, preferred_chunks array<string>, boost double, refused array<string>",
    )


def source_authority(spark, preset: dict[str, float] | None = None):
    """(source_type, authority): the base table, overridden by a preset; raw types never above 0."""
    table = SOURCE_AUTHORITY | (preset or {})
    return spark.createDataFrame([(k, float(min(v, 0.0) if k in RAW_TYPES else v)) for k, v in table.items()], "source_type string, authority double")
