"""Question planning: routes, entities, sub-questions and search queries, for all questions at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from deskgrain.functions import dims
from deskgrain.functions import text as T

# What is looked for in a ticket.
QUESTION = r"([^.!?\n]*\?)"
VERSION = r"(?i)\b(?:v(?:ersion)?\s*)?(\d+\.\d+(?:\.\d+)?)\b"
PRIORITY = r"(?i)\b(urgent|critical|high priority|low priority|p[0-3])\b"
PLAN = r"(?i)\b(free|trial|starter|pro|business|enterprise)\s+(?:plan|tier)?\b"
CHANNEL = r"(?i)\b(email|chat|phone|mobile app|website|web|api)\b"
RISK = r"(?i)\b(urgent|critical|security|breach|legal|compliance|refund|payment|data loss|outage|all users|everyone)\b"
TOKEN, ENTITY = r"[\p{L}\p{N}_-]+", r"^[A-Z][A-Za-z0-9_-]{2,}$"


def route(ticket: Column) -> Column:
    """First route whose pattern matches; general for evaluation chatter, vague short tickets and all else."""
    t = F.coalesce(ticket, F.lit(""))
    n = F.regexp_count(t, F.lit(r"\w+"))
    out = F.when(
        t.rlike(r"(?i)\bgolden eval\b") & t.rlike(r"(?i)\b(latency|cost|budget|baseline|retrieval recall)\b"), "general",
    ).when((n <= 5) & t.rlike(r"(?i)\b(help|broken|issue|problem)\b"), "general")
    for name, pattern in dims.ROUTES:
        out = out.when(t.rlike(pattern), name)
    return out.otherwise("general")


def explicit_questions(ticket: Column) -> Column:
    return F.filter(
        F.transform(F.regexp_extract_all(F.coalesce(ticket, F.lit("")), F.lit(QUESTION), F.lit(1)), lambda x: F.trim(x)),
        lambda q: q != "",
    )


def extract(ticket: Column) -> Column:
    """Entities, version, priority, plan tier, channel, risk words and questions of a ticket."""
    t = F.coalesce(ticket, F.lit(""))
    found = lambda p: F.array_sort(F.array_distinct(F.regexp_extract_all(t, F.lit(p), F.lit(0))))
    return F.struct(
        F.slice(F.filter(found(TOKEN), lambda x: x.rlike(ENTITY)), 1, 12).alias("entities"),
        F.regexp_extract(t, VERSION, 1).alias("version"), F.lower(F.regexp_extract(t, PRIORITY, 1)).alias("priority"),
        F.lower(F.regexp_extract(t, PLAN, 1)).alias("plan_tier"),
        F.lower(F.regexp_extract(t, CHANNEL, 1)).alias("channel"),
        F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(t, F.lit(RISK), F.lit(1)), F.lower))).alias("risk_flags"),
        F.slice(explicit_questions(t), 1, 5).alias("questions"),
    )


def missing_context(ticket: Column, product: Column, channel: Column, role: Column) -> Column:
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    needs_role = F.coalesce(ticket, F.lit("")).rlike(r"(?i)\b(permission|role|admin|manager|owner|compliance)\b")
    return F.array_sort(
        F.array_compact(F.array(F.when(blank(product), "product"), F.when(blank(channel), "platform"), F.when(needs_role & blank(role), "role")))
    )


def answer_type(route_: Column, ticket: Column) -> Column:
    return F.when(route_.isin("billing", "policy"), "policy_guidance").when(route_ == "release_change", "change_summary").when(route_.isin("bug", "access", "integration"), "troubleshooting").when(
        F.coalesce(ticket, F.lit("")).rlike(r"(?i)\bhow (?:do|can|to)\b|\bsteps?\b"), "how_to",
    ).otherwise("support_resolution")


def retrieval_plan(tickets: DataFrame, id_col: str, text_col: str, most: int = 3, cut: int = 300) -> DataFrame:
    """(id, question_no, query): up to three explicit questions, or the whole ticket, collapsed and cut to 300 characters."""
    q = explicit_questions(F.col(text_col))
    asked = F.when(F.size(q) > 0, q).otherwise(F.array(F.coalesce(F.col(text_col), F.lit(""))))
    return tickets.select(F.col(id_col), F.posexplode(F.slice(asked, 1, most)).alias("i", "q")).select(
        id_col, (F.col("i") + 1).alias("question_no"), F.substring(T.collapse(F.col("q")), 1, cut).alias("query"),
    )


def search_query(normalized: Column, product: Column, plat: Column, role: Column, words: int = 12, most: int = 18) -> Column:
    """The first twelve words that are no filler, with product, platform and role if they are not among them; 18 words at most."""
    all_ = T.words(normalized)
    kept = F.filter(all_, lambda w: ~F.regexp_replace(F.lower(w), r"[.,!?]+$", "").isin(*dims.FILLER))
    base = F.regexp_replace(F.array_join(F.slice(F.when(F.size(kept) > 0, kept).otherwise(all_), 1, words), " "), r"[.!?,]+$", "")
    extra = [
        F.when(
            (F.coalesce(F.trim(c), F.lit("")) != "") & ~F.contains(F.lower(base), F.lower(F.trim(c))), F.lower(F.trim(c)),
        ) for c in (product, plat, role)
    ]
    return F.array_join(F.slice(T.words(F.concat_ws(" ", base, *extra)), 1, most), " ")


def query_set(base: DataFrame, planned: DataFrame, most: int = 4) -> DataFrame:
    """(ticket_id, query, no): the base query first, then planned ones, without repeats, four at most."""
    both = base.select("ticket_id", "query", F.lit(0).alias("no")).unionByName(planned.select("ticket_id", "query", F.col("question_no").alias("no")))
    first = both.where(F.trim("query") != "").groupBy("ticket_id", "query").agg(F.min("no").alias("no"))
    return first.withColumn("no", F.row_number().over(Window.partitionBy("ticket_id").orderBy("no", "query"))).where(F.col("no") <= most)


def fingerprint(*cols: Column) -> Column:
    """Digest under which exact repeats of a request meet."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(T.collapse(F.lower(c)), F.lit("")) for c in cols]), 256)
