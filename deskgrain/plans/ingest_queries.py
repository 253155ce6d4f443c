"""Registered ingest and planning queries, with their SQL."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import functions as F

from deskgrain.functions import dims
from deskgrain.functions import text as T
from deskgrain.operators import html
from deskgrain.operators import ingest as I
from deskgrain.operators import planning as P
from deskgrain.operators import retrieval as R

from .common import AS_OF, WS, book, collapse_sql, quoted, redact_sql, table, words_sql
from .retrieval_queries import CAND, candidates

QUERIES, SQL, query = book()
RX = quoted
ENTITIES = ("ACCOUNT_ID", "ADDRESS", "PERSON")


@query(f"""WITH r AS (SELECT doc_id, text, {redact_sql('text', ENTITIES)} AS r FROM documents)
SELECT doc_id, coalesce(text, '') <> r AS redaction_applied,
  CASE WHEN coalesce(text, '') <> r THEN 'redacted' ELSE 'checked_no_sensitive_data_found' END AS redaction_status, sha256(r) AS redacted_sha256
  FROM r""")
def redacted_documents(spark, sf):
    """Redacted text of every document with its redaction status."""
    d = table(spark, sf, "documents").select("doc_id", "text", T.redact(F.col("text"), ENTITIES).alias("redacted"))
    s = T.redaction_status(F.col("text"), F.col("redacted"))
    return d.select(
        "doc_id", s["applied"].alias("redaction_applied"), s["status"].alias("redaction_status"),
        T.sha256(F.col("redacted")).alias("redacted_sha256"),
    )


@query(f"""SELECT lang,
  count(*) FILTER (WHERE regexp_matches(text, {RX(T.EMAIL)})) AS emails,
  count(*) FILTER (WHERE regexp_matches(text, {RX(T.SECRET)})) AS secrets,
  count(*) FILTER (WHERE regexp_matches(text, {RX(T.PAYMENT)})) AS payments
  FROM documents
  GROUP BY lang""")
def sensitive_documents(spark, sf):
    """Documents with e-mail addresses, secrets and payment numbers by language."""
    t = F.col("text")
    return table(
        spark, sf, "documents",
    ).groupBy("lang").agg(*[F.count_if(t.rlike(p)).alias(n) for n, p in (("emails", T.EMAIL), ("secrets", T.SECRET), ("payments", T.PAYMENT))])


@query(
    f"SELECT doc_id, regexp_replace(text, {RX(T.EMAIL)}, '[redacted_email]', 'g') AS masked FROM documents WHERE regexp_matches(text, {RX(T.EMAIL)})"
)
def masked_emails(spark, sf):
    """E-mail addresses masked."""
    t = F.col("text")
    return table(spark, sf, "documents").where(t.rlike(T.EMAIL)).select("doc_id", F.regexp_replace(t, T.EMAIL, "[redacted_email]").alias("masked"))


@query(
    r"SELECT doc_id, regexp_replace(lower(regexp_replace(text, '[^a-zA-Z0-9]', '_', 'g')), '^_+|_+$', '', 'g') AS slug, sha256(text) AS document_hash FROM documents"
)
def document_slugs(spark, sf):
    """Slugs and content hashes."""
    return table(spark, sf, "documents").select("doc_id", T.slug(F.col("text")).alias("slug"), T.sha256(F.col("text")).alias("document_hash"))


def _unescaped(c: str) -> str:
    """All references with a semicolon that the standard table names, and decimal numbers, replaced one after the other."""
    names = {n: v for n, v in html5.items() if n.endswith(";") and len(v) == 1}
    known = "MAP {" + ", ".join(f"{RX('&' + n)}: {RX(v)}" for n, v in sorted(names.items())) + "}"
    found = rf"list_filter(list_distinct(regexp_extract_all({c}, '&(#[0-9]+|[a-zA-Z][a-zA-Z0-9]*);')), lambda e: e <> '&amp;')"
    by = rf"coalesce(try({known}[e]), try(chr(CAST(regexp_extract(e, '^&#([0-9]+);$', 1) AS INT))), e)"
    return f"replace(list_reduce({found}, lambda t, e: replace(t, e, {by}), {c}), '&amp;', '&')"


#: Pages cut at each "<": pieces of markup, which ends at the first ">" that no quote holds, and text. A piece within a script or
#: style belongs to it; a nested hidden element counts; depths come from running sums instead of a fold.
_PIECES = rf"""
WITH RECURSIVE s AS (SELECT page_id, string_split(coalesce(html, ''), '<') AS p FROM pages),
c AS (SELECT page_id, generate_subscripts(p, 1) - 1 AS i, unnest(p) AS piece FROM s),
o AS (SELECT *, regexp_matches(piece, '^(script|style)[ >]') AS opens, regexp_matches(piece, '^/(script|style)>') AS shuts FROM c),
r AS (SELECT *, coalesce(max(CASE WHEN opens THEN i END) OVER before, -1) > coalesce(max(CASE WHEN shuts THEN i END) OVER before, -1) AND NOT shuts AS raw
  FROM o WINDOW before AS (PARTITION BY page_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT page_id, i, lower(regexp_extract(piece, '^(/?[a-zA-Z][a-zA-Z0-9]*)', 1)) AS tag,
  CASE WHEN i = 0 THEN piece WHEN starts_with(piece, '!--') THEN regexp_extract(piece, '^!--.*?-->(.*)$', 1, 's') ELSE regexp_extract(piece, '^[^>]*>(.*)$', 1, 's') END AS body
  FROM r WHERE NOT raw),
k AS (SELECT *, CASE WHEN tag IN ('nav', 'footer', 'script', 'style') THEN 1 WHEN tag IN ('/nav', '/footer', '/script', '/style') THEN -1 ELSE 0 END AS step FROM t),
d AS (SELECT *, sum(step) OVER w AS open, coalesce(max(CASE WHEN tag = 'title' THEN i END) OVER w, -1) > coalesce(max(CASE WHEN tag = '/title' THEN i END) OVER w, -1) AS named
  FROM k WINDOW w AS (PARTITION BY page_id ORDER BY i ROWS UNBOUNDED PRECEDING))"""


def _collapsed(c: str) -> str:
    return rf"trim(regexp_replace({c}, '[\t-\r\x{{1C}}-\x{{20}}\x{{85}}\x{{A0}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{3000}}]+', ' ', 'g'))"


def _plain_sql() -> str:
    t = f"translate({_unescaped('raw')}, {RX(html.ONE_TO_ONE[0])}, {RX(html.ONE_TO_ONE[1])})"
    for p, by in {html.DROPPED: "", **html.LONGER}.items():
        t = f"regexp_replace({t}, '{p}', '{by}', 'g')"
    t = rf"trim(regexp_replace(regexp_replace({t}, '[^\x00-\x7F]', '', 'g'), '[ \t\n\r\f\x0B]+', ' ', 'g'))"
    return rf"""{_PIECES},
j AS (SELECT page_id, string_agg(CASE WHEN tag IN ('script', 'style') THEN '' ELSE body END, ' ' ORDER BY i) AS raw FROM d GROUP BY page_id)
SELECT page_id, {t} AS plain FROM j"""


@query(_plain_sql())
def html_plain_text(spark, sf):
    """A4: pages as plain ASCII text."""
    return table(spark, sf, "pages").select("page_id", html.html_plain(F.col("html")).alias("plain"))


def _page_sql() -> str:
    return rf"""{_PIECES},
v AS (SELECT *, {_collapsed(_unescaped('body'))} AS text, regexp_matches(tag, '^/?(h1|h2|h3|p|li|tr)$') AND open <= 0 AS breaks FROM d),
g AS (SELECT page_id, coalesce(string_agg(text, ' ' ORDER BY i) FILTER (WHERE named AND text <> ''), '') AS title,
  string_agg(CASE WHEN breaks THEN chr(10) ELSE '' END || CASE WHEN open > 0 OR named THEN '' ELSE text END, '' ORDER BY i) AS body FROM v GROUP BY page_id),
b AS (SELECT page_id, title, array_to_string(list_filter(list_transform(string_split(body, chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10)) AS body FROM g)
SELECT page_id, title, body, len({words_sql('body')}) < 5 AS rejected FROM b"""


@query(_page_sql())
def html_pages(spark, sf):
    """A3: title and visible text of pages, rejected below five words."""
    p = html.html_page(F.col("html"))
    return table(spark, sf, "pages").select("page_id", p.alias("p")).select("page_id", "p.title", "p.body", "p.rejected")


@query(r"""WITH p AS (SELECT p_partkey, p_brand || ' | ' || p_name || CASE WHEN p_partkey % 3 = 0 THEN ' mobile app' ELSE '' END AS raw,
  CASE WHEN p_partkey % 5 = 0 THEN 'nan' WHEN p_partkey % 7 = 0 THEN ' iOS ' ELSE '' END AS plat
  FROM part)
SELECT p_partkey, trim(split_part(raw, '|', 1)) AS product, trim(split_part(raw, '|', 2)) AS title,
  CASE WHEN trim(lower(plat)) NOT IN ('', 'nan') THEN trim(lower(plat)) WHEN regexp_matches(trim(split_part(raw, '|', 2)), '(?i)\b(app|mobile)\b') THEN 'app' ELSE 'website' END AS platform
  FROM p""")
def parsed_titles(spark, sf):
    """Product, title and platform from ``Product | Title``, with a platform column that overrides."""
    k = F.col("p_partkey")
    raw = F.concat("p_brand", F.lit(" | "), "p_name", F.when(k % 3 == 0, " mobile app").otherwise(""))
    plat = F.when(k % 5 == 0, "nan").when(k % 7 == 0, " iOS ").otherwise("")
    t = I.parse_title(raw)
    return table(spark, sf, "part").select(
        "p_partkey", t["product"].alias("product"), t["title"].alias("title"), I.platform(t["platform"], plat).alias("platform"),
    )


@query(r"""WITH p AS (SELECT p_partkey, p_brand || ' | ' || p_type || CASE WHEN p_partkey % 2 = 0 THEN ' Mobile' ELSE '' END || ' | 2024-01-0' || (1 + p_partkey % 9) AS raw
  FROM part)
SELECT p_partkey, trim(split_part(raw, '|', 1)) AS product, trim(split_part(raw, '|', 2)) AS title,
  CASE WHEN regexp_matches(split_part(raw, '|', 2), '(?i)\bmobile\b') THEN 'app' ELSE 'website' END AS platform
  FROM p""")
def parsed_release_titles(spark, sf):
    """B2: release-note titles."""
    k = F.col("p_partkey")
    t = I.parse_release_title(
        F.concat("p_brand", F.lit(" | "), "p_type", F.when(k % 2 == 0, " Mobile").otherwise(""), F.lit(" | 2024-01-0"), (k % 9 + 1).cast("string"))
    )
    return table(spark, sf, "part").select("p_partkey", *[t[c].alias(c) for c in ("product", "title", "platform")])


@query("""SELECT c_custkey,
  CASE WHEN c_custkey % 10 = 0 THEN 'general' WHEN lower(trim(c_mktsegment)) = 'automobile' THEN 'vehicles' WHEN lower(trim(c_mktsegment)) = 'machinery' THEN 'vehicles' WHEN lower(trim(c_mktsegment)) = 'building' THEN 'construction' ELSE trim(c_mktsegment) END AS product
  FROM customer""")
def canonical_products(spark, sf):
    """Alias canonicalisation, a default where blank, unknown names passed through."""
    aliases = spark.createDataFrame(
        [("automobile", "vehicles"), ("machinery", "vehicles"), ("building", "construction")], "alias string, canonical string",
    )
    c = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 10 == 0, " ").otherwise(F.col("c_mktsegment")).alias("segment"))
    return I.canonical(c, "segment", aliases, "general", "product").select("c_custkey", "product")


STOPS = ", ".join(f"'{w}'" for w in dims.STOP_WORDS)


@query(rf"""WITH t AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS pos
  FROM (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'), lambda x: regexp_full_match(x, '[a-z]{{3,}}') AND x NOT IN ({STOPS})) AS ws
  FROM documents)),
g AS (SELECT doc_id, word, count(*) AS n, min(pos) AS first FROM t GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS r FROM g)
SELECT doc_id, string_agg(word, ', ' ORDER BY r) AS keywords FROM r WHERE r <= 8 GROUP BY doc_id""")
def document_keywords(spark, sf):
    """The eight commonest words of every document."""
    return I.keywords(table(spark, sf, "documents"), "doc_id", "text")


@query(r"""SELECT doc_id,
  array_to_string(list_filter(string_split(regexp_replace(trim(text), '([.!?])[ \t\n\r\f\v]+', '\1' || chr(1), 'g'), chr(1))[1:2], lambda x: x <> ''), ' ') AS summary
  FROM documents""")
def document_summaries(spark, sf):
    """First two sentences."""
    return table(spark, sf, "documents").select("doc_id", I.summary(F.col("text")).alias("summary"))


@query(rf"""WITH s AS (SELECT doc_id, list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?])[ \t\n\r\f\v]+', '\1' || chr(1), 'g'), chr(1)), lambda x: {{'done': CAST([] AS VARCHAR[]), 'open': x, 'n': len({words_sql('x')})}}) AS s
  FROM documents),
p AS (SELECT doc_id, list_reduce(s, lambda a, x: CASE WHEN a.n + x.n > 200 THEN {{'done': list_append(a.done, a.open), 'open': x.open, 'n': x.n}} ELSE {{'done': a.done, 'open': a.open || ' ' || x.open, 'n': a.n + x.n}} END) AS r
  FROM s),
c AS (SELECT doc_id, list_append(r.done, r.open) AS cs FROM p)
SELECT doc_id,
  CAST(i AS INT) AS chunk_no,
  CAST(len({words_sql('cs[i + 1]')}) AS INT) AS n_words, sha256(cs[i + 1]) AS chunk_hash
  FROM (SELECT *, unnest(range(len(cs))) AS i
  FROM c)""")
def sentence_chunks(spark, sf):
    """Texts packed sentence by sentence into chunks of at most 200 words, a fold in order."""
    c = table(spark, sf, "documents").select("doc_id", F.posexplode(I.sentence_chunks(F.col("text"))).alias("chunk_no", "content"))
    return c.select("doc_id", "chunk_no", T.word_count(F.col("content")).alias("n_words"), T.sha256(F.col("content")).alias("chunk_hash"))


@query()
def sectioned_chunks(spark, sf):
    """pages' text cut into sections at headings, and the sections into chunks."""
    p = table(spark, sf, "pages").select(
        "page_id",
        F.regexp_replace(F.regexp_replace("html", r"(?i)<h[1-4][^>]*>", "\n\n## "), r"(?i)</(h[1-4]|p|li|div)>", "\n\n").alias("t"),
    )
    p = p.select("page_id", F.regexp_replace("t", r"<[^>]*>", " ").alias("t"))
    return I.smart_chunks(I.sections(p, "page_id", "t")).select(
        "article_id", "section_id", "heading", "chunk_no", T.word_count(F.col("content")).alias("n_words"),
        T.sha256(F.col("content")).alias("chunk_hash"),
    )


def _any_sql(c: str, terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, {RX(t)})" for t in terms) + ")"


FLAGS = ", ".join(f"CASE WHEN {_any_sql('t', w)}" + (f" OR regexp_matches(t, {RX(dims.DATE_MENTION)})" if n == "version_or_date_specific" else "") + f" THEN '{n}' END" for n, w in sorted(dims.CONDITION_FLAGS.items()))


@query(f"""WITH x AS (SELECT doc_id, lower(source || ' ' || lang || ' ' || text) AS t FROM documents)
SELECT doc_id, array_to_string(list_filter([{FLAGS}], lambda x: x IS NOT NULL), ',') AS flags FROM x""")
def condition_flags(spark, sf):
    """Kinds of conditions that documents mention."""
    return table(spark, sf, "documents").select(
        "doc_id", F.array_join(I.condition_flags(F.col("text"), F.col("lang"), F.col("source")), ",").alias("flags"),
    )


#: The rules with one that is off and two with negative keywords.
RULES = dims.CHUNK_TYPE_RULES | {
    "warning": dims.CHUNK_TYPE_RULES["warning"] | {"enabled": False},
    "faq": dims.CHUNK_TYPE_RULES["faq"] | {"negative": ["error"]},
    "policy": dims.CHUNK_TYPE_RULES["policy"] | {"negative": ["the", "license"]},
}
TYPES = " ".join(
    f"WHEN ({_any_sql('h', r['heading'])} OR {_any_sql('c', r['content'])}) {'AND NOT ' + _any_sql('c', r['negative']) if 'negative' in r else ''} THEN '{n}'"
    for n, r in sorted(RULES.items(), key=lambda x: (x[1]["priority"], x[0]), reverse=True) if r.get("enabled", True)
)


@query(f"""WITH x AS (SELECT doc_id, lower(text) AS c, lower(source) || chr(10) || lower(lang) AS h FROM documents)
SELECT doc_id, CASE {TYPES} WHEN doc_id % 4 = 0 THEN 'release_change' ELSE 'concept' END AS chunk_type FROM x""")
def chunk_types(spark, sf):
    """Chunk types by rules of descending priority, one of them off, some with negative keywords (documents hold no pipe
    tables with separators)."""
    dt = F.when(F.col("doc_id") % 4 == 0, "release_note").otherwise("faq")
    return table(spark, sf, "documents").select("doc_id", I.chunk_type(F.col("text"), F.col("lang"), F.col("source"), dt, RULES).alias("chunk_type"))


@query(f"""WITH x AS (SELECT doc_id, 'Title: ' || source || chr(10) || 'Product: ' || lang || chr(10) || 'Source type: faq' || chr(10) || chr(10) || text || CASE WHEN len({words_sql('text')}) < 60 THEN chr(10) || chr(10) || 'Nearby section context: ' || substr(text, 1, 1200) ELSE '' END AS e, 'Article: ' || source || chr(10) || chr(10) || text AS d
  FROM documents)
SELECT doc_id, sha256(e) AS embedding_text_sha256, sha256(d) AS display_text_sha256 FROM x""")
def chunk_texts(spark, sf):
    """Embedding and display texts with labelled context."""
    t = I.chunk_texts(F.col("text"), F.col("source"), F.lit(""), F.lit("faq"), F.col("lang"), F.lit(""), F.col("text"))
    return table(spark, sf, "documents").select("doc_id", t.alias("t")).select(
        "doc_id", T.sha256(F.col("t.embedding_text")).alias("embedding_text_sha256"),
        T.sha256(F.col("t.display_text")).alias("display_text_sha256"),
    )


def _chunks(spark, sf):
    """Chunks of all documents as they were: some texts twice as long, some hashes of another text, some no longer active."""
    i = F.col("article_id")
    d = table(spark, sf, "documents").withColumn("old", F.when(F.col("doc_id") % 13 == 0, F.concat_ws(" ", "text", "text")).otherwise(F.col("text")))
    c = R.word_windows(d, "doc_id", "old", keep=("old",))
    return c.select(
        "article_id", F.concat_ws(":", i.cast("string"), "chunk_index").alias("chunk_id"),
        F.when(i % 7 == 0, T.sha256(F.lit("old"))).otherwise(T.sha256(F.col("old"))).alias("document_hash"),
        (1 + i % 3).cast("int").alias("document_version"), (i % 5 != 0).alias("is_active"),
    )


def _plan(spark, sf):
    """All documents come in again, some of them longer."""
    d = table(spark, sf, "documents").withColumn(
        "t", F.when(F.col("doc_id") % 11 == 0, F.concat_ws(" ", "text", "text", "text")).otherwise(F.col("text")),
    )
    return I.reingest_plan(_chunks(spark, sf), I.incoming(R.word_windows(d, "doc_id", "t", keep=("t",)), F.col("t")))


PLAN = f"""o AS (SELECT doc_id, len({words_sql('t')}) AS n,
  CASE WHEN doc_id % 7 = 0 THEN sha256('old') ELSE sha256(t) END AS h, 1 + doc_id % 3 AS v, doc_id % 5 <> 0 AS live
  FROM (SELECT doc_id,
  CASE WHEN doc_id % 13 = 0 THEN text || ' ' || text ELSE text END AS t
  FROM documents)),
i AS (SELECT doc_id, len({words_sql('t')}) AS n, sha256(t) AS h
  FROM (SELECT doc_id,
  CASE WHEN doc_id % 11 = 0 THEN text || ' ' || text || ' ' || text ELSE text END AS t
  FROM documents)),
j AS (SELECT i.doc_id AS article_id,
  CASE WHEN live THEN o.h END AS oh, i.h AS nh, o.v, coalesce(1 + greatest(0,
  CAST(ceil((o.n - 180) / 150.0) AS INT)), 0) AS oc, 1 + greatest(0,
  CAST(ceil((i.n - 180) / 150.0) AS INT)) AS nc
  FROM i
  LEFT JOIN o ON i.doc_id = o.doc_id AND o.n > 0
  WHERE i.n > 0),
plan AS (SELECT article_id,
  CASE WHEN oh IS NULL THEN 'insert' WHEN oh = nh AND nc <= oc THEN 'skip_unchanged' ELSE 'upsert_changed' END AS action, oc, nc,
  CAST(coalesce(v, 1) + CASE WHEN oh <> nh THEN 1 ELSE 0 END AS INT) AS next_version
  FROM j)"""


@query(f"""WITH {PLAN} SELECT article_id, action,
  CAST(CASE WHEN action = 'skip_unchanged' THEN 0 ELSE nc END AS INT) AS n_upsert,
  CAST(greatest(0, oc - nc) AS INT) AS n_delete, next_version
  FROM plan""")
def reingest_plan(spark, sf):
    """What re-ingesting every document does."""
    return _plan(spark, sf).select(
        "article_id", "action", F.size("chunks_to_upsert").alias("n_upsert"), F.size("chunks_to_delete").alias("n_delete"),
        "next_version",
    )


@query(f"""WITH {PLAN} SELECT action,
  count(*) AS documents,
  CAST(sum(CASE WHEN action = 'skip_unchanged' THEN 0 ELSE nc END) AS BIGINT) AS chunks_to_upsert,
  max(next_version) AS newest_version
  FROM plan
  GROUP BY action""")
def reingest_preview(spark, sf):
    """the plan by action."""
    return _plan(spark, sf).groupBy("action").agg(
        F.count("*").alias("documents"), F.sum(F.size("chunks_to_upsert")).alias("chunks_to_upsert"),
        F.max("next_version").alias("newest_version"),
    )


@query(f"""WITH {PLAN} SELECT o.doc_id AS article_id,
  count(*) AS chunks,
  CAST(sum(CASE WHEN action = 'upsert_changed' OR NOT live THEN 0 ELSE 1 END) AS BIGINT) AS active
  FROM (SELECT doc_id, live, unnest(range(1 + greatest(0,
  CAST(ceil((n - 180) / 150.0) AS INT)))) AS c
  FROM o
  WHERE n > 0) o
  LEFT JOIN plan ON article_id = doc_id
  GROUP BY o.doc_id""")
def tombstoned_chunks(spark, sf):
    """Chunks of changed documents become inactive."""
    return I.tombstone(_chunks(spark, sf), _plan(spark, sf), F.lit(AS_OF)).groupBy("article_id").agg(
        F.count("*").alias("chunks"), F.sum(F.col("is_active").cast("long")).alias("active"),
    )


def _manifest(spark, sf):
    i = F.col("p_partkey")
    pick = lambda n, bad, good: F.when(i % n == 0, bad).otherwise(good)
    v = {"source_id": i.cast("string"), "source_title": F.col("p_name"), "source_type": pick(9, F.lit("docx"), F.lit("csv")), "source_authority": F.lit("approved"), "is_approved": pick(6, F.lit("maybe"), F.lit("true")), "is_active": pick(4, F.lit("no"), F.lit("yes")), "is_customer_facing_allowed": F.lit("1"),
         "approved_at": pick(8, F.lit("not-a-date"), F.lit("2024-01-01")), "reviewed_by": pick(10, F.lit(""), F.lit("lead")), "needs_review_at": F.lit("2024-06-01"), "doc_type": pick(12, F.lit("memo"), F.lit("faq")), "product_area": F.col("p_brand"), "issue_class": F.col("p_type"), "version_scope": F.lit("all"), "escalation_risk": pick(14, F.lit("extreme"), F.lit("low")), "body": pick(15, F.lit(" "), F.col("p_name"))}
    return table(spark, sf, "part").select(i.alias("row_number"), *[c.alias(k) for k, c in v.items()])


MANIFEST = """e AS (SELECT p_partkey AS row_number, unnest(list_filter([CASE WHEN p_partkey % 10 = 0 THEN {'field': 'reviewed_by', 'message': 'Required field is missing'} END,
  CASE WHEN p_partkey % 15 = 0 THEN {'field': 'body', 'message': 'Required field is missing'} END,
  CASE WHEN p_partkey % 9 = 0 THEN {'field': 'source_type', 'message': 'Invalid value: docx'} END,
 CASE WHEN p_partkey % 12 = 0 THEN {'field': 'doc_type', 'message': 'Invalid value: memo'} END, CASE WHEN p_partkey % 14 = 0 THEN {'field': 'escalation_risk', 'message': 'Invalid value: extreme'} END, CASE WHEN p_partkey % 6 = 0 THEN {'field': 'is_approved', 'message': 'Boolean must be explicit true/false'} END,
 CASE WHEN p_partkey % 8 = 0 THEN {'field': 'approved_at', 'message': 'Invalid datetime'} END,
  CASE WHEN p_partkey % 6 <> 0 AND p_partkey % 10 = 0 THEN {'field': 'approved_at/reviewed_by', 'message': 'Approved sources require approved_at and reviewed_by'} END], lambda x: x IS NOT NULL)) AS err
  FROM part)"""


@query(f"WITH {MANIFEST} SELECT row_number, err.field AS field, err.message AS message FROM e")
def manifest_errors(spark, sf):
    """Every defect of every manifest row."""
    return I.manifest_errors(_manifest(spark, sf)).select("row_number", F.explode("errors").alias("e")).select("row_number", "e.field", "e.message")


@query(f"""WITH {MANIFEST}, b AS (SELECT DISTINCT row_number FROM e)
SELECT CASE WHEN p_partkey % 9 = 0 THEN 'docx' ELSE 'csv' END AS format,
  count(*) FILTER (WHERE b.row_number IS NULL) AS loaded,
  count(*) FILTER (WHERE b.row_number IS NOT NULL OR p_partkey % 4 = 0) AS rejected,
  count(*) FILTER (WHERE b.row_number IS NULL AND p_partkey % 4 <> 0) AS chunked
  FROM part
  LEFT JOIN b ON p_partkey = b.row_number
  GROUP BY 1""")
def validation_report(spark, sf):
    """Loaded, rejected and chunked rows by format; inactive sources load but give no chunks."""
    m = I.manifest_errors(_manifest(spark, sf)).withColumn("ok", F.size("errors") == 0).withColumn(
        "live", F.col("ok") & T.strict_bool(F.col("is_active")),
    )
    return m.groupBy(F.col("source_type").alias("format")).agg(
        F.count_if("ok").alias("loaded"), F.count_if(~F.col("ok") | ~T.strict_bool(F.col("is_active"))).alias("rejected"),
        F.count_if("live").alias("chunked"),
    )


@query(f"""WITH w AS (SELECT source, len({words_sql('text')}) AS n FROM documents)
SELECT source,
  count(*) AS rows_seen,
  count(*) FILTER (WHERE n >= 5) AS rows_loaded,
  count(*) FILTER (WHERE n < 5) AS rows_skipped,
  CAST(coalesce(sum(CASE WHEN n >= 5 THEN 1 + greatest(0,
  CAST(ceil((n - 180) / 150.0) AS INT)) END), 0) AS BIGINT) AS chunks
  FROM w
  GROUP BY source""")
def import_summary(spark, sf):
    """Rows seen, loaded and skipped for having fewer than five words, and chunks, by source."""
    d = table(spark, sf, "documents").withColumn("n", T.word_count(F.col("text")))
    chunks = F.when(F.col("n") >= 5, 1 + F.greatest(F.lit(0), F.ceil((F.col("n") - 180) / 150))).cast("long")
    return d.groupBy("source").agg(
        F.count("*").alias("rows_seen"), F.count_if(F.col("n") >= 5).alias("rows_loaded"),
        F.count_if(F.col("n") < 5).alias("rows_skipped"), F.coalesce(F.sum(chunks), F.lit(0)).cast("long").alias("chunks"),
    )


@query("""WITH v(variant, lang) AS (VALUES ('all', 'en'), ('all', 'de'), ('all', 'fr'), ('all', 'es'), ('english', 'en'), ('strict', 'en'), ('strict', 'de'))
SELECT variant, lang,
  count(*) AS rows_seen,
  count(*) FILTER (WHERE variant <> 'strict' OR quality = 1) AS loaded,
  count(*) FILTER (WHERE variant = 'strict' AND quality IS DISTINCT
  FROM 1) AS rejected
  FROM documents JOIN v USING (lang)
  LEFT JOIN labels USING (doc_id)
  GROUP BY ALL""")
def variant_inventory(spark, sf):
    """What each loading variant would load; the variant table is tiny and broadcast."""
    v = spark.createDataFrame(
        [("all", x) for x in ("en", "de", "fr", "es")] + [("english", "en"), ("strict", "en"), ("strict", "de")],
        "variant string, lang string",
    )
    d = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id", "left").join(F.broadcast(v), "lang")
    bad = (F.col("variant") == "strict") & ~F.coalesce(F.col("quality") == 1, F.lit(False))
    return d.groupBy("variant", "lang").agg(F.count("*").alias("rows_seen"), F.count_if(~bad).alias("loaded"), F.count_if(bad).alias("rejected"))


@query(f"""WITH t AS (SELECT conv_id, turn, text, {collapse_sql(redact_sql("trim(coalesce(text, ''))"))} AS c FROM conversations WHERE role = 'user')
SELECT conv_id, turn, sha256(trim(coalesce(text, ''))) AS raw_text_hash,
  CAST(length(c) AS INT) AS char_count,
  CAST(len({words_sql('c')}) AS INT) AS word_count, coalesce(text, '') <> c AS redaction_applied,
CASE WHEN trim(coalesce(text, '')) = '' THEN 'empty' WHEN len({words_sql('c')}) < 3 THEN 'too short' END AS reject FROM t""")
def cleaned_tickets(spark, sf):
    """User turns as cleaned tickets, rejects marked."""
    t = I.clean_tickets(table(spark, sf, "conversations").where("role = 'user'"), "text")
    return t.select("conv_id", "turn", "raw_text_hash", "char_count", "word_count", "redaction_applied", "reject")


@query()
def hashed_embeddings(spark, sf):
    """Default text vectors, hashed term frequencies of unit length, with the buckets that are not zero (their hash has no
    SQL; a test holds them against plain counts)."""
    e = I.embed(table(spark, sf, "documents").select("doc_id", "text"), "text", 256)
    held = F.filter(
        F.transform("embedding", lambda x, i: F.when(x > 0, F.concat(i.cast("string"), F.lit(":"), F.round(x, 4).cast("string")))),
        lambda x: x.isNotNull(),
    )
    return e.select(
        "doc_id", F.size("embedding").alias("width"),
        F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x), 4).alias("norm"),
        F.array_join(held, " ").alias("buckets"),
    )


USER = "u AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user')"


def _user(spark, sf):
    return table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", "text")


ROUTES = " ".join(f"WHEN regexp_matches(text, {RX(p)}) THEN '{r}'" for r, p in dims.ROUTES)
ROUTE = rf"CASE WHEN regexp_matches(text, '(?i)\bgolden eval\b') AND regexp_matches(text, '(?i)\b(latency|cost|budget|baseline|retrieval recall)\b') THEN 'general' WHEN len(regexp_extract_all(text, '\w+')) <= 5 AND regexp_matches(text, '(?i)\b(help|broken|issue|problem)\b') THEN 'general' {ROUTES} ELSE 'general' END"


@query(f"WITH {USER} SELECT conv_id, turn, {ROUTE} AS route FROM u")
def ticket_routes(spark, sf):
    """Route of every user turn."""
    return _user(spark, sf).select("conv_id", "turn", P.route(F.col("text")).alias("route"))


def _found(p: str, g: int = 0) -> str:
    return f"list_sort(list_distinct(regexp_extract_all(text, {RX(p)}, {g})))"


@query(f"""WITH {USER} SELECT conv_id, turn,
  array_to_string(list_filter({_found(P.TOKEN)}, lambda x: regexp_matches(x, {RX(P.ENTITY)}))[1:12], ',') AS entities, regexp_extract(text, {RX(P.VERSION)}, 1) AS version, lower(regexp_extract(text, {RX(P.PRIORITY)}, 1)) AS priority, lower(regexp_extract(text, {RX(P.CHANNEL)}, 1)) AS channel,
array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, {RX(P.RISK)}, 1), lambda x: lower(x)))), ',') AS risk_flags FROM u""")
def ticket_plans(spark, sf):
    """Entities, version, priority, channel and risk words."""
    e = P.extract(F.col("text"))
    u = _user(spark, sf).select("conv_id", "turn", e.alias("e"))
    return u.select(
        "conv_id", "turn", F.array_join("e.entities", ",").alias("entities"), "e.version", "e.priority", "e.channel",
        F.array_join("e.risk_flags", ",").alias("risk_flags"),
    )


QS = "list_filter(list_transform(regexp_extract_all(text, '([^.!?' || chr(10) || ']*\\?)', 1), lambda x: trim(x)), lambda x: x <> '')"


@query(f"""WITH {USER}, q AS (SELECT conv_id, turn, CASE WHEN len({QS}) > 0 THEN {QS} ELSE [text] END AS qs FROM u)
SELECT conv_id, turn,
  CAST(i + 1 AS INT) AS question_no, substr(trim(regexp_replace(qs[i + 1], {WS}, ' ', 'g')), 1, 300) AS query
  FROM (SELECT *, unnest(range(least(3, len(qs)))) AS i
  FROM q)""")
def retrieval_plans(spark, sf):
    """Up to three sub-questions of every user turn."""
    u = _user(spark, sf).withColumn("id", F.struct("conv_id", "turn"))
    return P.retrieval_plan(u, "id", "text").select("id.conv_id", "id.turn", "question_no", "query")


FILL = ", ".join(f"'{w}'" for w in dims.FILLER)


@query(f"""WITH {USER}, w AS (SELECT conv_id, turn, {words_sql('lower(text)')} AS ws, 'p' || (conv_id % 5) AS product FROM u),
k AS (SELECT *, list_filter(ws, lambda x: regexp_replace(lower(x), '[.,!?]+$', '') NOT IN ({FILL})) AS kept FROM w),
b AS (SELECT *, regexp_replace(array_to_string((CASE WHEN len(kept) > 0 THEN kept ELSE ws END)[1:12], ' '), '[.!?,]+$', '') AS base FROM k)
SELECT conv_id, turn,
  array_to_string(({words_sql("base || CASE WHEN contains(base, product) THEN '' ELSE ' ' || product END || CASE WHEN contains(base, 'website') THEN '' ELSE ' website' END")})[1:18], ' ') AS search_query
  FROM b""")
def search_queries(spark, sf):
    """C4: search query of every user turn."""
    q = P.search_query(F.lower("text"), F.concat(F.lit("p"), (F.col("conv_id") % 5).cast("string")), F.lit("website"), F.lit(""))
    return _user(spark, sf).select("conv_id", "turn", q.alias("search_query"))


@query(f"""WITH {USER}, b AS (SELECT conv_id AS ticket_id, trim(regexp_replace(text, {WS}, ' ', 'g')) AS query, CAST(turn AS INT) AS no FROM u),
f AS (SELECT ticket_id, query, min(no) AS no FROM b WHERE query <> '' GROUP BY ALL)
SELECT ticket_id, query, CAST(no AS INT) AS no FROM (SELECT ticket_id, query, row_number() OVER (PARTITION BY ticket_id ORDER BY no, query) AS no FROM f) WHERE no <= 4""")
def query_sets(spark, sf):
    """At most four distinct queries of a conversation, the first turn's first."""
    u = _user(spark, sf).select(
        F.col("conv_id").alias("ticket_id"), T.collapse(F.col("text")).alias("query"),
        F.col("turn").cast("int").alias("question_no"),
    )
    return P.query_set(u.where("question_no < 0"), u).select("ticket_id", "query", "no")


@query(f"""WITH {USER}, f AS (SELECT sha256(trim(regexp_replace(lower(text), {WS}, ' ', 'g')) || chr(31) || 'v1') AS fingerprint, conv_id FROM u)
SELECT fingerprint, count(*) AS requests, min(conv_id) AS first_conv FROM f GROUP BY fingerprint""")
def request_fingerprints(spark, sf):
    """Exact repeats of requests."""
    return _user(spark, sf).select(
        P.fingerprint(F.col("text"), F.lit("v1")).alias("fingerprint"), "conv_id",
    ).groupBy("fingerprint").agg(F.count("*").alias("requests"), F.min("conv_id").alias("first_conv"))


@query(f"""WITH {USER}, r AS (SELECT *, {ROUTE} AS route FROM u)
SELECT route,
  CASE WHEN route IN ('billing', 'policy') THEN 'policy_guidance' WHEN route = 'release_change' THEN 'change_summary' WHEN route IN ('bug', 'access', 'integration') THEN 'troubleshooting' WHEN regexp_matches(text, '(?i)\\bhow (?:do|can|to)\\b|\\bsteps?\\b') THEN 'how_to' ELSE 'support_resolution' END AS answer_type,
  count(*) AS n
  FROM r
  GROUP BY ALL""")
def answer_types(spark, sf):
    """Answer types by route."""
    u = _user(spark, sf).withColumn("route", P.route(F.col("text")))
    return u.groupBy("route", P.answer_type(F.col("route"), F.col("text")).alias("answer_type")).agg(F.count("*").alias("n"))


@query(f"""WITH d AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn, {words_sql("coalesce(text, '')")} AS ws FROM documents)
SELECT source, doc_id,
  array_to_string(ws[1:200], ' ') AS chunk_preview,
  CASE WHEN doc_id % 6 = 0 THEN 'attribution text is missing' END AS warning, len(ws) >= 5 AS can_load
  FROM d
  WHERE rn <= 5""")
def source_previews(spark, sf):
    """The first documents of each source with chunk texts, warnings and whether they can load (a preview is a top-k)."""
    from pyspark.sql.window import Window

    d = table(spark, sf, "documents").withColumn("rn", F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))).where("rn <= 5")
    return d.select(
        "source", "doc_id", F.array_join(F.slice(T.words(F.col("text")), 1, 200), " ").alias("chunk_preview"),
        F.when(F.col("doc_id") % 6 == 0, "attribution text is missing").alias("warning"),
        (T.word_count(F.col("text")) >= 5).alias("can_load"),
    )


@query(f"""WITH {CAND} SELECT chunk_id, 'cat' || (chunk_id % 3) || ':' || article_id AS source_id, CASE source_type WHEN 'policy' THEN 'canonical_policy' WHEN 'release_note' THEN 'approved_release_note' WHEN 'known_issue' THEN 'approved_conditional' WHEN 'raw_ticket_history' THEN 'unreviewed' ELSE 'approved_kb' END AS tier,
  CASE WHEN chunk_id % 2 = 0 THEN 'http://x/' || chunk_id ELSE 'f.csv' END AS source_ref, source_type <> 'raw_ticket_history' AS is_approved,
  CASE WHEN source_type = 'raw_ticket_history' THEN 'internal' ELSE 'customer,internal' END AS audience, sha256(content) AS document_hash
  FROM cand""")
def source_metadata(spark, sf):
    """Tier, references, approval and audience of every chunk's source."""
    c, i = candidates(spark, sf), F.col("chunk_id")
    m = I.source_metadata(
        F.concat(F.lit("cat"), (i % 3).cast("string")), F.col("source_type"), F.col("article_id"),
        F.when(i % 2 == 0, F.concat(F.lit("http://x/"), i.cast("string"))).otherwise(""), F.lit("f.csv"), F.col("content"),
        F.lit(AS_OF),
    )
    return c.select("chunk_id", m.alias("m")).select(
        "chunk_id", "m.source_id", "m.tier", "m.source_ref", "m.is_approved",
        F.array_join("m.audience_allowed", ",").alias("audience"), "m.document_hash",
    )
