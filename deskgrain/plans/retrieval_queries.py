"""Registered retrieval queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deskgrain.functions import dims
from deskgrain.functions import text as T
from deskgrain.functions.frames import new_folder
from deskgrain.operators import inverted, lists
from deskgrain.operators import retrieval as R

from .common import AS_OF, WS, book, pick, table

TYPES = ["policy", "faq", "knowledge_base", "release_note", "known_issue", "official_help_article", "raw_ticket_history"]
CHUNK_TYPES = ["concept", "faq", "how_to", "policy", "troubleshooting"]
ROUTE_NAMES = ["billing", "access", "bug", "how_to", "integration", "policy", "release_change", "general"]


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as candidates of questions of twenty documents each, with the safety fields of a chunk table."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    i = F.col("doc_id")
    return d.select(
        F.expr("doc_id div 20").alias("question_id"), i.alias("chunk_id"), F.expr("doc_id div 8").alias("article_id"),
        F.expr("cast(doc_id % 8 as int)").alias("chunk_index"),
        F.col("source").alias("source_id"), pick(TYPES, i % 7).alias("source_type"), pick(CHUNK_TYPES, i % 5).alias("chunk_type"),
        pick(ROUTE_NAMES, F.expr("(doc_id div 20) % 8")).alias("route"),
        F.when(i % 3 != 0, F.concat(F.lit("sec"), F.expr("doc_id div 4"))).otherwise("").alias("parent_section_id"),
        ((F.col("n_chars") % 1000) / 100).alias("score"),
        F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (i % 60).cast("int")), "yyyy-MM-dd").alias("needs_review_at"),
        F.when(i % 11 == 0, "2024-01-05").otherwise("").alias("expires_at"),
        (F.coalesce("quality", F.lit(1)) == 1).alias("is_approved"), (i % 13 != 0).alias("is_customer_facing_allowed"),
        (F.coalesce("toxic", F.lit(0)) == 1).alias("is_internal_only"), (i % 29 == 0).alias("is_future_only"),
        (i % 23 == 0).alias("disabled"), (i % 17 != 0).alias("is_active"), (i % 9 == 0).alias("has_conditions"),
        F.col("text").alias("content"),
    )


def ranked(spark, sf) -> DataFrame:
    return R.top_k(candidates(spark, sf), 20)


def _list(names):
    return "[" + ", ".join(f"'{x}'" for x in names) + "]"


CAND = f"""cand AS (SELECT doc_id // 20 AS question_id, doc_id AS chunk_id, doc_id // 8 AS article_id,
  CAST(doc_id % 8 AS INT) AS chunk_index, source AS source_id, ({_list(TYPES)})[1 + doc_id % 7] AS source_type,
  ({_list(CHUNK_TYPES)})[1 + doc_id % 5] AS chunk_type, ({_list(ROUTE_NAMES)})[1 + (doc_id // 20) % 8] AS route, CASE WHEN doc_id % 3 <> 0 THEN 'sec' || (doc_id // 4) ELSE '' END AS parent_section_id,
  (n_chars % 1000) / 100.0::DOUBLE AS score, strftime(DATE '2024-01-01' + CAST(doc_id % 60 AS INT), '%Y-%m-%d') AS needs_review_at, CASE WHEN doc_id % 11 = 0 THEN '2024-01-05' ELSE '' END AS expires_at,
  coalesce(quality, 1) = 1 AS is_approved, doc_id % 13 <> 0 AS is_customer_facing_allowed, coalesce(toxic, 0) = 1 AS is_internal_only, doc_id % 29 = 0 AS is_future_only, doc_id % 23 = 0 AS disabled, doc_id % 17 <> 0 AS is_active, doc_id % 9 = 0 AS has_conditions, text AS content
  FROM documents LEFT JOIN labels USING (doc_id)),
ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM cand) WHERE rank <= 20)"""
STALE = f"CAST(coalesce(nullif(expires_at, ''), nullif(needs_review_at, '')) AS TIMESTAMP) < TIMESTAMP '{AS_OF}'"
GATE = "source_type IN ('knowledge_base','official_help_article','faq','policy','release_note','known_issue') AND NOT disabled AND is_approved AND is_customer_facing_allowed AND NOT is_internal_only AND NOT is_future_only"
QUERIES, SQL, query = book()
CHUNKS = rf"""w AS (SELECT doc_id, lang, source, list_filter(regexp_split_to_array(text, {WS}), lambda x: x <> '') AS ws FROM documents),
chunks AS (SELECT doc_id AS article_id, lang, source, i AS chunk_index, array_to_string(ws[i * 150 + 1 : i * 150 + 180], ' ') AS content
  FROM (SELECT *, unnest(range(0, 1 + greatest(0, CAST(ceil((len(ws) - 180) / 150.0) AS INT)))) AS i FROM w WHERE len(ws) > 0))"""


@query(f"""WITH {CHUNKS} SELECT article_id,
  CAST(chunk_index AS INT) AS chunk_index,
  CAST(article_id AS VARCHAR) || ':' || chunk_index || ':' || substr(sha256(CAST(article_id AS VARCHAR) || ':' || chunk_index || ':' || content), 1, 12) AS chunk_id,
  CAST(len(string_split(content, ' ')) AS INT) AS n_words
  FROM chunks""")
def word_window_chunks(spark, sf):
    """Overlapping word windows and content-addressed chunk ids."""
    c = R.word_windows(table(spark, sf, "documents"), "doc_id", "text")
    key = F.concat_ws(":", F.col("article_id").cast("string"), "chunk_index", "content")
    return c.select(
        "article_id", "chunk_index",
        F.concat_ws(":", F.col("article_id").cast("string"), "chunk_index", F.substring(T.sha256(key), 1, 12)).alias("chunk_id"),
        T.word_count(F.col("content")).alias("n_words"),
    )


def _bm25_sql(scope: str, questions: str) -> str:
    return rf"""WITH {CHUNKS},
t AS (SELECT {scope} AS scope, article_id || ':' || chunk_index AS chunk_id, unnest(list_filter(regexp_split_to_array(lower(content), {WS}), lambda x: x <> '')) AS term
  FROM chunks),
tf AS (SELECT scope, chunk_id, term, count(*) AS tf FROM t GROUP BY ALL),
dl AS (SELECT scope, chunk_id, sum(tf) AS dl FROM tf GROUP BY ALL),
st AS (SELECT scope, count(*) AS n, avg(dl) AS avgdl FROM dl GROUP BY ALL),
raw AS (SELECT scope, term, ln((n - count(*) + 0.5) / (count(*) + 0.5)) AS raw FROM tf JOIN st USING (scope) GROUP BY scope, term, n),
m AS (SELECT scope, 0.25 * avg(raw) AS low FROM raw GROUP BY ALL),
q AS ({questions}),
qt AS (SELECT scope, question_id, term,
  count(*) AS times
  FROM (SELECT scope, question_id, unnest(list_filter(regexp_split_to_array(lower(question), {WS}), lambda x: x <> '')) AS term
  FROM q)
  GROUP BY ALL),
s AS (SELECT qt.question_id, tf.chunk_id,
  round(sum(qt.times * (CASE WHEN raw < 0 THEN low ELSE raw END) * tf.tf * 2.5 / (tf.tf + 1.5 * (0.25 + 0.75 * dl.dl / st.avgdl))), 6) AS score
  FROM qt JOIN tf USING (scope, term) JOIN raw USING (scope, term) JOIN m USING (scope) JOIN dl USING (scope, chunk_id) JOIN st USING (scope) GROUP BY ALL)
SELECT question_id, chunk_id, score,
  CAST(rank AS INT) AS rank
  FROM (SELECT *,
  row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank
  FROM s)
  WHERE rank <= 3"""


def _chunk_table(spark, sf):
    return R.word_windows(table(spark, sf, "documents"), "doc_id", "text", keep=("lang",)).select(
        "lang", F.concat_ws(":", F.col("article_id").cast("string"), "chunk_index").alias("chunk_id"),
        F.col("content").alias("text"),
    )


@query(_bm25_sql("0", "SELECT 0 AS scope, item_id AS question_id, text AS question FROM benchmark"))
def bm25_topk(spark, sf):
    """BM25 of word-window chunks for every benchmark question."""
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))
    return R.bm25(_chunk_table(spark, sf), q, k=3)


@query(_bm25_sql("0", "SELECT 0 AS scope, item_id AS question_id, text AS question FROM benchmark"))
def indexed_bm25_topk(spark, sf):
    """The same from a stored index, which the chunks in English make and a second batch of all others extends."""
    folder, chunks = new_folder(spark, "bm25-index"), _chunk_table(spark, sf)
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    for part in (english, ~english):
        inverted.add(chunks.where(part), folder)
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))
    return inverted.search(q, folder, k=3)


@query(_bm25_sql("lang", "SELECT lang AS scope, item_id AS question_id, text AS question FROM benchmark, (VALUES ('en')) l(lang)"))
def bm25_scoped_topk(spark, sf):
    """BM25 with statistics of one scope, the chunks of the question's language."""
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"), F.lit("en").alias("lang"))
    return R.bm25(_chunk_table(spark, sf), q, k=3, scope="lang")


DENSE = """e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
n AS (SELECT vec_id, label, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm, v FROM e),
pairs AS (SELECT q.vec_id AS question_id, c.vec_id AS chunk_id, q.label AS ql, c.label AS cl,
  round(list_dot_product(q.v, c.v) / (q.norm * c.norm), 6) AS score
  FROM n q JOIN n c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0),
top AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM pairs)"""


def _dense(spark, sf, k):
    e = table(spark, sf, "embeddings")
    return R.dense_topk(
        e.select(F.col("vec_id").alias("chunk_id"), "embedding"),
        e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("question_id"), "embedding"), k,
    )


@query(f"WITH {DENSE} SELECT question_id, chunk_id, score, CAST(rank AS INT) AS rank FROM top WHERE rank <= 20")
def dense_topk(spark, sf):
    """Exact cosine top-20; every fiftieth vector is a stated question against all vectors."""
    return _dense(spark, sf, 20)


@query(f"""WITH {DENSE}, r AS (SELECT question_id, avg(CASE WHEN rank <= 1 THEN (ql = cl)::INT END) AS p1, avg(CASE WHEN rank <= 5 THEN (ql = cl)::INT END) AS p5, min(CASE WHEN ql = cl AND rank <= 20 THEN rank END) AS first
  FROM top
  GROUP BY question_id)
SELECT count(*) AS n, round(avg(p1), 4) AS precision_at_1, round(avg(p5), 4) AS precision_at_5, round(avg(coalesce(1.0::DOUBLE / first, 0)), 4) AS mrr FROM r""")
def dense_recall_mrr(spark, sf):
    """Precision at 1 and 5 and mean reciprocal rank of the dense ranking, equal labels being relevant."""
    e = table(spark, sf, "embeddings").select("vec_id", "label")
    r = _dense(spark, sf, 20).join(
        e.select(F.col("vec_id").alias("question_id"), F.col("label").alias("ql")), "question_id",
    ).join(e.select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("cl")), "chunk_id")
    hit = (F.col("ql") == F.col("cl")).cast("int")
    per = r.groupBy("question_id").agg(
        F.avg(F.when(F.col("rank") <= 1, hit)).alias("p1"), F.avg(F.when(F.col("rank") <= 5, hit)).alias("p5"),
        F.min(F.when(hit == 1, F.col("rank"))).alias("first"),
    )
    return per.agg(
        F.count("*").alias("n"), F.round(F.avg("p1"), 4).alias("precision_at_1"), F.round(F.avg("p5"), 4).alias("precision_at_5"),
        F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 4).alias("mrr"),
    )


@query()
def ivf_dense_topk(spark, sf):
    """D3: approximate dense top-k over k-means cells (tests measure its recall)."""
    e = table(spark, sf, "embeddings")
    return R.ivf_topk(
        e.select(F.col("vec_id").alias("chunk_id"), "embedding"),
        e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("question_id"), "embedding"), 10, cells=None, probes=None,
    )


@query(f"WITH {DENSE} SELECT question_id, chunk_id, score, CAST(rank AS INT) AS rank FROM top WHERE rank <= 10")
def listed_dense_topk(spark, sf):
    """D3: the same from stored lists, which nine tenths of the vectors make and the last tenth extends; here all cells are probed, so
    that the rows are those of the exact search."""
    folder, e = new_folder(spark, "vector-lists"), table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    tenth = F.coalesce(F.col("chunk_id") % 10 == 3, F.lit(False))
    for part in (~tenth, tenth):
        lists.add(e.where(part), folder)
    q = e.where("chunk_id % 50 = 0").withColumnRenamed("chunk_id", "question_id")
    return lists.search(q, folder, 10, probes=lists.MOST_CELLS, id_type="bigint")


FUSE = f"""WITH {CAND}, a AS (SELECT question_id, chunk_id, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM cand),
b AS (SELECT question_id, chunk_id, row_number() OVER (PARTITION BY question_id ORDER BY length(content) DESC, chunk_id) AS rank FROM cand),
u AS (SELECT question_id, chunk_id, WA / (60 + rank) AS part FROM a WHERE rank <= 10
UNION ALL SELECT question_id, chunk_id, WB / (60 + rank) FROM b WHERE rank <= 10),
s AS (SELECT question_id, chunk_id, round(sum(part), 6) AS score FROM u GROUP BY ALL)
SELECT question_id, chunk_id, score,
  CAST(rank AS INT) AS rank
  FROM (SELECT *,
  row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank
  FROM s)
  WHERE rank <= 10"""


def _two_lists(spark, sf):
    c = candidates(spark, sf)
    return [R.top_k(c, 10), R.top_k(c.withColumn("score", F.length("content").cast("double")), 10)]


@query(FUSE.replace("WA", "1.0::DOUBLE").replace("WB", "1.0::DOUBLE"))
def rank_fusion(spark, sf):
    """Reciprocal rank fusion of two ranked lists."""
    return R.fuse(_two_lists(spark, sf), 10)


@query(FUSE.replace("WA", "0.7::DOUBLE").replace("WB", "0.3::DOUBLE"))
def weighted_rank_fusion(spark, sf):
    """Fusion with unequal weights, as the hybrid arms use it."""
    return R.fuse(_two_lists(spark, sf), 10, [0.7, 0.3])


def _policy_sql() -> str:
    rows = ", ".join(f"('{r}', {_list(p)}, {_list(c)}, {b}::DOUBLE, {_list(x)})" for r, (p, c, b, x) in dims.ROUTE_POLICIES.items())
    auth = ", ".join(f"('{k}', {min(v, 0.0) if k in dims.RAW_TYPES else v}::DOUBLE)" for k, v in dims.SOURCE_AUTHORITY.items())
    return f"""pol(route, preferred, preferred_chunks, boost, refused) AS (VALUES {rows}), auth(source_type, authority) AS (VALUES {auth}),
scored AS (SELECT c.*,
  round(score * greatest(coalesce(authority, 1.0), 0.0) + CASE WHEN list_contains(preferred, c.source_type) THEN boost ELSE 0 END + CASE WHEN list_contains(preferred_chunks, chunk_type) THEN boost ELSE 0 END, 6) AS policy_score
  FROM ranked c JOIN pol USING (route) LEFT JOIN auth ON auth.source_type = c.source_type WHERE NOT list_contains(refused, c.source_type))"""


def _scored(spark, sf):
    return R.policy_score(ranked(spark, sf), dims.route_policies(spark), dims.source_authority(spark))


@query(f"""WITH {CAND}, {_policy_sql()} SELECT question_id, chunk_id, policy_score,
  CAST(row_number() OVER (PARTITION BY question_id ORDER BY policy_score DESC, chunk_id) AS INT) AS rank
  FROM scored""")
def policy_ranking(spark, sf):
    """Policy score by route, source authority and preferred types; refused types dropped."""
    return R.top_k(_scored(spark, sf).drop("rank"), 20, "policy_score").select("question_id", "chunk_id", "policy_score", "rank")


@query(
    f"WITH {CAND} SELECT question_id, count(*) AS candidates, CAST(sum(CASE WHEN {GATE} THEN 1 ELSE 0 END) AS BIGINT) AS allowed FROM cand GROUP BY ALL"
)
def customer_gate(spark, sf):
    """Candidates that may reach a customer."""
    return candidates(spark, sf).groupBy("question_id").agg(F.count("*").alias("candidates"), F.sum(R.customer_gate().cast("long")).alias("allowed"))


@query(f"""WITH {CAND}, p AS (SELECT question_id, chunk_id, lower(content) LIKE '%tion that%' AS pass FROM ranked),
a AS (SELECT *, max(pass::INT) OVER (PARTITION BY question_id) AS any_pass FROM p)
SELECT question_id, chunk_id FROM a WHERE pass OR any_pass = 0""")
def metadata_filter(spark, sf):
    """Keep candidates that mention a term; keep all where none does."""
    return R.metadata_filter(ranked(spark, sf), F.lower("content").contains("tion that")).select("question_id", "chunk_id")


def _merged(spark, sf):
    c = _scored(spark, sf).where(R.customer_gate()).withColumn(
        "stale", T.stale(F.col("expires_at"), F.col("needs_review_at"), F.lit(AS_OF).cast("timestamp")),
    )
    return R.merge_by_source_type(c, 5)


MERGED = f"""{_policy_sql()}, g AS (SELECT *, {STALE} AS stale FROM scored WHERE {GATE}),
t AS (SELECT *, row_number() OVER (PARTITION BY question_id, source_type ORDER BY stale, policy_score DESC, chunk_id) AS rn FROM g),
s AS (SELECT *,
  CASE WHEN rn = 1 THEN CASE WHEN route IN ('policy', 'billing') AND source_type = 'policy' THEN 1 WHEN route = 'access' AND source_type = 'policy' THEN 1 WHEN route = 'access' AND source_type = 'official_help_article' THEN 2
   WHEN route = 'bug' AND source_type = 'known_issue' THEN 1 WHEN route = 'bug' AND source_type = 'release_note' THEN 2 WHEN route = 'release_change' AND source_type = 'release_note' THEN 1 WHEN route = 'release_change' AND source_type = 'known_issue' THEN 2 ELSE 1000 END ELSE 1000 END AS slot
  FROM t
  WHERE rn <= 3),
o AS (SELECT *,
  row_number() OVER (PARTITION BY question_id,
  CASE WHEN parent_section_id = '' THEN 'only ' || chunk_id ELSE parent_section_id END ORDER BY slot, stale, policy_score DESC, chunk_id) AS nth
  FROM s),
merged AS (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY question_id ORDER BY slot, stale, policy_score DESC, chunk_id) AS rank FROM o WHERE nth = 1 OR slot < 1000)"""


@query(f"WITH {CAND}, {MERGED} SELECT question_id, chunk_id, source_type, CAST(rank AS INT) AS rank FROM merged WHERE rank <= 5")
def source_type_merge(spark, sf):
    """Gate, freshness, slots of route-critical types, three of a type, one of a section."""
    return _merged(spark, sf).select("question_id", "chunk_id", "source_type", "rank")


@query(f"""WITH {CAND}, {MERGED}, p AS (SELECT * FROM merged WHERE rank <= 5),
w AS (SELECT question_id, chunk_id AS expanded_from, article_id, policy_score, unnest(range(chunk_index - CASE WHEN has_conditions THEN 2 ELSE 1 END, chunk_index + CASE WHEN has_conditions THEN 3 ELSE 2 END)) AS chunk_index
  FROM p),
f AS (SELECT w.question_id, c.chunk_id, w.expanded_from, w.policy_score
  FROM w JOIN cand c USING (article_id, chunk_index)
  WHERE c.is_active AND NOT c.disabled AND c.chunk_id <> w.expanded_from AND NOT EXISTS (SELECT 1
  FROM p
  WHERE p.question_id = w.question_id AND p.chunk_id = c.chunk_id))
SELECT question_id, chunk_id, expanded_from, policy_score
  FROM (SELECT *,
  row_number() OVER (PARTITION BY question_id, chunk_id ORDER BY policy_score DESC, expanded_from) AS n
  FROM f)
  WHERE n = 1""")
def neighbour_expansion(spark, sf):
    """Neighbours within the article, as an equi-join on listed places."""
    return R.expand_neighbours(_merged(spark, sf), candidates(spark, sf))


@query(rf"""WITH {CAND}, {MERGED}, p AS (SELECT * FROM merged WHERE rank <= 5),
sec AS (SELECT 'sec' || (doc_id // 4) AS parent_section_id, string_agg(text, ' ' ORDER BY doc_id) AS section_text FROM documents GROUP BY 1),
j AS (SELECT p.*, section_text, len(list_filter(regexp_split_to_array(content, {WS}), lambda x: x <> '')) AS base, list_filter(regexp_split_to_array(section_text, {WS}), lambda x: x <> '') AS ws
  FROM p
  LEFT JOIN sec USING (parent_section_id))
SELECT question_id, chunk_id, section_text IS NOT NULL AND len(ws) > 2 * base AS capped,
  CAST(CASE WHEN section_text IS NULL THEN base ELSE least(len(ws), 2 * base) END AS INT) AS n_words
  FROM j""")
def parent_expansion(spark, sf):
    """The parent section's text, cut to twice the chunk's words."""
    sections = table(
        spark, sf, "documents",
    ).groupBy(F.concat(F.lit("sec"), F.expr("doc_id div 4")).alias("section_id")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "text"))), lambda x: x["text"]), " ").alias("section_text")
    )
    return R.expand_parents(_merged(spark, sf), sections).select(
        "question_id", "chunk_id", "capped", T.word_count(F.col("expanded")).alias("n_words"),
    )


@query(f"""WITH {CAND} SELECT question_id,
  max(score) AS top_score,
  round(max(score) - coalesce(max(CASE WHEN rank = 2 THEN score END), 0), 6) AS score_gap,
  CAST(count(*) AS INT) AS n, string_agg(CAST(chunk_id AS VARCHAR), ',' ORDER BY rank) AS chunk_ids
  FROM ranked
  WHERE rank <= 5
  GROUP BY question_id""")
def retrieval_signals(spark, sf):
    """Top score, gap and ids in rank order."""
    return R.signals(R.top_k(candidates(spark, sf), 5))


@query(f"""WITH {CAND}, t AS (SELECT *,
  max(score) OVER (PARTITION BY question_id) AS top,
  max(CASE WHEN rank = 2 THEN score END) OVER (PARTITION BY question_id) AS second
  FROM ranked
  WHERE rank <= 7)
SELECT question_id, chunk_id, CAST(rank AS INT) AS rank FROM t WHERE NOT (top >= 7 AND top - coalesce(second, 0) >= 3) OR rank <= 3""")
def dominant_trim(spark, sf):
    """Three candidates where one dominates."""
    return R.trim_dominant(R.top_k(candidates(spark, sf), 7)).select("question_id", "chunk_id", "rank")


@query(f"WITH {CAND} SELECT question_id, chunk_id FROM ranked WHERE score >= 7.0 OR source_id = 'src3'")
def threshold_with_pins(spark, sf):
    """A similarity threshold, with pinned sources added back."""
    c = ranked(spark, sf)
    pins = c.where("source_id = 'src3'").select("question_id", "source_id").distinct()
    return R.threshold_and_pins(c, pins, 7.0).select("question_id", "chunk_id")


@query(f"""WITH {CAND}, o AS (SELECT *, CASE WHEN chunk_id % 4 = 0 THEN chunk_id % 3 ELSE 0 END AS overlap FROM ranked),
pr(route, types) AS (VALUES {", ".join(f"('{r}', {_list(t)})" for r, t in dims.DIRECT_PRIORITY.items())}),
p AS (SELECT o.*,
  CASE WHEN overlap > 0 AND list_position(types, source_type) > 0 THEN list_position(types, source_type) - 1 ELSE len(coalesce(types, [])) END AS place,
  max(overlap) OVER (PARTITION BY question_id) > 0 AS any_overlap
  FROM o
  LEFT JOIN pr USING (route)),
n AS (SELECT *, row_number() OVER (PARTITION BY question_id, source_id ORDER BY place, overlap DESC, score DESC, chunk_id) AS nth FROM p WHERE overlap > 0 OR NOT any_overlap)
SELECT question_id, chunk_id,
  CAST(rank AS INT) AS rank
  FROM (SELECT question_id, chunk_id,
  row_number() OVER (PARTITION BY question_id ORDER BY place, overlap DESC, score DESC, chunk_id) AS rank
  FROM n
  WHERE nth = 1)
  WHERE rank <= 3""")
def direct_evidence(spark, sf):
    """Up to three direct candidates, one for each source."""
    c = ranked(spark, sf).withColumn("overlap", F.when(F.col("chunk_id") % 4 == 0, F.col("chunk_id") % 3).otherwise(0)).drop("rank")
    return R.direct_evidence(c).select("question_id", "chunk_id", "rank")


@query(f"""WITH {CAND}, x AS (SELECT question_id, chunk_id, CASE WHEN chunk_id % 2 = 0 THEN source_type END AS source_type FROM ranked)
SELECT x.question_id, x.chunk_id, coalesce(x.source_type, c.source_type) AS source_type FROM x LEFT JOIN cand c USING (chunk_id)""")
def rehydrated_candidates(spark, sf):
    """Missing safety fields filled from the chunk table."""
    c = candidates(spark, sf)
    half = R.top_k(c, 20).select("question_id", "chunk_id", F.when(F.col("chunk_id") % 2 == 0, F.col("source_type")).alias("source_type"))
    return R.rehydrate(half, c, ["source_type"])


@query(f"""WITH {CAND}, k(route, k) AS (VALUES {", ".join(f"('{r}', {k})" for r, k in dims.ROUTE_RERANK_K.items())}),
s AS (SELECT question_id, chunk_id, k,
  round(score * CASE source_type WHEN 'raw_ticket_history' THEN 0 WHEN 'release_note' THEN 0.9 WHEN 'known_issue' THEN 0.85 ELSE 1 END, 6) AS rerank_score
  FROM ranked
  LEFT JOIN k USING (route))
SELECT question_id, chunk_id, rerank_score,
  CAST(rank AS INT) AS rank
  FROM (SELECT *,
  row_number() OVER (PARTITION BY question_id ORDER BY rerank_score DESC, chunk_id) AS rank
  FROM s)
  WHERE rank <= coalesce(k, 5)""")
def route_rerank(spark, sf):
    """Rerank by authority, with the route's own number of results."""
    k = F.coalesce(
        F.try_element_at(F.create_map(*[F.lit(x) for kv in dims.ROUTE_RERANK_K.items() for x in kv]), F.col("route")),
        F.lit(dims.DEFAULT_RERANK_K),
    )
    c = ranked(spark, sf).join(
        F.broadcast(dims.source_authority(spark)), "source_type", "left",
    ).withColumn("policy_boost", F.lit(None).cast("double"))
    return R.rerank(c, k, score=F.col("score")).select("question_id", "chunk_id", "rerank_score", "rank")


def shared_words(questions, contents):
    """A model of questions and contents: the share of a question's words that the content holds."""
    asked = [set(q.split()) for q in questions]
    return [len(a & set(c.split())) / max(len(a), 1) for a, c in zip(asked, contents)]


@query(f"""WITH {CAND}, b AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(text, {WS}), lambda x: x <> '')) AS ws FROM benchmark),
au(source_type, authority) AS (VALUES {', '.join(f"('{k}', {min(v, 0.0) if k in dims.RAW_TYPES else v}::DOUBLE)" for k, v in dims.SOURCE_AUTHORITY.items())}),
s AS (SELECT question_id, chunk_id,
  round(len(list_intersect(ws, list_distinct(list_filter(regexp_split_to_array(content, {WS}), lambda x: x <> ''))))::DOUBLE / greatest(len(ws), 1) * greatest(coalesce(authority, 1), 0) + CASE WHEN chunk_id % 4 = 0 THEN 0.1 ELSE 0 END, 6) AS rerank_score
  FROM ranked JOIN b ON b.item_id = question_id % (SELECT count(*)
  FROM benchmark)
  LEFT JOIN au USING (source_type)
  WHERE rank <= 15)
SELECT question_id, chunk_id, rerank_score,
  CAST(rank AS INT) AS rank
  FROM (SELECT *,
  row_number() OVER (PARTITION BY question_id ORDER BY rerank_score DESC, chunk_id) AS rank
  FROM s)
  WHERE rank <= 5""")
def model_rerank(spark, sf):
    """Rerank by a user's model, the first fifteen candidates only, with boosts."""
    asked = table(spark, sf, "benchmark")
    c = ranked(spark, sf).withColumn("item_id", F.col("question_id") % asked.count()).join(
        asked.select("item_id", F.col("text").alias("question")), "item_id",
    )
    c = c.join(F.broadcast(dims.source_authority(spark)), "source_type", "left").withColumn("policy_boost", F.when(F.col("chunk_id") % 4 == 0, 0.1))
    return R.rerank(c, F.lit(5), score_fn=shared_words, cap=15).select("question_id", "chunk_id", "rerank_score", "rank")


ARM_NAMES = [*R.ARM_WEIGHTS, R.GATED_ARM, "unheard_of", ""]
ARM_ROWS = ", ".join(f"('{a}', {x}::DOUBLE, {y}::DOUBLE)" for a, (x, y) in R.ARM_WEIGHTS.items())
ALLOWED = [*R.ARM_WEIGHTS, R.GATED_ARM]


@query(f"""WITH {CAND}, w(arm, wa, wb) AS (VALUES {ARM_ROWS}), q AS (SELECT DISTINCT question_id, ({_list(ARM_NAMES)})[1 + question_id % {len(ARM_NAMES)}] AS asked FROM cand),
m AS (SELECT question_id, wa, wb FROM q JOIN w ON w.arm = CASE WHEN asked IN ({", ".join(repr(x) for x in ALLOWED)}) THEN asked ELSE '{R.DEFAULT_ARM}' END),
a AS (SELECT question_id, chunk_id, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM cand),
b AS (SELECT question_id, chunk_id, row_number() OVER (PARTITION BY question_id ORDER BY length(content) DESC, chunk_id) AS rank FROM cand),
u AS (SELECT question_id, chunk_id, wa / (60 + rank) AS part FROM a JOIN m USING (question_id) WHERE rank <= 10 AND wa > 0
UNION ALL SELECT question_id, chunk_id, wb / (60 + rank) FROM b JOIN m USING (question_id) WHERE rank <= 10 AND wb > 0),
s AS (SELECT question_id, chunk_id, round(sum(part), 6) AS score FROM u GROUP BY ALL)
SELECT question_id, chunk_id, score,
  CAST(rank AS INT) AS rank
  FROM (SELECT *,
  row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank
  FROM s)
  WHERE rank <= 10""")
def arm_rankings(spark, sf):
    """Each question's arm by an allow-list; arms of one list or of two weighted ones; a disabled arm yields nothing."""
    q = candidates(spark, sf).select("question_id").distinct()
    arms = R.select_arms(q.withColumn("requested_arm", pick(ARM_NAMES, F.col("question_id") % len(ARM_NAMES))), ALLOWED)
    return R.fuse_by_arm(*_two_lists(spark, sf), arms, 10)


@query(f"""WITH {CAND} SELECT arm,
  count(*) AS n,
  round(avg(score), 4) AS avg_score
  FROM (SELECT *, unnest(CASE WHEN rank <= 5 THEN ['top5', 'top20'] ELSE ['top20'] END) AS arm
  FROM ranked)
  GROUP BY arm""")
def retrieval_arms(spark, sf):
    """Enabled arms only; a disabled arm yields nothing."""
    arms = spark.createDataFrame([("top5", 5, True), ("top20", 20, True), ("graph", 20, False)], "arm string, k int, enabled boolean")
    c = ranked(spark, sf).join(F.broadcast(arms.where("enabled")), F.col("rank") <= F.col("k"))
    return c.groupBy("arm").agg(F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("avg_score"))
