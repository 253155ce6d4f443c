"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import ann, bpe, embedding_dedup, fill_middle, langid, mixing, prefix_bpe, quality, resample, simhash, suffix, url_filter, warc
from .common import table

URL_RULES = [
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def op1_simhash_near_dedup(spark, sf_dir):
    return simhash.components(table(spark, sf_dir, "documents"), words=4, radius=4)


def op2_byte_bpe(spark, sf_dir):
    import public_tokenizers

    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_suffix_array_dedup(spark, sf_dir):
    return suffix.dedup_report(table(spark, sf_dir, "documents"), length=200)


def op4_nearest_neighbours(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where(F.col("vec_id") % 100 == 0), k=10)


def op8_embedding_near_dedup(spark, sf_dir):
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op7_arc_to_warc(spark, sf_dir):
    return warc.archived(table(spark, sf_dir, "pages"))


def op10_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs.select("doc_id", "text"), langid.fit(docs))
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op5_quality(spark, sf_dir):
    return quality.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"))


def op6_source_mixing(spark, sf_dir):
    return mixing.mix_report(table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, cap=2.0)


def op9_url_filter(spark, sf_dir):
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), url_filter.rules_frame(spark, URL_RULES))


def op11_fill_middle(spark, sf_dir):
    """Digests of each document's fill-in-the-middle output, and of the text restored from output and form."""
    made = fill_middle.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = fill_middle.restored(F.col("output"), F.col("form"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(back, 256).alias("restored_sha256"),
    )


def op12_importance_resampling(spark, sf_dir):
    """Weights, scores and ranks of a quarter of the documents drawn towards the benchmark."""
    found = resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=25, seed=7)
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op13_prefix_bpe(spark, sf_dir):
    """Tokens of every document by the last token of each prefix, and what decoding gives."""
    import public_tokenizers

    return prefix_bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


QUERIES = {
    f.__name__: f for f in (
        op1_simhash_near_dedup, op2_byte_bpe, op3_suffix_array_dedup, op4_nearest_neighbours, op5_quality, op6_source_mixing,
        op7_arc_to_warc, op8_embedding_near_dedup, op9_url_filter, op10_language_id, op11_fill_middle, op12_importance_resampling,
        op13_prefix_bpe,
    )
}


def _bucket(c: str, n: int) -> str:
    return f"CAST('0x' || substr(md5({c}), 1, 4) AS INT) % {n}"


def _strength(up: str) -> str:
    """The strength of a level from its sums of squares, as ``quality.strength`` has it."""
    low, high = quality.STRENGTH
    return f"""SELECT CASE WHEN coalesce(r1, 0) = 0 OR coalesce(r3, 0) = 0 THEN {high} WHEN rho <= 0 THEN {high} ELSE least(greatest((1 - rho) / rho, {low}), {high}) END::DOUBLE AS k
  FROM (SELECT *, (r0 / r1 - r2 / r3) / greatest(r0 / r1 + (r4 / r1 - 1) * (r2 / r3), 1e-12) AS rho FROM (
    SELECT sum(gg - good * good / n)::DOUBLE AS r0, sum(sites - 1)::DOUBLE AS r1, sum(good - gg)::DOUBLE AS r2, sum(n - sites)::DOUBLE AS r3, sum(n - nn / n)::DOUBLE AS r4
  FROM ({up})
  WHERE sites > 1))"""


def _measures_sql() -> str:
    """The features of ``quality.measures`` over t (text), ws (distinct words) and many (words)."""
    share = lambda p: f"(length(t) - length(regexp_replace(t, '{p}', '', 'g')))::DOUBLE / greatest(length(t), 1)"
    bins = [
        f"floor({x} * {quality.BINS})" for x in (
            share(r"\p{L}+"), "4 * " + share(r"[^\p{L}\p{N}\x20\x09-\x0D]+"), "4 * " + share(r"\p{Lu}+"),
            "len(ws)::DOUBLE / greatest(many, 1)",
        )
    ]
    bins.append("length(bin(many + 1))")
    return "[" + ", ".join(f"CAST(least({b}, {quality.BINS - 1}) AS INT) + {quality.HASHED + i * quality.BINS}" for i, b in enumerate(bins)) + "]"


_SITES = "count(*) AS sites, sum(n)::DOUBLE AS n, sum(good)::DOUBLE AS good, sum(n * n)::DOUBLE AS nn, sum(good * good / n::DOUBLE) AS gg"
_W, _E, _C = quality.WORDS, quality.ENDS, quality.CHARS
ORACLES = {
    "op5_quality": rf"""
WITH t AS (SELECT doc_id, max(quality) > 0 AS y FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY 1),
d AS (SELECT doc_id, source AS host, lang AS path, CAST(y AS INT) AS y, list_distinct(list_filter(regexp_split_to_array(coalesce(text, ''), '[ 	-
]+'), lambda x: x <> '')) AS ws, coalesce(text, '') AS t, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS many
  FROM documents
  LEFT JOIN t USING (doc_id)),
w AS (SELECT doc_id, y, unnest(ws) AS w FROM d),
f AS (SELECT DISTINCT doc_id, y, unnest([{_bucket("w", _W)}, {_W} + {_bucket(f"'^' || substr(w, 1, {_C})", _E)}, {_W + _E} + {_bucket(f"'$' || right(w, {_C})", _E)}]) AS f FROM w),
b AS (SELECT doc_id, y, unnest({_measures_sql()}) AS f FROM d),
n AS (SELECT coalesce(sum(y), 0)::DOUBLE AS g, coalesce(sum(1 - y), 0)::DOUBLE AS b FROM d WHERE y IS NOT NULL),
a AS (SELECT doc_id, y, f, TRUE AS hashed FROM f UNION ALL SELECT doc_id, y, f, FALSE FROM b),
c AS (SELECT f, sum(y)::DOUBLE AS g, sum(1 - y)::DOUBLE AS b FROM a WHERE y IS NOT NULL GROUP BY f),
r AS (SELECT a.doc_id, hashed, avg(ln(coalesce(c.g, 0) - coalesce(y, 0) + 1) - ln(n.g - coalesce(y, 0) + 2) - ln(coalesce(c.b, 0) - coalesce(1 - y, 0) + 1) + ln(n.b - coalesce(1 - y, 0) + 2)) AS x
  FROM a
  LEFT JOIN c USING (f), n
  GROUP BY ALL),
x AS (SELECT d.*, coalesce(i.x, 0) AS x, coalesce(j.x, 0) AS z
  FROM d
  LEFT JOIN (SELECT *
  FROM r
  WHERE hashed) i USING (doc_id)
  LEFT JOIN (SELECT *
  FROM r
  WHERE NOT hashed) j USING (doc_id)),
m AS (SELECT y, count(*)::DOUBLE AS n, avg(x) AS mx, avg(z) AS mz, var_pop(x) AS xx, var_pop(z) AS zz, covar_pop(x, z) AS xz FROM x WHERE y IS NOT NULL GROUP BY y),
v AS (SELECT count(*) AS classes, sum(n * xx) / sum(n) + {quality.RIDGE} AS xx, sum(n * zz) / sum(n) + {quality.RIDGE} AS zz, sum(n * xz) / sum(n) AS xz, sum(CASE WHEN y = 1 THEN mx ELSE -mx END) AS dx, sum(CASE WHEN y = 1 THEN mz ELSE -mz END) AS dz, sum(mx) AS sx, sum(mz) AS sz
  FROM m),
l AS (SELECT CASE WHEN classes = 2 THEN (zz * dx - xz * dz) / (xx * zz - xz * xz) ELSE 0 END AS wa,
  CASE WHEN classes = 2 THEN (xx * dz - xz * dx) / (xx * zz - xz * xz) ELSE 0 END AS wb, coalesce(sx, 0) AS sx, coalesce(sz, 0) AS sz
  FROM v),
p AS (SELECT host, path, count(*) AS n, sum(y) AS good FROM d WHERE y IS NOT NULL GROUP BY ALL), h AS (SELECT host, sum(n) AS n, sum(good) AS good FROM p GROUP BY ALL),
kh AS ({_strength(f"SELECT {_SITES} FROM h")}), kp AS ({_strength(f"SELECT host, {_SITES} FROM p GROUP BY host")}),
o AS (SELECT x.*, (n.g + 1 - coalesce(y, 0)) / (n.g + n.b + 2 - (y IS NOT NULL)::INT) AS overall FROM x, n),
s AS (SELECT o.*, (coalesce(h.good - coalesce(y, 0), 0) + kh.k * overall) / (coalesce(h.n - (y IS NOT NULL)::INT, 0) + kh.k) AS hs
  FROM o
  LEFT JOIN h ON o.host IS NOT DISTINCT
  FROM h.host, kh),
q AS (SELECT s.*, (coalesce(p.good - coalesce(y, 0), 0) + kp.k * hs) / (coalesce(p.n - (y IS NOT NULL)::INT, 0) + kp.k) AS ps,
  CASE WHEN x = 0 AND z = 0 THEN 0 ELSE greatest(least(wa * x + wb * z - (wa * sx + wb * sz) / 2, {quality.MOST_EVIDENCE}), -{quality.MOST_EVIDENCE}) END AS e
  FROM s
  LEFT JOIN p ON s.host IS NOT DISTINCT
  FROM p.host AND s.path IS NOT DISTINCT
  FROM p.path, kp, l),
z AS (SELECT doc_id,
  round(e::DOUBLE, 6) AS evidence,
  round(hs::DOUBLE, 6) AS host_share,
  round(ps::DOUBLE, 6) AS path_share,
  round((1 / (1 + exp(-(e + ln(ps / (1 - ps))))))::DOUBLE, 6) AS score
  FROM q)
SELECT *, score >= 0.5 AS kept FROM z""",
    "op7_arc_to_warc": """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS kept FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN kept = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN kept <> page_id THEN kept END AS refers_to FROM g""",
    "op6_source_mixing": r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents),
s AS (SELECT source,
  CAST(sum(size) AS BIGINT) AS source_size, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][CAST(1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS INT)] AS w
  FROM d
  GROUP BY source),
c AS (SELECT *, 2.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
        / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
a AS (SELECT arg_min(level, cap / w) FILTER (WHERE NOT level * w >= cap) AS lam FROM l),
t AS (SELECT source, source_size, CASE WHEN level * w >= cap THEN cap ELSE (SELECT lam FROM a) * w END AS target FROM l),
b AS (SELECT *, CAST(CASE WHEN source_size > 0 THEN least(floor(target / source_size), 2) ELSE 0 END AS BIGINT) AS base FROM t),
r AS (SELECT d.doc_id, d.size, b.source_size, b.target, b.base,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h) AS upto, sum(d.size) OVER (PARTITION BY d.source, d.h) AS own, b.target - b.base * b.source_size AS budget
      FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source),
n AS (SELECT *, least(2, base + CASE WHEN upto <= budget OR upto - own <= budget AND upto - budget < budget - (upto - own) THEN 1 ELSE 0 END) AS times FROM r)
SELECT doc_id, size, source_size, target, CAST(size * times AS BIGINT) AS taken, CAST(times AS INT) AS times FROM n""",
    "op9_url_filter": r"""
WITH rules(said, host, path) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
p AS (SELECT page_id, url, row_number() OVER () AS n,
             translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
f AS (SELECT p.n, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.said, length(r.host || r.path)) AS said
      FROM p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY p.n)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.said, 'allow') AS verdict FROM p LEFT JOIN f ON p.n = f.n""",
    "op11_fill_middle": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
  list_transform([0, 1, 2, 3], lambda i: CAST('0x' || substr(h, 8 * i + 1, 8) AS BIGINT)) AS r FROM d),
c AS (SELECT *, CAST(len(u) AS BIGINT) AS n, least(r[1] % (len(u) + 1), r[2] % (len(u) + 1)) AS a, greatest(r[1] % (len(u) + 1), r[2] % (len(u) + 1)) AS b,
  CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR r[3] % 100 >= 50 THEN 'plain' WHEN r[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p""",
    "op12_importance_resampling": r"""
WITH RECURSIVE step(i, k, c) AS (
  SELECT CAST(range AS BIGINT), 0, CAST(range AS BIGINT) FROM range(256)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM step WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM step WHERE k = 8),
x AS (SELECT row_number() OVER () AS n, doc_id, text, TRUE AS ours FROM documents UNION ALL SELECT row_number() OVER () AS n, NULL, text, FALSE FROM benchmark),
w AS (SELECT n, doc_id, ours, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM x),
f AS (SELECT n, ours, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM w),
h AS (SELECT f, hex(f) AS h FROM (SELECT DISTINCT f FROM f)),
b AS (SELECT f, xor(list_reduce(list_transform(range(1, len(h), 2), lambda i: CAST('0x' || substr(h, i, 2) AS BIGINT)), lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1]), 4294967295), 4294967295) % 10000 AS b FROM h, crc),
c AS (SELECT n, ours, b FROM f JOIN b USING (f)),
s AS (SELECT b, count(*) FILTER (WHERE ours) AS s, count(*) FILTER (WHERE NOT ours) AS t FROM c GROUP BY b),
g AS (SELECT b, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS g FROM s),
m AS (SELECT n, count(*) AS n_features, floor(sum(g)::DOUBLE / count(*))::BIGINT AS weight FROM c JOIN g USING (b) WHERE ours GROUP BY n),
r AS (SELECT doc_id, len(w) >= 20 AS able, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM w LEFT JOIN m USING (n) WHERE ours),
k AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS k, 25 * count(*) FILTER (WHERE able) OVER () // 100 AS most FROM r)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND k <= most THEN k END AS rank FROM k""",
}
