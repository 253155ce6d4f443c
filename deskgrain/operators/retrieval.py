"""Retrieval over whole tables: questions joined to chunks, ranked, fused, filtered, merged and expanded.

Ranked candidates are long tables (question_id, chunk_id, rank, ...); a list is never built before the end. Every
ranking ends with the chunk id, so that ties have one order.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from deskgrain.functions import dims
from deskgrain.functions import text as T
from deskgrain.functions.frames import small, written


def word_windows(docs: DataFrame, id_col: str, text_col: str, size: int = 180, overlap: int = 30, keep: tuple[str, ...] = ()) -> DataFrame:
    """Overlapping windows of ``size`` words (article_id, chunk_index, content); the first that reaches the end is the last."""
    step = max(1, size - max(0, overlap))
    w = docs.select(F.col(id_col).alias("article_id"), *keep, T.words(F.col(text_col)).alias("_w")).where(F.size("_w") > 0)
    last = F.greatest(F.ceil((F.size("_w") - size) / step), F.lit(0)).cast("int")
    parts = F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.struct(i.alias("chunk_index"), F.array_join(F.slice(F.col("_w"), i * step + 1, F.lit(size)), " ").alias("content")),
    )
    return w.select("article_id", *keep, F.explode(parts).alias("c")).select("article_id", *keep, "c.chunk_index", "c.content")


def tokens(c: Column) -> Column:
    return T.words(F.lower(c))


def bm25(
    chunks: DataFrame, questions: DataFrame, k: int = 20, k1: float = 1.5, b: float = 0.75, floor: float = 0.25,
    scope: str | None = None,
) -> DataFrame:
    """(question_id, chunk_id, rank, score): Okapi BM25 of ``chunks`` (chunk_id, text) for ``questions`` (question_id, question).

    Statistics are those of the scope (a column of both tables) or of all chunks. A negative idf counts as ``floor`` times
    the mean idf. Only chunks that hold a term are ranked. One pass over the chunks counts in how many each term is (before
    anything moves); a second keeps the terms that are asked, and deals their occurrences into blocks of chunks. A block of
    chunks meets a block of questions, which adds up scores in arrays and hands on the best k of each question: terms are
    never joined across tables, so a word that all chunks hold costs no more than its occurrences.
    """
    s = F.col(scope) if scope else F.lit(0)
    held = chunks.select(s.alias("scope"), "chunk_id", tokens(F.col("text")).alias("w")).withColumn("dl", F.size("w"))
    # the null term counts the chunks themselves
    counted = held.select("scope", "dl", F.explode(F.concat(F.array_distinct("w"), F.array(F.lit(None).cast("string")))).alias("term"))
    df = written(counted.groupBy("scope", "term").agg(F.count("*").alias("df"), F.sum("dl").alias("words")), "bm25-terms")
    stats = small(df.where("term IS NULL").select("scope", F.col("df").alias("n"), (F.col("words") / F.col("df")).alias("avgdl")))
    idf = df.where("term IS NOT NULL").join(stats, "scope").withColumn("raw", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    mean = small(idf.groupBy("scope").agg((F.lit(floor) * F.avg("raw")).alias("low")))
    asked = questions.select(
        s.alias("scope"), "question_id", F.explode(tokens(F.col("question"))).alias("term"),
    ).groupBy("scope", "question_id", "term").agg(F.count("*").alias("times"))
    many = small(questions.groupBy(s.alias("scope")).agg(F.ceil(F.count("*") / QUESTION_BLOCK).cast("int").alias("n_q")))
    weight = idf.join(asked.select("scope", "term").distinct(), ["scope", "term"], "left_semi").join(mean, "scope").join(many, "scope")
    weight = weight.select(
        "scope", "term", "avgdl", F.ceil(F.col("n") / CHUNK_BLOCK).cast("int").alias("n_c"), "n_q",
        F.when(F.col("raw") < 0, F.col("low")).otherwise(F.col("raw")).alias("idf"),
    )
    weight = small(written(weight.withColumn("tid", F.monotonically_increasing_id()), "bm25-weights"))
    norm = k1 * (1 - b + b * F.col("dl") / F.col("avgdl"))
    hits = held.select("scope", "chunk_id", "dl", F.explode("w").alias("term")).join(weight, ["scope", "term"])
    hits = hits.select(
        "scope", "n_c", "n_q", F.pmod(F.xxhash64("chunk_id"), "n_c").cast("int").alias("c"),
        F.struct(F.col("chunk_id").alias("id"), "tid", norm.alias("x")).alias("h"),
    )
    ask = asked.join(weight, ["scope", "term"])
    ask = ask.select(
        "scope", "n_c", "n_q", F.pmod(F.xxhash64("question_id"), "n_q").cast("int").alias("q"),
        F.struct(F.col("question_id").alias("id"), "tid", (F.col("idf") * F.col("times")).alias("x")).alias("h"),
    )
    # both sides in blocks, each once for every block of the other side
    of_chunks = hits.groupBy("scope", "c", "n_q").agg(F.collect_list("h").alias("chunks")).withColumn(
        "q", F.explode(F.sequence(F.lit(0), F.col("n_q") - 1)),
    ).drop("n_q")
    of_questions = ask.groupBy("scope", "q", "n_c").agg(F.collect_list("h").alias("questions")).withColumn(
        "c", F.explode(F.sequence(F.lit(0), F.col("n_c") - 1)),
    ).drop("n_c")
    met = of_chunks.join(of_questions, ["scope", "c", "q"])
    kinds = dict(questions.dtypes)["question_id"], dict(chunks.dtypes)["chunk_id"]

    def fields(side) -> tuple:
        ids = pa.array(side.field("id")).dictionary_encode()
        return ids.dictionary.to_numpy(zero_copy_only=False), ids.indices.to_numpy(), side.field("tid").to_numpy(), side.field("x").to_numpy()

    def run(batches):
        for batch in batches:
            for one, other in zip(batch.column(0), batch.column(1)):
                ids, chunk, tid, norm = fields(one.values)
                qids, question, qtid, weight = fields(other.values)
                terms, tid = np.unique(tid, return_inverse=True)
                size = np.zeros(len(ids))
                size[chunk] = norm
                pair, tf = np.unique(tid * len(ids) + chunk, return_counts=True)
                place = pair % len(ids)
                part = tf * (k1 + 1) / (tf + size[place])
                start = np.searchsorted(pair // len(ids), np.arange(len(terms) + 1))
                at = np.searchsorted(terms, qtid)
                known = (at < len(terms)) & (terms[np.minimum(at, len(terms) - 1)] == qtid)
                found = []
                for i in range(len(qids)):
                    score, seen = np.zeros(len(ids)), np.zeros(len(ids), bool)
                    for j in np.flatnonzero((question == i) & known):
                        rows = slice(start[at[j]], start[at[j] + 1])
                        score[place[rows]] += weight[j] * part[rows]
                        seen[place[rows]] = True
                    score, rows = np.round(score, 6), np.flatnonzero(seen)
                    if len(rows) > k:
                        rows = rows[score[rows] >= np.partition(score[rows], -k)[-k]]
                    rows = rows[np.lexsort((ids[rows], -score[rows]))[:k]]
                    found.append((np.full(len(rows), qids[i]), ids[rows], score[rows]))
                a, b_, c = (np.concatenate(x) for x in zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b_), pa.array(c)], names=["question_id", "chunk_id", "score"])

    return top_k(met.select("chunks", "questions").mapInArrow(run, f"question_id {kinds[0]}, chunk_id {kinds[1]}, score double"), k)


def top_k(scored: DataFrame, k: int, score: str = "score") -> DataFrame:
    w = Window.partitionBy("question_id").orderBy(F.desc(score), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def normalised(df: DataFrame, vec: str) -> DataFrame:
    d = F.transform(F.col(vec), lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(d, F.lit(0.0), lambda a, x: a + x * x))
    return df.withColumn(vec, F.when(norm > 0, F.transform(d, lambda x: x / norm)).otherwise(d))


#: Questions and chunks of a block that dense search compares at once.
QUESTION_BLOCK, CHUNK_BLOCK = 1_024, 8_192


def usable(v: Column) -> Column:
    """Whether a vector can be compared: not null nor empty, all components finite."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(v) > 0) & ~bad, F.lit(False))


def _meet(chunks: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """The best k by cosine of ``chunks`` (cell, chunk_id, embedding) for ``questions`` (cell, question_id, embedding) of the same
    cell and length. Blocks of bounded size are paired by an equal key, a pair is one matrix product, and only the best k of
    a pair go on. A question does not find its own id."""
    key = ["cell", "width"]
    sides = [df.where(usable(F.col("embedding"))).withColumn("width", F.size("embedding")) for df in (chunks, questions)]
    sizes = [df.groupBy(*key).agg(F.ceil(F.count("*") / size).cast("int").alias(n)) for df, size, n in ((sides[0], CHUNK_BLOCK, "n_c"), (sides[1], QUESTION_BLOCK, "n_q"))]
    both = small(written(sizes[0].join(sizes[1], key), "block-sizes"))

    def blocks(df: DataFrame, id_col: str, own: str, other: str, is_question: bool) -> DataFrame:
        item = F.struct(F.col(id_col).alias("id"), F.col("embedding").alias("v"))
        rows = df.join(both, key).select(*key, other, F.pmod(F.xxhash64(id_col), own).cast("int").alias("block"), item.alias("x"))
        packed = rows.groupBy(*key, other, "block").agg(F.collect_list("x").alias("items"))
        met = packed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        q, c = ("block", "other") if is_question else ("other", "block")
        return met.select(*key, F.col(q).alias("q"), F.col(c).alias("c"), F.lit(is_question).alias("is_question"), "items")

    dealt = blocks(sides[1], "question_id", "n_q", "n_c", True).unionByName(blocks(sides[0], "chunk_id", "n_c", "n_q", False))
    met = dealt.groupBy(*key, "q", "c").agg(F.array_sort(F.collect_list(F.struct("is_question", "items"))).alias("t"))
    kinds = dict(questions.dtypes)["question_id"], dict(chunks.dtypes)["chunk_id"]

    def unit(items) -> tuple[np.ndarray, np.ndarray]:
        v = items.field("v")
        x = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(v), -1)
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        return items.field("id").to_numpy(zero_copy_only=False), x / np.where(norm > 0, norm, 1)

    def run(batches):
        for batch in batches:
            for pair in batch.column(0):
                if len(pair) < 2:
                    continue
                (ids, c), (qids, q) = (unit(side["items"].values) for side in pair)
                found = []
                for i in range(0, len(q), 64):
                    scores = np.round(q[i : i + 64] @ c.T, 6)
                    for qid, row in zip(qids[i : i + 64], scores):
                        row = np.where(ids == qid, -np.inf, row)
                        least = np.partition(row, -k)[-k] if len(row) > k else -np.inf
                        at = np.flatnonzero((row >= least) & (row > -np.inf))
                        at = at[np.lexsort((ids[at], -row[at]))[:k]]
                        found.append((np.full(len(at), qid), ids[at], row[at]))
                a, b, s = (np.concatenate(x) for x in zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(s)], names=["question_id", "chunk_id", "score"])

    return top_k(met.select("t").mapInArrow(run, f"question_id {kinds[0]}, chunk_id {kinds[1]}, score double"), k)


def dense_topk(chunks: DataFrame, questions: DataFrame, k: int = 20) -> DataFrame:
    """(question_id, chunk_id, rank, score): exact cosine top-k of ``chunks`` (chunk_id, embedding) for ``questions`` (question_id, embedding).

    All questions meet all chunks of vectors of the same length, block by block. Vectors that are null, empty or hold null or
    non-finite components take no part; a zero vector has score 0; a question does not find its own id.
    """
    c, q = (df.select(F.lit(0).alias("cell"), i, "embedding") for df, i in ((chunks, "chunk_id"), (questions, "question_id")))
    return _meet(c, q, k)


def fuse(lists: list[DataFrame], k: int, weights: list[float] | None = None, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (question_id, chunk_id, rank), each weighted (1 by default)."""
    weights = weights or [1.0] * len(lists)
    parts = [x.select("question_id", "chunk_id", (F.lit(w) / (constant + F.col("rank"))).alias("part")) for x, w in zip(lists, weights)]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return top_k(both.groupBy("question_id", "chunk_id").agg(F.round(F.sum("part"), 6).alias("score")), k)


def customer_gate() -> Column:
    """Whether a candidate may be shown to a customer at all."""
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    return F.coalesce(F.col("source_id") != "", F.lit(False)) & F.coalesce(
        F.col("source_type").isin(*dims.ALLOWED_TYPES), F.lit(False),
    ) & no("disabled") & yes("is_approved") & yes("is_customer_facing_allowed") & no("is_internal_only") & no("is_future_only")


def policy_score(cands: DataFrame, policies: DataFrame, authority: DataFrame, default_authority: float = 1.0) -> DataFrame:
    """Score of each candidate under its question's route: base x authority x type weight, plus boosts; refused types go."""
    p, a = F.broadcast(policies), F.broadcast(authority)
    joined = cands.join(p, "route", "left").join(a, "source_type", "left")
    boost = F.when(F.array_contains("preferred", F.col("source_type")), F.col("boost")).otherwise(0.0) + F.when(
        F.array_contains("preferred_chunks", F.col("chunk_type")), F.col("boost"),
    ).otherwise(0.0)
    weight = F.greatest(F.coalesce("authority", F.lit(default_authority)), F.lit(0.0))
    kept = joined.where(~F.coalesce(F.array_contains("refused", F.col("source_type")), F.lit(False)))
    return kept.withColumn(
        "policy_score", F.round(F.col("score") * weight + F.coalesce(boost, F.lit(0.0)), 6),
    ).drop("preferred", "preferred_chunks", "boost", "refused", "authority")


def metadata_filter(cands: DataFrame, keep: Column) -> DataFrame:
    """Candidates that pass; all of a question's candidates if none of them would."""
    any_ = F.max(F.col("_pass").cast("int")).over(Window.partitionBy("question_id"))
    return cands.withColumn("_pass", F.coalesce(keep, F.lit(False))).withColumn("_any", any_).where("_pass or _any = 0").drop("_pass", "_any")


def merge_by_source_type(cands: DataFrame, k: int, per_type: int = 3) -> DataFrame:
    """At most k candidates a question, at most ``per_type`` of a source type: the best of the route's critical types first,
    then by freshness and score, one for each parent section. Needs route, source_type, stale, policy_score and
    parent_section_id (null or blank: none)."""
    order = [F.col("stale").cast("int"), F.desc("policy_score"), F.col("chunk_id")]
    slots = F.create_map(*[x for r, types in dims.ROUTE_SLOTS.items() for x in (F.lit(r), F.array(*[F.lit(t) for t in types]))])
    slot = F.coalesce(F.array_position(F.try_element_at(slots, F.col("route")), F.col("source_type")), F.lit(0))
    best = cands.withColumn(
        "rn", F.row_number().over(Window.partitionBy("question_id", "source_type").orderBy(*order)),
    ).where(F.col("rn") <= per_type)
    best = best.withColumn("slot", F.when(F.col("rn") == 1, slot).otherwise(0)).withColumn("section", T.blank_to_null(F.col("parent_section_id")))
    # a section counts as taken by a reserved candidate first, else by the best of the others
    w = Window.partitionBy(
        "question_id", F.coalesce("section", F.concat(F.lit("only "), F.col("chunk_id").cast("string"))),
    ).orderBy(F.when(F.col("slot") > 0, F.col("slot")).otherwise(1_000), *order)
    one = best.withColumn("nth", F.row_number().over(w)).where("nth = 1 or slot > 0")
    last = Window.partitionBy("question_id").orderBy(F.when(F.col("slot") > 0, F.col("slot")).otherwise(1_000), *order)
    return one.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).drop("rn", "slot", "section", "nth")


def expand_neighbours(picked: DataFrame, chunks: DataFrame, span: int = 1, wide: int = 2) -> DataFrame:
    """Neighbours of each picked chunk (question_id, article_id, chunk_index, policy_score, has_conditions): one on either
    side, two if it has conditions. A range join made equal by listing the wanted places."""
    reach = F.when(F.col("has_conditions"), wide).otherwise(span)
    wanted = picked.withColumn("r", reach).select(
        "question_id", F.col("chunk_id").alias("expanded_from"), "article_id", "policy_score",
        F.explode(F.sequence(F.col("chunk_index") - F.col("r"), F.col("chunk_index") + F.col("r"))).alias("chunk_index"),
    )
    found = chunks.where("is_active and not disabled").select(
        "article_id", "chunk_index", "chunk_id",
    ).join(wanted, ["article_id", "chunk_index"]).where(F.col("chunk_id") != F.col("expanded_from"))
    new = found.join(picked.select("question_id", "chunk_id"), ["question_id", "chunk_id"], "left_anti")
    w = Window.partitionBy("question_id", "chunk_id").orderBy(F.desc("policy_score"), "expanded_from")
    return new.withColumn("n", F.row_number().over(w)).where("n = 1").select("question_id", "chunk_id", "expanded_from", "policy_score")


def expand_parents(picked: DataFrame, sections: DataFrame, ratio: float = 2.0) -> DataFrame:
    """Content of each picked chunk replaced by its section's text, cut to ``ratio`` times the chunk's words."""
    j = picked.join(sections.select(F.col("section_id").alias("parent_section_id"), "section_text"), "parent_section_id", "left")
    base, sec = T.word_count(F.col("content")), T.words(F.col("section_text"))
    cap = F.when(base > 0, F.greatest(base, F.floor(base * ratio).cast("int"))).otherwise(F.size(sec))
    text = F.when(F.col("section_text").isNull(), F.col("content")).when(
        F.size(sec) > cap, F.array_join(F.slice(sec, F.lit(1), cap), " "),
    ).otherwise(F.col("section_text"))
    return j.withColumn("expanded", text).withColumn("capped", F.coalesce(F.size(sec) > cap, F.lit(False)) & F.col("section_text").isNotNull())


def dedupe(cands: DataFrame, order: list[Column]) -> DataFrame:
    """First row of each (question, chunk)."""
    return cands.withColumn("_n", F.row_number().over(Window.partitionBy("question_id", "chunk_id").orderBy(*order))).where("_n = 1").drop("_n")


def trim_dominant(cands: DataFrame, high: float = dims.HIGH_SCORE, gap: float = dims.MIN_GAP, keep: int = 3) -> DataFrame:
    """Three candidates only where the best scores high and leads by a gap."""
    w = Window.partitionBy("question_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    top, second = F.first("score").over(w), F.nth_value("score", 2).over(w)
    trimmed = (top >= high) & (top - F.coalesce(second, F.lit(0.0)) >= gap)
    return cands.withColumn("_t", trimmed).where(~F.col("_t") | (F.col("rank") <= keep)).drop("_t")


def threshold_and_pins(cands: DataFrame, pins: DataFrame, least: float | None) -> DataFrame:
    """Candidates of at least ``least``, and those of pinned sources (question_id, source_id) whatever their score."""
    if least is None:
        return cands
    kept = cands.where(F.col("score") >= least)
    pinned = cands.join(pins.select("question_id", "source_id").distinct(), ["question_id", "source_id"], "left_semi")
    return kept.unionByName(pinned.join(kept.select("question_id", "chunk_id"), ["question_id", "chunk_id"], "left_anti").select(*kept.columns))


def direct_evidence(cands: DataFrame, most: int = 3) -> DataFrame:
    """Up to three candidates a question, one for each source: by overlap of labels with the question's terms, source type
    priority of the route, and score; the first by rank where the question has no candidates with overlap. Needs overlap
    (a count), route, source_type, source_id, score."""
    priority = F.create_map(*[x for r, types in dims.DIRECT_PRIORITY.items() for x in (F.lit(r), F.array(*[F.lit(t) for t in types]))])
    types = F.coalesce(F.try_element_at(priority, F.col("route")), F.array().cast("array<string>"))
    place = F.array_position(types, F.col("source_type"))
    placed = F.when((F.col("overlap") > 0) & (place > 0), place - 1).otherwise(F.size(types).cast("long"))
    any_ = F.max("overlap").over(Window.partitionBy("question_id")) > 0
    rows = cands.withColumn("place", placed).withColumn("any", any_).where("overlap > 0 or not any")
    order = ["place", F.desc("overlap"), F.desc("score"), "chunk_id"]
    one = rows.withColumn("n", F.row_number().over(Window.partitionBy("question_id", "source_id").orderBy(*order))).where("n = 1")
    return one.withColumn(
        "rank", F.row_number().over(Window.partitionBy("question_id").orderBy(*order)),
    ).where(F.col("rank") <= most).drop("place", "any", "n")


def signals(cands: DataFrame) -> DataFrame:
    """Per question: top score, gap to the second, number of candidates, ids in rank order."""
    return cands.groupBy("question_id").agg(F.max("score").alias("top_score"), F.array_sort(F.collect_list(F.struct(F.col("rank"), F.col("score"), F.col("chunk_id")))).alias("r")).select(
        "question_id", "top_score",
        F.round(F.get(F.col("r"), F.lit(0))["score"] - F.coalesce(F.get(F.col("r"), F.lit(1))["score"], F.lit(0.0)), 6).alias("score_gap"),
        F.size("r").alias("n"), F.array_join(F.transform("r", lambda x: x["chunk_id"].cast("string")), ",").alias("chunk_ids"),
    )


def rehydrate(cands: DataFrame, chunks: DataFrame, fields: list[str], id_col: str = "chunk_id") -> DataFrame:
    """Fields missing from candidates, filled from the chunk table."""
    c = chunks.select(F.col(id_col).alias("_id"), *[F.col(f).alias(f"_{f}") for f in fields])
    j = cands.join(c, cands[id_col] == c["_id"], "left")
    return j.select(*[F.coalesce(cands[x], F.col(f"_{x}")).alias(x) if x in fields else cands[x] for x in cands.columns])


#: Questions searched exactly to choose how many cells are probed.
SAMPLE_QUESTIONS = 200


def ivf_topk(
    chunks: DataFrame, questions: DataFrame, k: int = 20, cells: int | None = 16, probes: int | None = 4, fit_on: int = 20_000,
    seed: int = 7, recall: float = 0.95,
) -> DataFrame:
    """Approximate dense top-k: chunks dealt to k-means cells, questions to their nearest cells, compared within cells by blocks.

    Without ``cells`` their number follows that of the chunks; without ``probes`` a sample of the questions is searched exactly
    and as many cells are probed as hold the share ``recall`` of its neighbours. Vectors must have one length; without usable
    chunks the result is empty.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    ok = usable(F.col("embedding"))
    c = normalised(chunks.where(ok).select("chunk_id", "embedding"), "embedding").withColumn("f", array_to_vector("embedding"))
    if c.isEmpty():  # nothing to fit cells on: the exact search gives the empty result
        return dense_topk(chunks, questions, k)
    cells = cells or max(8, round(chunks.count() ** 0.5 / 4))
    sample = c.orderBy(F.xxhash64("chunk_id")).limit(fit_on)
    model = KMeans(k=cells, seed=seed, maxIter=10, featuresCol="f", predictionCol="cell").fit(sample)
    placed = model.transform(c).select("cell", "chunk_id", "embedding")
    centres = F.array(
        *[F.struct(F.lit(i).alias("cell"), F.array(*[F.lit(float(x)) for x in v]).alias("v")) for i, v in enumerate(model.clusterCenters())]
    )
    q = normalised(questions.where(ok).select("question_id", "embedding"), "embedding")
    far = lambda v: F.aggregate(F.zip_with(v, F.col("embedding"), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x)
    order = F.transform(F.array_sort(F.transform(centres, lambda s: F.struct(far(s["v"]).alias("d"), s["cell"].alias("cell")))), lambda s: s["cell"])
    if probes is None:
        tried = questions.where(ok).orderBy(F.xxhash64("question_id")).limit(SAMPLE_QUESTIONS)
        near = q.join(F.broadcast(tried.select("question_id")), "question_id", "left_semi").select("question_id", order.alias("cells"))
        places = dense_topk(chunks, tried, k).join(placed.select("chunk_id", "cell"), "chunk_id").join(F.broadcast(near), "question_id")
        probes = ceil(places.agg(F.percentile(F.array_position("cells", F.col("cell")), F.lit(recall))).first()[0] or cells)
    probed = q.select(F.explode(F.slice(order, 1, probes)).alias("cell"), "question_id", "embedding")
    return _meet(placed, probed, k)


def rerank(cands: DataFrame, k: Column, score: Column | None = None, score_fn=None, cap: int = 100) -> DataFrame:
    """The best ``k`` (a column) of each question's first ``cap`` candidates by score x authority (not below 0) + boost.

    ``cands``: question_id, chunk_id, rank, question, content, authority and policy_boost (both may be null). The score is a
    column, or comes from a user's model: ``score_fn`` takes arrays of questions and contents, batch by batch, and returns
    an array of floats.
    """
    if score_fn is not None:
        from pyspark.ml.functions import predict_batch_udf
        from pyspark.sql.types import DoubleType

        model = predict_batch_udf(lambda: lambda q, c: np.asarray(score_fn(q, c), np.float64), return_type=DoubleType(), batch_size=32)
        score = model(F.coalesce("question", F.lit("")), F.coalesce("content", F.lit("")))
    first = cands.where(F.col("rank") <= cap).withColumn("_s", score)
    total = F.col("_s") * F.greatest(F.coalesce("authority", F.lit(1.0)), F.lit(0.0)) + F.coalesce("policy_boost", F.lit(0.0))
    out = first.withColumn("rerank_score", F.round(total, 6)).withColumn("_k", k).drop("_s", "rank")
    w = Window.partitionBy("question_id").orderBy(F.desc("rerank_score"), "chunk_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= F.col("_k")).drop("_k")


# Weights of the BM25 and the dense list in each retrieval arm.
ARM_WEIGHTS = {
    "current_hybrid_rag": (1.0, 1.0), "bm25_heavy": (0.7, 0.3), "dense_heavy": (0.3, 0.7), "bm25_only": (1.0, 0.0),
    "dense_only": (0.0, 1.0),
}
DEFAULT_ARM, GATED_ARM = "current_hybrid_rag", "graphrag_layer"


def select_arms(requests: DataFrame, allowed: list[str] | None = None, default: str = DEFAULT_ARM, gated: bool = False) -> DataFrame:
    """``requests`` (question_id, requested_arm) with active_arm and enabled: the arm that was asked for if the allow-list has
    it (without a list all are allowed), else the default; the gated arm is disabled unless ``gated``, and yields nothing."""
    asked = T.blank_to_null(F.col("requested_arm"))
    active = F.when(asked.isNotNull() & (asked.isin(*allowed) if allowed else F.lit(True)), asked).otherwise(default)
    off = (F.col("active_arm") == GATED_ARM) & F.lit(not gated)
    return requests.withColumn("active_arm", active).withColumn("enabled", ~off).withColumn(
        "active_arm", F.when(F.col("enabled"), F.col("active_arm")).otherwise("disabled"),
    )


def fuse_by_arm(sparse: DataFrame, dense: DataFrame, arms: DataFrame, k: int, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion with the weights of each question's active arm; an arm of one list leaves the other out. ``arms``
    comes from ``select_arms``; disabled questions have no candidates."""
    kept = arms.where("enabled").select("question_id", "active_arm")
    parts = []
    for i, ranked in enumerate((sparse, dense)):
        weights = F.create_map(*[x for a, w in ARM_WEIGHTS.items() for x in (F.lit(a), F.lit(w[i]))])
        weight = F.coalesce(F.try_element_at(weights, F.col("active_arm")), F.lit(ARM_WEIGHTS[DEFAULT_ARM][i]))
        parts.append(
            ranked.join(kept, "question_id").where(weight > 0).select("question_id", "chunk_id", (weight / (constant + F.col("rank"))).alias("part"))
        )
    return top_k(parts[0].unionByName(parts[1]).groupBy("question_id", "chunk_id").agg(F.round(F.sum("part"), 6).alias("score")), k)
