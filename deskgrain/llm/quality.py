"""Quality classifier: evidence from the text, combined with what is known of its host and path by empirical Bayes.

The evidence comes from two naive Bayes classifiers, one over hashed words and the first and last characters of words, one over
binned measures of the text: of each the log ratios of its features' frequencies in good and in bad documents, averaged over
the distinct features of a text. Both averages together are calibrated by their means and their spread within the labelled
documents of either class (a linear discriminant). The classifiers are fitted on a bounded sample of labelled documents, the
sites on all. The prior comes from the document's site: the share of good documents of a path is shrunk toward that of its
host, and that of a host toward the share overall, the more the fewer labels there are; how strongly is estimated from the
spread between sites (a beta-binomial fitted by moments), level by level. A labelled document's own label is left out of all
sums that judge it, so that its score is that of a document that was not labelled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Memory, release_memory, sampled, small, written

#: Buckets of words, of their first and of their last characters, and how many characters these are.
WORDS, ENDS, CHARS = 16_384, 2_048, 3
HASHED = WORDS + 2 * ENDS
#: Measures of a text and bins of each; their features come after the hashed ones.
MEASURES, BINS = ("letters", "signs", "capitals", "distinct", "words"), 24
FEATURES = HASHED + len(MEASURES) * BINS
SPACE = r"[\x20\x09-\x0D]"
#: Labelled documents that the classifiers are fitted on at most (those of the smallest id hashes).
FIT_DOCS = 20_000
#: Bounds of the strength of the shrinking, in labels; bound of the evidence; digits of what is returned.
STRENGTH, MOST_EVIDENCE, DIGITS = (1.0, 10_000.0), 20.0, 6
#: What is added to the variances, so that the discriminant is defined.
RIDGE = 1e-6


def _bucket(text: str, n: int) -> int:
    return int(hashlib.md5(text.encode("utf-8", "surrogatepass")).hexdigest()[:4], 16) % n


def word_features(word: bytes) -> tuple[int, int, int]:
    """Buckets of a word, its first characters and its last ones."""
    w = word.decode("utf-8", "surrogatepass")
    return _bucket(w, WORDS), WORDS + _bucket("^" + w[:CHARS], ENDS), WORDS + ENDS + _bucket("$" + w[-CHARS:], ENDS)


def measures(text: Column) -> Column:
    """The feature of each measure of a text, in the order of MEASURES; a null text is empty."""
    t = F.coalesce(text, F.lit(""))
    n = F.length(t)

    def share(pattern: str) -> Column:
        return (n - F.length(F.regexp_replace(t, pattern, ""))) / F.greatest(n, F.lit(1))

    words = F.filter(F.split(t, SPACE + "+"), lambda w: w != "")
    many, distinct = F.size(words), F.size(F.array_distinct(words))
    shares = [share(r"\p{L}+"), 4 * share(r"[^\p{L}\p{N}\x20\x09-\x0D]+"), 4 * share(r"\p{Lu}+"), distinct / F.greatest(many, F.lit(1))]
    bins = [F.floor(x * BINS) for x in shares] + [F.length(F.bin((many + 1).cast("long")))]
    return F.array(*[(F.least(b, F.lit(BINS - 1)) + HASHED + i * BINS).cast("smallint") for i, b in enumerate(bins)])


def _hashed(texts: pa.Array, memory: Memory) -> list[np.ndarray]:
    """The sorted distinct features of each text's words (runs without ASCII white space)."""
    known, find, found = memory.known, memory.find, []
    for t in texts:
        words = set((t.as_py() or "").encode("utf-8", "surrogatepass").split())
        found.append(np.unique(np.array([known(w) or find(w) for w in words], np.int16).reshape(-1)))
    return found


def features(rows: DataFrame) -> DataFrame:
    """``rows`` (good, g, text) as (good, f): the features of every text, hashed ones and measures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Memory(word_features)
        for b in batches:
            made = [np.concatenate((f, np.asarray(g.values))) for f, g in zip(_hashed(b.column(2), memory), b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.list_(pa.int16()))], names=["good", "f"])
        release_memory()

    return rows.select("good", "g", "text").mapInArrow(run, "good long, f array<smallint>")


def tables(known: DataFrame) -> tuple[np.ndarray, int, int]:
    """(good and bad documents that hold each feature, good documents, bad documents) of all rows of ``known`` (good, f)."""
    # feature -1 counts the documents themselves
    each = known.select("good", F.explode(F.concat("f", F.array(F.lit(-1).cast("smallint")))).alias("f"))
    sums = each.groupBy("f").agg(F.sum("good").alias("good"), F.count("*").alias("n")).collect()  # FEATURES rows at most, and one
    counts = np.zeros((2, FEATURES + 1))
    for r in sums:
        counts[:, r["f"]] = r["good"], r["n"] - r["good"]
    return counts[:, :-1], int(counts[0, -1]), int(counts[1, -1])


def mean_ratios(rows: DataFrame, counts: np.ndarray, good: int, bad: int) -> DataFrame:
    """``rows`` (good: the label if it was fitted on, else null; g, text and others) without g and text, with x and z: the mean
    log ratios of the hashed features and of the measures, a fitted document's own label left out."""

    def ratio(y: int | None) -> np.ndarray:
        held, missed = counts[0] - (y == 1), counts[1] - (y == 0)
        here, there = np.log(np.maximum(held, 0) + 1), np.log(np.maximum(missed, 0) + 1)
        return here - np.log(good - (y == 1) + 2) - there + np.log(bad - (y == 0) + 2)

    by_label = {y: ratio(y) for y in ((None, 1, 0) if good + bad else (None,))}
    others = [f for f in rows.schema if f.name not in ("g", "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Memory(word_features)
        for b in batches:
            labels = b.column("good").to_pylist()
            x = [float(by_label[y][f].mean()) if len(f) else 0.0 for f, y in zip(_hashed(b.column("text"), memory), labels)]
            z = [float(by_label[y][np.asarray(g.values)].mean()) for g, y in zip(b.column("g"), labels)]
            cols = [*[b.column(f.name) for f in others], pa.array(x, pa.float64()), pa.array(z, pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*[f.name for f in others], "x", "z"])
        release_memory()

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others)
    return rows.mapInArrow(run, kinds + ", x double, z double")


def calibration(known: DataFrame) -> tuple[float, float, float]:
    """(weight of x, weight of z, offset) of the log likelihood ratio as a plane, from the means of either class and the
    covariance within classes; all 0 unless both classes are there."""
    moments = [
        F.count("*").alias("n"), F.avg("x").alias("x"), F.avg("z").alias("z"), F.var_pop("x").alias("xx"),
        F.var_pop("z").alias("zz"), F.covar_pop("x", "z").alias("xz"),
    ]
    r = {r["good"]: r for r in known.groupBy("good").agg(*moments).collect()}
    if len(r) < 2:
        return 0.0, 0.0, 0.0
    n = r[0]["n"] + r[1]["n"]
    xx, zz, xz = (sum(c["n"] * c[k] for c in r.values()) / n + (RIDGE if k != "xz" else 0.0) for k in ("xx", "zz", "xz"))
    dx, dz = r[1]["x"] - r[0]["x"], r[1]["z"] - r[0]["z"]
    det = xx * zz - xz * xz
    a, b = (zz * dx - xz * dz) / det, (xx * dz - xz * dx) / det
    return a, b, -(a * (r[1]["x"] + r[0]["x"]) + b * (r[1]["z"] + r[0]["z"])) / 2


def strength(groups: DataFrame, by: str | None) -> float:
    """Labels that the prior of a level counts as, from (n, good, and the level above ``by``) for each site of the level."""
    base = groups if by is None else groups.withColumn("_u", F.col(by))
    own = [
        F.count("*").alias("sites"), F.sum("n").alias("n"), F.sum("good").alias("good"),
        F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("good") * F.col("good") / F.col("n")).alias("gg"),
    ]
    up = base.groupBy(*([] if by is None else ["_u"])).agg(*own)
    # between and within sums of squares of all parents together
    r = up.where("sites > 1").agg(
        F.sum(F.col("gg") - F.col("good") * F.col("good") / F.col("n")), F.sum(F.col("sites") - 1), F.sum(F.col("good") - F.col("gg")),
        F.sum(F.col("n") - F.col("sites")), F.sum(F.col("n") - F.col("nn") / F.col("n")),
    ).first()
    if not r[1] or not r[3]:
        return STRENGTH[1]
    between, within, n0 = r[0] / r[1], r[2] / r[3], r[4] / r[1]
    rho = (between - within) / max(between + (n0 - 1) * within, 1e-12)
    return STRENGTH[1] if rho <= 0 else min(max((1 - rho) / rho, STRENGTH[0]), STRENGTH[1])


def assess(
    docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "quality",
) -> DataFrame:
    """Per row of ``docs``: id, evidence, host_share, path_share, score (probability of good quality), kept (score >= 0.5).

    ``labels`` (id, label 0 or 1) cover some documents; null labels and ids count for nothing, of several labels of one
    id the larger counts. Null hosts and paths are sites of their own; sites without labels take the share of the level
    above. A null text is empty. Without labels of both classes all evidence is 0, and without any the share overall is 0.5.
    The evidence is fitted on FIT_DOCS labelled documents at most, the shares on all. Rows may repeat (each counts); an empty table gives an empty result; other columns
    are not read. Figures are rounded to six digits.
    """
    text = F.col(f"`{text_col}`")
    labelled = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    truth = labelled.groupBy(F.col(id_col).alias("_lid")).agg((F.max(label_col) > 0).cast("long").alias("label"))
    truth = written(truth, "quality-labels")
    h = F.xxhash64("_lid")
    fit = sampled(truth, h, truth.count(), FIT_DOCS).orderBy(h).limit(FIT_DOCS).withColumnRenamed("label", "good")
    fit = F.broadcast(written(fit, "quality-fitted"))  # FIT_DOCS rows at most
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), host.cast("string").alias("_host"), path.cast("string").alias("_path"), text.alias("text"))
    chosen = rows.join(fit, F.col("_id") == F.col("_lid")).select("good", measures(F.col("text")).alias("g"), "text")
    counts, good, bad = tables(features(chosen))
    # one pass over all texts; what moves from here on is a few numbers of each document
    marked = rows.join(fit, F.col("_id") == F.col("_lid"), "left").select("_id", "_host", "_path", "good", measures(F.col("text")).alias("g"), "text")
    ratios = written(mean_ratios(marked, counts, good, bad), "quality-ratios")
    a, b, offset = calibration(ratios.where("good IS NOT NULL"))
    judged = written(
        ratios.drop("good").join(truth, F.col("_id") == F.col("_lid"), "left").drop("_lid").withColumnRenamed("label", "good"),
        "quality-judged",
    )
    known = judged.where("good IS NOT NULL")
    total = known.agg(F.coalesce(F.sum("good"), F.lit(0)), F.count("*")).first()
    paths = written(known.groupBy("_host", "_path").agg(F.count("*").alias("n"), F.sum("good").alias("good")), "quality-paths")
    hosts = written(paths.groupBy("_host").agg(F.sum("n").alias("n"), F.sum("good").alias("good")), "quality-hosts")
    k_host, k_path = strength(hosts, None), strength(paths, "_host")
    h = hosts.select(F.col("_host").alias("_hh"), F.col("n").alias("_hn"), F.col("good").alias("_hg"))
    p = paths.select(F.col("_host").alias("_ph"), F.col("_path").alias("_pp"), F.col("n").alias("_pn"), F.col("good").alias("_pg"))
    sited = judged.join(small(h), F.col("_host").eqNullSafe(F.col("_hh")), "left").join(
        small(p), F.col("_host").eqNullSafe(F.col("_ph")) & F.col("_path").eqNullSafe(F.col("_pp")), "left",
    )
    # one label less where it is the document's own
    one, own = F.col("good").isNotNull().cast("long"), F.coalesce("good", F.lit(0))
    less = lambda n, sub: F.coalesce(F.col(n) - sub, F.lit(0))
    overall = (F.lit(total[0] + 1.0) - own) / (F.lit(total[1] + 2.0) - one)
    host_share = (less("_hg", own) + k_host * overall) / (less("_hn", one) + k_host)
    path_share = (less("_pg", own) + k_path * F.col("_hs")) / (less("_pn", one) + k_path)
    evidence = F.greatest(F.least(a * F.col("x") + b * F.col("z") + offset, F.lit(MOST_EVIDENCE)), F.lit(-MOST_EVIDENCE))
    out = sited.withColumn("_hs", host_share).withColumn("_ps", path_share).withColumn(
        "_e", F.when((F.col("x") == 0) & (F.col("z") == 0), 0.0).otherwise(evidence),
    )
    score = 1 / (1 + F.exp(-(F.col("_e") + F.log(F.col("_ps") / (1 - F.col("_ps"))))))
    rounded = [F.round(c, DIGITS).alias(n) for n, c in (("evidence", F.col("_e")), ("host_share", F.col("_hs")), ("path_share", F.col("_ps")), ("score", score))]
    return out.select(F.col("_id").alias(id_col), *rounded).withColumn("kept", F.col("score") >= 0.5)
