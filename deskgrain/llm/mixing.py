"""Mixing sources to target weights by hash-threshold histograms (DataFrame functions only).

Every document has a 60-bit hash of its id. A source takes all documents whose hash lies below a threshold; the
threshold is found from sums of sizes by (source, 12 hash bits). Only the bucket in which the budget ends is opened
again, by the next 12 bits and then by all 36 that are left. Nothing is sorted by document and no document moves: the result
is a filter against one small row for each source.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, columns, small, unused, written

#: Bits of the hash that each level looks at; together 60.
DIGITS = (12, 12, 36)


def word_count(text: Column) -> Column:
    """Number of words; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def id_hash(key: Column) -> Column:
    """60 bits of the MD5 of the id's decimal text (a null id hashes as the empty text)."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def _digit(h: Column, level: int) -> Column:
    return F.shiftright(h, _below(level)).bitwiseAND(F.lit((1 << DIGITS[level]) - 1)).cast("long")


def _below(level: int) -> int:
    return sum(DIGITS[level + 1 :])


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Target of every source, from one row (mix_source, source_size) for each.

    The sources, by code point with null last, weigh ``weights`` in turn and share ``share`` times the sum of all sizes
    by weight. No target exceeds ``cap`` times its source's size; what is cut off is shared again by weight among the
    rest until none exceeds it. With sources in order of cap/weight the cut ones come first, so running sums give the
    fixed point at once. One row for each source: the ordering windows see no documents.
    """
    by_name = Window.orderBy(F.col("mix_source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("w", w).withColumn("cap", F.lit(cap) * F.col("source_size"))
    full = Window.orderBy(F.col("cap") / F.col("w"), F.col("mix_source").asc_nulls_last())
    before, after, everything = full.rowsBetween(Window.unboundedPreceding, -1), full.rowsBetween(0, Window.unboundedFollowing), full.rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing,
    )
    s = s.withColumn(
        "level",
        (F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after),
    )
    s = s.withColumn("cut", F.col("level") * F.col("w") >= F.col("cap"))
    s = s.withColumn("at", F.first(F.when(~F.col("cut"), F.col("level")), ignorenulls=True).over(everything))
    return s.select("mix_source", "source_size", F.when(F.col("cut"), F.col("cap")).otherwise(F.col("at") * F.col("w")).alias("target"))


def thresholds(sized: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row for each source of ``sized`` (mix_source, mix_size, mix_hash): source_size, target, base and bound.

    A document is taken ``base`` times, and once more if its hash is below ``bound``; documents in hash order are taken
    as long as their running sum stays within the budget, and one more where this comes nearer to it; documents of the same
    hash together. What a source gives is thus off its target by half the words of one hash at most. The few rows that a
    level finds are written, so that no plan holds those of the levels before it.
    """
    # long sums by (source, first digit): the only pass over all documents
    top = written(sized.groupBy("mix_source", _digit(F.col("mix_hash"), 0).alias("digit")).agg(F.sum("mix_size").alias("s")), "mix-histogram")
    goal = written(targets(top.groupBy("mix_source").agg(F.sum("s").alias("source_size")), weights, share, cap), "mix-targets")
    base = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(int(cap)))).otherwise(F.lit(0)).cast("int")
    state = goal.withColumn("base", base).withColumn(
        "left", F.col("target") - F.col("base") * F.col("source_size"),
    ).withColumn("bound", F.lit(0).cast("long"))
    closed = []
    hist = top
    for level in range(len(DIGITS)):
        # per source at most 4096 rows enter this window; on the last level, the documents of one of 2^24 buckets
        w = Window.partitionBy("mix_source").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)
        run = hist.withColumn("upto", F.sum("s").over(w)).withColumnRenamed("mix_source", "k")
        over = run.join(small(state.select("mix_source", "left")), F.col("k").eqNullSafe(F.col("mix_source"))).where(F.col("upto") > F.col("left"))
        edge = over.groupBy("k").agg(F.min_by(F.struct("digit", "upto", (F.col("upto") - F.col("s")).alias("below")), "digit").alias("e"))
        step = state.join(small(written(edge, "mix-edge")), F.col("mix_source").eqNullSafe(F.col("k")), "left")
        unit = 1 << _below(level)
        # no bucket overruns the budget: everything that is still open is taken
        closed.append(
            step.where(F.col("e").isNull()).select(
                "mix_source", "source_size", "target", "base",
                (F.col("bound") + F.lit(unit << DIGITS[level]).cast("long")).alias("bound"),
            )
        )
        # the last digit is one hash: it is taken too if it overshoots by less than it would leave open
        nearer = (F.col("e.upto") - F.col("left") < F.col("left") - F.col("e.below")).cast("long") if unit == 1 else F.lit(0).cast("long")
        state = step.where(F.col("e").isNotNull()).select(
            "mix_source", "source_size", "target", "base", (F.col("left") - F.col("e.below")).alias("left"),
            (F.col("bound") + F.col("e.digit") * F.lit(unit).cast("long") + nearer).alias("bound"),
        )
        state = written(state, "mix-open")
        if level + 1 < len(DIGITS):
            opened = state.select(F.col("mix_source").alias("k"), F.shiftright("bound", _below(level)).alias("prefix"))
            inside = sized.withColumn("prefix", F.shiftright("mix_hash", _below(level))).join(
                small(opened).withColumnRenamed("prefix", "p"),
                F.col("k").eqNullSafe(F.col("mix_source")) & (F.col("prefix") == F.col("p")),
            )
            hist = inside.groupBy("mix_source", _digit(F.col("mix_hash"), level + 1).alias("digit")).agg(F.sum("mix_size").alias("s"))
    closed.append(state.select("mix_source", "source_size", "target", "base", "bound"))
    return written(reduce(DataFrame.unionByName, closed), "mix-bounds")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, mix_source, mix_size, mix_hash) of every document."""
    return docs.select(
        F.col(f"`{id_col}`"), F.col(f"`{source_col}`").alias("mix_source"), word_count(F.col(f"`{text_col}`")).alias("mix_size"),
        id_hash(F.col(f"`{id_col}`")).alias("mix_hash"),
    )


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, out: str = "mix_times",
) -> DataFrame:
    """``docs`` with column ``out``: how often the mix takes each document (0 up to ``cap``).

    Only the columns named are read for the decision; all others pass through, whatever their names; a column named as ``out`` is
    replaced. A null or empty text has size 0 and is taken like any other; a null source is a source of its own; rows of one
    id and source are taken alike; an empty table gives an empty result.
    """
    docs = docs.drop(out)
    source, base, bound = unused(docs.columns, "mix_source", "base", "bound")
    found = thresholds(written(sized(docs, id_col, text_col, source_col), "mix-sizes"), weights, share, cap)
    bounds = small(found.select(F.col("mix_source").alias(source), F.col("base").alias(base), F.col("bound").alias(bound)))
    joined = docs.join(bounds, F.col(f"`{source_col}`").eqNullSafe(F.col(source)), "left")
    return joined.select(*columns(docs), _times(id_hash(F.col(f"`{id_col}`")), F.col(base), F.col(bound), cap).alias(out))


def _times(h: Column, base: Column, bound: Column, cap: float) -> Column:
    """How often a document of this hash is taken, never above ``cap`` times."""
    return F.coalesce(F.least(base + (h < bound).cast("int"), F.lit(int(cap))), F.lit(0))


def mix_report(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0,
) -> DataFrame:
    """Per document: id, size, source_size, target of its source, taken (words the mix takes) and times (see ``mix``)."""
    slim = written(sized(docs, id_col, text_col, source_col), "mix-sizes").withColumnRenamed(id_col, "mix_id")
    bounds = small(thresholds(slim, weights, share, cap).withColumnRenamed("mix_source", "bound_source"))
    joined = slim.join(bounds, F.col("mix_source").eqNullSafe(F.col("bound_source")), "left")
    times = _times(F.col("mix_hash"), F.col("base"), F.col("bound"), cap)
    return joined.select(
        F.col("mix_id").alias(id_col), F.col("mix_size").alias("size"), "source_size", "target",
        (F.col("mix_size") * times).cast("long").alias("taken"), times.alias("times"),
    )
