"""Exact percentiles of groups of any size, by a histogram whose bucket of the rank is opened.

Values are counted before they move, and the counts are stored. Approximate quantiles, which merge in bounded memory, cut each
group's distinct values into buckets of about equal numbers; running sums over these few buckets tell in which one a rank lies, and only the distinct
values of that bucket are put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from deskgrain.functions.frames import written

BUCKETS, ACCURACY = 200, 10_000


def percentiles(df: DataFrame, keys: list[str], col: str, ps: list[float], lower: bool = False) -> DataFrame:
    """(*keys, p0, p1, ...): interpolated percentiles of ``col`` for each group, or the element below each of them if
    ``lower``. Nulls do not count; groups without a value have no row; a null key is a key."""
    key = F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))
    v = df.select(key.alias("key"), F.col(col).cast("double").alias("value")).where("value IS NOT NULL")
    # counted once; all that follows reads what is stored
    stored = written(v.groupBy("key", "value").agg(F.count("*").alias("n")), "counted")
    shares = F.array(*[F.lit(i / BUCKETS) for i in range(1, BUCKETS)])
    cuts = stored.groupBy("key").agg(F.percentile_approx("value", shares, ACCURACY).alias("cuts"), F.sum("n").alias("total"))
    counted = stored.join(cuts, "key")
    counted = counted.select("key", "value", "n", "total", F.size(F.filter("cuts", lambda c: c < F.col("value"))).alias("bucket"))
    hist = counted.groupBy("key", "total", "bucket").agg(F.sum("n").alias("s"))
    hist = hist.withColumn("upto", F.sum("s").over(Window.partitionBy("key").orderBy("bucket")))  # BUCKETS rows a group
    ends = (F.floor,) if lower else (F.floor, F.ceil)
    ranks = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(e).alias("e"), f(p * (F.col("total") - 1)).cast("long").alias("rank")) for i, p in enumerate(ps) for e, f in enumerate(ends)])
    edge = hist.select(
        "key", "bucket", "s", "upto", F.explode(ranks).alias("r"),
    ).where((F.col("r.rank") < F.col("upto")) & (F.col("r.rank") >= F.col("upto") - F.col("s")))
    edge = edge.select(
        "key", "bucket", F.col("r.i").alias("i"), F.col("r.e").alias("e"),
        (F.col("r.rank") - F.col("upto") + F.col("s")).alias("left"),
    )
    inside = counted.join(edge, ["key", "bucket"])
    inside = inside.withColumn("to", F.sum("n").over(Window.partitionBy("key", "i", "e").orderBy("value")))
    hits = inside.where((F.col("left") < F.col("to")) & (F.col("left") >= F.col("to") - F.col("n")))

    def at(i: int, e: int) -> Column:
        return F.max(F.when((F.col("i") == i) & (F.col("e") == e), F.col("value")))

    found = hits.groupBy("key", "total").agg(*[at(i, e).alias(f"v{i}_{e}") for i in range(len(ps)) for e in range(len(ends))])

    def between(i: int, p: float) -> Column:
        part = p * (F.col("total") - 1) - F.floor(p * (F.col("total") - 1))
        return F.col(f"v{i}_0") if lower else F.col(f"v{i}_0") + part * (F.col(f"v{i}_1") - F.col(f"v{i}_0"))

    return found.select(*[F.col("key")[k].alias(k) for k in keys], *[between(i, p).alias(f"p{i}") for i, p in enumerate(ps)])
