"""Reports over append-only facts: daily metrics, usage, cost, freshness and listings. ``as_of`` stands for now."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from deskgrain.functions import text as T
from deskgrain.functions.frames import small
from deskgrain.operators.percentiles import percentiles

# US dollars for a million tokens in and out.
PRICES = {"gpt-4.1-mini": (0.40, 1.60), "gpt-4o-mini": (0.15, 0.60), "gpt-4o": (2.50, 10.00), "gpt-4.1": (2.00, 8.00)}
DEFAULT_MODEL = "gpt-4.1-mini"


def rate(part: Column, whole: Column, digits: int = 4) -> Column:
    return F.round(F.coalesce(F.try_divide(part, whole), F.lit(0.0)), digits)


def daily_metrics(facts: DataFrame, calls: DataFrame | None = None) -> DataFrame:
    """One row a day from facts (created_at, action, confidence, edit_ratio, latency_ms): counts by action, rates, means,
    exact interpolated percentiles, and the day's average call cost from ``calls`` (created_at, cost_usd)."""
    a = F.coalesce("action", F.lit("pending"))
    d = facts.groupBy(F.to_date("created_at").alias("metric_date")).agg(
        F.count("*").alias("total"), *[F.count_if(a == x).alias(x) for x in ("sent_as_is", "edited", "rejected", "pending")],
        F.round(F.coalesce(F.avg("edit_ratio"), F.lit(0.0)), 4).alias("mean_edit_distance"),
        F.count_if(F.col("confidence").isin("HIGH", "MEDIUM")).alias("covered"),
    )
    day = percentiles(facts.select(F.to_date("created_at").alias("metric_date"), "latency_ms"), ["metric_date"], "latency_ms", [0.5, 0.95])
    day = day.select(F.col("metric_date").alias("_day"), F.round("p0", 4).alias("latency_p50_ms"), F.round("p1", 4).alias("latency_p95_ms"))
    d = d.join(day, F.col("metric_date").eqNullSafe(F.col("_day")), "left").drop("_day")
    d = d.withColumns(
        {
            "send_as_is_rate": rate(F.col("sent_as_is"), F.col("total")), "reject_rate": rate(F.col("rejected"), F.col("total")),
            "coverage_rate": rate(F.col("covered"), F.col("total")),
        }
    )
    if calls is None:
        return d
    c = calls.groupBy(F.to_date("created_at").alias("metric_date")).agg(F.round(F.avg("cost_usd"), 6).alias("avg_cost_usd"))
    return d.join(c, "metric_date", "left").fillna(0.0, ["avg_cost_usd"])


def action_breakdown(facts: DataFrame) -> DataFrame:
    """(metric_date, breakdown): counts by confidence and action of each day as a map; blanks count as unknown and pending."""
    conf, act = F.coalesce(T.blank_to_null(F.col("confidence")), F.lit("unknown")), F.coalesce(T.blank_to_null(F.col("action")), F.lit("pending"))
    n = facts.groupBy(F.to_date("created_at").alias("metric_date"), F.concat_ws("/", conf, act).alias("k")).agg(F.count("*").alias("n"))
    return n.groupBy("metric_date").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias("breakdown"))


def since(df: DataFrame, col: str, as_of: Column, days: int) -> DataFrame:
    return df.where((F.col(col) >= as_of - F.make_dt_interval(F.lit(days))) & (F.col(col) <= as_of))


def counts(df: DataFrame, col: Column, name: str, most: int | None = None) -> DataFrame:
    """(name, n), most frequent first, ties by name; blanks count as unknown."""
    out = df.groupBy(F.coalesce(T.blank_to_null(col), F.lit("unknown")).alias(name)).agg(F.count("*").alias("n"))
    return out.orderBy(F.desc("n"), name).limit(most) if most else out


def usage_report(traces: DataFrame, calls: DataFrame) -> DataFrame:
    """One row: queries, distinct users, no-answer and low-confidence rates, mean score, cost and p95 latency, each section
    aggregated by itself and put side by side. The p95 is the element at floor(0.95 (n - 1)) of the ordered latencies."""
    t = traces.agg(
        F.count("*").alias("total_queries"), F.count_distinct("user_id").alias("active_users"),
        F.count_if("no_answer").alias("no_answers"), F.count_if("low_confidence").alias("low_confidences"),
        F.round(F.avg("score"), 4).alias("average_score"), F.round(F.sum("cost_usd"), 6).alias("total_cost_usd"),
    )
    t = t.withColumns(
        {
            "no_answer_rate": rate(F.col("no_answers"), F.col("total_queries")),
            "low_confidence_rate": rate(F.col("low_confidences"), F.col("total_queries")),
        }
    )
    c = calls.agg(F.count("latency_ms").alias("api_calls")).join(
        F.broadcast(element_p95(calls, "latency_ms").select(F.col("value").alias("p95_latency_ms"))), F.lit(True),
    )
    return t.join(F.broadcast(c), F.lit(True))


def element_p95(df: DataFrame, col: str, p: float = 0.95) -> DataFrame:
    """(value): the element at floor(p (n - 1)), counted from 0, of the ordered values; null without any."""
    found = percentiles(df, [], col, [p], lower=True).select(F.round("p0", 6).alias("value"))
    return df.sparkSession.range(1).join(found, F.lit(True), "left").select("value")


def freshness(updated_at: Column, needs_review_at: Column, as_of: Column) -> Column:
    age = F.datediff(as_of, T.parsed_time(updated_at))
    return F.when(
        F.coalesce(T.parsed_time(needs_review_at) < as_of, F.lit(False)), "needs_review",
    ).when(age.isNull(), "unknown").when(age >= 90, "stale").when(age >= 60, "review_soon").otherwise("fresh")


def source_status(chunks: DataFrame, as_of: Column) -> DataFrame:
    """One row a source: chunk counts by flag, completeness of metadata, ingestion and freshness status."""
    yes = lambda c: F.sum(F.coalesce(F.col(c), F.lit(False)).cast("long"))
    s = chunks.groupBy("source_id").agg(
        F.count("*").alias("chunks"), yes("is_approved").alias("approved"),
        yes("is_customer_facing_allowed").alias("customer_facing"), yes("disabled").alias("disabled_chunks"),
        F.max("updated_at").alias("updated_at"), F.max("needs_review_at").alias("needs_review_at"),
        F.sum((F.coalesce(F.col("updated_at"), F.lit("")) != "").cast("long")).alias("complete"),
    )
    s = s.withColumns(
        {
            "metadata_completeness": rate(F.col("complete"), F.col("chunks")),
            "ingestion_status": F.when(F.col("disabled_chunks") == F.col("chunks"), "disabled").otherwise("loaded"),
            "freshness_status": freshness(F.col("updated_at"), F.col("needs_review_at"), as_of),
        }
    )
    return s.drop("complete")


def source_dashboard(status: DataFrame) -> DataFrame:
    return status.agg(
        F.count("*").alias("source_count"), F.count_if(F.col("ingestion_status") == "loaded").alias("loaded_count"),
        F.count_if(F.col("freshness_status").isin("stale", "needs_review")).alias("needs_review_count"),
        F.count_if(F.col("metadata_completeness") < 1).alias("quality_warning_count"),
    )


def expiring(chunks: DataFrame, as_of: Column, days: int = 14, many: int = 3) -> DataFrame:
    """Enabled sources that expire or need review within ``days``: stale or near, with a warning from ``many`` chunks on."""
    due = as_of + F.make_dt_interval(F.lit(days))
    exp, rev = T.parsed_time(F.col("expires_at")), T.parsed_time(F.col("needs_review_at"))
    rows = chunks.where(~F.coalesce("disabled", F.lit(False)) & (F.coalesce(exp <= due, F.lit(False)) | F.coalesce(rev <= due, F.lit(False))))
    g = rows.groupBy("source_id", "expires_at", "needs_review_at").agg(F.count("*").alias("chunks"))
    return g.withColumns(
        {
            "status": F.when(T.stale(F.col("expires_at"), F.col("needs_review_at"), as_of), "stale").otherwise("near_review"),
            "warning": F.col("chunks") >= many,
        }
    )


def call_costs(calls: DataFrame, prices: DataFrame, default: str = DEFAULT_MODEL) -> DataFrame:
    """Cost of each call (model, tokens_in, tokens_out) by a price table (model, price_in, price_out); unknown models cost as the default."""
    p = small(prices.select(F.col("model").alias("_m"), "price_in", "price_out"))
    other = F.broadcast(prices.where(F.col("model") == default).agg(F.max("price_in").alias("_in"), F.max("price_out").alias("_out")))  # one row
    j = calls.join(p, F.col("model") == F.col("_m"), "left").join(other, F.lit(True))
    cost = F.col("tokens_in") * F.coalesce("price_in", "_in") + F.col("tokens_out") * F.coalesce("price_out", "_out")
    return j.withColumn("cost_usd", cost / 1_000_000).drop("_m", "price_in", "price_out", "_in", "_out")


def price_table(spark) -> DataFrame:
    return spark.createDataFrame([(m, *p) for m, p in PRICES.items()], "model string, price_in double, price_out double")


def cumulative(daily: DataFrame, day: str, value: str, out: str) -> DataFrame:
    """Running sum over days; ``daily`` has one row a day, so the window sees days, not facts."""
    return daily.withColumn(out, F.round(F.sum(value).over(Window.orderBy(day).rowsBetween(Window.unboundedPreceding, 0)), 6))


def newest(df: DataFrame, by: str, tie: str, most: int) -> DataFrame:
    return df.orderBy(F.desc_nulls_last(by), tie).limit(most)


def inventory(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n) of every table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out
