"""Structured Streaming twins of the batch jobs over append-only facts.

Rows later than the watermark are not counted by a stream; the batch job over the same facts corrects them. Every job
reads files, so ``availableNow`` brings a stream to the end of what is there. Sinks are folders, never memory.

A job is its folder and its checkpoint: whoever starts it again with both goes on where it stopped. A batch that runs
again has the same number: state kept by a ledger leaves it out if it was committed, other sinks overwrite its folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deskgrain.functions import text as T
from deskgrain.functions.frames import new_folder, small
from deskgrain.operators import ingest as I
from deskgrain.operators.reports import rate

from .ledger import Ledger, shuffles_removed


def table_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the rows of a Parquet table, be it a folder or a single file (which a stream takes only as a pattern)."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def events_stream(spark: SparkSession, path: str, time_col: str = "ts") -> DataFrame:
    """A stream of a table of events, its time column as a timestamp."""
    return table_stream(spark, path).withColumn(time_col, F.col(time_col).cast("timestamp"))


def run_to_folder(stream: DataFrame, what: str, folder: str | None = None) -> DataFrame:
    """Runs an append stream over all that is there and reads its result; a ``folder`` that was used before is gone on with."""
    spark = stream.sparkSession
    out = folder or new_folder(spark, what)
    stream.writeStream.format("parquet").option(
        "checkpointLocation", f"{out}-state",
    ).outputMode("append").trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_batches(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> None:
    """Hands all that is there, and was not handed on under this ``checkpoint`` before, to ``each`` in batches."""
    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def first_writes(stream: DataFrame, key: str, time_col: str = "ts", late: str = "1 day") -> DataFrame:
    """First row of each key within the watermark."""
    return stream.withWatermark(time_col, late).dropDuplicatesWithinWatermark([key])


def windowed(
    stream: DataFrame, aggs: dict[str, Column], length: str, slide: str | None = None, time_col: str = "ts", late: str = "1 day",
) -> DataFrame:
    """Tumbling or sliding windows (window_start and the named aggregates) under a watermark."""
    w = F.window(time_col, length, slide) if slide else F.window(time_col, length)
    return stream.withWatermark(time_col, late).groupBy(w).agg(*[c.alias(n) for n, c in aggs.items()]).select(
        F.col("window.start").alias("window_start"), *aggs,
    )


def retained(df: DataFrame, as_of: Column, days: int = 30, time_col: str = "ts") -> DataFrame:
    """Facts of the last ``days`` days."""
    return df.where(F.col(time_col) >= as_of - F.make_dt_interval(F.lit(days)))


def latest_by_key(df: DataFrame, key: str, order: str) -> DataFrame:
    cols = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*cols), F.col(order)).alias("s")).select(key, "s.*")


#: Stored bytes of buckets that are merged at a time, so that the shuffles of a merge do not grow with the table.
MERGE_BYTES = 256 << 20


class Buckets:
    """A keyed table in ``folder``, its rows dealt into buckets by a hash of the key. A batch writes the buckets it touches and
    no others, and commits them together (``Ledger``): a batch that breaks shows nothing, one that was committed is not run again,
    and buckets of old versions are removed."""

    def __init__(self, spark: SparkSession, folder: str, key: str, n: int = 64):
        self.spark, self.key, self.n, self.ledger = spark, key, n, Ledger(spark, folder)

    def newest(self) -> dict[int, int]:
        """The batch that wrote each bucket, from the names of the live folders."""
        live = self.ledger.last()["live"]
        return {int(part.split("=")[1]): int(path.rsplit("/batch=", 1)[1].split("-")[0]) for part, path in live.items()}

    def read(self) -> DataFrame | None:
        """The table as the last batch left it; None if nothing is there."""
        return self.ledger.read()

    def merge(
        self, new: DataFrame, batch_id: int, how: Callable[[DataFrame | None, DataFrame], DataFrame],
        prepare: Callable[[DataFrame], DataFrame] | None = None,
    ) -> None:
        """Commits ``how(old rows of some buckets, new rows of these)`` of all touched buckets. The new rows are computed once: they are
        written by bucket, and the names of the folders tell which buckets are touched. Buckets are merged a few at a time, and their new
        rows go as soon as they are. What ``prepare`` makes of new rows is written too, so that ``how`` may use it often."""
        last = self.ledger.last()
        if batch_id <= last["batch"]:
            return
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.n)).cast("int")
        with shuffles_removed(new.sparkSession, self.spark):
            arrived, schema = self.ledger.write(new.withColumn("bucket", bucket), "bucket", batch_id)
            if not arrived:
                return
            live = {part: path for part, path in last["live"].items() if part not in arrived}
            for parts in self._groups(arrived, last["live"]):
                paths = [arrived[p] for p in parts]
                rows = self.spark.read.schema(schema).parquet(*paths)
                if prepare:
                    rows, path = prepare(rows), self.ledger.data_folder(batch_id)
                    rows.write.parquet(path)
                    self.ledger.drop(paths)
                    rows, paths = self.spark.read.schema(rows.schema).parquet(path), [path]
                merged = how(self.ledger.read(set(parts), last), rows)
                written, kind = self.ledger.write(merged.withColumn("bucket", bucket), "bucket", batch_id)
                live |= written
                self.ledger.drop(paths)
        self.ledger.commit(last, live, kind, batch_id)

    def _groups(self, arrived: dict[str, str], live: dict[str, str]) -> list[list[str]]:
        """The arrived buckets in groups of at most MERGE_BYTES of old and new rows, or of one bucket."""
        groups, size = [], MERGE_BYTES
        for part in sorted(arrived):
            own = sum(self.ledger.size(paths[part]) for paths in (arrived, live) if part in paths)
            if size + own > MERGE_BYTES:
                groups.append([])
                size = 0
            groups[-1].append(part)
            size += own
        return groups


class LatestState:
    """Latest row of each key: a batch rewrites the buckets of its keys."""

    def __init__(self, spark: SparkSession, key: str, order: str, folder: str, buckets: int = 64):
        self.key, self.order, self.state = key, order, Buckets(spark, folder, key, buckets)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        def latest(old: DataFrame | None, new: DataFrame) -> DataFrame:
            return latest_by_key(new if old is None else old.unionByName(new), self.key, self.order)

        self.state.merge(latest_by_key(batch, self.key, self.order), batch_id, latest)

    def read(self) -> DataFrame | None:
        return self.state.read()


class RetainedFacts:
    """Facts of the last ``days`` days before the newest one, kept in a folder a day (by the time's date in the session's zone).

    A batch appends its facts; then days that ended before the cut leave the table with their folders, and the day of the cut is
    written again without what is older. Rows without a time are not kept. A day that a batch adds to is
    written anew with it, so a day is one folder; late facts older than the cut are not taken."""

    def __init__(self, spark: SparkSession, folder: str, days: int = 30, time_col: str = "ts"):
        self.spark, self.days, self.time, self.ledger = spark, days, time_col, Ledger(spark, folder)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        last, day = self.ledger.last(), F.to_date(self.time)
        if batch_id <= last["batch"]:
            return
        rows = batch.where(F.col(self.time).isNotNull())
        arrived, schema = self.ledger.write(rows.withColumn("day", day), "day", batch_id)
        if not arrived:
            return
        live = set(last["live"]) | set(arrived)
        new = self.spark.read.schema(schema).parquet(*arrived.values())
        newest = max(live)  # day=yyyy-mm-dd
        held = new if newest in arrived else self.ledger.read({newest}, last)
        cut = F.lit(held.agg(F.max(self.time)).first()[0]) - F.make_dt_interval(F.lit(self.days))
        first = "day=" + self.spark.range(1).select(F.to_date(cut).cast("string")).first()[0]
        again = {p for p in live if p == first or (p in arrived and p > first)}
        kept = {p: path for p, path in last["live"].items() if p > first and p not in again}
        if again:
            old = self.ledger.read(again, last)
            merged = new if old is None else old.unionByName(new)
            written, schema = self.ledger.write(merged.where((F.col(self.time) >= cut) & (day >= F.lit(first[4:]).cast("date"))).withColumn("day", day), "day", batch_id)
            kept |= written
        self.ledger.commit(last, kept, schema, batch_id)

    def read(self) -> DataFrame | None:
        return self.ledger.read()


def _mean(total: Column, n: Column, digits: int) -> Column:
    """The mean from an exact sum, rounded half-up as a decimal, so that the last bits of a double do not decide ties."""
    return F.round(F.try_divide(total.cast("double"), n).cast("decimal(28,9)"), digits).cast("double")


class DayFigures:
    """Figures of days and of any number of days together, from facts that a stream delivers in any order.

    The state holds, for each day, confidence and action, what can be merged: counts, sums and a quantile sketch of latencies; and
    for each day a bitmap of users for every 32,768 ids. A batch merges its own into the days that it touches, however late its
    facts are. Facts: created_at, user_id (whole numbers), confidence, action, edit_ratio, latency_ms, cost_usd, error; any may be
    null, and facts without a time do not count. Sums are decimals of nine digits, so that no order of merging changes them. Numbers of
    users are exact; percentiles are within the rank error of a
    KLL sketch of ``k`` (1.33 % for 200)."""

    SUMS = ("n", "edit_sum", "edit_n", "latency_sum", "latency_n", "cost_sum", "cost_n", "errors")
    KEYS = ("metric_date", "confidence", "action", "part")

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64, k: int = 200):
        self.spark, self.k, self.state = spark, k, Buckets(spark, folder, "metric_date", buckets)

    def _parts(self, facts: DataFrame) -> DataFrame:
        f = facts.where("created_at IS NOT NULL").withColumns(
            {
                "metric_date": F.to_date("created_at"), "confidence": F.coalesce(T.blank_to_null(F.col("confidence")), F.lit("unknown")),
                "action": F.coalesce(T.blank_to_null(F.col("action")), F.lit("pending")), "latency_ms": F.col("latency_ms").cast("double"),
            }
        )
        exact = lambda c: F.sum(F.col(c).cast("decimal(28,9)")).cast("decimal(38,9)")
        sums = f.groupBy("metric_date", "confidence", "action", F.lit(None).cast("long").alias("part")).agg(
            F.count("*").alias("n"), exact("edit_ratio").alias("edit_sum"), F.count("edit_ratio").alias("edit_n"),
            exact("latency_ms").alias("latency_sum"), F.count("latency_ms").alias("latency_n"), exact("cost_usd").alias("cost_sum"),
            F.count("cost_usd").alias("cost_n"), F.count_if("error").alias("errors"), F.kll_sketch_agg_double("latency_ms", self.k).alias("latency"),
        )
        users = f.where("user_id IS NOT NULL").groupBy("metric_date", F.bitmap_bucket_number(F.col("user_id")).alias("part")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position(F.col("user_id"))).alias("users")
        )
        return sums.unionByName(users, allowMissingColumns=True)

    def _merged(self, rows: DataFrame, keys: list[str]) -> DataFrame:
        """Rows of the state put together by ``keys``: sums and sketches of facts, and bitmaps of users, which are rows of their own."""
        sums = rows.where("part IS NULL").groupBy(*keys).agg(
            *[F.sum(c).cast(rows.schema[c].dataType).alias(c) for c in self.SUMS], F.kll_merge_agg_double("latency", self.k).alias("latency"),
        )
        users = rows.where("part IS NOT NULL").groupBy(*keys).agg(F.bitmap_or_agg("users").alias("users"))
        return sums.unionByName(users, allowMissingColumns=True)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        def both(old: DataFrame | None, new: DataFrame) -> DataFrame:
            return new if old is None else self._merged(old.unionByName(new), list(self.KEYS))

        self.state.merge(self._parts(batch), batch_id, both)

    def _quantile(self, p: float) -> Column:
        # a sketch of no values has no quantile
        return F.when(F.kll_sketch_get_n_double("latency") > 0, F.kll_sketch_get_quantile_double("latency", F.lit(p)))

    def days(self) -> DataFrame | None:
        """A row a day: counts by action and their rates, means, coverage, percentiles, the breakdown by confidence and action (a
        map of "confidence/action"), average cost and number of users; None if no facts came yet."""
        rows = self.state.read()
        if rows is None:
            return None
        a, n = F.col("action"), F.col("n")
        sums = rows.where("part IS NULL").groupBy("metric_date").agg(
            F.sum(n).alias("total"), *[F.coalesce(F.sum(F.when(a == x, n)), F.lit(0)).alias(x) for x in ("sent_as_is", "edited", "rejected", "pending")],
            F.coalesce(_mean(F.sum("edit_sum"), F.sum("edit_n"), 4), F.lit(0.0)).alias("mean_edit_distance"),
            F.coalesce(F.sum(F.when(F.col("confidence").isin("HIGH", "MEDIUM"), n)), F.lit(0)).alias("covered"),
            F.kll_merge_agg_double("latency", self.k).alias("latency"),
            F.coalesce(_mean(F.sum("cost_sum"), F.sum("cost_n"), 6), F.lit(0.0)).alias("avg_cost_usd"),
            F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat_ws("/", "confidence", "action").alias("k"), n)))).alias("breakdown"),
        )
        sums = sums.withColumns(
            {
                "send_as_is_rate": rate(F.col("sent_as_is"), F.col("total")), "reject_rate": rate(F.col("rejected"), F.col("total")),
                "coverage_rate": rate(F.col("covered"), F.col("total")), "latency_p50_ms": self._quantile(0.5), "latency_p95_ms": self._quantile(0.95),
            }
        ).drop("latency")
        users = rows.where("part IS NOT NULL").groupBy("metric_date").agg(F.sum(F.bitmap_count("users")).alias("active_users"))
        return sums.join(users, "metric_date", "left").fillna(0, ["active_users"])

    def rolling(self, days: int = 7) -> DataFrame | None:
        """A row for every day from the first fact's to the last fact's on which one of the ``days`` days up to it has facts: number of
        facts, latency, cost, errors and users of those days."""
        rows = self.state.read()
        if rows is None:
            return None
        last = rows.agg(F.max("metric_date").alias("last_day"))  # one row
        ends = F.explode(F.sequence(F.col("metric_date"), F.least(F.date_add("metric_date", days - 1), F.col("last_day")))).alias("metric_date")
        kept = rows.join(F.broadcast(last), F.lit(True)).select(*[c for c in rows.columns if c != "metric_date"], ends)
        both = self._merged(kept, ["metric_date", "part"])
        sums = both.where("part IS NULL").select(
            "metric_date", F.col("n").alias("total"), _mean(F.col("latency_sum"), F.col("latency_n"), 4).alias("avg_latency_ms"),
            F.coalesce(_mean(F.col("cost_sum"), F.lit(1), 4), F.lit(0.0)).alias("total_cost_usd"), "errors",
            self._quantile(0.5).alias("latency_p50_ms"), self._quantile(0.95).alias("latency_p95_ms"),
        )
        users = both.where("part IS NOT NULL").groupBy("metric_date").agg(F.sum(F.bitmap_count("users")).alias("active_users"))
        return sums.join(users, "metric_date", "left").fillna(0, ["active_users"])


class FanOut:
    """A stream's facts written to several tables, each made by a function of the batch that keeps the fact's ``key``.

    A batch writes a folder of each table and then, last, its mark; what has no mark is not read, so that all tables show the same
    batches. A batch that runs again replaces its folders, and of a fact that is delivered in several batches the rows of the
    first count."""

    def __init__(self, spark: SparkSession, tables: dict[str, Callable[[DataFrame], DataFrame]], key: str, folder: str):
        self.spark, self.tables, self.key, self.folder = spark, tables, key, folder

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        for name, made in self.tables.items():
            made(batch).dropDuplicates([self.key]).write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={batch_id}")
        self.spark.range(1).write.mode("overwrite").parquet(f"{self.folder}/marks/batch={batch_id}")

    def read(self, table: str) -> DataFrame:
        """The rows of all marked batches, one for each fact."""
        marked = small(self.spark.read.parquet(f"{self.folder}/marks").select("batch"))
        rows = self.spark.read.option("mergeSchema", False).parquet(f"{self.folder}/{table}").join(marked, "batch", "left_semi")
        others = [c for c in rows.columns if c not in (self.key, "batch")]
        first = rows.groupBy(self.key).agg(F.min_by(F.struct(*others), "batch").alias("first"))
        return first.select(self.key, "first.*")


class IncrementalIngest:
    """Documents of a stream merged into a chunk table by a re-ingest plan.

    ``chunk`` makes chunks (article_id, chunk_index, content) of a batch's documents. Documents whose chunks did not change are
    left alone; of changed ones the old chunks become inactive, with the reason, and the new ones are written under the next
    version. A document that shrinks thus leaves no active chunk behind. Of a document that is in a batch twice the chunks of
    the later ``order`` count (a column of the batch; by default its text decides).
    """

    def __init__(
        self, spark: SparkSession, chunk: Callable[[DataFrame], DataFrame], folder: str, id_col: str = "doc_id",
        text_col: str = "text", order: str | None = None, as_of: Column | None = None, buckets: int = 64,
    ):
        self.spark, self.chunk, self.id, self.text, self.order = spark, chunk, id_col, text_col, order or text_col
        self.as_of, self.state = F.current_timestamp() if as_of is None else as_of, Buckets(spark, folder, "article_id", buckets)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        docs = batch.select(F.col(self.id).alias("article_id"), *({self.text, self.order} - {self.id}))
        self.state.merge(docs, batch_id, self._merged, self._chunks)

    def _chunks(self, docs: DataFrame) -> DataFrame:
        """The chunks of documents, and a row for each document without any: it still supersedes those that it had."""
        docs = latest_by_key(docs, "article_id", "article_id" if self.order == self.id else self.order).withColumnRenamed("article_id", self.id)
        hashes = docs.select(F.col(self.id).alias("article_id"), F.sha2(F.coalesce(self.text, F.lit("")), 256).alias("document_hash"))
        name = F.concat_ws(":", F.col("article_id").cast("string"), "chunk_index")
        chunks = self.chunk(docs).select("article_id", "chunk_index", "content", name.alias("chunk_id"))
        return hashes.join(chunks, "article_id", "left")

    def _merged(self, old: DataFrame | None, new: DataFrame) -> DataFrame:
        columns = [
            "article_id", "chunk_index", "content", "chunk_id", "document_hash", "document_version", "is_active", "superseded_at",
            "superseded_reason", "superseded_by",
        ]
        first = new.where("chunk_id IS NOT NULL").withColumns(
            {
                "document_version": F.lit(1), "is_active": F.lit(True), "superseded_at": F.lit(None).cast("timestamp"),
                "superseded_reason": F.lit(None).cast("string"), "superseded_by": F.lit(None).cast("string"),
            }
        )
        if old is None:
            return first.select(*columns)
        incoming = new.groupBy("article_id").agg(F.max("document_hash").alias("document_hash"), F.collect_set("chunk_id").alias("chunk_ids"))
        plan = I.reingest_plan(old, incoming)
        changed = plan.where("action <> 'skip_unchanged'").select("article_id", "next_version")
        upserts = first.join(changed, "article_id").withColumn("document_version", F.col("next_version"))
        # what was superseded before keeps its reason; chunks that come again replace their namesakes
        before = old.select(*[F.col(c).alias(f"was_{c}") if c.startswith("superseded") else F.col(c) for c in columns])
        kept = I.tombstone(before, plan, self.as_of)
        kept = kept.withColumns({c: F.coalesce(c, f"was_{c}") for c in columns if c.startswith("superseded")})
        kept = kept.join(upserts.select("article_id", "chunk_id"), ["article_id", "chunk_id"], "left_anti")
        return kept.select(*columns).unionByName(upserts.select(*columns))

    def read(self) -> DataFrame | None:
        return self.state.read()
