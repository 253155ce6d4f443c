"""Tables as versioned Parquet folders, with upserts, insert-if-absent and updates as joins, and readers of input files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from deskgrain.functions import text as T
from deskgrain.functions.frames import new_folder, shared_dir, small  # noqa: F401  (folders belong to the store)


def last_by_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """``new`` and those rows of ``old`` whose key it does not hold: the last write wins. Of a key that ``new`` repeats the row
    that comes first by ``order`` counts (by default the greatest by its other columns); a null key is a key."""
    others = [F.col(c).desc_nulls_last() for c in new.columns if c not in keys]
    last = last_by_key(new, keys, order or others or [F.lit(0)])
    held = last.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)])
    same = [old[c].eqNullSafe(held[f"_k{i}"]) for i, c in enumerate(keys)]
    rest = old.join(held, _all(same), "left_anti")
    return rest.unionByName(last, allowMissingColumns=True)


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The rows of ``new`` to append: keys that ``old`` does not hold, the first of each."""
    return last_by_key(new, keys, order).join(old.select(*keys), keys, "left_anti")


def upsert_payload(old: DataFrame, new: DataFrame, key: str, payload: list[str]) -> DataFrame:
    """Rows of both; a key in both keeps the old row but for its payload."""
    n = new.select(key, *[F.col(c).alias(f"_{c}") for c in new.columns if c != key], F.lit(True).alias("_new"))
    j = old.withColumn("_old", F.lit(True)).join(n, key, "full")
    return j.select(
        key,
        *[
            (
                F.coalesce(F.col(f"_{c}"), F.col(c)) if c in payload else F.when(F.col("_old"), F.col(c)).otherwise(F.col(f"_{c}"))
            ).alias(c) for c in old.columns if c != key
        ],
    )


def apply_commands(chunks: DataFrame, commands: DataFrame, as_of: Column) -> DataFrame:
    """Commands (target, command: disable | stale) applied to chunks: one chunk disabled, or a source's review date passed."""
    off = commands.where("command = 'disable'").select(F.col("target").alias("_chunk")).distinct()
    old = commands.where("command = 'stale'").select(F.col("target").alias("_source")).distinct()
    j = chunks.join(
        small(off), F.col("chunk_id").cast("string") == F.col("_chunk"), "left",
    ).join(small(old), F.col("source_id") == F.col("_source"), "left")
    return j.withColumns(
        {
            "disabled": F.coalesce("disabled", F.lit(False)) | F.col("_chunk").isNotNull(),
            "needs_review_at": F.when(F.col("_source").isNotNull(), as_of.cast("string")).otherwise(F.col("needs_review_at")),
        }
    ).drop("_chunk", "_source")


def backfill(df: DataFrame, col: str, others: list[str], as_of: Column) -> DataFrame:
    """``col`` where blank from the first other column that is not, else ``as_of``."""
    return df.withColumn(col, F.coalesce(T.blank_to_null(F.col(col)), *[T.blank_to_null(F.col(c)) for c in others], as_of.cast("string")))


def write_version(df: DataFrame, folder: str, version: int, partition_by: list[str] | None = None) -> None:
    """A whole table as version folder; readers of older versions are not disturbed."""
    w = df.write.mode("errorifexists")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(f"{folder}/version={version}")


def read_articles(spark: SparkSession, path: str, mapping: dict[str, list[str]]) -> DataFrame:
    """A CSV of articles (quoted fields may hold line breaks) under canonical names: each the first of its columns that is not
    blank; rows without content are dropped. Missing columns are blank."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    have = {c.lower(): c for c in raw.columns}
    def first(names: list[str]) -> Column:
        held = [T.blank_to_null(F.col(f"`{have[n.lower()]}`")) for n in names if n.lower() in have]
        return F.coalesce(*held, F.lit("")) if held else F.lit("")
    return raw.select(*[first(names).alias(out) for out, names in mapping.items()]).where("content <> ''")


def as_documents(articles: DataFrame, source_key: str) -> DataFrame:
    """Articles as documents with one section each and a row reference."""
    section = F.struct(
        F.lit("csv-main").alias("section_id"), F.col("title").alias("heading_path"), F.col("content").alias("text"),
        F.concat(F.lit("row "), F.col("id")).alias("row_ref"),
    )
    return articles.select("id", F.lit(source_key).alias("source_key"), "title", F.col("content").alias("body"), F.array(section).alias("sections"))


def read_jsonl(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, malformed lines) of a file of JSON lines. Malformed lines keep their text (``lines.malformed_json_lines``
    gives their numbers too); a value of another type than the schema's makes a line malformed."""
    full = StructType([*schema.fields]).add("_corrupt_record", "string")
    parsed = F.from_json("value", full, {"mode": "PERMISSIVE"})  # with an option all fields are parsed on both sides
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("_file"), parsed.alias("r")).where("trim(value) <> ''")
    return raw.where("r._corrupt_record IS NULL").select("r.*").drop("_corrupt_record"), raw.where("r._corrupt_record IS NOT NULL").select(
        "_file", "r._corrupt_record",
    )


def manifest_join(files: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files with their manifest row, files without one)."""
    return files.join(manifest, "file_name"), files.join(manifest, "file_name", "left_anti")


def selected_sources(sources: DataFrame) -> DataFrame:
    """Sources (source_key, file_name, enabled, is_demo) to load: enabled ones, never ticket history, custom ones instead of
    demo ones where there are any."""
    live = sources.where(F.col("enabled") & ~F.lower("file_name").contains("historical_tickets"))
    custom = live.agg((F.max((~F.col("is_demo")).cast("int")) == 1).alias("_c"))  # one row
    kept = live.join(F.broadcast(custom), F.lit(True)).where(~F.col("_c") | ~F.col("is_demo")).drop("_c")
    return kept.withColumn("category", F.when(F.lower("file_name").contains("release_note"), "release_note").otherwise("knowledge_base"))


def new_articles(fetched: DataFrame, known: DataFrame, product: str = "", most: int | None = None) -> DataFrame:
    """Fetched articles not yet known by url name, of a product if one is given."""
    out = fetched.join(known.select("url_name"), "url_name", "left_anti")
    out = out.where(F.contains(F.lower("title"), F.lit(product.lower()))) if product else out
    return out.orderBy("url_name").limit(most) if most else out


def export_jsonl(df: DataFrame, path: str, by: str, tie: str, most: int) -> None:
    df.orderBy(F.desc(by), tie).limit(most).write.mode("errorifexists").json(path)


def support_bundle(traces: DataFrame, secrets: list[str]) -> DataFrame:
    """Per trace the parts of a support bundle, redacted and with configured secret values masked."""
    def masked(c: Column) -> Column:
        c = T.redact(c)
        for s in secrets:
            c = F.replace(c, F.lit(s), F.lit("[masked]"))
        return c
    chunks = F.array_join(F.transform("chunks", lambda x: F.concat(F.lit("- **"), x["source_id"], F.lit("** "), x["preview"])), "\n")
    return traces.select(
        "trace_id", masked(F.to_json(F.struct("trace_id", "answer"))).alias("trace_json"),
        masked(chunks).alias("retrieved_markdown"), masked(F.col("answer")).alias("answer"),
    )
