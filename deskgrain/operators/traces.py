"""Stored JSON traces: listings, diagnoses and support bundles.

A trace table has trace_id, created_at and ``trace``, its JSON text. The text is parsed once, into a variant, and typed paths are
read from it; a path that is missing, null or of another type counts as not there, and a trace that is no JSON as one of no
fields. Nothing groups or sorts but the listings, which keep the newest few.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The parts of a bundle, the mark of a masked secret, and the length from which a secret is masked.
PARTS = ("trace.json", "logs.jsonl", "retrieved_chunks.md", "final_answer.md", "validation_report.json", "config_snapshot.json")
SECRET_MARK, LEAST_SECRET = "[REDACTED_SECRET]", 4
SNAPSHOT = ("config_hash", "model_provider", "workflow_mode", "product", "platform", "role")

#: Characters that a task reads from files before it hands them on, about.
BATCH_CHARS = 4 << 20

#: A string of JSON with the colon behind it if it is a name, or what lies between strings. Possessive, so of any length.
JSON_PIECE = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"\s*+:?|[^"]++'


def parsed(traces: DataFrame) -> DataFrame:
    """``traces`` with ``v``, the trace as a variant; null if it is null or no JSON."""
    return traces.withColumn("v", F.try_parse_json("trace"))


def _at(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _text(v: Column, *paths: str) -> Column:
    """The first of ``paths`` that holds a text which is not empty, else an empty one."""
    found = [_at(v, p) for p in paths]
    return F.coalesce(*[F.when(c != "", c) for c in found], F.lit(""))


def _list(v: Column, path: str, kind: str = "string") -> Column:
    return F.coalesce(_at(v, path, f"array<{kind}>"), F.array().cast(f"array<{kind}>"))


def _json(v: Column, path: str) -> Column:
    """JSON text of what is at ``path``; null if nothing is there or it is null, empty, zero or false."""
    text = F.to_json(_at(v, path, "variant"))
    return F.when(~text.isin("null", "[]", "{}", '""', "0", "false"), text)


def _citations(v: Column) -> Column:
    """The first list of citations with an element: the answer's, what the answer used, what the trace used."""
    none = F.array().cast("array<string>")
    held = [_list(v, p) for p in ("$.final_response.citations", "$.final_response.citations_used", "$.citations_used")]
    return F.coalesce(*[F.when(F.size(c) > 0, c) for c in held], none)


def answer(v: Column) -> Column:
    return _text(v, "$.final_response.draft_email", "$.final_response.answer_text", "$.final_response.raw")


def listing(traces: DataFrame, most: int = 50) -> DataFrame:
    """The newest traces with their ticket's preview, user, product, platform, role, configuration, confidence, why no draft is
    there, and the number of retrieved chunks. Only these are parsed."""
    t = parsed(traces.orderBy(F.desc_nulls_last("created_at"), "trace_id").limit(most))
    v = F.col("v")
    return t.select(
        "trace_id", "created_at", _text(v, "$.redacted_ticket_preview").alias("ticket_preview"),
        *[_text(v, f"$.{f}").alias(f) for f in ("user_id", "config_hash", "product", "platform", "role")],
        _text(v, "$.final_response.confidence").alias("confidence"),
        _text(v, "$.final_response.draft_unavailable_reason").alias("draft_unavailable_reason"),
        F.size(_list(v, "$.reranked_results", "variant")).alias("retrieved_result_count"),
    )


def drafts(traces: DataFrame, most: int = 50) -> DataFrame:
    """The newest drafts: preview, confidence band, validation status, citations and sources, as the trace tells them."""
    newest = traces.orderBy(F.desc_nulls_last("created_at"), "trace_id").limit(most)
    return diagnosis_runs(newest, "created_at").select(
        F.col("draft_run_id").alias("id"), "trace_id", F.col("ticket_preview_redacted").alias("ticket_preview"),
        F.col("confidence_band"), "validation_status", "citations_used", "source_ids", "config_hash", "created_at",
    )


def diagnosis_runs(traces: DataFrame, *more: str) -> DataFrame:
    """The run row of every trace's diagnosis, and the columns ``more`` of ``traces``. The trace's own id counts, the table's where it has none."""
    t = parsed(traces)
    v = F.col("v")
    chunks = _list(v, "$.reranked_results", "variant")
    sources = F.array_sort(F.array_distinct(F.filter(F.transform(chunks, lambda c: _text(c, "$.source_id")), lambda s: s != "")))
    own = F.coalesce(F.when(_text(v, "$.trace_id") != "", _text(v, "$.trace_id")), F.col("trace_id"))
    draft = _text(v, "$.final_response.draft_run_id", "$.draft_run_id")
    return t.select(
        F.when(draft != "", draft).otherwise(own).alias("run_id"), draft.alias("draft_run_id"), own.alias("trace_id"),
        _text(v, "$.user_id").alias("user_id"), _text(v, "$.ticket_text_hash").alias("ticket_hash"),
        _text(v, "$.redacted_ticket_preview").alias("ticket_preview_redacted"), _text(v, "$.timestamp").alias("timestamp"),
        F.when(_json(v, "$.errors").isNotNull(), "error").otherwise("ok").alias("status"),
        _text(v, "$.final_response.confidence_band", "$.final_response.confidence").alias("confidence_band"),
        _text(v, "$.validation_output.status").alias("validation_status"), answer(v).alias("answer"),
        _citations(v).alias("citations_used"), F.size(chunks).alias("chunks_retrieved"),
        F.size(_list(v, "$.evidence_sent_to_llm.chunks", "variant")).alias("chunks_sent_to_llm"), sources.alias("source_ids"),
        _list(v, "$.warnings").alias("warnings"), _list(v, "$.errors").alias("errors"),
        _text(v, "$.final_response.agent_action").alias("feedback_action"),
        _list(v, "$.final_response.knowledge_issue_ids").alias("knowledge_issue_ids"), _text(v, "$.config_hash").alias("config_hash"), *more,
    )


def diagnosis_chunks(traces: DataFrame) -> DataFrame:
    """One row for each retrieved chunk of a trace, ranked from 1: ids, versions, score, whether it was in the prompt and cited
    (by its source or itself), and its safety fields. A chunk is in the prompt and active, and not approved or for
    customers, where nothing is said; a null ``used_in_prompt`` says no."""
    t = parsed(traces).select("trace_id", _citations(F.col("v")).alias("cited"), F.posexplode(_list(F.col("v"), "$.reranked_results", "variant")).alias("pos", "c"))
    c = F.col("c")

    def flag(name: str, default: bool) -> Column:
        return F.coalesce(_at(c, f"$.{name}", "boolean"), F.lit(default))

    def version(name: str) -> Column:
        return F.coalesce(_at(c, f"$.{name}", "int"), F.lit(1)).alias(name)

    null = F.coalesce(F.is_variant_null(_at(c, "$.used_in_prompt", "variant")), F.lit(False))
    source, chunk = F.coalesce(_at(c, "$.source_id"), F.lit("")), F.coalesce(_at(c, "$.id"), F.lit(""))
    return t.select(
        "trace_id", (F.col("pos") + 1).alias("rank"), chunk.alias("chunk_id"), source.alias("source_id"),
        F.coalesce(_at(c, "$.document_id"), F.lit("")).alias("document_id"), version("document_version"), version("chunk_version"),
        F.coalesce(_at(c, "$.score", "double"), _at(c, "$.rerank_score", "double"), F.lit(0.0)).alias("score"),
        F.when(null, False).otherwise(flag("used_in_prompt", True)).alias("used_in_prompt"),
        (F.array_contains("cited", source) | F.array_contains("cited", chunk)).alias("citation_used"),
        flag("is_active", True).alias("is_active"), flag("is_approved", False).alias("is_approved"),
        flag("is_customer_facing_allowed", False).alias("is_customer_facing_allowed"),
        *[F.coalesce(_at(c, f"$.{n}"), F.lit("")).alias(n) for n in ("expires_at", "needs_review_at")],
    )


def masked_text(c: Column, secrets: list[str]) -> Column:
    """``c`` with every secret of at least four characters masked, the longest first."""
    for s in sorted((s for s in secrets if len(s) >= LEAST_SECRET), key=lambda s: (-len(s), s)):
        c = F.replace(c, F.lit(s), F.lit(SECRET_MARK))
    return c


def _in_json(secret: str) -> str:
    """The secret as a string of JSON holds it."""
    plain = json.dumps(secret, ensure_ascii=False)[1:-1]
    return re.sub(r"\\u00([0-9a-f]{2})", lambda m: "\\u00" + m[1].upper(), plain)


def masked_json(c: Column, secrets: list[str]) -> Column:
    """JSON text with the secrets masked in every string at any depth; names, numbers and what holds them stay as they are."""
    held = [_in_json(s) for s in secrets if len(s) >= LEAST_SECRET]
    if not held:
        return c

    def piece(p: Column) -> Column:
        return F.when(p.startswith('"') & ~p.endswith(":"), masked_text(p, held)).otherwise(p)

    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(JSON_PIECE), 0), piece), "")


def bundle(traces: DataFrame, secrets: list[str]) -> DataFrame:
    """(trace_id, part, value): the six parts of every trace's support bundle. Secrets are masked in every string of the JSON parts
    and anywhere in the others. The names in JSON are in alphabetical order."""
    v = F.col("v")
    chunks = _list(v, "$.reranked_results", "variant")
    shown = F.transform(
        chunks,
        lambda c: F.concat(F.lit("### "), F.coalesce(_at(c, "$.id"), F.lit("")), F.lit("\n"), F.coalesce(_at(c, "$.content_preview"), F.lit(""))),
    )
    # a line for each stage is text: names in it are masked too
    lines = F.transform(_list(v, "$.stage_events", "variant"), lambda e: masked_text(F.to_json(e), [_in_json(s) for s in secrets]))
    checks = F.coalesce(_json(v, "$.validation_output"), _json(v, "$.final_response.validation"), F.lit("{}"))
    config = F.to_json(F.struct(*[_text(v, f"$.{n}").alias(n) for n in SNAPSHOT]))
    values = (
        masked_json(F.coalesce(F.to_json(v), F.lit("{}")), secrets), F.array_join(lines, "\n"),
        masked_text(F.array_join(shown, "\n\n"), secrets), masked_text(answer(v), secrets), masked_json(checks, secrets), masked_json(config, secrets),
    )
    parts = F.array(*[F.struct(F.lit(n).alias("part"), x.alias("value")) for n, x in zip(PARTS, values, strict=True)])
    return parsed(traces).select("trace_id", F.explode(parts).alias("p")).select("trace_id", "p.*")


def _local(spark: SparkSession, path: str) -> str | None:
    """The name of a folder that is mounted on every machine (``file:``); None for any other store."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


#: Characters that names of partition folders hold as %XX.
_ESCAPED = {i: f"%{i:02X}" for i in [*range(1, 32), *map(ord, "\"#%'*/:=?\\{[]^"), 127]}


def _folder(name: str | None) -> str:
    """A value as the name of a partition's folder has it."""
    return name.translate(_ESCAPED) if name else "__HIVE_DEFAULT_PARTITION__"


def _write_files(root: str):
    """Sorted (trace_id, part, value) to a file for each trace and part under ``root``, one line a row; gives the number of files. A task
    that runs again writes the same files, each renamed into place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, key, lines = 0, None, []

        def close() -> None:
            folder = f"{root}/trace_id={_folder(key[0])}/part={_folder(key[1])}"
            os.makedirs(folder, exist_ok=True)
            own = f"{folder}/.{uuid.uuid4().hex}"
            with open(own, "wb") as f:
                f.writelines(lines)
            os.replace(own, f"{folder}/part-00000.txt")

        for b in batches:
            for trace, part, value in zip(*[c.to_pylist() for c in b.columns]):
                if (trace, part) != key:
                    if key:
                        close()
                    key, lines, files = (trace, part), [], files + 1
                lines.append((value or "").encode() + b"\n")
        if key:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([files], pa.int64())], names=["files"])

    return run


def write_bundles(parts: DataFrame, path: str) -> None:
    """Writes each part as a file, path/trace_id=.../part=.../. The six parts of a trace are written by one task, so that each is one
    file; tasks take traces by hash, and none holds more than the row it writes. Opening files is the work, not their bytes, so the
    number of tasks is given, which adaptive execution does not lower.

    To a mounted folder the tasks write by themselves, as Hadoop's local file system starts a process for the mode of every file and
    folder; the whole is renamed into place when all are there. Any other store is written by Spark's text sink."""
    spark = parts.sparkSession
    dealt = parts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "trace_id").sortWithinPartitions("trace_id", "part")
    root = _local(spark, path)
    if root is None:
        dealt.write.mode("errorifexists").partitionBy("trace_id", "part").text(path)
        return
    fs, made = spark._jvm.org.apache.hadoop.fs, f"{root}.{uuid.uuid4().hex}"
    local = fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if local.exists(fs.Path(path)):
        raise FileExistsError(path)
    local.mkdirs(fs.Path(f"file://{made}"))
    dealt.select("trace_id", "part", "value").mapInArrow(_write_files(made), "files long").agg(F.sum("files")).collect()
    if not local.rename(fs.Path(f"file://{made}"), fs.Path(path)):
        raise OSError(f"{path} cannot be made")


def _named(folder: str) -> str | None:
    """The value that the name of a partition's folder stands for."""
    name = folder.partition("=")[2]
    return None if name == "__HIVE_DEFAULT_PARTITION__" else unquote(name)


def _read_files(root: str, tasks: int):
    """Numbers of tasks to (trace_id, part, value) of the files in their shares of the folders under ``root``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=["trace_id", "part", "value"])

        mine = {i for b in batches for i in b.column(0).to_pylist()}
        for trace in (x.path for x in os.scandir(root) if x.name.startswith("trace_id=") and zlib.crc32(x.name.encode()) % tasks in mine):
            for part in (x.path for x in os.scandir(trace) if x.name.startswith("part=")):
                for file in (x.path for x in os.scandir(part) if x.name[0] not in "._"):
                    with open(file, "rb") as f:
                        value = f.read().removesuffix(b"\n").decode()
                    rows.append((_named(os.path.basename(trace)), _named(os.path.basename(part)), value))
                    size += len(value)
                    if size > BATCH_CHARS or len(rows) >= 10_000:
                        yield batch()
                        rows, size = [], 0
        if rows:
            yield batch()

    return run


def read_bundles(spark, path: str) -> DataFrame:
    """(trace_id, part, value) of written bundles. In a mounted folder each task lists the traces and reads a share of them; else Spark
    lists all files, which the driver keeps, and gives a task few of them, however small, so that tasks are put together."""
    tasks, root = int(spark.conf.get("spark.sql.shuffle.partitions")), _local(spark, path)
    if root is not None:
        return spark.range(0, tasks, 1, tasks).mapInArrow(_read_files(root, tasks), "trace_id string, part string, value string")
    whole = spark.read.schema("value string, trace_id string, part string").text(path, wholetext=True)
    return whole.coalesce(tasks).select("trace_id", "part", F.regexp_replace("value", "\n\\z", "").alias("value"))
