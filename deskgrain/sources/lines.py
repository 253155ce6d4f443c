"""Line and row numbers of files that many tasks read.

A file is read in splits, and a task sees only its own. One pass counts in each split the lines, and for CSV the quotation marks and the
records that would start in it if it began outside or inside quotes. Running sums over the splits of a file (a row a split) then say with
which line, which record and inside or outside of quotes each split begins, and a second pass numbers lines in place. Texts do not move,
but for records that cross from one split into the next.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window

from deskgrain.functions.frames import small, written

#: Splits whose sums are sent to every task; of more splits (more than 12 TB of 128 MB each) the lines meet their sums by a shuffle.
SPLITS = 100_000
#: Characters of a CSV record at most; a longer one (a quotation mark that nothing closes) is listed as malformed.
RECORD = 16 << 20


def _scan(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """(file, start, at, value): lines with their file and split; ``at`` rises within a split."""
    reader = spark.read.option("lineSep", sep) if sep else spark.read
    return reader.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("at"), "value",
    )


def _with_sums(lines: DataFrame, sums: DataFrame) -> DataFrame:
    """``lines`` with the sums of their split, the lines of a split still together and in order."""
    if sums.limit(SPLITS + 1).count() <= SPLITS:
        return lines.join(F.broadcast(sums), ["file", "start"])
    return lines.join(sums.hint("shuffle_hash"), ["file", "start"]).sortWithinPartitions("file", "start", "at")


def _before(*by: str) -> Window:
    return Window.partitionBy(*by).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): all lines of text files, numbered from 1 in each file. Empty lines count; an empty file has none."""
    lines = _scan(spark, path)
    splits = lines.groupBy("file", "start").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    sums = splits.select("file", "start", "first", F.coalesce(F.sum("n").over(_before("file")), F.lit(0)).alias("lines_before"))
    return _with_sums(lines, sums).select("file", (F.col("lines_before") + F.col("at") - F.col("first") + 1).alias("line"), "value")


def malformed_json_lines(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """(file, line, value): the lines that are no JSON objects of ``schema``, blank ones left out, with their numbers."""
    full = StructType([*schema.fields, StructField("_corrupt_record", StringType())])
    # without an option the parser would be asked for the corrupt record alone, and take a value of another type for a good one
    parsed = numbered_lines(spark, path).where("trim(value) <> ''").withColumn("r", F.from_json("value", full, {"mode": "PERMISSIVE"}))
    return parsed.where("r._corrupt_record IS NOT NULL").select("file", "line", "value")


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """The parts of a batch (file, start, ...) that belong to one split."""
    file, start = batch.column(0).dictionary_encode().indices.to_numpy(), batch.column(1).to_numpy()
    cuts = [0, *(np.flatnonzero((np.diff(file) != 0) | (np.diff(start) != 0)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield (batch.column(0)[a].as_py(), int(start[a])), batch.slice(a, b - a)


def _marks(value: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each line whether it has an odd number of quotation marks, and whether it is blank."""
    odd = pc.count_substring(value, '"').to_numpy(zero_copy_only=False) % 2
    return odd, pc.is_in(value, pa.array(["", "\r"])).to_numpy(zero_copy_only=False)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, start, lines, odd, outside, inside, head) of each part of a split: its lines, whether it turns quotes over, the records that
    start in it, by how it begins, and the first record of the file."""
    split, odd_so_far, head, headed = None, 0, [], False
    for batch in batches:
        out = []
        for key, run in _runs(batch):
            if key != split:
                split, odd_so_far, head, headed = key, 0, [], False
            odd, blank = _marks(run.column(2))
            before = (odd_so_far + np.cumsum(odd) - odd) % 2
            turned = odd_so_far
            odd_so_far = int((odd_so_far + odd.sum()) % 2)
            found = None
            if key[1] == 0 and not headed:
                for text, inside, empty, o in zip(run.column(2), before, blank, odd):
                    if head or not empty:
                        head.append(text.as_py())
                        headed = bool((inside + o) % 2 == 0)
                    if headed:
                        found = "\n".join(head).removesuffix("\r")
                        break
            # a split that begins inside quotes has outside what one that begins outside has inside
            out.append((*key, run.num_rows, turned ^ odd_so_far, int(((before == 0) & ~blank).sum()), int(((before == 1) & ~blank).sum()), found))
        types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        names = ["file", "start", "lines", "odd", "outside", "inside", "head"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * 7, types)], names=names)


def _cut(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """(file, line, row, text, whole): records that begin and end in a split, and the pieces of those that do not."""
    names, types = ["file", "line", "row", "text", "whole"], [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
    split, held = None, []  # lines of the record that is open
    line = row = inside = first = size = 0
    begun = False

    def piece(whole: bool):
        return split[0], first, row, "\n".join(held) if size <= most else None, whole

    for batch in batches:
        out = []
        for key, run in _runs(batch):
            if key != split:
                if held:
                    out.append(piece(False))
                split, held, size = key, [], 0
                line, row, inside = (run.column(i)[0].as_py() for i in (3, 4, 5))
                begun = not inside  # whether the open record began in this split
            odd, blank = _marks(run.column(2))
            for text, o, empty in zip(run.column(2).to_pylist(), odd.tolist(), blank.tolist()):
                line += 1
                if not inside and not held:
                    if empty:
                        continue
                    row, begun = row + 1, True
                if not held:
                    first = line
                size += len(text) + 1
                held.append(text)
                if size > most:
                    held = [""]
                inside ^= o
                if not inside:
                    out.append(piece(begun))
                    held, size = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * 5, types)], names=names)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(piece(False), types)], names=names)


def csv_records(spark: SparkSession, path: str, most: int = RECORD) -> tuple[DataFrame, DataFrame]:
    """(records, malformed) of CSV files whose quoted fields may hold line breaks and doubled quotation marks.

    Records: file, row_number (from 1, without the header), line (of the record's first line), names (of its file's header, lower case) and
    values, both arrays. Blank lines are no records. Malformed: file, row_number, line and reason, for records of more than ``most`` characters and all
    records of a file whose header does not end in its first split. A quotation mark inside an unquoted field opens a quote here."""
    lines = _scan(spark, path, "\n")
    counted = lines.select("file", "start", "value").mapInArrow(
        _count, "file string, start long, lines long, odd long, outside long, inside long, head string",
    ).groupBy("file", "start").agg(
        F.sum("lines").alias("lines"), (F.sum("odd") % 2).alias("odd"), F.sum("outside").alias("outside"), F.sum("inside").alias("inside"),
        F.max("head").alias("head"),
    )
    zero = F.lit(0).cast("long")
    turned = counted.withColumn("inside_at", F.coalesce(F.sum("odd").over(_before("file")), zero) % 2)
    starts = F.when(F.col("inside_at") == 0, F.col("outside")).otherwise(F.col("inside"))
    sums = turned.withColumn("records", starts).select(
        "file", "start", F.coalesce(F.sum("lines").over(_before("file")), zero).alias("lines_before"),
        F.coalesce(F.sum("records").over(_before("file")), zero).alias("rows_before"), "inside_at",
        F.max("head").over(Window.partitionBy("file")).alias("head"),
    )
    sums = written(sums, "csv-splits")
    pieces = _with_sums(lines, sums.drop("head")).select("file", "start", "value", "lines_before", "rows_before", "inside_at").mapInArrow(
        lambda batches: _cut(batches, most), "file string, line long, row long, text string, whole boolean",
    )
    crossing = pieces.where("not whole").groupBy("file", "row").agg(
        F.sort_array(F.collect_list(F.struct("line", "text"))).alias("p"), F.sum(F.length("text")).alias("chars"),
        F.count_if(F.col("text").isNull()).alias("long"),
    )
    joined = F.when((F.col("long") == 0) & (F.col("chars") <= most), F.array_join(F.col("p.text"), "\n"))
    records = pieces.where("whole").select("file", "line", "row", "text").unionByName(
        crossing.select("file", F.col("p")[0]["line"].alias("line"), "row", joined.alias("text"))
    )
    heads = sums.where("start = 0").select("file", "head")
    width = heads.agg(F.max(F.regexp_count("head", F.lit(","))).alias("w")).first()["w"]
    shape = ", ".join(f"c{i} string" for i in range((width or 0) + 1))

    def fields(c: Column) -> Column:
        parsed = F.from_csv(F.regexp_replace(c, "\r$", ""), shape, {"quote": '"', "escape": '"', "maxCharsPerColumn": "-1"})
        return F.array(*[parsed[f"c{i}"] for i in range((width or 0) + 1)])

    names = small(heads.select("file", "head", F.transform(fields(F.col("head")), lambda x: F.lower(F.trim(x))).alias("names")))
    met = records.where("row > 1").join(names, "file", "left").withColumn("row_number", F.col("row") - 1)
    good = F.col("text").isNotNull() & F.col("head").isNotNull()
    reason = F.when(F.col("head").isNull(), "no header in the first split").otherwise("record too long")
    return met.where(good).select("file", "row_number", "line", "names", fields(F.col("text")).alias("values")), met.where(~good).select(
        "file", "row_number", "line", reason.alias("reason"),
    )


# Columns that stand for a field of a document, in order, if no mapping names one.
FALLBACKS = {
    "title": ("title", "policy_name", "issue_title"), "body": ("content", "body", "symptoms", "customer_message"), "url": ("url",),
    "product": ("product",), "platform": ("platform", "affected_platform"), "role": ("role", "permission"),
    "version_or_date": ("version", "release_date", "updated_at"), "applies_when": ("applies_when", "workaround"),
    "source_license": ("source_license",), "attribution_required": ("attribution_required",), "attribution_text": ("attribution_text",),
    "status": ("status",),
}
TRUE_WORDS = ("1", "true", "yes", "required")


def csv_documents(
    records: DataFrame, source_key: str, source_type: str | None = None, mapping: dict[str, str] | None = None,
) -> DataFrame:
    """Records of ``csv_records`` as documents. A field is that of its column, or of the column that ``mapping`` names for it where the file
    has that one; with several columns the first that is not blank, without white space around it. Missing fields are blank. A
    document has one section, or none where title and body are blank."""
    mapped = {k.lower(): v.lower() for k, v in (mapping or {}).items()}

    def held(column: str) -> Column:
        own, other = F.array_position("names", F.lit(column)), F.array_position("names", F.lit(mapped.get(column, column)))
        place = F.when(other > 0, other).otherwise(own)
        return F.when(place > 0, F.get("values", (place - 1).cast("int")))

    def first(columns: tuple[str, ...]) -> Column:
        if len(columns) == 1:
            return F.coalesce(held(columns[0]), F.lit(""))
        return F.coalesce(*[F.nullif(F.btrim(held(c), F.lit(" \t\n\r\v\f")), F.lit("")) for c in columns], F.lit(""))

    docs = records.select(
        "file", "row_number", "line", F.lit(source_key).alias("source_key"), F.lit(source_type or source_key).alias("source_type"),
        *[first(c).alias(out) for out, c in FALLBACKS.items()], F.struct("names", "values").alias("raw_row"),
    ).withColumn("attribution_required", F.lower(F.trim("attribution_required")).isin(*TRUE_WORDS))
    text = F.array_join(F.filter(F.array("title", "body"), lambda x: x != ""), "\n\n")
    section = F.struct(
        F.concat(F.lit("row-"), F.col("row_number")).alias("section_id"), F.col("title").alias("heading_path"), text.alias("text"),
        F.col("row_number").cast("string").alias("row_ref"),
    )
    none = F.array().cast("array<struct<section_id:string,heading_path:string,text:string,row_ref:string>>")
    return docs.withColumn("sections", F.when(text != "", F.array(section)).otherwise(none))
