"""A stored inverted index for BM25: built once, extended by batches, searched without reading a text.

    <folder>/data/batch=B/bucket=N    postings: term, block, packed places and counts, and the block's best (count, length) pairs;
                                      bucket -1 holds the blocks themselves: chunk ids and lengths
    <folder>/terms/batch=B/bucket=N   in how many chunks of the batch each term is
    <folder>/stats/batch=B            chunks and words of each scope
    <folder>/histogram/version=V      how many terms are in how many chunks, over all batches
    <folder>/manifest/version=V       the live batches; written last, so a batch that failed half-way is never read

A block is up to BLOCK neighbouring chunks of one scope in the order a task reads them, so building moves postings only. Impact
depends on the mean length, which later batches change; so a block keeps, for each term, the pairs of count and length that no
other pair beats, from which its largest impact follows under any mean. A search adds these bounds up for each question and
block, scores the few blocks of the highest bounds, and then only those whose bound reaches the k-th score found there.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S
from pyspark.sql.window import Window

from deskgrain.functions.frames import small, written

from .retrieval import tokens, top_k

#: Chunks of a block, and bytes of their texts, at most (one chunk at least).
BLOCK, BLOCK_BYTES = 256, 4 << 20
#: Parts that terms are dealt into by hash; parts that the blocks of a term are dealt into where questions are too many to broadcast.
BUCKETS, SALTS = 32, 16
#: Blocks of the highest bounds that a question scores first.
FIRST = 3
#: Scores are rounded to six places: a block may reach a score that its bound misses by less.
MARGIN = 2e-6

_words = re.compile(r"[^ \t\n\x0B\f\r]+").findall


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _best(pairs: dict[int, int]) -> list[tuple[int, int]]:
    """Of counts with their least lengths those that no higher count with a length as small or smaller beats."""
    kept, least = [], None
    for tf in sorted(pairs, reverse=True):
        if least is None or pairs[tf] < least:
            least = pairs[tf]
            kept.append((tf, least))
    return kept


def _block_rows(scope: str, block: int, ids: list, counts: list[Counter], names: list[str], schema: pa.Schema) -> pa.RecordBatch:
    """The row of a block and those of its terms."""
    lengths = [sum(c.values()) for c in counts]
    held: dict[str, tuple[list[int], list[int], dict[int, int]]] = defaultdict(lambda: ([], [], {}))
    for place, c in enumerate(counts):
        for term, tf in c.items():
            places, tfs, best = held[term]
            places.append(place)
            tfs.append(tf)
            best[tf] = min(best.get(tf, lengths[place]), lengths[place])
    best = [_best(h[2]) for h in held.values()]
    columns = {
        "scope": [scope] * (len(held) + 1), "block": [block] * (len(held) + 1), "term": [None, *held],
        "place": [None, *(h[0] for h in held.values())], "tf": [None, *(h[1] for h in held.values())],
        "best_tf": [None, *([p[0] for p in b] for b in best)], "best_dl": [None, *([p[1] for p in b] for b in best)],
        "ids": [ids, *[None] * len(held)], "dl": [lengths, *[None] * len(held)],
    }
    return pa.RecordBatch.from_arrays([pa.array(columns[n], schema.field(n).type) for n in names], schema=schema)


def _built(chunks: DataFrame, scope: str | None) -> DataFrame:
    kind = chunks.schema["chunk_id"].dataType
    ints = S.ArrayType(S.IntegerType())
    fields = {
        "scope": S.StringType(), "block": S.LongType(), "term": S.StringType(), "place": ints, "tf": ints, "best_tf": ints,
        "best_dl": ints, "ids": S.ArrayType(kind), "dl": ints,
    }
    schema = S.StructType([S.StructField(n, t) for n, t in fields.items()])
    names = list(fields)
    s = F.col(scope).cast("string") if scope else F.lit("")
    given = chunks.select(s.alias("scope"), "chunk_id", F.lower(F.coalesce("text", F.lit(""))).alias("text")).where("scope IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        open_: dict[str, tuple[list, list[Counter], list[int]]] = {}
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for sc, cid, text in zip(*[c.to_pylist() for c in batch.columns]):
                ids, counts, size = open_.setdefault(sc, ([], [], [0]))
                ids.append(cid)
                counts.append(Counter(_words(text)))
                size[0] += len(text)
                if len(ids) >= BLOCK or size[0] >= BLOCK_BYTES:
                    yield _block_rows(sc, block, ids, counts, names, arrow)
                    block += 1
                    del open_[sc]
        for sc, (ids, counts, _) in open_.items():
            yield _block_rows(sc, block, ids, counts, names, arrow)
            block += 1

    return given.mapInArrow(run, schema).withColumn("bucket", F.when(F.col("term").isNull(), -1).otherwise(_bucket(F.col("term"))))


def _version(spark: SparkSession, folder: str) -> tuple[int, list[str]]:
    """The newest version and its batches; version 0 and none where there is no index yet."""
    try:
        live = spark.read.schema("batch string, version int").parquet(f"{folder}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0, []
    newest = live.agg(F.max("version")).first()[0] or 0
    return newest, sorted(r["batch"] for r in live.where(F.col("version") == newest).collect() if r["batch"])


def add(chunks: DataFrame, folder: str, scope: str | None = None) -> str:
    """Adds ``chunks`` (chunk_id, text and the column ``scope``, if one is named) to the index in ``folder``, which the first batch
    makes, and returns the name of the batch.

    Ids must be new to the index; rows of a null scope are left out, null texts are chunks without words. An empty table adds an
    empty batch. A batch counts only once its version of the manifest is there; one writer at a time."""
    spark = chunks.sparkSession
    version, live = _version(spark, folder)
    batch = uuid.uuid4().hex
    made = _built(chunks, scope).hint("rebalance", "bucket")  # a file or few for each bucket, large ones split by their size
    made.write.partitionBy("bucket").parquet(f"{folder}/data/batch={batch}")
    live.append(batch)
    data = _data(spark, folder, [batch], chunks.schema["chunk_id"].dataType)
    terms = data.where("bucket >= 0").groupBy("scope", "term", "bucket").agg(F.sum(F.size("place")).alias("df"))
    terms.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{folder}/terms/batch={batch}")
    words = F.aggregate("dl", F.lit(0).cast("long"), lambda a, x: a + x)
    stats = data.where("bucket = -1").groupBy("scope").agg(F.sum(F.size("ids")).alias("n"), F.sum(words).alias("words"))
    stats.coalesce(1).write.parquet(f"{folder}/stats/batch={batch}")  # a row for each scope
    total = _terms(spark, folder, live).groupBy("scope", "term").agg(F.sum("df").alias("df"))
    total.groupBy("scope", "df").agg(F.count("*").alias("terms")).hint("rebalance").write.parquet(f"{folder}/histogram/version={version + 1}")
    spark.createDataFrame([(b,) for b in live], "batch string").coalesce(1).write.parquet(f"{folder}/manifest/version={version + 1}")
    return batch


def _read(spark: SparkSession, path: str, schema: str, live: list[str]) -> DataFrame:
    return spark.read.schema(schema + ", batch string").parquet(path).where(F.col("batch").isin(live))


def _data(spark: SparkSession, folder: str, live: list[str], kind: S.DataType | str) -> DataFrame:
    kind = kind if isinstance(kind, str) else kind.simpleString()
    return _read(
        spark, f"{folder}/data",
        "scope string, block long, term string, place array<int>, tf array<int>, best_tf array<int>, best_dl array<int>, "
        f"ids array<{kind}>, dl array<int>, bucket int", live,
    )


def _terms(spark: SparkSession, folder: str, live: list[str]) -> DataFrame:
    return _read(spark, f"{folder}/terms", "scope string, term string, df long, bucket int", live)


def _impact(tf: Column, dl: Column, avgdl: Column, k1: float, b: float) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def search(
    questions: DataFrame, folder: str, k: int = 20, k1: float = 1.5, b: float = 0.75, floor: float = 0.25, scope: str | None = None,
    id_type: str = "string",
) -> DataFrame:
    """(question_id, chunk_id, rank, score): the rows of ``retrieval.bm25`` for the chunks of the index in ``folder``.

    ``questions`` has question_id, question and the column ``scope`` if the index has scopes; ``id_type`` is the type of the chunks'
    ids. Only buckets of terms that are asked are read, only postings of blocks that may reach a question's best k are unpacked, and
    no text. An index without chunks, or a folder without an index, gives an empty result."""
    spark = questions.sparkSession
    version, live = _version(spark, folder)
    qtype = questions.schema["question_id"].dataType.simpleString()
    if not live:
        return spark.createDataFrame([], f"question_id {qtype}, chunk_id {id_type}, score double, rank int")
    data = _data(spark, folder, live, id_type)
    stats = _read(spark, f"{folder}/stats", "scope string, n long, words long", live).groupBy("scope").agg(
        F.sum("n").alias("n"), (F.sum("words") / F.sum("n")).alias("avgdl"),
    )
    histogram = spark.read.schema("scope string, df long, terms long, version int").parquet(f"{folder}/histogram").where(F.col("version") == version)
    raw = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    mean = histogram.join(stats, "scope").groupBy("scope").agg((F.lit(floor) * F.sum(raw * F.col("terms")) / F.sum("terms")).alias("low"))
    s = F.col(scope).cast("string") if scope else F.lit("")
    asked = questions.select(s.alias("scope"), "question_id", F.explode(tokens(F.col("question"))).alias("term"))
    asked = asked.groupBy("scope", "question_id", "term").agg(F.count("*").alias("times")).withColumn("bucket", _bucket(F.col("term")))
    wanted = small(asked.select("bucket", "scope", "term").distinct())
    df = _terms(spark, folder, live).join(wanted, ["bucket", "scope", "term"], "left_semi").groupBy("scope", "term").agg(F.sum("df").alias("df"))
    idf = df.join(stats, "scope").join(mean, "scope").select("scope", "term", "avgdl", F.when(raw < 0, F.col("low")).otherwise(raw).alias("idf"))
    weight = asked.join(idf, ["scope", "term"]).select(
        "question_id", "scope", "bucket", "term", "avgdl", (F.col("idf") * F.col("times")).alias("w"),
    )
    weight = written(weight, "bm25-asked")

    # a term that many ask and all blocks hold is dealt out by its blocks where the questions are too many to broadcast
    salt = F.pmod("block", F.lit(SALTS)).cast("int")
    dealt = small(weight.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), 20_000 * SALTS)
    tops = data.where("bucket >= 0").select("bucket", "scope", "term", "batch", "block", "best_tf", "best_dl", salt.alias("salt"))
    met = tops.join(dealt, ["bucket", "scope", "term", "salt"])
    most = F.array_max(F.zip_with("best_tf", "best_dl", lambda tf, dl: _impact(tf, dl, F.col("avgdl"), k1, b)))
    # what a term takes away counts as nothing
    bound = met.groupBy("question_id", "scope", "batch", "block").agg(F.sum(F.greatest(F.col("w") * most, F.lit(0.0))).alias("bound"))
    order = Window.partitionBy("question_id").orderBy(F.desc("bound"), "batch", "block")
    bound = written(bound.withColumn("nth", F.row_number().over(order)), "bm25-bounds")

    first = written(_scored(bound.where(F.col("nth") <= FIRST), weight, data, k, k1, b, qtype, id_type), "bm25-first")
    least = first.groupBy("question_id").agg(F.when(F.count("*") >= k, F.get(F.sort_array(F.collect_list("score"), False), F.lit(k - 1))).alias("least"))
    rest = bound.where(F.col("nth") > FIRST).join(least, "question_id", "left")
    rest = rest.where(F.col("least").isNull() | (F.col("bound") + MARGIN >= F.col("least")))
    return top_k(first.unionByName(_scored(rest, weight, data, k, k1, b, qtype, id_type)), k).select("question_id", "chunk_id", "score", "rank")


def _scored(pairs: DataFrame, weight: DataFrame, data: DataFrame, k: int, k1: float, b: float, qtype: str, id_type: str) -> DataFrame:
    """(question_id, chunk_id, score): the best ``k`` chunks of each pair of a question and a block."""
    at = ["scope", "batch", "block"]
    # written, so that its size is known when the join is planned, and nothing above it runs twice
    asked = written(pairs.select("question_id", *at).join(weight, ["question_id", "scope"]), "bm25-pairs")
    held = data.where("bucket >= 0").select("bucket", "term", *at, "place", "tf").join(asked, ["bucket", "term", *at])
    each = held.groupBy("question_id", "avgdl", *at).agg(F.collect_list(F.struct("w", "place", "tf")).alias("hits"))  # bounded by the block
    met = each.join(data.where("bucket = -1").select(*at, "ids", "dl"), at).select("question_id", "avgdl", "hits", "ids", "dl")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            for q, avgdl, hits, ids, dl in zip(*batch.columns):
                norm = k1 * (1 - b + b * np.asarray(dl.values, np.float64) / avgdl.as_py())
                score, seen = np.zeros(len(norm)), np.zeros(len(norm), bool)
                found = hits.values
                for w, place, tf in zip(found.field("w").to_numpy(), found.field("place"), found.field("tf")):
                    place, tf = np.asarray(place.values), np.asarray(tf.values, np.float64)
                    score[place] += w * (tf * (k1 + 1) / (tf + norm[place]))
                    seen[place] = True
                score, rows = np.round(score, 6), np.flatnonzero(seen)
                if len(rows) > k:
                    rows = rows[score[rows] >= np.partition(score[rows], -k)[-k]]
                names = ids.values.take(pa.array(rows)).to_pylist()
                best = sorted(zip((-score[rows]).tolist(), names))[:k]
                out[0] += [q.as_py()] * len(best)
                out[1] += [n for _, n in best]
                out[2] += [-x for x, _ in best]
            types = batch.schema.field("question_id").type, batch.schema.field("ids").type.value_type, pa.float64()
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], names=["question_id", "chunk_id", "score"])

    return met.mapInArrow(run, f"question_id {qtype}, chunk_id {id_type}, score double")
