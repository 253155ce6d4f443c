"""A corpus pipeline of five stages; each takes what its predecessor kept and returns what it keeps.

    language ID -> SimHash near-dedup -> suffix-array dedup -> source mixing -> byte-level BPE

``run`` writes each stage's result to the shared folder as Parquet and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deskgrain.llm import bpe, langid, mixing, near_copies, suffix
from deskgrain.llm.common import columns, table, unused, written

#: Documents whose language is less certain than this are rejected, as are those without a letter.
LEAST_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language the network can tell with a score of LEAST_SCORE or more.

    Null and empty texts and those without a letter are rejected, however long; all other columns may be null. Rows that
    repeat are judged alike and all kept or all rejected. Without any labelled text all is rejected; an empty table stays empty."""
    lang, score = unused(docs.columns, "lang_pred", "lang_score")
    found = langid.identify(docs, langid.fit(docs), out=(lang, score))
    return found.where((F.col(lang) != langid.UNKNOWN) & (F.col(score) >= LEAST_SCORE)).select(*columns(docs))


def row_keys(docs: DataFrame, names: list[str]) -> DataFrame:
    """``docs`` with two hashes of the whole row, named ``names``: only equal rows share both."""
    every = [*columns(docs), *[c.isNull() for c in columns(docs)]]  # hashing skips nulls
    return docs.withColumns({names[0]: F.xxhash64(*every), names[1]: F.xxhash64(F.lit(1), *every)})


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group linked by Jaccard similarities of 0.8 or more (shingles of five words; texts without a
    word are copies of each other): that of the smallest id, nulls last, and among rows of one id that of the smallest hash.

    Ids play no other part: texts that are no near copies are all kept, whatever ids they share, null included; equal rows
    are one. Null and empty texts are one group. An empty table stays empty."""
    key = unused(docs.columns, "k1", "k2")
    keyed = row_keys(docs, key)
    nodes = near_copies.apart(written(near_copies.nodes(keyed, ["doc_id", *key], words=5), "nodes"))
    roots = near_copies.roots(nodes, keyed, key, words=5)
    # the first row of each text, then of each group: many copies are one row before they meet
    first = nodes.groupBy("sid").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", *key)).alias("first"))
    kept = first.join(roots, "sid").groupBy("root").agg(F.min("first").alias("first")).select(*[F.col(f"first.{k}") for k in key])
    return keyed.join(kept, key, "left_semi").dropDuplicates(key).select(*columns(docs))


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts every string of 200 bytes or more that starts elsewhere too; documents of which nothing is left go.

    So do null and empty texts. Rows that repeat are copies of each other and lose all; n_chars follows the text. Shorter
    texts stay as they are; an empty table stays empty."""
    cut = suffix.dedup(docs, length=200)
    return cut.withColumn("n_chars", F.length("text").cast("long")).where("n_chars > 0").select(*columns(docs))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each source to its target: documents not taken go, documents taken twice are there twice.

    A null source is a source; null and empty texts have no words and are taken by their hash like others; rows of one id
    and source are taken alike; an empty table stays empty."""
    times, copy = unused(docs.columns, "times", "copy")
    taken = mixing.mix(docs, weights=(3, 1, 2), share=1.5, cap=2.0, out=times).where(F.col(times) > 0)
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*columns(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of every document that is left, with their number and digests; decoding them gives the text again.

    A null or empty text has no tokens; rows may repeat; an empty table gives an empty result."""
    import public_tokenizers

    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("language ID", language),
    ("SimHash near-dedup", near_dedup),
    ("suffix-array dedup", passage_dedup),
    ("source mixing", mixing_stage),
    ("byte-level BPE", tokens),
]

#: Fingerprints, the network and the merges have no SQL form; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.split()[0].lower())
    return docs
