"""URL filter: a blocked Bloom filter of the listed canonical URLs, then an exact hash join.

A rule (host, path) fits a URL of that host or a subdomain of it whose path starts with the rule's path. Rules come in
few shapes (labels in the host, characters in the path), so a URL has one canonical key for each shape that could be
listed. The Bloom filter, 512-bit blocks of eight 64-bit words with one bit set in each, drops nearly all keys; the few
that pass meet the list itself in an equi-join, which removes false positives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small, written

WORDS, BITS_PER_KEY = 8, 16

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty for null or without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _bits(key: Column) -> list[Column]:
    h = F.xxhash64(key, F.lit(1))
    return [F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(WORDS)]


def _block(key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n).cast("long"))


def bloom(keys: DataFrame, n_blocks: int) -> DataFrame:
    """Blocks (block, w0..w7) of the filter over column ``key``; at most ``n_blocks`` rows."""
    one = F.lit(1).cast("long")
    bits = keys.select(
        _block(F.col("key"), n_blocks).alias("block"),
        *[F.call_function("shiftleft", one, b).alias(f"b{i}") for i, b in enumerate(_bits(F.col("key")))],
    )
    return bits.groupBy("block").agg(*[F.bit_or(f"b{i}").alias(f"w{i}") for i in range(WORDS)])


def might_hold(keys: DataFrame, blocks: DataFrame, n_blocks: int) -> DataFrame:
    """The rows of ``keys`` whose ``key`` may be in the filter: never drops one that is."""
    held = [F.call_function("shiftright", F.col(f"w{i}"), b).bitwiseAND(F.lit(1).cast("long")) == 1 for i, b in enumerate(_bits(F.col("key")))]
    probe = keys.withColumn("block", _block(F.col("key"), n_blocks)).join(blocks, "block")
    for h in held:
        probe = probe.where(h)
    return probe.drop("block", *[f"w{i}" for i in range(WORDS)])


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row for each row of ``pages``: id, host, path, rule (host + path of the rule that decides, else null), verdict.

    ``rules`` has host, path and verdict. Of the rules that fit the longest (host and path together) decides; without one
    the verdict is ``default``. A null URL, an empty one or one without ``://`` has an empty host and path and fits no
    rule. Rows repeated in ``pages`` stay repeated; a rule listed with two verdicts blocks. Other columns of ``pages``
    are not read.
    """
    listed = written(
        rules.groupBy("host", "path").agg(F.min(F.when(F.col("verdict") == "block", 0).otherwise(1)).alias("open")).select(
            F.concat("host", "path").alias("key"), F.length("path").alias("n"), F.size(F.split("host", r"\.")).alias("d"),
            F.when(F.col("open") == 0, "block").otherwise("allow").alias("said"),
        ),
        "url-rules",
    )
    shapes = [(r["d"], r["n"]) for r in listed.select("d", "n").distinct().orderBy("d", "n").collect()]  # at most labels x path lengths, not rules
    n_blocks = max(1, -(-listed.count() * BITS_PER_KEY // (64 * WORDS)))
    seen = pages.select(F.col(id_col), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    if not shapes:
        return seen.select(id_col, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    keys = F.array_distinct(F.array(*[F.concat(F.substring_index("host", ".", -d), F.substring("path", 1, n)) for d, n in shapes]))
    maybe = might_hold(
        seen.where(F.col("host") != "").select(F.col(id_col), "host", "path", F.explode(keys).alias("key")),
        small(bloom(listed, n_blocks)), n_blocks,
    )
    hits = maybe.join(small(listed), "key").groupBy(
        id_col, "host", "path",
    ).agg(F.max_by(F.struct("key", "said"), F.struct(F.length("key"), F.col("key"))).alias("hit"))
    h = hits.select(F.col(id_col).alias("_id"), F.col("host").alias("_host"), F.col("path").alias("_path"), "hit")
    joined = seen.join(h, seen[id_col].eqNullSafe(h["_id"]) & (seen["host"] == h["_host"]) & (seen["path"] == h["_path"]), "left")
    return joined.select(seen[id_col], "host", "path", F.col("hit.key").alias("rule"), F.coalesce(F.col("hit.said"), F.lit(default)).alias("verdict"))


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(verdict, host, path) triples as a DataFrame."""
    return spark.createDataFrame(rules, "verdict string, host string, path string")
