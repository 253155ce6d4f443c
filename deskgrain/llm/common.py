"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII space and the control characters 9-13.
WORD = r"[^\x20\x09-\x0D]+"

#: Tables of at most this many (narrow) rows may be broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session. Where that is unset a folder of this machine is
    taken in local mode (tests), and nothing on a cluster, whose executors would not see it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, what: str, **options) -> DataFrame:
    """``df`` written once to the shared folder, with ``options`` of the writer, and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcasting if it proves to have at most ``most`` rows, else as it is. ``df`` should be cheap to count."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


#: A key that has this share of all rows or more counts as hot: there are no more such keys than this.
HOT_SHARE = 5_000


def meet(rows: DataFrame, found: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """``rows`` joined to ``found``, which has one row for each ``key`` with the number ``n`` of its rows out of ``total``.

    The few keys that many rows have meet them in place, so that no task gathers the rows of one key; all others move."""
    hot = F.col(n) * HOT_SHARE >= total
    few, rest = F.broadcast(found.where(hot)), small(found.where(~hot))
    return rows.join(few, key).unionByName(rows.join(few, key, "left_anti").join(rest, key))


def unused(columns: list[str], *names: str) -> list[str]:
    """``names``, each with as many underscores behind it as it takes to differ from all of ``columns`` (letter case aside)."""
    taken, made = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        made.append(n)
    return made


def columns(df: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in df.columns]


def release_memory() -> None:
    """Hands memory that a Python worker no longer uses back to the system: workers live on, and later stages need it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no such call in this C library
        pass


def sampled(df: DataFrame, h: Column, n: int, most: int) -> DataFrame:
    """About 1.2 times ``most`` of the ``n`` rows of ``df`` (all of them if there are no more), by a hash ``h``: the same rows
    in every run, picked where they lie, so that a bounded sample moves no more than itself."""
    if n <= 1.2 * most:
        return df
    return df.where(F.pmod(h, F.lit(1 << 31)) < int((1 << 31) * 1.2 * most / n))


#: Values that a memory holds in each generation.
REMEMBERED = 100_000


class Memory:
    """Values of ``make`` that are remembered, in two generations: what is used again is kept, all else is forgotten when the
    older one goes. ``known`` is asked first and ``find`` if it holds nothing."""

    def __init__(self, make, size: int = REMEMBERED):
        self.make, self.size, self.young, self.old = make, size, {}, {}
        self.known = self.young.get

    def find(self, key):
        found = self.old.pop(key, self)
        if found is self:
            found = self.make(key)
        if len(self.young) >= self.size:
            self.old = dict(self.young)
            self.young.clear()
        self.young[key] = found
        return found

    def clear(self) -> None:
        self.young.clear()
        self.old = {}
