"""A table of folders whose state is one small manifest.

A commit writes its data to a folder of its own and then, last, a manifest that names all live folders; the manifest is written
under another name and renamed into place. Readers take the last manifest, so that they see a batch whole or not at all: what a
broken run left is named nowhere. A batch whose manifest is there is not run again. A manifest names one folder for each part
(bucket or day), never files or rows, so it stays small.

There is one writer at a time, as for any stream's sink, and the batch numbers are those of one checkpoint: a folder goes with its
checkpoint.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(*sessions: SparkSession) -> Iterator[None]:
    """Within it, each query's shuffle files go when it ends, not when the driver happens to collect its garbage."""
    before = [s.conf.get(CLEANUP) for s in sessions]
    for s in sessions:
        s.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        for s, was in reversed(list(zip(sessions, before))):
            s.conf.set(CLEANUP, was)


class Ledger:
    """Manifests and data of a table in ``folder``; the last ``keep`` manifests and what they name stay when older ones are removed, so
    that readers of those can end."""

    def __init__(self, spark: SparkSession, folder: str, keep: int = 3):
        self.spark, self.folder, self.keep = spark, folder, keep

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def _fs(self):
        return self._path(self.folder).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, pattern: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs().globStatus(self._path(f"{self.folder}/{pattern}")) or [])

    def _load(self, name: str) -> dict:
        stream = self._fs().open(self._path(f"{self.folder}/manifests/{name}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def last(self) -> dict:
        """The last manifest: number, batch (the last one committed), live (folder of each part), schema."""
        names = self._names("manifests/*.json")
        return self._load(names[-1]) if names else {"number": -1, "batch": -1, "live": {}, "schema": None}

    def data_folder(self, batch: int) -> str:
        """A new folder, named in no manifest."""
        return f"{self.folder}/data/batch={batch}-{uuid.uuid4().hex}"

    def parts(self, path: str) -> list[str]:
        """The parts that a write partitioned by one column left in ``path``."""
        found = self._fs().globStatus(self._path(f"{path}/*=*")) or []
        return sorted(s.getPath().getName() for s in found)

    def size(self, path: str) -> int:
        """Bytes of a folder."""
        return self._fs().getContentSummary(self._path(path)).getLength()

    def drop(self, paths: list[str]) -> None:
        """Removes folders that no manifest names."""
        for path in paths:
            self._fs().delete(self._path(path), True)

    def commit(self, before: dict, live: dict[str, str], schema: StructType, batch: int | None = None) -> None:
        """Makes ``live`` the table's folders, after the manifest ``before``; ``batch`` None keeps the last one's number."""
        number = before["number"] + 1
        held = {"number": number, "batch": before["batch"] if batch is None else batch, "live": live, "schema": schema.jsonValue()}
        fs, name = self._fs(), f"{self.folder}/manifests/{number:012d}.json"
        out = fs.create(self._path(f"{name}.part"), True)
        try:
            out.write(bytearray(json.dumps(held).encode()))
        finally:
            out.close()
        if fs.exists(self._path(name)) or not fs.rename(self._path(f"{name}.part"), self._path(name)):
            raise RuntimeError(f"another writer has committed {name}")
        self.clean()

    def clean(self) -> None:
        """Removes manifests beyond the last ``keep`` and all data that no manifest left names."""
        fs, names = self._fs(), self._names("manifests/*.json")
        for name in names[: -self.keep]:
            fs.delete(self._path(f"{self.folder}/manifests/{name}"), False)
        # a part's folder is data/batch=.../part: within a batch's folder single parts go too
        named = {p for name in names[-self.keep :] for p in self._load(name)["live"].values()}
        batches = {p.rsplit("/", 1)[0] for p in named}
        for name in self._names("data/*"):
            path = f"{self.folder}/data/{name}"
            if path not in batches:
                fs.delete(self._path(path), True)
                continue
            for part in self.parts(path):
                if f"{path}/{part}" not in named:
                    fs.delete(self._path(f"{path}/{part}"), True)

    def read(self, only: set[str] | None = None, manifest: dict | None = None) -> DataFrame | None:
        """The table (its parts ``only``); None if nothing was ever committed or none of the parts is there."""
        m = self.last() if manifest is None else manifest
        paths = [p for part, p in sorted(m["live"].items()) if only is None or part in only]
        return self.spark.read.schema(StructType.fromJson(m["schema"])).parquet(*paths) if paths else None

    def write(self, rows: DataFrame, by: str, batch: int) -> tuple[dict[str, str], StructType]:
        """Writes ``rows`` by the column ``by``, dealt out by its values, large ones to several tasks where execution is adaptive;
        (folder of each part, schema of the rest)."""
        path = self.data_folder(batch)
        rows.hint("rebalance", by).write.partitionBy(by).parquet(path)
        return {part: f"{path}/{part}" for part in self.parts(path)}, rows.drop(by).schema
