"""Legacy archives: ARC version 1 and 2 files, converted to WARC records, written as WARC files and read back.

An ARC record is a header line whose fields the file's version block names, a declared number of bytes and a line end.
The converter reads by those lengths only, whatever the bytes are, and makes up what WARC asks for beyond: record
identifiers (a UUID of the record's file and place), ISO timestamps, record types, block and payload digests. Records of
equal payload are written once; the others revisit it. Which ones they are is found from identifiers and digests alone.

A WARC file starts with a warcinfo record and holds one gzip member for each record. Spark's text sink writes it: a row is the
bytes of one file but for the last, and the separator behind the row is the zero byte that ends a gzip member of less than
16 MiB (behind a larger one it is padding, which readers skip).
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT_SHARE, shared_dir, small, written

#: Fixed values of the formats.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
WARC_VERSION = "WARC/1.0"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
PAGE_ID = "X-Page-Id"
URL_SAFE = ":/?#[]@!$&'()*+,;=%-._~"

#: Bytes of an ARC file and of a WARC file, about; payloads from so many bytes on may be revisited.
ARC_BYTES, WARC_BYTES, REVISIT_BYTES = 8 << 20, 16 << 20, 1_000
#: Effort of the compression.
LEVEL = 4


def arc_head(version: int, name: str, date: str) -> bytes:
    block = f"{version} 0 converter\n{ARC_FIELDS[version]}\n\n".encode()
    first = {
        "URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/plain",
        "Result-code": "200", "Checksum": "-",
        "Location": "-", "Offset": "0", "Filename": name, "Archive-length": str(len(block)),
    }
    return " ".join(first[f] for f in ARC_FIELDS[version].split()).encode() + b"\n" + block + b"\n"


def arc_record(version: int, name: str, offset: int, url: str | None, date: str, page_id: int | None, payload: bytes) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n{PAGE_ID}: {'' if page_id is None else page_id}\r\n\r\n".encode()
    line = {
        "URL": quote(url, safe=URL_SAFE) if url else "unknown:", "IP-address": "127.0.0.1", "Archive-date": date,
        "Content-type": "text/html", "Result-code": "200",
        "Checksum": hashlib.md5(payload).hexdigest(), "Location": "-", "Offset": str(offset), "Filename": name,
        "Archive-length": str(len(http) + len(payload)),
    }
    return " ".join(line[f] for f in ARC_FIELDS[version].split()).encode() + b"\n" + http + payload + b"\n"


def write_arc(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "20240101000000") -> DataFrame:
    """(name, content): the pages as ARC files of about ARC_BYTES, even ids in version 1 and all others in version 2.

    A null page is empty, a null URL ``unknown:``, and a null id is left blank. Pages may be text or bytes. Rows may repeat;
    other columns are not read; without pages there are no files. Names are unique in the table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[int, list] = {}
        task, files = TaskContext.get().partitionId(), 0

        def closed(version: int) -> pa.RecordBatch:
            name, parts, _ = open_.pop(version)
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b"".join(parts)], pa.binary())], names=["name", "content"])

        for b in batches:
            for i, url, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                version = 1 if i is not None and i % 2 == 0 else 2
                if version not in open_:
                    name = f"legacy-v{version}-{task:06d}-{files:06d}.arc"
                    files += 1
                    first = arc_head(version, name, date)
                    open_[version] = [name, [first], len(first)]
                file = open_[version]
                record = arc_record(version, file[0], file[2], url, date, i, html.as_py() or b"")
                file[1].append(record)
                file[2] += len(record)
                if file[2] >= ARC_BYTES:
                    yield closed(version)
        for version in sorted(open_):
            yield closed(version)

    cols = F.col(f"`{id_col}`").cast("long"), F.col(f"`{url_col}`"), F.col(f"`{html_col}`").cast("binary")
    return pages.select(*cols).mapInArrow(run, "name string, content binary")


def stored_arc(files: DataFrame) -> DataFrame:
    """ARC files (name, content) written once. Each is a row group and a page of its own: Parquet looks at a writer's memory only
    every hundred rows, so that all files of a task would else be one page, which is compressed and read as a whole."""
    return written(files, "legacy-archives", **{"parquet.block.row.count.limit": 1})


def _header(line: str, fields: list[str]) -> dict[str, str]:
    """The fields of a header line. URL and content type may hold spaces: the date is the last field of digits before those that
    stand behind the content type, and the address stands before it. No fields if there is no such date or length."""
    values, behind = line.strip().split(" "), len(fields) - fields.index("Content-type") - 1
    dates = [i for i in range(2, len(values) - behind) if _date(values[i])]
    if not dates or not values[-1].isascii() or not values[-1].isdigit():
        return {}
    at = dates[-1]
    parts = [" ".join(values[: at - 1]), *values[at - 1 : at + 1], " ".join(values[at + 1 : len(values) - behind]), *values[len(values) - behind :]]
    return dict(zip(fields, parts))


_date = re.compile(r"[0-9]{8,14}").fullmatch


def read_arc(content: bytes) -> Iterator[tuple[dict[str, str], bytes, int]]:
    """(fields of the header line, declared bytes, place in the file) of every record after the version block.

    Header lines are read byte by byte (Latin-1), payloads not at all. Files of gzip members (``.arc.gz``) are unpacked; places
    are those in the unpacked file. An empty file has no records. Where a header line or a length cannot be read, or the file
    ends before a record does, one last item has the field ``Error`` and all bytes from there on.
    """
    if content[:2] == b"\x1f\x8b":
        z, unpacked = zlib.decompressobj(31), []
        while content:
            try:
                unpacked.append(z.decompress(content))
            except zlib.error:  # what was unpacked before is still read
                break
            content, z = z.unused_data, zlib.decompressobj(31)
        content = b"".join(unpacked)
    if not content.strip():
        return
    first, _, rest = content.partition(b"\n")
    length = first.rsplit(b" ", 1)[-1].strip()
    block = rest[: int(length)].decode("latin-1") if length.isdigit() else ""
    if len(block.split("\n")) < 2 or block.split(" ", 1)[0] not in map(str, ARC_FIELDS):
        yield {"Error": "no version block of a known version"}, content, 0
        return
    fields = block.split("\n")[1].strip().split(" ")
    if fields != ARC_FIELDS[int(block.split(" ", 1)[0])].split(" "):
        yield {"Error": "the version block names other fields"}, content, 0
        return
    at = len(first) + 1 + int(length)
    while at < len(content):
        if content[at] in b"\r\n":  # blank lines between records
            at += 1
            continue
        end = content.find(b"\n", at)
        head = _header(content[at : end if end >= 0 else len(content)].decode("latin-1"), fields)
        size = int(head["Archive-length"]) if head else 0
        if end < 0 or not head or end + 1 + size > len(content):
            yield {"Error": "a record is shorter than declared" if head else "a header line cannot be read"}, content[at:], at
            return
        yield head, content[end + 1 : end + 1 + size], at
        at = end + 1 + size


def arc_errors(files: DataFrame) -> DataFrame:
    """(name, place, bytes, message): what ``convert_arc`` leaves out of ARC files (name, content), one row a file at most: from
    a header line or length that cannot be read, or a record that the file ends within, to the file's end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1)):
                for head, rest, at in read_arc(content.as_py() or b""):
                    if "Error" in head:
                        row = [name], [at], [len(rest)], [head["Error"]]
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["name", "place", "bytes", "message"])

    return files.select("name", "content").mapInArrow(run, "name string, place long, bytes long, message string")


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _split(block: bytes) -> tuple[bytes, bytes]:
    """(HTTP header with the blank line that ends it, payload); no header if the block has none."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    ends = [(i, len(e)) for e in (b"\r\n\r\n", b"\n\n") if (i := block.find(e)) >= 0]
    if not ends:
        return block, b""
    i, n = min(ends)
    return block[: i + n], block[i + n :]


def _page_id(http: bytes) -> int | None:
    for line in http.decode("latin-1").splitlines():
        name, _, value = line.partition(":")
        if name == PAGE_ID:
            return int(value) if value.strip() else None
    return None


IDS = "page_id long, record_id string, uri string, date string, payload_bytes long, payload_digest string"
RECORD = IDS + ", kind string, ip string, content_type string, http binary, payload binary, block_digest string"
_KINDS = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def convert_arc(files: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of ARC files (name, content), with all that their WARC records need; without ``payloads`` only who they are.

    Payloads are bytes of any encoding. A block that starts as an HTTP answer is a response (its header ends at the first
    blank line), any other a resource. Null and empty files give none, and neither does what cannot be read, which ``arc_errors``
    lists. Equal records in two places have two identifiers.
    """
    fields = [f.split(" ") for f in (RECORD if payloads else IDS).split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, (_, k) in zip(zip(*rows), fields)], names=[n for n, _ in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1)):
                rows: list[tuple] = []
                size = 0
                for head, block, at in read_arc(content.as_py() or b""):
                    if "Error" in head:
                        continue
                    http, payload = _split(block)
                    d = head["Archive-date"].ljust(14, "0")
                    who = uuid.uuid5(uuid.NAMESPACE_URL, f"{name}#{at}")
                    when = f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"
                    row = _page_id(http), f"urn:uuid:{who}", quote(head["URL"].encode("latin-1"), safe=URL_SAFE), when, len(payload), _sha1(payload)
                    if payloads:
                        row += "response" if http else "resource", head["IP-address"], head["Content-type"], http, payload, _sha1(block)
                        size += len(block)
                    rows.append(row)
                    if size > ARC_BYTES or len(rows) >= 10_000:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)

    return files.select("name", "content").mapInArrow(run, RECORD if payloads else IDS)


def _member(head: list[tuple[str, str]], block: bytes) -> bytes:
    """A WARC record as a gzip member."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*head, ("Content-Length", str(len(block)))])
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(f"{WARC_VERSION}\r\n{lines}\r\n".encode() + block + b"\r\n\r\n") + z.flush()


def _volumes(names: list[str]):
    """Joined records to the bytes of WARC files, each less its last byte if that is zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, volumes, parts, size = TaskContext.get().partitionId(), 0, [], 0

        def closed() -> pa.RecordBatch:
            content = b"".join(parts)
            parts.clear()
            return pa.RecordBatch.from_arrays([pa.array([content[:-1] if content[-1] == 0 else content], pa.binary())], names=["value"])

        for b in batches:
            for r in zip(*[b.column(n) for n in names]):
                r = {n: v.as_py() for n, v in zip(names, r)}
                if not parts:
                    name = f"converted-{task:06d}-{volumes:06d}.warc.gz"
                    info = f"software: converter\r\nformat: {WARC_VERSION}\r\n".encode()
                    who = uuid.uuid5(uuid.NAMESPACE_URL, r["record_id"] + name)
                    parts.append(
                        _member(
                            [
                                ("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{who}>"), ("WARC-Date", r["date"]),
                                ("WARC-Filename", name), ("Content-Type", "application/warc-fields"),
                            ],
                            info,
                        )
                    )
                    volumes, size = volumes + 1, 0
                kept = r["kept"]
                head = [
                    ("WARC-Type", "revisit" if kept else r["kind"]), ("WARC-Record-ID", f"<{r['record_id']}>"),
                    ("WARC-Date", r["date"]), ("WARC-Target-URI", r["uri"]), ("WARC-IP-Address", r["ip"]),
                ]
                if kept:
                    head += [
                        ("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{kept['record_id']}>"),
                        ("WARC-Refers-To-Target-URI", kept["uri"]), ("WARC-Refers-To-Date", kept["date"]),
                        ("X-Refers-To-Page-Id", "" if kept["page_id"] is None else str(kept["page_id"])),
                    ]
                else:
                    head += [("WARC-Block-Digest", r["block_digest"])]
                head += [
                    ("WARC-Payload-Digest", r["payload_digest"]), ("X-Payload-Length", str(r["payload_bytes"])),
                    ("Content-Type", "application/http; msgtype=response" if r["http"] else r["content_type"]),
                ]
                parts.append(_member(head, r["http"] if kept else r["http"] + r["payload"]))
                size += len(parts[-1])
                if size >= WARC_BYTES:
                    yield closed()
        if parts:
            yield closed()

    return run


def write_warc(files: DataFrame, path: str, least: int = REVISIT_BYTES) -> None:
    """Converts ARC files (name, content) and writes WARC files of about WARC_BYTES to the folder ``path``.

    Of records of equal payload of at least ``least`` bytes the one with the largest page id is the response; null ids come
    last. Smaller ones are all written in full, as are rows of that largest id if they repeat, and all if no id is known.
    ``files`` is read twice, so it should be a stored table. Without files an empty folder is written.
    """
    ids = convert_arc(files, payloads=False).where(F.col("payload_bytes") >= least)
    kept = F.max_by(F.struct("page_id", "record_id", "uri", "date"), F.struct("page_id", "record_id"))
    counted = ids.groupBy("payload_digest").agg(F.count("*").alias("n"), kept.alias("first"))
    groups = written(counted.select(F.col("payload_digest").alias("_digest"), "n", "first"), "payloads")
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    again = groups.where("n > 1")
    hot = F.col("n") * HOT_SHARE >= total
    records = convert_arc(files)
    # the few payloads that many records have meet them in place; of all others no one has many records
    joined = records.join(
        F.broadcast(again.where(hot).select(F.col("_digest").alias("_hot"), F.col("first").alias("_kept"))),
        F.col("payload_digest") == F.col("_hot"), "left",
    )
    joined = joined.join(small(again.where(~hot).select("_digest", "first")), F.col("payload_digest") == F.col("_digest"), "left")
    first = F.coalesce("_kept", "first")
    other = (F.col("payload_bytes") >= least) & first.isNotNull() & ~F.col("page_id").eqNullSafe(first["page_id"])
    names = [f.split(" ")[0] for f in RECORD.split(", ")]
    made = joined.select(*names, F.when(other, first).alias("kept")).mapInArrow(_volumes([*names, "kept"]), "value binary")
    made.select(F.col("value").cast("string")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).option("compression", "none").text(path)


def read_warc_bytes(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header, block) of every record of an uncompressed WARC file."""
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        version, *lines = content[at:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        head = {k: v for k, _, v in (x.partition(": ") for x in lines)}
        size = int(head["Content-Length"])
        yield head, content[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record of the WARC files in ``path`` but warcinfo ones: page_id, payload_bytes, payload_digest (hex),
    record_type, refers_to (page id). Lengths and digests of full records are taken from the payload and must agree with the
    header. Payloads are bytes of any encoding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                rows = []
                for head, block in read_warc_bytes(gzip.GzipFile(fileobj=io.BytesIO(content.as_py())).read()):
                    if head["WARC-Type"] == "warcinfo":
                        continue
                    http, payload = _split(block)
                    digest, size = head["WARC-Payload-Digest"], int(head["X-Payload-Length"])
                    if head["WARC-Type"] != "revisit" and (digest, size, head["WARC-Block-Digest"]) != (_sha1(payload), len(payload), _sha1(block)):
                        raise ValueError(f"{head['WARC-Record-ID']} differs from its digests")
                    to = head.get("X-Refers-To-Page-Id")
                    rows.append((_page_id(http), size, base64.b32decode(digest[5:]).hex(), head["WARC-Type"], int(to) if to else None))
                if rows:
                    c = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2]), pa.array(c[3]), pa.array(c[4], pa.int64())],
                        names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
                    )

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, READ)


def archived(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Pages as ARC files in the shared folder, converted to WARC files there, and read back: one row for each page.

    A null page has an empty payload; URLs do not matter; rows may repeat (rows of one id and payload are all response
    or all revisit); without pages the result is empty; other columns are not read.
    """
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(stored_arc(write_arc(pages, id_col, url_col, html_col)), path)
    return read_warc(spark, path).withColumnRenamed("page_id", id_col)
