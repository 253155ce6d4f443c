import hashlib
import zlib
from urllib.parse import urlparse

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from deskgrain.llm import ann, queries, url_filter, warc


def test_urls_against_plain_rules(spark):
    urls = [
        "http://EXAMPLE.org/es/x", "https://a.b.example.org/en/12?q#f", "http://x.org", "http://x.org/", "ftp://Y.COM/fr/",
        "http://y.com/de/z", "http://notexample.org/es/", "no scheme", None, "", "http://", "http://example.org/en/1",
        "http://exämple.ORG/ES/", "x://h/p://k/fr/", "http://org/a", "http://a.org\n/b",
    ]
    d = spark.createDataFrame([(i // 2, u, "clash") for i, u in enumerate(urls + urls[:3])], "page_id long, url string, host string")
    got = sorted(
        map(tuple, url_filter.filter_urls(d.select("page_id", "url", "host"), url_filter.rules_frame(spark, queries.URL_RULES)).collect()),
        key=str,
    )

    def plain(i, u):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[: min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])])
            tail = rest[len(host) :]
            path = tail[: min([tail.find(c) for c in "?#" if c in tail] + [len(tail)])]
        fits = [(h + p, v) for v, h, p in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, "allow"))
        return i, host, path, rule, verdict

    assert got == sorted((plain(i // 2, u) for i, u in enumerate(urls + urls[:3])), key=str)


def test_bloom_drops_most_and_keeps_all(spark):
    keys = spark.range(2_000).select(F.concat(F.lit("k"), "id").alias("key"))
    n = 2_000 * url_filter.BITS_PER_KEY // 512
    blocks = url_filter.bloom(keys, n)
    assert url_filter.might_hold(keys, blocks, n).count() == 2_000
    assert url_filter.might_hold(spark.range(5_000).select(F.concat(F.lit("other"), "id").alias("key")), blocks, n).count() < 250


def test_no_rules_and_no_pages(spark):
    d = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    assert url_filter.filter_urls(d, spark.createDataFrame([], "verdict string, host string, path string")).first()["verdict"] == "allow"
    assert url_filter.filter_urls(d.limit(0), url_filter.rules_frame(spark, queries.URL_RULES)).count() == 0


def test_archives_round_trip(spark):
    big, other = "<p>" + "é" * 900 + "\r\n\r\nWARC/1.0\r\n\r\n</p>", "b" * 1_000
    rows = [
        (1, "http://a", big), (2, None, big), (9, "http://a b\n", big), (3, "", other), (4, "u", "small"), (5, "u", "small"),
        (6, "u", None), (7, "u", ""), (8, "u", other), (8, "u", other), (None, "u", "nobody"),
    ]
    d = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, payload string")
    got = sorted(map(tuple, warc.archived(d).collect()), key=str)

    def plain(i, html):
        raw = (html or "").encode()
        kept = max([j for j, _, h in rows if h == html and j is not None], default=None) if len(raw) >= 1_000 else i
        return i, len(raw), hashlib.sha1(raw).hexdigest(), "response" if kept == i else "revisit", None if kept == i else kept

    assert got == sorted((plain(i, h) for i, _, h in rows), key=str)


def test_arc_versions_and_damage():
    for v in (1, 2):
        name = f"x{v}.arc"
        data = warc.arc_head(v, name, "20240101000000") + warc.arc_record(
            v, name, 0, "http://a/ü", "20240102030405", 7, b"one\n\ntwo",
        ) + warc.arc_record(v, name, 9, None, "20240102030405", None, b"")
        got = list(warc.read_arc(data))
        assert [h["Archive-date"] for h, _, _ in got] == ["20240102030405"] * 2 and got[0][1].endswith(b"\r\n\r\none\n\ntwo")
        assert got[0][0]["URL"] == "http://a/%C3%BC"
        cut = list(warc.read_arc(data[:-8]))  # what stands before the damage is kept
        assert cut[0] == got[0] and cut[1][0] == {"Error": "a record is shorter than declared"} and len(cut) == 2


LATIN, BINARY = "é ü".encode("latin-1") * 400, bytes(range(256)) * 8


def members(raw):
    """Decompressed gzip members of a file."""
    found = []
    while raw.strip(b"\0"):
        z = zlib.decompressobj(31)
        found.append(z.decompress(raw))
        raw = z.unused_data
    return found


def test_arc_files_as_they_are_found(spark):
    """Empty and compressed files, spaces in addresses and content types, and files that break off."""
    import gzip

    head = warc.arc_head(1, "a.arc", "20240101000000")
    odd = b"http://h/a b 20230101 c.html 10.0.0.1 20240102030405 text/html; charset=utf-8 5\nhello\n"
    plain = b"http://h/x 10.0.0.1 20240102030405 text/plain 3\nabc\n"
    second = warc.arc_head(2, "b.arc", "20240101000000") + b"http://h/q r 1.1.1.1 20240102030405 a b; c 200 - - 0 b.arc 2\nok\n"
    files = {
        "empty": b"", "blank": b"\n\n", "gz": b"".join(gzip.compress(x) for x in (head, odd, plain)), "plain": head + odd + b"\r\n\n" + plain, "two": second,
        "cut gz": gzip.compress(head + plain) + gzip.compress(odd)[:-12], "no arc": b"<html>", "no length": head + plain + b"http://h/x 1.1.1.1 20240102030405 text/plain x\nabc\n",
        "no date": head + b"http://h/x 1.1.1.1 text/plain 3\nabc\n" + plain, "no end": head + plain + b"http://h/x 1", "other": b"filedesc://x 0 20240101 text/plain 9\n7 0 x\nURL",
    }
    d = spark.createDataFrame([*files.items(), (None, None)], "name string, content binary")
    got = {}
    for r in warc.convert_arc(d).collect():
        got.setdefault((r["uri"], r["content_type"], bytes(r["payload"])), 0)
        got[r["uri"], r["content_type"], bytes(r["payload"])] += 1
    # a gzip member that breaks off may give its last bytes or not
    assert got.pop(("http://h/a%20b%2020230101%20c.html", "text/html; charset=utf-8", b"hello")) in (2, 3)
    assert got == {("http://h/x", "text/plain", b"abc"): 5, ("http://h/q%20r", "a b; c", b"ok"): 1}
    errors = {r["name"]: r["message"] for r in warc.arc_errors(d).collect()}
    assert set(errors) - {"cut gz"} == {"no arc", "no length", "no date", "no end", "other"}
    assert errors["no arc"] == "no version block of a known version" and errors["no date"] == "a header line cannot be read"


def test_archives_of_any_bytes(spark, tmp_path):
    def file(version, records):
        name, date = f"old{version}.arc", "20010203040506"
        data = warc.arc_head(version, name, date)
        for i, url, payload in records:
            data += warc.arc_record(version, name, len(data), url, date, i, payload)
        if version == 1:  # one without an HTTP header, one with a header of bare line ends, blank lines between
            raw = b"example.org. 60 IN A 192.0.2.1"
            data += b"\r\n\ndns:example.org 192.0.2.9 20010203 text/dns %d\n" % len(raw) + raw + b"\n"
            old = b"HTTP/1.0 200 OK\nX-Page-Id: 50\n\n" + LATIN
            data += b"http://b/\xe9 192.0.2.9 20010203040506 text/html %d\n" % len(old) + old + b"\n"
        return name, data

    twice = [(7, "http://t/", b"same"), (7, "http://t/", b"same")]
    files = spark.createDataFrame(
        [file(1, [(1, "http://a/", LATIN), (2, "http://a/", BINARY), *twice]), file(2, [(3, None, BINARY), (4, "http://c/", b"")])],
        "name string, content binary",
    )
    records = warc.convert_arc(files).collect()
    assert len({r["record_id"] for r in records}) == len(records) == 8
    assert {(r["page_id"], bytes(r["payload"])) for r in records if r["page_id"] in (1, 2, 3, 4, 50)} == {
        (1, LATIN), (2, BINARY), (3, BINARY), (4, b""), (50, LATIN),
    }
    assert [
        (r["kind"], r["date"], bytes(r["payload"])) for r in records if r["page_id"] is None
    ] == [("resource", "2001-02-03T00:00:00Z", b"example.org. 60 IN A 192.0.2.1")]
    path = str(tmp_path / "warc")
    warc.write_warc(files, path)
    got = {(r["page_id"], r["record_type"], r["refers_to"], r["payload_digest"]) for r in warc.read_warc(spark, path).collect()}
    sha = lambda b: hashlib.sha1(b).hexdigest()
    assert got == {
        (1, "revisit", 50, sha(LATIN)), (50, "response", None, sha(LATIN)), (2, "revisit", 3, sha(BINARY)),
        (3, "response", None, sha(BINARY)), (4, "response", None, sha(b"")), (7, "response", None, sha(b"same")),
        (None, "resource", None, sha(b"example.org. 60 IN A 192.0.2.1")),
    }
    for part in (p for p in (tmp_path / "warc").glob("part-*") if p.stat().st_size):  # a task without records leaves an empty file
        held = members(part.read_bytes())
        assert all(m.startswith(b"WARC/1.0\r\n") and m.endswith(b"\r\n\r\n") for m in held)
        assert b"WARC-Type: warcinfo" in held[0] and not any(b"WARC-Type: warcinfo" in m[:40] for m in held[1:])
        assert all(len(list(warc.read_warc_bytes(m))) == 1 for m in held)


def test_many_repeated_payloads_and_large_records(spark, monkeypatch):
    """Some payloads joined by broadcast, others by a shuffle; files closed by size; a record above 16 MiB."""
    monkeypatch.setattr(warc, "HOT_SHARE", 10)
    monkeypatch.setattr(warc, "WARC_BYTES", 20_000)
    big = [("x%d" % (i % 40)) * 600 if i % 3 else "hot" * 500 for i in range(240)]
    rows = [(i, "u", t) for i, t in enumerate(big)] + [(900, "u", "0123456789abcdef" * (1 << 20) + "end")]
    got = {r["page_id"]: r for r in warc.archived(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    last = {t: i for i, _, t in rows}
    assert len(got) == len(rows) and all(got[i]["refers_to"] == (None if last[t] == i else last[t]) for i, _, t in rows)
    assert got[900]["payload_bytes"] == len(rows[-1][2]) and got[900]["payload_digest"] == hashlib.sha1(rows[-1][2].encode()).hexdigest()


def test_each_stored_archive_is_a_row_group(spark):
    """Else a task's archives are one Parquet page, held and compressed as a whole."""
    d = spark.range(0, 6, 1, 1).select(F.lit("a.arc").alias("name"), F.lit(b"x" * 1000).alias("content"))
    files = [pq.read_metadata(urlparse(f).path) for f in warc.stored_arc(d).inputFiles()]
    assert [[m.row_group(i).num_rows for i in range(m.num_row_groups)] for m in files] == [[1] * 6]


def test_archive_of_nothing(spark):
    d = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archived(d).count() == 0


def exact(x, ids, q, k):
    d = np.sqrt(((x - x[q]) ** 2).sum(1))
    d[ids == ids[q]] = np.inf
    order = np.lexsort((ids, d))[:k]
    return [(int(ids[i]), float(d[i])) for i in order if np.isfinite(d[i])]


def test_neighbours_recall_and_scores(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = e.collect()
    x, ids = np.array([r["embedding"] for r in rows], np.float64), np.array([r["vec_id"] for r in rows])
    got = {}
    for r in ann.search(e, e.where("vec_id % 100 = 0")).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    hits = total = 0
    for q in np.flatnonzero(ids % 100 == 0):
        want, found = exact(x, ids, q, 10), [got[int(ids[q])][i] for i in range(1, 11)]
        true = np.sqrt(((x[[int(np.flatnonzero(ids == v)[0]) for v, _ in found]] - x[q]) ** 2).sum(1))
        assert np.allclose(true, [s for _, s in found], atol=1e-12) and found == sorted(found, key=lambda p: (p[1], p[0]))
        hits, total = hits + len({v for v, _ in want} & {v for v, _ in found}), total + len(want)
    assert hits / total >= 0.9


def test_neighbours_of_odd_vectors(spark):
    good = [(i, [float(i % 3), 1.0, 2.0]) for i in range(6)]
    rows = good + [
        (10, None), (11, [0.0, 0.0, 0.0]), (12, [float("nan"), 1.0, 1.0]), (13, [1.0]), (None, [1.0, 1.0, 1.0]),
        (100, [0.0, 1.0, 2.0]), (100, [0.0, 1.0, 2.0]),
    ]
    d = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<float>, rank string")
    got = ann.search(d, d.where("vec_id in (100, 11, 12)")).orderBy("rank").collect()
    assert [(r["query_id"], r["vec_id"]) for r in got] == [(100, v) for v in (0, 3, 1, 4, 2, 5)]
    assert [r["rank"] for r in got] == list(range(1, 7))
    assert ann.search(d.limit(0), d.limit(0)).count() == 0


def test_neighbours_of_other_lengths_and_repeated_ids(spark):
    rng = np.random.default_rng(6)
    x = {i: rng.normal(size=3 if i < 60 else 5) for i in range(90)}
    rows = [(i, v.tolist()) for i, v in x.items()] + [(200, [1.0, 2.0]), (7, x[8].tolist())]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(d, d.where("vec_id in (7, 70, 200)"), k=4).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    query = min(x[7].tolist(), x[8].tolist())
    flat = [(i, np.array(v)) for i, v in rows]
    near = lambda q, own: [i for _, i in sorted((float(((v - q) ** 2).sum()), i) for i, v in flat if len(v) == len(q) and i != own)[:4]]
    assert [v for _, v in sorted(got[70])] == near(x[70], 70) and [v for _, v in sorted(got[7])] == near(np.array(query), 7)
    assert 200 not in got
