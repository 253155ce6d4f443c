"""Numbers of lines and rows against Python's own readers, in files cut into many splits."""

import csv
import json
import random

import pytest
from pyspark.sql.types import LongType, StructType

from deskgrain.sources import lines


@pytest.fixture(params=[40, 300, 1 << 20])
def cut(spark, request, monkeypatch):
    """Splits of this many bytes."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", request.param)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    yield request.param
    for k, v in old.items():
        spark.conf.set(k, v)


def by_file(rows, *cols):
    return sorted((r["file"].rsplit("/", 1)[-1], *(r[c] for c in cols)) for r in rows)


@pytest.mark.parametrize("splits", [100_000, 0])
def test_lines_have_the_numbers_that_python_counts(spark, tmp_path, cut, splits, monkeypatch):
    monkeypatch.setattr(lines, "SPLITS", splits)
    rng, want = random.Random(cut), []
    for name in ("a.txt", "b.txt", "c.txt"):
        text = ["" if rng.random() < 0.2 else "é" * rng.randint(0, 30) + str(i) for i in range(rng.randint(1, 60))]
        (tmp_path / name).write_bytes(("\r\n" if name == "b.txt" else "\n").join(text).encode() + b"\n")
        want += [(name, i, x) for i, x in enumerate(text, 1)]
    (tmp_path / "empty.txt").write_bytes(b"")
    found = lines.numbered_lines(spark, str(tmp_path))
    assert by_file(found.collect(), "line", "value") == sorted(want)


def test_malformed_json_lines_are_numbered(spark, tmp_path, cut):
    rng, want = random.Random(7), []
    for name in ("a.jsonl", "b.jsonl"):
        text = [rng.choice(['{"a": 1}', '{"a": 22, "b": "x"}', "", "  ", "not json", '{"a": ', '{"a": "word"}']) for _ in range(50)]
        (tmp_path / name).write_text("\n".join(text))
        for i, x in enumerate(text, 1):
            if x.strip() and not _object(x):
                want.append((name, i, x))
    found = lines.malformed_json_lines(spark, str(tmp_path), StructType().add("a", LongType()))
    assert by_file(found.collect(), "line", "value") == sorted(want)


def _object(x):
    try:
        return isinstance(json.loads(x)["a"], int)
    except json.JSONDecodeError:
        return False


FIELDS = ["plain", "", 'a "quoted" word', "two\nlines", "\n\nthree\n", "comma, here", "é", " spaced ", '"', '""\n"', "x" * 90, "cr\r\nlf"]


@pytest.mark.parametrize("splits", [100_000, 0])
def test_csv_rows_have_the_numbers_and_values_that_python_reads(spark, tmp_path, cut, splits, monkeypatch):
    monkeypatch.setattr(lines, "SPLITS", splits)
    rng, want = random.Random(cut + 1), []
    for name, end, quoting in (("a.csv", "\n", csv.QUOTE_MINIMAL), ("b.csv", "\r\n", csv.QUOTE_MINIMAL), ("c.csv", "\n", csv.QUOTE_ALL)):
        with open(tmp_path / name, "w", newline="", encoding="utf-8-sig" if name == "b.csv" else "utf-8") as f:
            out = csv.writer(f, lineterminator=end, quoting=quoting)
            out.writerow(["Id", "Title", "body"] if name != "c.csv" else ["body", "id"])
            for i in range(rng.randint(20, 60)):
                if rng.random() < 0.1:
                    f.write(end)
                out.writerow([f"{name}{i}", *rng.choices(FIELDS, k=2 if name != "c.csv" else 1)])
        with open(tmp_path / name, newline="", encoding="utf-8-sig") as f:
            for n, row in enumerate(csv.DictReader(f), 1):
                want.append((name, n, [k.lower() for k in row], [v or None for v in row.values()]))
    records, bad = lines.csv_records(spark, str(tmp_path))
    found = records.collect()
    width = max(len(r["names"]) for r in found)
    assert width == 3 and bad.count() == 0
    got = sorted((r["file"].rsplit("/", 1)[-1], r["row_number"], [n for n in r["names"] if n], [v or None for v in r["values"]]) for r in found)
    assert got == sorted((f, n, names, values + [None] * (width - len(values))) for f, n, names, values in want)
    text = {name: (tmp_path / name).read_bytes().decode("utf-8-sig").split("\n") for name in ("a.csv", "b.csv", "c.csv")}
    for r in found:  # the line that a record names is the one it begins on
        name = r["file"].rsplit("/", 1)[-1]
        began = "\n".join(text[name][r["line"] - 1 :])
        assert next(csv.reader([x + "\n" for x in began.split("\n")]))[0] == (r["values"][0] or "")


def test_csv_records_that_cannot_be_read(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,body\n1,short\n2,"' + "long\n" * 40 + '"\n3,after\n4,"never closed\n5,x\n')
    records, bad = lines.csv_records(spark, str(tmp_path))
    found = sorted((r["row_number"], r["line"], r["values"][0]) for r in records.collect())
    assert found == [(1, 2, "1"), (2, 3, "2"), (3, 44, "3"), (4, 45, "4")]
    assert bad.count() == 0
    records, bad = lines.csv_records(spark, str(tmp_path), most=50)
    assert sorted((r["row_number"], r["values"][0]) for r in records.collect()) == [(1, "1"), (3, "3"), (4, "4")]
    assert [(r["row_number"], r["line"], r["reason"]) for r in bad.collect()] == [(2, 3, "record too long")]
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "a.csv").write_text("")
    (tmp_path / "none" / "b.csv").write_text("id,body\n")
    records, bad = lines.csv_records(spark, str(tmp_path / "none"))
    assert records.count() == 0 and bad.count() == 0


def test_csv_documents(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        "policy_name,Content,permission,version,source_license,attribution_required,own\n"
        '"  Refunds ","Line one\nline two",admin,,CC-BY, Yes ,zone\n,,,,,,\nOnly title,,,1.2,,no,\n'
    )
    records, _ = lines.csv_records(spark, str(tmp_path))
    got = lines.csv_documents(records, "kb", mapping={"platform": "own", "title": "absent"}).orderBy("row_number").collect()
    assert [(r["title"], r["body"], r["role"], r["platform"], r["version_or_date"], r["attribution_required"]) for r in got] == [
        ("Refunds", "Line one\nline two", "admin", "zone", "", True), ("", "", "", "", "", False), ("Only title", "", "", "", "1.2", False),
    ]
    assert [[(s["section_id"], s["heading_path"], s["text"], s["row_ref"]) for s in r["sections"]] for r in got] == [
        [("row-1", "Refunds", "Refunds\n\nLine one\nline two", "1")], [], [("row-3", "Only title", "Only title", "3")],
    ]
