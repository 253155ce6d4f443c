from pyspark.sql import functions as F

from deskgrain.operators import reports as P
from deskgrain.operators import retrieval as R
from deskgrain.sources import store as S
from deskgrain.streaming import jobs as J


def test_csv_with_line_breaks_and_fallback_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,issue_title,symptoms\n1,Title,"line one\nline ""two"""\n2,Other,\n')
    got = S.read_articles(
        spark, str(tmp_path / "a.csv"),
        {"id": ["id"], "title": ["title", "issue_title"], "content": ["body", "symptoms"], "role": ["role"]},
    ).collect()
    assert [tuple(r) for r in got] == [("1", "Title", 'line one\nline "two"', "")]


def test_jsonl_keeps_malformed_lines_apart(spark, tmp_path):
    from pyspark.sql.types import LongType, StructType

    (tmp_path / "a.jsonl").write_text('{"a": 1}\nnot json\n{"a": 2}\n{"a": "word", "b": 1}\n')
    good, bad = S.read_jsonl(spark, str(tmp_path / "a.jsonl"), StructType().add("a", LongType()))
    assert sorted(r["a"] for r in good.collect()) == [1, 2]
    assert sorted(r["_corrupt_record"] for r in bad.collect()) == ["not json", '{"a": "word", "b": 1}']


def test_upserts(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string"), spark.createDataFrame(
        [(2, "c"), (3, "e"), (3, "d"), (None, "m"), (None, None)], "k int, v string",
    )
    assert sorted(map(tuple, S.upsert(old, new, ["k"]).collect()), key=str) == [(1, "a"), (2, "c"), (3, "e"), (None, "m")]
    assert {r["v"] for r in S.upsert(old, new, ["k"], [F.col("v").asc_nulls_last()]).where("k = 3").collect()} == {"d"}
    assert S.upsert(old, new.limit(0), ["k"]).count() == 3
    assert [tuple(r) for r in S.insert_absent(old, new.where("k > 2"), ["k"], [F.col("v")]).collect()] == [(3, "d")]


def test_p95_is_an_element(spark):
    d = spark.createDataFrame([(float(x),) for x in range(1, 11)], "v double")
    assert P.element_p95(d, "v").first()[0] == 9.0
    assert P.element_p95(d.where("v > 99"), "v").first()[0] is None


def test_streams_read_single_files_and_folders(spark, tmp_path, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    e.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    for path in (f"{sf}/events.parquet", str(tmp_path / "events.parquet")):
        got = J.run_to_folder(J.first_writes(J.events_stream(spark, path), "event_id"), "test")
        assert got.count() == e.count()


def test_latest_state_goes_on_after_a_restart(spark, tmp_path):
    folder, schema = f"file://{tmp_path}/state", "k int, o int, v string"
    state = lambda: J.LatestState(spark, "k", "o", folder, buckets=4)
    assert state().read() is None
    state()(spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (None, 1, "n")], schema), 0)
    state()(spark.createDataFrame([(1, 2, "c"), (1, 0, "z")], schema), 1)
    before = state().state.newest()
    state()(spark.createDataFrame([(1, 2, "c"), (1, 0, "z")], schema), 1)  # a batch that runs again, after the process died
    assert state().state.newest() == before and set(before.values()) == {0, 1}  # only the touched bucket is written again
    state()(spark.createDataFrame([], schema), 2)
    assert sorted(((r["k"], r["v"]) for r in state().read().collect()), key=str) == [(1, "c"), (2, "b"), (None, "n")]


def test_stream_starts_again_where_it_stopped(spark, tmp_path):
    seen, schema = [], "k int, o int, v string"
    for part in range(2):
        spark.createDataFrame([(part, 1, "x")], schema).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        J.run_batches(stream, f"{tmp_path}/check", lambda b, i: seen.append((i, sorted(r["k"] for r in b.collect()))))
    assert seen == [(0, [0]), (1, [1])]


def test_shrinking_and_emptied_documents_leave_nothing_active(spark, tmp_path):
    folder = f"file://{tmp_path}/chunks"
    chunk = lambda d: R.word_windows(d, "doc_id", "text", size=2, overlap=0)
    job = lambda: J.IncrementalIngest(spark, chunk, folder, as_of=F.lit("2024-01-01").cast("timestamp"), buckets=3)
    batches = [[(1, "a b c d e f"), (2, "x y"), (3, "p q r"), (4, None)], [(1, "a b"), (3, ""), (2, "x y")], [(1, "a b c"), (5, "new one")]]
    for i, rows in enumerate(batches):
        job()(spark.createDataFrame(rows, "doc_id long, text string"), i)
    rows = job().read().collect()
    active = sorted((r["article_id"], r["chunk_index"], r["content"], r["document_version"]) for r in rows if r["is_active"])
    assert active == [(1, 0, "a b", 3), (1, 1, "c", 3), (2, 0, "x y", 1), (5, 0, "new one", 1)]
    gone = {(r["article_id"], r["chunk_index"]) for r in rows if not r["is_active"]}
    assert gone == {(1, 2), (3, 0), (3, 1)} and all(r["superseded_reason"] == "document_reingested" for r in rows if not r["is_active"])


def test_fan_out_shows_whole_batches_only_and_each_fact_once(spark, tmp_path):
    tables = {"a": lambda b: b.where("v > 0").select("id", "v"), "b": lambda b: b.where("v > 0").select("id", (F.col("v") * 10).alias("ten"))}

    def batch(*rows):
        return spark.createDataFrame(list(rows), "id int, v int")

    def held(t):
        return sorted(map(tuple, J.FanOut(spark, tables, "id", str(tmp_path)).read(t).collect()))

    out = J.FanOut(spark, tables, "id", str(tmp_path))
    out(batch((1, 1), (1, 1), (2, 0)), 0)
    broken = J.FanOut(spark, {**tables, "b": lambda b: 1 / 0}, "id", str(tmp_path))
    try:
        broken(batch((3, 3), (1, 9)), 1)  # the first table is written, the second and the mark are not
    except ZeroDivisionError:
        pass
    assert held("a") == [(1, 1)] and held("b") == [(1, 10)]
    for _ in range(2):  # the batch is run again, and again after its mark
        out(batch((3, 3), (1, 9)), 1)
        assert held("a") == [(1, 1), (3, 3)] and held("b") == [(1, 10), (3, 30)]
    out(batch((4, 0)), 2)  # nothing negative
    assert held("a") == [(1, 1), (3, 3)]
