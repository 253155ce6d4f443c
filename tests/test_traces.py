import json

import pytest

from deskgrain.operators import traces as X

TRACE = {
    "trace_id": "a", "user_id": "u", "timestamp": "2024-01-02", "config_hash": "h", "product": "mail", "draft_run_id": "",
    "model_provider": "local key-12345", "redacted_ticket_preview": "help",
    "final_response": {
        "draft_email": "", "answer_text": "use key-12345 twice", "confidence": "LOW", "draft_run_id": "d1", "citations": [],
        "citations_used": ["kb", "c2"], "knowledge_issue_ids": ["k1"], "validation": {"status": "later", "why": ["key-12345", {"deep": 'q"uote9'}]},
    },
    "validation_output": {}, "errors": [], "warnings": ["slow"], "evidence_sent_to_llm": {"chunks": [{}, {}]},
    "stage_events": [{"stage": "search", "note": "key-12345"}, {"stage": "draft", "key-12345": 1}],
    "reranked_results": [
        {"id": "c1", "source_id": "kb", "content_preview": "one key-12345", "score": 0, "used_in_prompt": None, "is_approved": True},
        {"id": "c2", "source_id": "", "rerank_score": 2.5, "used_in_prompt": False, "expires_at": "2024-02-01", "document_version": 3},
        {"id": "c3", "source_id": "ab", "is_active": False},
    ],
    "key-12345": {"nested": [["key-12345"], {"n": 12345}, 'q"uote9', "abc"]},
}


def rows(spark, *texts):
    return spark.createDataFrame([(f"t{i}", f"2024-01-0{i + 1}", x) for i, x in enumerate(texts)], "trace_id string, created_at string, trace string")


def test_run_row(spark):
    run, broken, none, odd = sorted(
        X.diagnosis_runs(rows(spark, json.dumps(TRACE), '{"trace_id": ', None, '{"errors": "bad", "reranked_results": {"a": 1}}')).collect(),
        key=lambda r: (r["trace_id"] != "a", r["trace_id"]),
    )
    assert (run["run_id"], run["draft_run_id"], run["trace_id"], run["status"]) == ("d1", "d1", "a", "ok")
    assert (run["confidence_band"], run["validation_status"], run["answer"]) == ("LOW", "", "use key-12345 twice")
    assert run["citations_used"] == ["kb", "c2"] and run["source_ids"] == ["ab", "kb"] and run["warnings"] == ["slow"]
    assert (run["chunks_retrieved"], run["chunks_sent_to_llm"], run["knowledge_issue_ids"]) == (3, 2, ["k1"])
    for r, name in ((broken, "t1"), (none, "t2")):
        assert (r["run_id"], r["trace_id"], r["status"], r["answer"], r["citations_used"], r["chunks_retrieved"]) == (name, name, "ok", "", [], 0)
    assert odd["status"] == "error" and odd["chunks_retrieved"] == 0


def test_chunk_rows(spark):
    got = sorted(X.diagnosis_chunks(rows(spark, json.dumps(TRACE), "no json")).collect(), key=lambda r: r["rank"])
    assert [(r["rank"], r["chunk_id"], r["score"], r["used_in_prompt"], r["citation_used"]) for r in got] == [
        (1, "c1", 0.0, False, True), (2, "c2", 2.5, False, True), (3, "c3", 0.0, True, False)]
    assert [(r["is_active"], r["is_approved"], r["is_customer_facing_allowed"]) for r in got] == [(True, True, False), (True, False, False), (False, False, False)]
    assert [(r["document_version"], r["chunk_version"], r["expires_at"]) for r in got] == [(1, 1, ""), (3, 1, "2024-02-01"), (1, 1, "")]


def test_bundles_are_six_masked_files_a_trace(spark, tmp_path):
    secrets = ["key-12345", 'q"uote9', "abc"]  # the last is too short to be masked
    path = f"file://{tmp_path}/bundles"
    X.write_bundles(X.bundle(rows(spark, json.dumps(TRACE), "no json"), secrets), path)
    files = list(tmp_path.glob("bundles/trace_id=*/part=*/part-*"))
    assert len(files) == 12 and len({f.parent for f in files}) == 12
    got = {(r["trace_id"], r["part"]): r["value"] for r in X.read_bundles(spark, path).collect()}
    trace = json.loads(got["t0", "trace.json"])
    assert trace["key-12345"] == {"nested": [["[REDACTED_SECRET]"], {"n": 12345}, "[REDACTED_SECRET]", "abc"]}
    assert trace["final_response"]["answer_text"] == "use [REDACTED_SECRET] twice" and trace["reranked_results"][1]["rerank_score"] == 2.5
    assert [json.loads(x) for x in got["t0", "logs.jsonl"].split("\n")] == [
        {"stage": "search", "note": "[REDACTED_SECRET]"}, {"stage": "draft", "[REDACTED_SECRET]": 1}]
    assert got["t0", "retrieved_chunks.md"] == "### c1\none [REDACTED_SECRET]\n\n### c2\n\n\n### c3\n"
    assert got["t0", "final_answer.md"] == "use [REDACTED_SECRET] twice"
    assert json.loads(got["t0", "validation_report.json"])["why"] == ["[REDACTED_SECRET]", {"deep": "[REDACTED_SECRET]"}]
    assert json.loads(got["t0", "config_snapshot.json"])["model_provider"] == "local [REDACTED_SECRET]"
    assert json.loads(got["t1", "trace.json"]) == {} and got["t1", "logs.jsonl"] == got["t1", "final_answer.md"] == ""


def test_bundles_are_renamed_into_place_as_spark_names_them(spark, tmp_path, monkeypatch):
    """In a mounted folder and by Spark's sink alike; the folder is whole or not there, and an old one is not touched."""
    named = [("a/b=c", "x", "one"), ("a/b=c", "y", None), ("ü {[%", "x", "two\nlines\n"), ("t", "x", "first"), ("t", "x", "first")]
    parts = spark.createDataFrame(named, "trace_id string, part string, value string")
    X.write_bundles(parts, f"file://{tmp_path}/by-tasks")
    with pytest.raises(FileExistsError):
        X.write_bundles(parts, f"file://{tmp_path}/by-tasks")
    assert not list(tmp_path.glob("by-tasks/trace_id=*/part=*/*.crc")) and len(list(tmp_path.iterdir())) == 1
    monkeypatch.setattr(X, "_local", lambda spark, path: None)
    X.write_bundles(parts, f"file://{tmp_path}/by-spark")
    folders = [sorted(str(p.parent.relative_to(tmp_path / w)) for p in tmp_path.glob(f"{w}/*/*/part-*")) for w in ("by-tasks", "by-spark")]
    assert folders[0] == folders[1] and len(folders[0]) == 4
    got = [sorted(map(tuple, X.read_bundles(spark, f"file://{tmp_path}/{w}").collect())) for w in ("by-tasks", "by-spark")]
    monkeypatch.undo()
    got += [sorted(map(tuple, X.read_bundles(spark, f"file://{tmp_path}/{w}").collect())) for w in ("by-tasks", "by-spark")]
    assert got[0] == got[1] == got[2] == got[3] == [("a/b=c", "x", "one"), ("a/b=c", "y", ""), ("t", "x", "first\nfirst"), ("ü {[%", "x", "two\nlines\n")]
    assert X.read_bundles(spark, f"file://{tmp_path}/by-tasks").rdd.getNumPartitions() <= 4


def test_masking_of_very_long_strings(spark):
    text = json.dumps({"a": "x\\\"" * 200_000 + "key-12345"})
    got = spark.createDataFrame([(text,)], "t string").select(X.masked_json(X.F.col("t"), ["key-12345"])).first()[0]
    assert json.loads(got)["a"].endswith('"[REDACTED_SECRET]') and len(got) == len(text) + len(X.SECRET_MARK) - 9


def test_listings_take_the_newest(spark):
    t = rows(spark, json.dumps(TRACE), "no json", json.dumps({**TRACE, "trace_id": "b"}))
    got = X.listing(t, 2).collect()
    assert [(r["trace_id"], r["ticket_preview"], r["confidence"], r["retrieved_result_count"]) for r in got] == [("t2", "help", "LOW", 3), ("t1", "", "", 0)]
    assert [(r["id"], r["trace_id"], r["validation_status"]) for r in X.drafts(t, 1).collect()] == [("d1", "b", "")]
