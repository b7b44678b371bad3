"""Transcript files and streams."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tracelode.sources import transcripts
from tracelode.streaming import reminders, sessions

CODEX = [
    {"type": "session_meta", "timestamp": "2026-01-01T00:00:00Z", "payload": {"id": "c1", "cwd": "/w/a"}},
    {"type": "turn_context", "payload": {"cwd": "/w/a/sub", "model": "m1"}},
    {"type": "response_item", "timestamp": "2026-01-01T00:00:01Z", "payload": {"type": "message", "id": "i1", "role": "user", "content": [{"type": "input_text", "text": "fix it"}]}},
    {"type": "response_item", "payload": {"type": "function_call", "name": "shell", "call_id": "k1", "arguments": '{"command": "ls"}'}},
    {"type": "response_item", "payload": {"type": "function_call_output", "call_id": "k1", "output": 'token = "f33e61083db5dbdf4bd2369d2f80176e57f7fda2"'}},
    {"type": "mystery"},
]
CLAUDE = [
    {"type": "user", "uuid": "u1", "sessionId": "s1", "cwd": "/w/b", "timestamp": "2026-01-01T00:00:00Z", "message": {"content": "hello"}},
    {"type": "assistant", "uuid": "u2", "sessionId": "s1", "message": {"model": "m2", "content": [{"type": "text", "text": "sure"}, {"type": "tool_use", "id": "t1", "name": "Bash", "input": {"command": "ls"}}, {"type": "thinking", "text": "no"}]}},
    {"type": "user", "uuid": "u3", "sessionId": "s1", "message": {"content": [{"type": "tool_result", "tool_use_id": "t1", "content": "a.py"}]}},
]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("logs")
    (top / "codex.jsonl").write_text("".join(json.dumps(r) + "\n" for r in CODEX) + "\nbroken {\n")
    (top / "claude").mkdir()
    (top / "claude" / "s1.jsonl").write_text("".join(json.dumps(r) + "\r\n" for r in CLAUDE))
    return top


def test_codex(spark, folder):
    lines = transcripts.read_lines(spark, f"file://{folder}/codex.jsonl")
    rows = [(r["role"], r["content"], r["cwd"], r["call_id"], r["model"], r["session_id"]) for r in transcripts.codex_records(lines).orderBy("pos").collect()]
    assert rows == [("user", "fix it", "/w/a/sub", None, "m1", "c1"), ("tool_call", 'Tool: shell\n{"command": "ls"}', "/w/a/sub", "k1", "m1", "c1"), ("tool_result", 'token = "[secret hidden]"', "/w/a/sub", "k1", "m1", "c1")]
    kinds = {r["type"]: (r["bucket"], r["n"]) for r in transcripts.row_types(lines).collect()}
    assert kinds["mystery"] == ("unknown", 1) and kinds["corrupt"] == ("unreadable", 1) and kinds["response_item"] == ("known", 3)


def test_claude(spark, folder):
    lines = transcripts.read_lines(spark, f"file://{folder}/claude")
    rows = [(r["role"], r["content"], r["cwd"], r["call_id"]) for r in transcripts.claude_records(lines).orderBy("pos", "native_id").collect()]
    assert rows == [("user", "hello", "/w/b", None), ("assistant", "sure", "/w/b", None), ("tool_call", 'Tool: Bash\n{"command":"ls"}', "/w/b", "t1"), ("tool_result", "a.py", "/w/b", "t1")]


def test_collected_ids_do_not_depend_on_the_place(spark, folder, tmp_path):
    import shutil

    shutil.copytree(folder, tmp_path / "moved")
    read = lambda top: transcripts.collect_records(transcripts.codex_records(transcripts.read_lines(spark, f"file://{top}/codex.jsonl")), transcripts.claude_records(transcripts.read_lines(spark, f"file://{top}/claude")))
    key = lambda df: sorted((r["source_id"], r["content_hash"]) for r in df.collect())
    assert key(read(folder)) == key(read(tmp_path / "moved")) == key(transcripts.collect_records(read(folder), read(tmp_path / "moved")))


def test_scope(spark):
    rows = spark.createDataFrame([("/a/b/c",), ("/a/bc",), ("/a/b",), (None,), ("/z",)], "path string")
    found = {r["path"]: r["root"] for r in transcripts.in_scope(rows, spark.createDataFrame([("/a",), ("/a/b",)], "root string")).collect()}
    assert found == {"/a/b/c": "/a/b", "/a/bc": "/a", "/a/b": "/a/b", None: None, "/z": None}


def _stream(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).withColumn("at", F.to_timestamp("at")).write.parquet(f"{tmp_path}/in")
    return spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")


def _run(stream, name, tmp_path, spark):
    query = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/checkpoint-{name}").trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name).collect()


def test_quiet_sessions_stream(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:30:00"), (1, "2024-01-01 05:00:00"), (2, "2024-01-01 00:10:00"), (3, "2024-01-03 00:00:00")]
    stream = _stream(spark, tmp_path, rows, "session_id long, at string")
    found = sorted((r["session_id"], r["n"]) for r in _run(sessions.quiet_sessions(stream), "quiet", tmp_path, spark))
    assert found == [(1, 1), (1, 2), (2, 1)]


def test_first_signals_stream(spark, tmp_path):
    stream = _stream(spark, tmp_path, [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:30"), (2, "2024-01-01 00:00:10")], "session_id long, at string")
    assert sorted(r["session_id"] for r in _run(sessions.first_signals(stream), "first", tmp_path, spark)) == [1, 2]


def test_upsert_stream(spark, tmp_path):
    stream = _stream(spark, tmp_path, [(1, "2024-01-01", "a"), (1, "2024-01-02", "b"), (2, "2024-01-01", "c")], "id long, at string, v string")
    query = stream.writeStream.foreachBatch(sessions.upsert_each_batch(f"file://{tmp_path}/out", "id", "at")).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted((r["id"], r["v"]) for r in spark.read.parquet(f"{tmp_path}/out/state-0").collect()) == [(1, "b"), (2, "c")]


def test_reminders_stream(spark, tmp_path):
    rows = [(1, f"2024-01-01 00:{m:02d}:00", m * 60_000, False) for m in range(12)] + [(2, "2024-01-01 00:00:00", 0, False), (2, "2024-01-01 00:01:00", 60_000, True)]
    stream = _stream(spark, tmp_path, rows, "session_id long, at string, ms long, is_commit boolean").withWatermark("at", "1 minute")
    found = sorted((r["session_id"], r["n_items"], r["why"]) for r in _run(reminders.reminders(stream), "due", tmp_path, spark))
    assert (1, 10, "count") in found and (2, 2, "commit") in found
