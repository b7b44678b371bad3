"""Reading what was appended, split by split, compressed, and from Git: incremental equals whole."""

from __future__ import annotations

import random
import subprocess

import pytest
from tracelode.sources import appended, git, sqlite, transcripts


def _plain(path) -> list[tuple]:
    """Finished lines of a file by plain Python: (n, offset, line)."""
    out, at, n = [], 0, 0
    data = path.read_bytes()
    for line in data[: data.rfind(b"\n") + 1].split(b"\n")[:-1]:
        n += 1
        if line.strip():
            out.append((n, at, line.removesuffix(b"\r").decode()))
        at += len(line) + 1
    return out


def _rows(lines, name: str) -> list[tuple]:
    return sorted((r["n"], r["offset"], r["line"]) for r in lines.collect() if r["file"].endswith(name))


def test_lines_of_splits(spark, tmp_path):
    draw = random.Random(3)
    (tmp_path / "a.jsonl").write_bytes(b"".join(b"%d " % i + b"x" * draw.randint(0, 90) + draw.choice([b"\n", b"\r\n", b"\n\n"]) for i in range(3000)) + b"not finished")
    (tmp_path / "b.jsonl").write_bytes("é\nlast\n".encode())
    (tmp_path / "c.jsonl").write_bytes(b"")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        lines = transcripts.read_lines(spark, f"file://{tmp_path}")
        assert lines.select("file").distinct().count() == 2
        for name in ("a.jsonl", "b.jsonl"):
            assert _rows(lines, name) == _plain(tmp_path / name)
        ends = {r["file"].rsplit("/", 1)[1]: r["end"] for r in transcripts.offsets_of(lines).collect()}
        assert ends["b.jsonl"] == (tmp_path / "b.jsonl").stat().st_size
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_overlong_lines_are_told(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(transcripts, "MOST_LINE", 50)
    (tmp_path / "a.jsonl").write_text('{"type": "user"}\n' + "y" * 60 + "\n")
    lines = transcripts.read_lines(spark, f"file://{tmp_path}")
    assert [(r["n"], r["line"] is None) for r in lines.orderBy("n").collect()] == [(1, False), (2, True)]
    assert {(r["type"], r["bucket"], r["n"]) for r in transcripts.row_types(lines).collect()} == {("user", "known", 1), ("too long", "unreadable", 1)}


def test_appended_equals_whole(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(appended, "RANGE", 700)
    draw, top = random.Random(11), tmp_path / "logs"
    (top / "sub").mkdir(parents=True)
    files, seen, state = [top / "a.jsonl", top / "sub" / "b.jsonl"], {}, None
    for step in range(7):
        for path in files:
            old = path.read_bytes() if path.exists() else b""
            way = draw.randrange(6) if step else 0
            if way == 4 and old:  # a byte before the end is changed
                at = draw.randrange(len(old))
                path.write_bytes(old[:at] + b"#" + old[at + 1 :])
            elif way == 5:  # shortened
                path.write_bytes(old[: len(old) // 2])
            else:
                path.write_bytes(old + b"".join(b"%d-%d" % (step, i) + b"z" * draw.randint(0, 200) + draw.choice([b"\n", b"\r\n", b"\n\n"]) for i in range(draw.randint(0, 12))) + draw.choice([b"", b"half"]))
        lines, then = appended.read_appended(spark, str(top), state)
        new = {str(p): _rows(lines, p.name) for p in files}
        read_on = {r["file"]: r for r in state.collect()} if state is not None else {}
        for path in files:
            name = str(path)
            whole = _plain(path)
            earlier = read_on.get(name)
            goes_on = earlier is not None and not (new[name] and new[name][0][1] < earlier["end"])
            if goes_on and path.stat().st_size >= earlier["end"] and appended._edges(name, earlier["end"]) == (earlier["head"], earlier["tail"]):
                assert [(o, t) for _, o, t in seen.get(name, [])] + [(o, t) for _, o, t in new[name]] == [(o, t) for _, o, t in whole]
                seen[name] = seen.get(name, []) + new[name]
            else:
                assert [(o, t) for _, o, t in new[name]] == [(o, t) for _, o, t in whole]
                seen[name] = new[name]
        state = spark.createDataFrame(then.collect(), appended.STATE)
    lines, _ = appended.read_appended(spark, str(top), state)
    assert lines.count() == 0
    assert appended.read_appended(spark, str(tmp_path / "none"))[0].count() == 0


def test_git_commits(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    run("init", "-q")
    for i in range(3):
        (tmp_path / "f.txt").write_text(f"line {i}\n")
        (tmp_path / "out").mkdir(exist_ok=True)
        (tmp_path / "out" / "g.txt").write_text(f"made {i}\n")
        run("add", "-A")
        run("commit", "-qm", f"change {i}")
    (tmp_path / "f.txt").write_text("not staged\n")
    rows = git.commits(spark, [str(tmp_path), str(tmp_path), str(tmp_path / "nowhere")], exclude=("out",), limit=2).orderBy("pos").collect()
    assert [r["kind"] for r in rows][:3] == ["commit", "commit", "unstaged"] and len({r["source_id"] for r in rows}) == 3
    assert "change 2" in rows[0]["content"] and "+line 2" in rows[0]["content"] and "made" not in rows[0]["content"]
    assert rows[0]["parent"] == rows[1]["native_id"] and "+not staged" in rows[2]["content"]


def test_sqlite_sessions(spark, tmp_path):
    import json
    import sqlite3

    with sqlite3.connect(tmp_path / "s.db") as db:
        db.execute("CREATE TABLE session (id, parent_id, directory, title, time_created, time_updated)")
        db.execute("CREATE TABLE message (id, session_id, time_created, data)")
        db.execute("CREATE TABLE part (id, message_id, session_id, time_created, data)")
        db.execute("INSERT INTO session VALUES ('s1', NULL, '/w', 't', 1, 9)")
        db.execute("INSERT INTO message VALUES ('m1', 's1', 1, ?)", [json.dumps({"role": "user"})])
        db.executemany("INSERT INTO part VALUES (?, 'm1', 's1', 2, ?)", [("p1", json.dumps({"type": "text", "text": "hi"})), ("p2", json.dumps({"type": "tool", "callID": "k", "tool": "bash", "state": {"input": {"command": "ls"}, "output": "a"}})), ("p3", json.dumps({"type": "reasoning", "text": "no"}))])
    rows = sqlite.session_records(spark, f"file://{tmp_path}/s.db").orderBy("role").collect()
    assert [(r["role"], r["content"], r["call_id"], r["cwd"]) for r in rows] == [("tool_call", 'Tool: bash\n{"command":"ls"}', "k", "/w"), ("tool_result", "a", "k", "/w"), ("user", "hi", None, "/w")]
    assert [tuple(r) for r in sqlite.session_times(spark, str(tmp_path / "s.db")).collect()] == [("s1", 9)]
    with pytest.raises(Exception, match="credential"):
        spark.read.format("session_sqlite").option("path", str(tmp_path / "s.db")).option("table", "credential").load().collect()
