"""A transcript stream: whatever is appended, cut or rewritten between batches and restarts, its rows are those of a whole read."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F
from tracelode.sources import tail
from tracelode.streaming import carried


def _finished(path) -> list[str]:
    data = path.read_bytes()
    return [x.removesuffix(b"\r").decode("utf-8", "replace") for x in data[: data.rfind(b"\n") + 1].split(b"\n")[:-1]]


def _run(spark, frame, target, name="q"):
    """The next call restarts the stream from its checkpoint."""
    carried.append_available(frame, f"{target}/{name}", f"{target}/{name}-checkpoint")


def _line(draw: random.Random, i: int) -> str:
    call = f"c{draw.randint(0, 9)}"
    folder = draw.choice([None, None, "/w", "/w/sub", "/x", "/wide"])
    top = {"uuid": f"u{i}", "sessionId": "s", "timestamp": "t"} | ({"cwd": folder} if folder else {})
    way = draw.randrange(7)
    if way == 0:
        return json.dumps(top | {"type": "user", "message": {"role": "user", "content": f"hello {i} é" + "y" * draw.randint(0, 80)}})
    if way == 1:
        named = draw.choice([{}, {"cwd": "/x/deep"}, {"workdir": "/w/other"}, {"cwd": "relative"}])
        return json.dumps(top | {"type": "assistant", "message": {"model": draw.choice(["m1", "m2", "<synthetic>"]), "content": [{"type": "text", "text": "then"}, {"type": "tool_use", "id": call, "name": "Bash", "input": {"command": "ls"} | named}]}})
    if way in (2, 3):
        return json.dumps(top | {"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": call, "content": f"out {i}"}, {"type": "image"}]}})
    if way == 4:
        return json.dumps(top | {"type": "progress"})
    return draw.choice(["", "  ", "{broken", json.dumps(top | {"type": "assistant", "message": {"content": []}}), '"text"'])


def _plainly(path, roots):
    """Records of a file by plain Python."""
    cwd, calls, relevant, out = None, {}, False, []
    inside = lambda folder: folder is not None and any(folder == r or folder.startswith(r + "/") for r in roots)
    for n, line in enumerate(_finished(path), 1):
        try:
            row = json.loads(line)
        except ValueError:
            continue
        if not isinstance(row, dict):
            continue
        cwd = row.get("cwd", cwd)
        relevant = relevant or inside(cwd)
        if row.get("type") not in ("user", "assistant"):
            continue
        model = row["message"].get("model") if row["type"] == "assistant" else None
        model = None if model and model.startswith("<") else model
        content = row["message"]["content"]
        for k, block in enumerate([{"type": "text", "text": content}] if isinstance(content, str) else content):
            if block["type"] == "text":
                out.append((n, f"{row['uuid']}:{k}", row["type"], cwd, model, relevant))
            elif block["type"] == "tool_use":
                named = block["input"].get("cwd") or block["input"].get("workdir") or ""
                calls[block["id"]] = (named if named.startswith("/") else cwd, model)
                out.append((n, f"{row['uuid']}:{k}", "tool_call", *calls[block["id"]], relevant))
            elif block["type"] == "tool_result":
                out.append((n, f"{row['uuid']}:{k}", "tool_result", *calls.get(block["tool_use_id"], (cwd, None)), relevant))
    return sorted([x for x in out if inside(x[3])], key=repr)


def test_lines_of_changing_files(spark, tmp_path):
    """Batches of 3,000 bytes in ranges of 200: appends, cuts, changed bytes, a replaced and a removed file, over restarts."""
    draw, top = random.Random(2), tmp_path / "logs"
    (top / "sub").mkdir(parents=True)
    files = [top / "a.jsonl", top / "sub" / "b.jsonl", top / "c.jsonl"]
    for step in range(4):
        for path in files:
            old = path.read_bytes() if path.exists() else b""
            way = draw.randrange(7) if step else 0
            if way == 4 and old:
                at = draw.randrange(len(old))
                path.write_bytes(old[:at] + b"#" + old[at + 1 :])
            elif way == 5:
                path.write_bytes(old[: len(old) // 2])
            elif way == 6 and old:  # another file at the path
                (tmp_path / "new").write_bytes(b"other\n" * 3)
                (tmp_path / "new").rename(path)
            else:
                path.write_bytes(old + b"".join(b"%d-%d" % (step, i) + b"z" * draw.randint(0, 300) + draw.choice([b"\n", b"\r\n", b"\n\n"]) for i in range(draw.randint(0, 12))) + draw.choice([b"", b"half"]))
        frame = tail.read_tail(spark, str(top), str(tmp_path / "log"), most_bytes=3000, range_bytes=200)
        _run(spark, frame, tmp_path)
        rows = spark.read.parquet(f"{tmp_path}/q")
        latest = carried.last_generation(rows, rows).where("offset >= 0").collect()
        for path in files:
            got = [r["line"] for r in sorted((r for r in latest if r["file"] == str(path)), key=lambda r: r["offset"])]
            assert got == _finished(path), (step, path.name)
        assert rows.groupBy("file", "generation", "offset").count().where("count > 1").count() == 0
    names = [x.name for x in (tmp_path / "log").iterdir()]
    assert len(names) <= 2 * tail.COMPACTED + 1 and not any(x.endswith(".part") for x in names)
    files[0].unlink()
    _run(spark, tail.read_tail(spark, str(top), str(tmp_path / "log"), most_bytes=3000, range_bytes=200), tmp_path)
    before = spark.read.parquet(f"{tmp_path}/q").count()
    _run(spark, tail.read_tail(spark, str(top), str(tmp_path / "log"), reader="of another version"), tmp_path)
    anew = spark.read.parquet(f"{tmp_path}/q").where("offset >= 0").count() - before
    assert anew <= sum(len(_finished(p)) for p in files[1:]) and spark.read.parquet(f"{tmp_path}/q").where("offset < 0").count() >= 2


def test_batches_are_bounded_and_long_lines_pass(spark, tmp_path, monkeypatch):
    top = tmp_path / "logs"
    top.mkdir()
    (top / "flood.jsonl").write_text("f" * 99 + "\n" + "long" * 2000 + "\n" + ("g" * 99 + "\n") * 40)
    (top / "quiet.jsonl").write_text("q\n" * 3)
    (top / ".quiet.jsonl.crc").write_text("hidden\n")
    (top / "_SUCCESS").write_text("")
    log = tmp_path / "log"
    reader = tail._TailReader({"path": str(top), "log": str(log), "bytes": "1000", "range": "300"})
    sizes, last = [], 0
    while (then := reader.latestOffset()["entry"]) > last:
        steps = reader.log.read(f"{then:012d}")["files"]
        sizes.append(sum(s["end"] - s["start"] for s in steps.values()))
        assert [p.file for p in reader.partitions({"entry": last}, {"entry": then})]
        last = then
    assert sum(sizes) == sum(p.stat().st_size for p in top.glob("*.jsonl") if p.name[0] != ".") and sorted(sizes)[-1] > 8000 and sorted(sizes)[-2] <= 1000
    again = tail._TailReader({"path": str(top), "log": str(log), "bytes": "1000", "range": "300"})
    assert again.latestOffset() == {"entry": last}
    monkeypatch.setattr(tail, "MOST_LINE", 50)
    rows = [r for p in again.partitions({"entry": 0}, {"entry": last}) for r in again.read(p)]
    assert sum(r[3] is None for r in rows) == 42 and len(rows) == 45


def test_records_carried_over_batches_and_restarts(spark, tmp_path):
    draw, top = random.Random(5), tmp_path / "logs"
    top.mkdir()
    files, roots = [top / "a.jsonl", top / "b.jsonl"], ["/w"]
    for step in range(3):
        for path in files:
            old = path.read_bytes() if path.exists() else b""
            if step == 1 and path == files[1]:
                old = b""  # rewritten
            path.write_bytes(old + "".join(_line(draw, 100 * step + i) + "\n" for i in range(25)).encode() + b'{"half')
            path.write_bytes(path.read_bytes().removesuffix(b'{"half') if draw.random() < 0.5 else path.read_bytes().replace(b'{"half', b"{}\n"))
        stream = carried.carried_lines(tail.read_tail(spark, str(top), str(tmp_path / "log"), most_bytes=5000, range_bytes=700), roots)
        _run(spark, stream, tmp_path)
    rows = spark.read.parquet(f"{tmp_path}/q")
    got = carried.records_of(carried.last_generation(rows, rows), roots).collect()
    columns = ("n", "native_id", "role", "cwd", "model", "relevant")
    for path in files:
        found = sorted((tuple(r[c] for c in columns) for r in got if r["file"] == str(path)), key=repr)
        assert found == _plainly(path, roots) and len(found) > 10
    lines = spark.createDataFrame([(str(p), 0, n, x) for p in files for n, x in enumerate(_finished(p), 1)], "file string, generation int, n long, line string")
    whole = carried.whole_records(lines, roots)
    key = ["file", "n", "k", "source_id", "role", "content", "cwd", "model", "call_id", "relevant"]
    assert sorted(map(tuple, whole.select(key).collect()), key=repr) == sorted((tuple(r[c] for c in key) for r in got), key=repr)
    every = carried.whole_records(lines, [])
    assert every.count() > whole.count() and every.where(F.col("cwd").startswith("/x")).count()
