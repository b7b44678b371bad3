"""Folders walked on executors with links of every kind; zstandard files by frames against plain decompression."""

from __future__ import annotations

import os
import random

import zstandard
from tracelode.sources import appended, frames, listing


def test_walk(spark, tmp_path):
    top, outside, home = tmp_path / "top", tmp_path / "outside", tmp_path / "home"
    for folder in (top / "a" / "b", outside, home / "h", top / "_tmp"):
        folder.mkdir(parents=True)
    for path in (top / "x.jsonl", top / "x.jsonl.zst", top / "a" / "y.jsonl.zst", top / "a" / "b" / "z.jsonl", top / "a" / "note.txt", outside / "o.jsonl", home / "h" / "in.jsonl", top / "_tmp" / "t.jsonl", top / ".hidden.jsonl"):
        path.write_text("x\n")
    (top / "loop").symlink_to(top)
    (top / "a" / "up").symlink_to(top / "a")
    (top / "out").symlink_to(outside)
    (top / "home").symlink_to(home)
    (top / "again").symlink_to(top / "a" / "b")
    (top / "linked.jsonl").symlink_to(top / "x.jsonl")
    (top / "broken.jsonl").symlink_to(top / "nowhere")
    found = listing.walk(spark, f"file://{top}", [str(home)])
    kinds = {os.path.relpath(r["path"], top): r["kind"] for r in found.collect()}
    assert kinds == {
        ".": "folder", "a": "folder", "again": "folder", "home": "folder", "home/h": "folder", "x.jsonl": "file", "x.jsonl.zst": "file", "a/y.jsonl.zst": "file", "again/z.jsonl": "file", "a/note.txt": "file", "home/h/in.jsonl": "file",
        "out": "outside", "linked.jsonl": "link", "broken.jsonl": "broken link",
    }
    assert sorted((os.path.relpath(r["path"], top), r["packed"]) for r in listing.transcripts(found).collect()) == [("a/y.jsonl.zst", True), ("again/z.jsonl", False), ("home/h/in.jsonl", False), ("x.jsonl", False)]
    assert sorted((os.path.relpath(r["path"], top), r["why"]) for r in listing.skipped(found).collect()) == [("broken.jsonl", "broken link"), ("linked.jsonl", "link"), ("out", "outside")]
    assert listing.walk(spark, str(tmp_path / "none")).count() == 0
    assert listing.walk(spark, str(outside), hidden=True).where("kind = 'file'").count() == 1


def _packed(body: bytes, cuts: list[int], draw: random.Random) -> bytes:
    out = b""
    for a, b in zip([0, *cuts], [*cuts, len(body)], strict=True):
        how = zstandard.ZstdCompressor(level=draw.choice([1, 19]), write_checksum=draw.random() < 0.5, write_content_size=draw.random() < 0.5)
        out += how.compress(body[a:b])
        if draw.random() < 0.3:
            out += (listing_magic := 0x184D2A53).to_bytes(4, "little") + (5).to_bytes(4, "little") + b"skip!"
            assert listing_magic
    return out


def _plain(body: bytes) -> list[tuple]:
    out, at = [], 0
    for n, line in enumerate(body[: body.rfind(b"\n") + 1].split(b"\n")[:-1], 1):
        if line.strip():
            out.append((n, at, line.removesuffix(b"\r").decode()))
        at += len(line) + 1
    return out


def test_frames_equal_plain_decompression(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(frames, "STEP", 1000)
    draw, bodies = random.Random(6), {}
    for k in range(8):
        body = b"".join(draw.choice(["é", "x", "long "]).encode() * draw.randint(0, 300) + draw.choice([b"\n", b"\r\n", b"\n\n"]) for _ in range(draw.randint(0, 80))) + draw.choice([b"", b"half"])
        cuts = sorted(draw.randint(0, len(body)) for _ in range(draw.randint(0, 12)))
        bodies[f"{k}.jsonl.zst"] = body
        (tmp_path / f"{k}.jsonl.zst").write_bytes(_packed(body, cuts, draw))
    lines, refused = appended.read_zstd(spark, f"file://{tmp_path}")
    assert refused.count() == 0
    found = lines.collect()
    for name, body in bodies.items():
        assert sorted((r["n"], r["offset"], r["line"]) for r in found if r["file"].endswith(name)) == _plain(body), name
    index = frames.frame_index(spark.createDataFrame([(str(tmp_path / n),) for n in bodies], "file string"))
    assert index.where("problem IS NOT NULL").count() == 0 and index.count() > len(bodies)


def test_files_that_are_not_whole_are_refused(spark, tmp_path, monkeypatch):
    body = b"".join(b'{"n": %d}\n' % i for i in range(3000))
    one = zstandard.ZstdCompressor(write_checksum=True).compress(body)
    two = one + one
    damaged = bytearray(two)
    damaged[len(one) // 2] ^= 0xFF
    cases = {"good": two, "cut": two[:-1], "cut-first": one[:20], "cut-magic": one + one[:3], "none": b"plain text\n", "tail": one + b"plain text\n", "damaged": bytes(damaged), "empty": b"", "bomb": zstandard.ZstdCompressor().compress(b"0" * 3_000_000)}
    for name, data in cases.items():
        (tmp_path / f"{name}.zst").write_bytes(data)
    lines, refused = frames.read_frames(spark, spark.createDataFrame([(str(tmp_path / f"{n}.zst"),) for n in cases], "file string"), most_bytes=1_000_000)
    assert {os.path.basename(r["file"]).removesuffix(".zst"): r["problem"] for r in refused.collect()} == {"cut": frames.CUT_OFF, "cut-first": frames.CUT_OFF, "cut-magic": frames.CUT_OFF, "none": frames.NO_FRAME, "tail": frames.DAMAGED, "damaged": frames.DAMAGED, "bomb": frames.TOO_LARGE}
    assert [r["line"] for r in lines.orderBy("n").collect()] == body.decode().splitlines() * 2
    monkeypatch.setattr(frames, "MOST_LINE", 100)
    (tmp_path / "long.zst").write_bytes(b"".join(zstandard.ZstdCompressor().compress(x) for x in (b"short\n" + b"y" * 60, b"y" * 30, b"y" * 60 + b"\n" + b"z" * 101 + b"\nlast\n")))
    long, _ = frames.read_frames(spark, spark.createDataFrame([(str(tmp_path / "long.zst"),)], "file string"))
    assert [(r["n"], r["line"]) for r in long.orderBy("n").collect()] == [(1, "short"), (2, None), (3, None), (4, "last")]
