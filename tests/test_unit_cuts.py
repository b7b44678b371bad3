"""Units by pointer doubling over blocks against the plain walk through each session."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from tracelode.operators import unit_cuts
from tracelode.operators.unit_cuts import Limits

SCHEMA = "session_id long, pos long, role string, at timestamp, cost long, links array<string>, prompt boolean, compaction boolean, hint string, failed boolean, i string, unit string"
FLAGS = ("safe", "natural", "turn", "result", "commit")


def _session(draw: random.Random, session, n: int) -> list[tuple]:
    at, out = datetime(2024, 1, 1), []
    for pos in range(n):
        at += timedelta(minutes=draw.choice([1, 1, 1, 1, 5, 30, 70, 200]) if draw.random() < 0.3 else 1)
        role = draw.choice(["user", "assistant", "tool_call", "tool_result"])
        links = [f"l{(pos + draw.randint(0, 3)) // 5}" if draw.random() < 0.4 else None, f"f{pos // 40}" if draw.random() < 0.02 else None]
        hint = draw.choice(["run", "commit", "read", None])
        out.append((session, 3 * pos, role, at if draw.random() < 0.95 else None, draw.choice([0, 10, 50, 90, 400, None]), draw.choice([links, links, [], None]), role == "user" and draw.random() < 0.3, draw.random() < 0.01 or None, hint, draw.random() < 0.5, "x", "y"))
    return out


def _plain_flags(rows: list[tuple]) -> dict[str, list[bool]]:
    out = {k: [False] * len(rows) for k in FLAGS}
    last = {link: i for i, r in enumerate(rows) for link in r[5] or [] if link}
    open_until = -1
    for i, row in enumerate(rows[:-1]):
        open_until = max([open_until, *(last[x] for x in row[5] or [] if x)])
        if open_until > i:
            continue
        then = rows[i + 1]
        gap = (then[3] - row[3]).total_seconds() if then[3] and row[3] else None
        out["safe"][i + 1] = True
        out["natural"][i + 1] = bool(then[7]) or (gap is not None and (gap >= 10800 or (gap >= 3600 and then[3].date() != row[3].date())))
        out["turn"][i + 1] = then[6]
        out["result"][i + 1] = row[2] == "tool_result" and row[8] in unit_cuts.RESULT_HINTS
        out["commit"][i + 1] = out["result"][i + 1] and row[8] == "commit" and not row[9]
    return out


def _check(spark, sessions: dict, limits: Limits):
    cuts = unit_cuts.boundaries(spark.createDataFrame([r for rows in sessions.values() for r in rows], SCHEMA).repartition(5))
    found = {}
    for r in cuts.collect():
        found.setdefault(r["session_id"], {})[r["i"]] = tuple(r[f] for f in FLAGS)
    units = {}
    for r in unit_cuts.best_units(cuts, limits).collect():
        units.setdefault(r["session_id"], {})[r["pos"]] = (r["unit"], r["begun"], r["why"])
    seen = set()
    for session, rows in sessions.items():
        flags = _plain_flags(rows)
        assert [found[session][i] for i in range(len(rows))] == [tuple(flags[f][i] for f in FLAGS) for i in range(len(rows))]
        starts = list(unit_cuts.plain_units([r[4] or 0 for r in rows], flags, limits))
        wanted, unit = {}, -1
        begins = dict(starts)
        for i, row in enumerate(rows):
            unit += i in begins
            wanted[row[1]] = (unit, i in begins, begins.get(i))
        assert units[session] == wanted
        seen |= set(begins.values())
    return seen


@pytest.mark.parametrize("block", [25, 4096])
def test_units_equal_the_plain_walk(spark, block):
    draw = random.Random(9)
    sessions = {s: _session(draw, s, n) for s, n in ((1, 1), (2, 2), (3, 700), (4, 90), (None, 130), (6, 24), (7, 25), (8, 26))}
    seen = _check(spark, sessions, Limits(records=20, chars=1500, payload=40_000, block=block))
    assert seen == {"", "limit", "natural", "commit", "turn", "result", "safe"}


def test_one_session_is_many_blocks(spark):
    """All rows are one session without any natural cut: 45 blocks, joined in six rounds."""
    draw = random.Random(1)
    rows = [(*r[:3], None, *r[4:7], None, *r[8:]) for r in _session(draw, 1, 1800)]
    _check(spark, {1: rows}, Limits(records=30, chars=2000, payload=60_000, block=40))


def test_awkward_sessions(spark):
    assert unit_cuts.best_units(unit_cuts.boundaries(spark.createDataFrame([], SCHEMA))).count() == 0
    long = [(1, p, "user", None, c, None, False, None, None, None, "", "") for p, c in enumerate([10**9, 0, 10**9, 5, 5])]
    linked = [(2, p, "tool_call", None, 10, ["a"], False, None, None, None, "", "") for p in range(50)]
    _check(spark, {1: long, 2: linked}, Limits(records=8, chars=100, payload=200_000, block=9))
    with pytest.raises(ValueError, match="block"):
        unit_cuts.best_units(unit_cuts.boundaries(spark.createDataFrame(long, SCHEMA)), Limits(records=8, block=8))


def test_many_short_sessions_take_no_call_each(spark):
    rows = [r for s in range(300) for r in _session(random.Random(s), s, 7)]
    units = unit_cuts.best_units(unit_cuts.boundaries(spark.createDataFrame(rows, SCHEMA)), Limits(records=5, chars=300, payload=32_000, block=6))
    assert "FlatMapGroups" not in units._jdf.queryExecution().optimizedPlan().toString()
    _check(spark, {s: _session(random.Random(s), s, 5 + s % 9) for s in range(40)}, Limits(records=5, chars=300, payload=32_000, block=6))


def test_blocks_are_cut_in_any_batches():
    import pyarrow as pa

    rows = [(b, i) for n in (3, 8, 1, 4) for b in range(-(-n // 4)) for i in range(4 * b, min(n, 4 * b + 6))]
    table = pa.table({"block": pa.array([b for b, _ in rows], pa.int32()), "i": pa.array([i for _, i in rows], pa.int64())})
    for size in (1, 2, 5, 100):
        found = [t.slice(low, high - low)["i"].to_pylist() for t, at in unit_cuts._groups(iter(table.to_batches(max_chunksize=size))) for low, high in zip(at[:-1], at[1:], strict=True)]
        assert found == [[0, 1, 2], [0, 1, 2, 3, 4, 5], [4, 5, 6, 7], [0], [0, 1, 2, 3]]
