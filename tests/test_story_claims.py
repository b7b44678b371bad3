"""Story answers: every reason, turned and repeated claims, and refusals handed on."""

from __future__ import annotations

import json

from tracelode.operators import story_claims as sc

RECORDS = "unit_id long, source_id string, pos long, session_id string, role string, prompt boolean"
ITEMS = "unit_id long, item_id string, edit boolean, run boolean, delegate boolean, status string, inline boolean, sources array<string>"


def _tables(spark, answers: dict):
    roles = ["user", "tool_call", "tool_call", "tool_result", "assistant", "tool_call", "user", "assistant", "assistant", "user"]
    records = [(u, f"r{i}", i, "other" if i in (8,) else "main", role, role == "user") for u in answers for i, role in enumerate(roles)]
    items = [
        ("edit", True, False, False, "applied", False, ["r1"]), ("run", False, True, False, "passed", False, ["r2", "r3"]), ("odd", False, True, False, "unknown", False, ["r2"]),
        ("late", True, False, False, "applied", False, ["r5"]), ("far", False, True, False, "failed", False, ["r8"]), ("agent", False, False, True, "asked", False, ["r2"]),
        ("inline", False, True, False, "passed", True, ["r5"]), ("lost", True, False, False, "applied", False, ["nowhere"]), ("note", False, False, False, "x", False, ["r4"]),
    ]
    blocks = [(u, f"B{i}", f"r{i}") for u in answers for i in (0, 1, 4, 7, 8)]
    return (
        spark.createDataFrame([(u, a if isinstance(a, str) else json.dumps(a)) for u, a in answers.items()], "unit_id long, answer string"),
        spark.createDataFrame(records, RECORDS), spark.createDataFrame([(u, *i) for u in answers for i in items], ITEMS),
        spark.createDataFrame(blocks, "unit_id long, block_id string, source_id string"), spark.createDataFrame([(u, "P1", "main") for u in answers] + [(u, "P2", "third") for u in answers] + [(u, "P3", "other") for u in answers], "unit_id long, request_id string, session_id string"),
    )


def _reasons(judged, unit=1):
    return {(r["from_id"], r["to_id"], r["relation"]): (r["reason"], r["turned"], r["blocks"]) for r in judged.links.where(f"unit_id = {unit}").collect()}


def test_checks(spark):
    link = lambda a, b, *blocks: {"from": a, "to": b, "relation": "verifies", "blocks": list(blocks)}
    links = [link("run", "edit", "B1"), link("edit", "run", "B4", "B0"), link("run", "run", "B4"), link("edit", "edit"), link("edit", "odd", "B4"), link("edit", "far", "B8"), link("late", "run", "B7"), link("late", "inline", "B7"), link("lost", "run", "B4"), link("nobody", "run"), link("edit", "inline", "B1", "B4")]
    answer = {"links": links, "work": [{"id": "edit", "checked_by": [{"run": "run", "blocks": ["B7", "B4"]}]}]}
    got = _reasons(sc.judge(*_tables(spark, {1: answer})))
    assert got == {
        ("edit", "run", "verifies"): (None, True, ["B4", "B7"]), ("run", "run", "verifies"): (sc.NOT_EDIT, False, ["B4"]), ("edit", "edit", "verifies"): (sc.NOT_RUN, False, []), ("edit", "odd", "verifies"): (sc.UNKNOWN, False, ["B4"]),
        ("edit", "far", "verifies"): (sc.OTHER_SESSION, False, []), ("late", "run", "verifies"): (sc.TOO_EARLY, False, ["B7"]), ("late", "inline", "verifies"): (None, False, ["B7"]), ("lost", "run", "verifies"): (sc.OTHER_SESSION, False, ["B4"]),
        ("nobody", "run", "verifies"): (sc.NOT_EDIT, False, []), ("edit", "inline", "verifies"): (sc.NO_REPORT, False, []),
    }


def test_answers(spark):
    reply = lambda item, *blocks: {"item": item, "blocks": list(blocks)}
    story = [{"id": "told", "kind": "outcome", "title": "t", "status": "x", "blocks": ["B7"]}, {"id": "gone", "kind": "outcome", "title": "t", "status": "x"}]
    requests = [
        {"id": "Q1", "answered_by": [reply("agent", "B4"), reply("Q2", "B4"), reply("none", "B4"), reply("note", "B0"), reply("gone", "B4"), reply("run", "B4"), reply("edit", "B4")]},
        {"id": "Q2", "answered_by": [reply("note", "B4"), reply("told", "B7"), reply("late", "B7"), reply("run", "B8")]}, {"id": "Q3", "answered_by": [reply("note", "B7")]},
        {"id": "P1", "answered_by": [reply("note", "B7")]}, {"id": "P2", "answered_by": [reply("note", "B7")]}, {"id": "P3", "answered_by": [reply("note", "B8")]}, {"id": "edit", "answered_by": [reply("note", "B7")]},
    ]
    answer = {"story": story, "requests": requests, "links": [{"from": "told", "to": "Q1", "relation": "answers", "blocks": ["B7"]}, {"from": "told", "to": "gone", "relation": "motivates"}, {"from": "told", "to": "edit", "relation": "motivates"}, {"from": "told", "to": "??", "relation": "produces"}]}
    judged = sc.judge(*_tables(spark, {1: answer, 2: "not json", 3: {"links": None}}))
    got = {k[:2]: v[0] for k, v in _reasons(judged).items()}
    assert got == {
        ("Q1", "agent"): sc.HANDED_OVER, ("Q1", "Q2"): sc.NOT_HERE, ("Q1", "none"): sc.NOT_HERE, ("Q1", "note"): sc.NO_REPLY, ("Q1", "gone"): sc.NOT_KEPT, ("Q1", "run"): None, ("Q1", "edit"): sc.SAME_REPLY, ("Q1", "told"): None,
        ("Q2", "note"): sc.NO_REPLY_AFTER, ("Q2", "told"): None, ("Q2", "late"): sc.SAME_REPLY, ("Q2", "run"): sc.NO_REPLY_AFTER, ("Q3", "note"): sc.NO_REPLY_AFTER, ("P1", "note"): sc.LATE_REPLY, ("P2", "note"): sc.NO_REPLY_IN, ("P3", "note"): None, ("edit", "note"): sc.NOT_REQUEST,
        ("told", "gone"): sc.LOST_END, ("told", "edit"): None, ("told", "??"): sc.LOST_END,
    }
    assert sorted(tuple(r) for r in judged.unclaimed.where("unit_id = 1").collect()) == []
    assert sorted(r["block_id"] for r in judged.unclaimed.where("unit_id = 2").collect()) == ["B4", "B7", "B8"]


def test_refusals_are_handed_on(spark):
    event = lambda key, blocks=(), work=(): {"id": key, "kind": "outcome", "title": key, "status": "x", "blocks": list(blocks), "work": list(work)}
    story = [event("c3", work=["c2"]), event("c2", work=["c1"]), event("c1", work=["c0", "?"]), event("c0", work=["lost"]), event("both", work=["c1", "sound"]), event("sound", ["B4"]), event("byitem", work=["edit"]), event("x", work=["y"]), event("y", work=["x"]), event("onx", work=["y", "both"]), event("self", work=["self"]), event("edit", ["B4"]), event("B0", ["B4"]), event("Q1", ["B4"]), event("ev_1", ["B4"]), event("sound", ["B7"])]
    judged = sc.judge(*_tables(spark, {1: {"story": story, "links": [{"from": "sound", "to": "c3", "relation": "motivates"}]}}))
    got = sorted((r["id"], r["reason"], r["round"]) for r in judged.events.collect() if r["reason"])
    assert got == sorted([("c0", sc.NO_EVIDENCE, 0), ("c1", sc.NO_EVIDENCE, 1), ("c2", sc.NO_EVIDENCE, 2), ("c3", sc.NO_EVIDENCE, 3), ("self", sc.NO_EVIDENCE, 0), ("x", sc.NO_EVIDENCE, None), ("y", sc.NO_EVIDENCE, None), *[(k, sc.TAKEN, None) for k in ("edit", "B0", "Q1", "ev_1", "sound")]], key=lambda x: (x[0], x[1], x[2]))
    assert sorted(r["id"] for r in judged.events.where("reason IS NULL").collect()) == ["both", "byitem", "onx", "sound"]
    assert _reasons(judged)[("sound", "c3", "motivates")][0] == sc.LOST_END
    assert sorted(r["block_id"] for r in judged.unclaimed.collect()) == ["B7", "B8"]


def test_nothing_told(spark):
    judged = sc.judge(*_tables(spark, {1: {}}))
    assert judged.links.count() == judged.events.count() == 0 and judged.unclaimed.count() == 3
