"""Notes: every reason, links through aliases, batches run again, and two writers at once."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from tracelode.operators import notes as rules
from tracelode.sources import appends
from tracelode.sources.versions import VersionConflict
from tracelode.streaming import notes

AT = datetime(2024, 1, 1)
RECORDS = [
    ("r0", "s", 0, "user", "please change the parser", None), ("r1", "s", 1, "tool_call", "edit parser.py: fixed the parser now", False), ("r2", "s", 2, "tool_result", "12 passed, 0 failed in the run", False),
    ("r3", "s", 3, "assistant", "12 passed, 0 failed in the run, so the parser is right", None), ("r4", "s", 4, "tool_result", "3 failed in another run", True), ("x1", "other", 1, "assistant", "words of another session", None), ("r5", "s", 5, "assistant", None, None),
]


@pytest.fixture
def records(spark):
    rows = [(i, s, p, role, c, AT + timedelta(minutes=p) if i != "r4" else AT + timedelta(minutes=4), f) for i, s, p, role, c, f in RECORDS]
    return spark.createDataFrame(rows, "record_id string, session_id string, pos long, role string, content string, recorded_at timestamp, failed boolean")


def _notes(spark, rows):
    return spark.createDataFrame([(i, "s", kind, f"title {i}", quotes, status, relations, AT + timedelta(seconds=k)) for k, (i, kind, quotes, status, relations) in enumerate(rows)], rules.NOTE)


DECISION = ["the parser is right"]


def test_every_reason(spark, records, tmp_path):
    run, failed = ["12 passed, 0 failed"], ["3 failed in another"]
    rows = [
        ("a", "wish", DECISION, None, None), ("b", "outcome", run, None, None), ("c", "decision", DECISION, "great", None), ("d", "decision", [], None, None), ("e", "decision", None, None, None), ("f", "decision", DECISION, None, {"likes": ["a"]}),
        ("g", "decision", DECISION, None, {"verifies": ["z"]}), ("h", "goal", DECISION, None, {"answers": ["z"]}), ("i", "decision", ["short"], None, None), ("j", "decision", ["words of another session"], None, None), ("k", "outcome", DECISION, "observed_success", None),
        ("l", "outcome", failed, "observed_success", None), ("m", "decision", DECISION, None, {"motivates": ["nothing"]}), ("n", "decision", DECISION, None, {"revises": ["m"]}), ("o", "decision", DECISION, None, {"revises": ["n"], "motivates": []}), ("p", "decision", DECISION, None, {"revises": ["q"]}),
        ("q", "decision", DECISION, None, None), ("r", "outcome", run, "observed_success", {"verifies": ["q"]}), ("s", "outcome", failed, "observed_failure", {"verifies": ["q"]}), ("t", "action", ["fixed the parser"], None, {"revises": ["q"]}), ("u", "outcome", run, "reported_complete", None), ("q", "decision", DECISION, None, None), (None, "decision", DECISION, None, None),
    ]
    judged, stored, edges = rules.stored(rules.checked(_notes(spark, rows).where("note_id IS NOT NULL").dropDuplicates(["note_id"]), records), spark.createDataFrame([], rules.EVENT), spark.createDataFrame([], rules.ALIAS))
    assert {r["note_id"]: r["reason"] for r in judged.collect() if r["reason"]} == {
        "a": rules.BAD_KIND, "b": rules.NO_STATUS, "c": rules.BAD_STATUS, "d": rules.NO_QUOTE, "e": rules.NO_QUOTE, "f": rules.BAD_RELATION, "g": rules.NOT_OBSERVED, "h": rules.GOAL_ANSWERS, "i": rules.SHORT_QUOTE, "j": rules.NOT_FOUND,
        "k": rules.NO_RESULT, "l": rules.RUN_FAILED, "m": rules.NO_EVENT, "n": rules.NO_EVENT, "o": rules.NO_EVENT, "p": rules.NO_EVENT, "r": rules.RAN_BEFORE,
    }
    kept = {r["note_id"]: (r["status"], r["basis"], r["record_ids"]) for r in stored.collect()}
    assert kept == {"q": ("adopted", "explicit_statement", ["r3"]), "s": ("observed_failure", "tool_record", ["r4"]), "t": ("applied", "tool_record", ["r1"]), "u": ("reported_complete", "explicit_statement", ["r3"])}
    assert sorted(r["relation"] for r in edges.collect()) == ["revises", "verifies"]


def test_batches_run_again_change_nothing(spark, records, tmp_path):
    root = f"file://{tmp_path}/store"
    flush = notes.flush_each_batch(records, root)
    first = _notes(spark, [("q1", "decision", DECISION, None, None), ("bad", "wish", DECISION, None, None)])
    then = _notes(spark, [("q2", "decision", DECISION, None, {"revises": ["q1"]}), ("q3", "decision", DECISION, None, {"revises": ["bad"]}), ("q1", "decision", DECISION, None, None)])
    for number, batch in ((0, first), (0, first), (1, then), (0, first), (1, then)):
        flush(batch, number)
    events, edges, aliases, refusals = notes.stored(spark, root)
    assert sorted(r["note_id"] for r in events.collect()) == ["q1", "q2"] and appends.Snapshot(spark, root).version == 2
    ids = {r["note_id"]: r["event_id"] for r in events.collect()}
    assert [tuple(r) for r in edges.collect()] == [(ids["q1"], ids["q2"], "revises")]
    assert {r["alias"]: r["event_id"] for r in aliases.collect()} == ids
    assert [(r[0], r[2]) for r in refusals] == [("bad", rules.BAD_KIND), ("q3", rules.NO_EVENT)]
    flush(_notes(spark, [(f"bad{i:02d}", "wish", DECISION, None, None) for i in range(14)]), 2)
    assert [r[0] for r in notes.stored(spark, root)[3]] == [f"bad{i:02d}" for i in range(4, 14)]
    assert notes.stored(spark, f"file://{tmp_path}/none")[0].count() == 0


def test_two_writers(spark, records, tmp_path, monkeypatch):
    """The other writer commits between this one's reading and its commit: both notes stand, and this one's link to the other's is found."""
    root, plain, done = f"file://{tmp_path}/store", appends.commit, []

    def commit(snapshot, tables, said):
        if not done:
            done.append(True)
            notes.write_notes(_notes(spark, [("theirs", "decision", DECISION, None, None)]), records, root)
        return plain(snapshot, tables, said)

    monkeypatch.setattr(appends, "commit", commit)
    assert notes.write_notes(_notes(spark, [("ours", "decision", DECISION, None, {"revises": ["theirs"]}), ("alone", "decision", DECISION, None, None)]), records, root) == 2
    events, edges, _, _ = notes.stored(spark, root)
    assert sorted(r["note_id"] for r in events.collect()) == ["alone", "ours", "theirs"] and edges.count() == 1

    def always(snapshot, tables, said):
        raise VersionConflict("taken")

    monkeypatch.setattr(appends, "commit", always)
    with pytest.raises(VersionConflict, match="3 times"):
        appends.append(spark, root, lambda snapshot: ({}, {}), attempts=3)


def test_aliases_lead_straight_to_their_end(spark):
    table = lambda rows, step: spark.createDataFrame([(a, b, step) for a, b in rows], rules.ALIAS)
    known = table([("q1", "e1"), ("q2", "e2"), ("q3", "e1")], 1)
    new = rules.compressed(known, table([("e1", "e5"), ("e5", "e6"), ("q4", "q2"), ("e6", "e7")], 0), 2)
    after = {r["alias"]: r["event_id"] for r in rules.latest(known.unionByName(new)).collect()}
    assert after == {"q1": "e7", "q3": "e7", "q2": "e2", "e1": "e7", "e5": "e7", "e6": "e7", "q4": "e2"}
    assert new.where("alias = 'q2'").count() == 0
    with pytest.raises(ValueError, match="circle"):
        rules.compressed(known, table([("a", "b"), ("b", "a")], 0), 2)


def test_parts_are_gathered(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(appends, "MOST_PARTS", 3)
    root = f"file://{tmp_path}/store"
    for i in range(5):
        appends.append(spark, root, lambda s: ({"t": spark.createDataFrame([(i,)], "x int")}, {}))
    last = appends.Snapshot(spark, root)
    assert len(last.parts["t"]) < 3 and sorted(r["x"] for r in last.table("t", "x int").collect()) == [0, 1, 2, 3, 4]
    assert appends.append(spark, root, lambda s: None) == 5
