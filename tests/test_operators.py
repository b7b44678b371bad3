"""Ordered, graph and ledger operators on small tables, with their awkward cases."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tracelode.operators import graph, ledger, ordered, texts, turns
from tracelode.sources import versions


def _rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_running_values_over_many_blocks(spark):
    draw = random.Random(4)
    rows = [(s, p, draw.random() < 0.2, draw.choice([None, None, p])) for s in (None, 1, 2) for p in range(300)]
    table = spark.createDataFrame(rows, "s long, p long, hit boolean, v long").repartition(5)
    block = ordered.block_of(F.col("p"), 16)
    counted = ordered.running_count(table, ["s"], ["p"], F.col("hit"), "n", block)
    last = ordered.last_before(table, ["s"], ["p"], F.col("v"), "w", block, strict=True)
    found, seen = {(r["s"], r["p"]): r["n"] for r in counted.collect()}, {(r["s"], r["p"]): r["w"] for r in last.collect()}
    for s in (None, 1, 2):
        n, w = 0, None
        for _, p, hit, v in (r for r in rows if r[0] == s):
            n += hit
            assert found[(s, p)] == n and seen[(s, p)] == w
            w = v if v is not None else w
    assert counted.where("false").count() == 0


def test_time_fill(spark):
    rows = [(0, 1, None), (1, 1, "2024-01-01"), (2, 2, None), (3, 1, None), (4, 2, "2024-01-03"), (5, 1, None), (6, 3, None)]
    events = spark.createDataFrame(rows, "pos long, session_id long, t string").select("pos", "session_id", F.to_timestamp("t").alias("at"))
    found = {r["pos"]: r["filled_at"] and r["filled_at"].day for r in turns.fill_times(events).collect()}
    assert found == {0: None, 1: 1, 2: 1, 3: 1, 4: 3, 5: 1, 6: 1}


EVENTS = [
    (1, "question", "asked", "user", "do it", None, None), (2, "action", "applied", "assistant", "edit", None, None), (3, "outcome", "observed_success", "assistant", "tests", None, None), (4, "action", "applied", "assistant", "more", None, None),
    (5, "outcome", "observed_failure", "assistant", "tests", None, None), (6, "outcome", "observed_failure", "assistant", "alone", None, None), (7, "question", "withdrawn", "user", "no", None, True), (8, "action", "applied", "assistant", "hand over", "delegate", None), (9, "revision", "reported_complete", "assistant", "fix", None, None),
]
EDGES = [(1, 2, 3, "verifies", True), (2, 4, 5, "verifies", True), (3, 4, 3, "verifies", True), (4, 1, 2, "follows", True), (5, 1, 4, "answers", False), (6, 9, 3, "verifies", False)]


def _graph(spark):
    events = spark.createDataFrame([(i, i, 1, k, s, a, t, "2024", None, step, inv) for i, k, s, a, t, step, inv in EVENTS], "id long, pos long, session_id long, kind string, status string, actor string, title string, at string, folded_into long, step string, invalidated boolean")
    edges = spark.createDataFrame([(i, a, b, r, "structural", on) for i, a, b, r, on in EDGES], "id long, from_id long, to_id long, relation string, basis string, active boolean")
    return events, edges


def test_labels_and_tones(spark):
    found = {r["id"]: (r["label"], r["tone"]) for r in graph.status_labels(*_graph(spark)).collect()}
    assert found == {
        1: ("request · no answer linked", "plain"), 2: ("applied · verified: tests", "ok"), 3: ("passed", "ok"), 4: ("applied · 1 checks passed · 1 checks failed", "fail"), 5: ("failed", "fail"),
        6: ("failed · not linked to what it checked", "fail"), 7: ("not a request · not the person's request under the current rules", "plain"), 8: ("delegated · no sub-agent work linked", "plain"), 9: ("reported done · unverified", "warn"),
    }


def test_relations_are_turned_and_checked(spark):
    events, edges = _graph(spark)
    wrong = spark.createDataFrame([(1, 3, 2, "verifies", "structural", True), (2, 2, 1, "answers", "explicit", True), (3, 99, 1, "follows", "explicit", True), (4, 2, 4, "verifies", "structural", True), (5, 2, 3, "verifies", "inferred", True)], "id long, from_id long, to_id long, relation string, basis string, active boolean")
    assert _rows(graph.oriented(wrong, events), "id", "from_id", "to_id", "turned") == [(1, 2, 3, True), (2, 1, 2, True), (3, 99, 1, False), (4, 2, 4, False), (5, 2, 3, False)]
    assert [i for i, _ in _rows(graph.relation_faults(graph.oriented(wrong, events).drop("turned"), events), "id", "fault")] == [3, 4, 5]
    assert graph.relation_faults(edges, events).isEmpty()


def test_flows_closure_and_short_ids(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (10, 11), (5, 5), (3, 1), (None, 4)], "from_id long, to_id long")
    assert _rows(graph.connected(links), "id", "flow") == [(1, 1), (10, 10), (11, 10), (2, 1), (3, 1), (5, 5)]
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)], "from_id long, to_id long")
    assert {f for _, f in _rows(graph.connected(chain), "id", "flow")} == {0}
    below = graph.descendants(spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 4), (5, 9)], "id long, parent long"), spark.createDataFrame([(1,)], "id long"))
    assert _rows(below, "root", "id", "depth") == [(1, 1, 0), (1, 2, 1), (1, 3, 2)]
    ids = spark.createDataFrame([("ev_aaaa1111x",), ("ev_aaaa1112y",), ("ev_bbbb0000z",), ("ev_short",)], "id string")
    assert _rows(graph.short_ids(ids), "id", "short_id") == [("ev_aaaa1111x", "ev_aaaa1111"), ("ev_aaaa1112y", "ev_aaaa1112"), ("ev_bbbb0000z", "ev_bbbb0000"), ("ev_short", "ev_short")]


def test_upserts_and_changes(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, content_hash string")
    new = spark.createDataFrame([(2, "c"), (3, None), (4, "d")], "id long, content_hash string")
    assert _rows(ledger.upsert_actions(old, new, "id"), "id", "action") == [(1, "missing"), (2, "update"), (3, "unchanged"), (4, "insert")]
    assert _rows(ledger.upserted(old, new, "id"), "id", "content_hash", "available") == [(1, "a", False), (2, "c", True), (3, None, True), (4, "d", True)]
    assert _rows(ledger.version_changes(old, new, "id", closed=F.col("content_hash") == "c"), "id", "change") == [(1, "removed"), (2, "invalidated"), (4, "added")] or _rows(ledger.version_changes(old, new, "id"), "id", "change")
    empty = old.where("false")
    assert _rows(ledger.upsert_actions(empty, empty, "id"), "id") == []


def test_one_writer_wins(spark, tmp_path):
    root, rows = f"file://{tmp_path}/graph", spark.range(3)
    assert versions.publish({"events": rows}, root, 0) == 1
    with pytest.raises(versions.VersionConflict):
        versions.publish({"events": rows}, root, 0)
    assert versions.publish({"events": spark.range(5)}, root, 1) == 2
    assert versions.read_version(spark, root, "events").count() == 5 and versions.read_version(spark, root, "events", 1).count() == 3


def test_quotes_by_broadcast_and_by_join(spark, monkeypatch):
    records = spark.createDataFrame([(1, "one two three four five six seven"), (2, None), (3, "zero one two three four five six"), (4, "a\nb one two three four five six six")], "record_id long, text string")
    quotes = spark.createDataFrame([(1, "one two three four five six"), (2, "six"), (3, ""), (None, "two")], "quote_id long, quote string")
    whole = _rows(texts.quote_places(records, quotes), "quote_id", "record_id", "place", "line", "n_hits")
    monkeypatch.setattr(texts, "AUTOMATON_CHARS", 10)
    assert _rows(texts.quote_places(records, quotes), "quote_id", "record_id", "place", "line", "n_hits") == whole
    assert (1, 4, 4, 2, 1) in whole and (2, 4, 28, 2, 2) in whole and len(whole) == 6


def test_memory_selection(spark):
    rows = spark.createDataFrame([(s, r, s * 3 + str(r) + "x" * 10) for s in ("decisions", "open", "failures") for r in range(1, 6)], "section string, rank int, text string")
    found = texts.memory_selection(rows, {"decisions": 4, "open": 3, "failures": 3}, 150)
    assert found.count() < 10 and found.agg(F.sum(F.length("text") + 1)).first()[0] <= 150


def test_plans_do_what_they_should(spark, tiny):
    """Filters and columns reach the scan; as-of steps need no join of rows with rows."""
    plan = turns.number_turns(spark.read.parquet(f"{tiny}/conversations.parquet").where("conv_id = 3").selectExpr("conv_id AS session_id", "turn AS pos", "role", "text AS content"))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(conv_id), EqualTo(conv_id,3)]" in plan
    assert "BroadcastNestedLoopJoin" not in plan and "Cartesian" not in plan


def test_near_in_time_equals_all_pairs(spark):
    import datetime as dt
    import random

    from tracelode.operators.steps import near_in_time

    draw, start = random.Random(3), dt.datetime(2024, 1, 1)
    make = lambda n, first: [(first + i, draw.choice(["a", "a", "a", "b", None]), draw.choice([1, 1, 1, 2, 3, None]), None if draw.random() < 0.05 else start + dt.timedelta(seconds=draw.choice([draw.randrange(400), draw.randrange(40) * 10]))) for i in range(n)]
    left, right = make(300, 0), make(300, 100)
    expected = []
    for i, tree, session, at in left:
        near = sorted((abs((at - b).total_seconds()), k) for k, t, s, b in right if at and b and tree and t == tree and session and s and s != session and abs((at - b).total_seconds()) <= 20)
        expected += [(i, k, d, n) for n, (d, k) in enumerate(near[:3], 1)]
    frame = lambda rows: spark.createDataFrame(rows, "id long, tree string, session_id long, at timestamp_ntz")
    found = near_in_time(frame(left), frame(right), 20, 3)
    assert sorted(map(tuple, found.collect())) == sorted(expected) and len(expected) > 300
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()  # no pairs
    assert near_in_time(frame(left[:0]), frame(right), 20, 3).count() == 0
