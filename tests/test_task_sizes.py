"""What one task holds or a query moves does not grow faster than its input."""

from __future__ import annotations

import re

from pyspark.sql import functions as F


def _plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_duplicate_match_deals_by_rows(spark, tiny, monkeypatch):
    """join12: both tables go into as many parts as their rows need, and the twins are those of a plain search."""
    from tracelode.plans import ledger

    monkeypatch.setattr(ledger, "TASK_ROWS", 500)
    many = ledger.parts_of(spark.read.parquet(f"{tiny}/lineitem.parquet").count())
    seen = []
    monkeypatch.setattr("tracelode.operators.texts.written", lambda df, label: seen.append(_plan(df)) or df)
    found = sorted(map(tuple, ledger.duplicate_match(spark, tiny).collect()))
    assert many > 8 and set(re.findall(r"hashpartitioning\([^)]*orderkey[^)]*\)?, (\d+)\), REPARTITION_BY_NUM", seen[0])) == {str(many)}
    sets: dict[int, set] = {}
    kind = {r["o_orderkey"]: r["o_orderstatus"] for r in spark.read.parquet(f"{tiny}/orders.parquet").collect()}
    for r in spark.read.parquet(f"{tiny}/lineitem.parquet").collect():
        if r["l_orderkey"] in kind:
            sets.setdefault(r["l_orderkey"], set()).add(r["l_partkey"] % 5)
    first: dict[tuple, int] = {}
    for i in sorted(sets):
        first.setdefault((kind[i], frozenset(sets[i])), i)
    assert found == sorted((i, twin) for i, c in sets.items() if (twin := first[kind[i], frozenset(c)]) != i)


def test_only_deep_delegations_go_round_again(spark, monkeypatch):
    """grf03: chains of delegated events end where they begin, and a round writes those below a delegated event only."""
    from tracelode.operators import stories

    at = "2026-01-01 00:00:00"
    # Boxes 1 and 50; 2 is delegated by a box, 3 by 2, 4 by 3, 5 by 4, 6 by an event that is none; the rest are plain.
    rows = [(1, "decision", None), (50, "decision", None), (2, "action", 1), (3, "action", 2), (4, "action", 3), (5, "action", 4), (6, "action", 999), *[(k, "action", None) for k in range(51, 150)]]
    events = spark.createDataFrame([(i, i, 1, at, kind, "applied", "assistant", by, True) for i, kind, by in rows], "id long, pos long, session_id long, at string, kind string, status string, actor string, delegated_by long, tool_based boolean").withColumn("at", F.col("at").cast("timestamp"))
    edges = spark.createDataFrame([(50, 5, "motivates", True, None)], "from_id long, to_id long, relation string, active boolean, origin string")
    sizes, plain = [], stories.written

    def counted(df, label):
        out = plain(df, label)
        sizes.append((label, out.count()))
        return out

    monkeypatch.setattr(stories, "written", counted)
    home = dict(map(tuple, stories.homes(events, edges).collect()))
    assert [home[i] for i in range(1, 7)] == [1] * 6 and home[50] == 50 and all(home[k] == 50 for k in range(51, 150))
    assert sum(n for label, n in sizes if label == "story-homes") == len(rows)
    assert all(n == 3 for label, n in sizes if label == "story-deep")


def test_zstd_lines_pass_in_short_batches(spark, tiny, monkeypatch):
    """src03: the texts reach a Python worker in batches of BATCH_ROWS rows, not of 10,000."""
    from tracelode.plans import files
    from tracelode.sources import store

    key, seen, plain = "spark.sql.execution.arrow.maxRecordsPerBatch", [], files._as_frames
    before = spark.conf.get(key, "10000")
    spark.conf.set(key, "10000")
    monkeypatch.setattr(files, "_as_frames", lambda lines: seen.append(int(spark.conf.get(key))) or plain(lines))
    try:
        docs = spark.read.parquet(f"{tiny}/documents.parquet").where("text IS NOT NULL").select("doc_id", F.sha2("text", 256))
        assert sorted(map(tuple, files.zstd_lines(spark, tiny).collect())) == sorted(map(tuple, docs.collect()))
    finally:
        spark.conf.set(key, before)
    assert seen == [store.BATCH_ROWS]


def test_a_stored_batch_is_not_checked_again(spark, tmp_path, monkeypatch):
    """str06: a batch of notes that is run again reads no records; the next one is stored."""
    from tracelode.operators import notes as rules
    from tracelode.streaming import notes

    records = spark.createDataFrame([("r1", "s", 1, "user", "we keep the old parser for now", None, False)], "record_id string, session_id string, pos long, role string, content string, recorded_at timestamp, failed boolean")
    row = lambda i: (i, "s", "decision", "t", ["keep the old parser"], "adopted", None, None)
    flush, root = notes.flush_each_batch(records, str(tmp_path / "store")), str(tmp_path / "store")
    calls, plain = [], rules.checked
    monkeypatch.setattr(rules, "checked", lambda *a: calls.append(1) or plain(*a))
    for number, name in ((0, "a"), (0, "a"), (1, "b"), (0, "a")):
        flush(spark.createDataFrame([row(name)], rules.NOTE), number)
    assert len(calls) == 2 and {r["note_id"] for r in notes.stored(spark, root)[0].collect()} == {"a", "b"}
