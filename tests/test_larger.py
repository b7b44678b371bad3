"""Operators that once paired all rows of a key: against plain Python on small tables, with plans that do not pair."""

from __future__ import annotations

import random

import pyarrow as pa
from pyspark.sql import functions as F

from tracelode.operators import evidence, texts
from tracelode.sources import transcripts


def test_context_ranking_does_not_pair_units_with_events(spark):
    draw = random.Random(7)
    some = lambda pool, n: [draw.choice(pool) for _ in range(draw.randrange(n))]
    units = [(u, draw.choice([None, 1, 2, 3]), some(["a", "b", None], 3), some(["x", "y", "z"], 4)) for u in range(40)]
    events = [(e, draw.choice([None, 1, 2, 3]), draw.randrange(30), some(["a", "b", None], 3), some(["x", "y", "z", "z"], 4)) for e in range(200)]
    wanted = set()
    for unit, session, paths, words in units:
        found = []
        for event, own, pos, there, said in events:
            named, shared = sum(p == q for p in paths for q in there if p), sum(w == v for w in words for v in said)
            if named or shared:
                found.append((not named, -min(shared, 8), 2 if None in (session, own) else session != own, -pos, event))
        wanted |= {(unit, event[-1], place) for place, event in enumerate(sorted(found)[:6], 1)}
    kinds = "session_id long, paths array<string>, words array<string>"
    a = spark.createDataFrame(units, f"unit_id long, {kinds}")
    b = spark.createDataFrame([(e, s, p, q, w) for e, s, p, q, w in events], "id long, session_id long, pos long, paths array<string>, words array<string>")
    assert {tuple(r) for r in evidence.context_ranking(a, b).collect()} == wanted

    # A path that all units and events share: 3,000 times 3,000 would be nine million pairs.
    many = spark.range(3000).select(F.col("id").alias("unit_id"), (F.col("id") % 50).alias("session_id"), F.array(F.lit("hot")).alias("paths"), F.array().cast("array<string>").alias("words"))
    known = many.select(F.col("unit_id").alias("id"), "session_id", F.col("unit_id").alias("pos"), "paths", "words")
    ranked = evidence.context_ranking(many, known)
    assert ranked.count() == 18_000
    assert _most_rows(ranked) < 100_000


def test_polls_do_not_pair_runs_with_polls(spark):
    draw = random.Random(9)
    runs = [(i, draw.choice([None, "a", "b", "c"]), draw.choice([None, *range(40)])) for i in range(60)]
    followers = [(i, draw.choice([None, "a", "b", "d"]), draw.choice([None, *range(40)]), draw.choice([None, True, False, False, False])) for i in range(100, 180)]
    wanted = set()
    for run, handle, at in runs:
        later = sorted((t, i, bool(x)) for i, h, t, x in followers if handle and h == handle and None not in (at, t) and t > at)
        ends = [(t, i) for t, i, x in later if x]
        if later:
            wanted.add((run, sum(not ends or (t, i) <= ends[0] for t, i, _ in later), ends[0][1] if ends else None))
    at = F.timestamp_seconds(F.col("s") * 20_000).alias("at")
    a = spark.createDataFrame(runs, "id long, handle string, s long").select("id", "handle", at)
    b = spark.createDataFrame(followers, "id long, handle string, s long, exited boolean").select("id", "handle", at, "exited")
    assert {tuple(r) for r in evidence.polls(a, b).collect()} == wanted

    hot = spark.range(2000).select("id", F.lit("hot").alias("handle"), F.timestamp_seconds(F.col("id")).alias("at"))
    found = evidence.polls(hot, hot.withColumn("exited", F.lit(False)))
    assert found.agg(F.sum("n_polls")).first()[0] == 1999 * 2000 // 2
    assert _most_rows(found) < 20_000


def test_scripts_are_counted_in_what_others_leave(spark):
    rows = [("漢a",), ("한漢",), ("かカ漢字字",), ("Жaб",), ("Жa",), ("éa Ж1",), ("123",), ("",), (None,)]
    found = [r["s"] for r in spark.createDataFrame(rows, "t string").coalesce(1).select(texts.script_of(F.col("t")).alias("s")).collect()]
    assert found == ["han", "hangul", "han", "cyrillic", "cyrillic", "latin", None, None, None]
    # Whole runs go at once, and the letters of the most frequent script are passed over once.
    plan = spark.createDataFrame(rows, "t string").select(texts.script_of(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(t#") == 1


def test_transcript_files_are_opened_once(spark, tmp_path):
    row = '{"type": "response_item", "payload": {"type": "message", "id": "%s", "role": "user", "content": "c"}}\n'
    for name in "ab":
        (tmp_path / f"{name}.jsonl").write_text('{"type": "session_meta", "payload": {"id": "s%s", "cwd": "/w"}}\n' % name + row % "m1" + (row % "m2")[:-1])
    lines = transcripts.read_lines(spark, f"file://{tmp_path}")
    assert sorted((r["n"], r["offset"]) for r in lines.collect()) == [(1, 0), (1, 0), (2, 63), (2, 63)]
    records = transcripts.codex_records(lines)
    assert "] text" in lines._jdf.queryExecution().optimizedPlan().toString() and "] text" not in records._jdf.queryExecution().optimizedPlan().toString()
    # The same rows from two readers are one record each.
    assert transcripts.collect_records(records, records).count() == records.count() == 2


def test_segments_are_cut_few_texts_at_once(spark, monkeypatch):
    docs = spark.range(1000).select("id", F.concat(F.lit("t"), "id").alias("text"))
    assert {(r["id"], r["content"]) for r in texts.segments(docs, "id", "text").collect()} == {(i, f"t{i}") for i in range(1000)}
    taken = []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda df, run, schema: taken.append(run) or df)
    texts.segments(docs, "id", "text")
    batch = pa.RecordBatch.from_pydict({"key": range(1000), "text": ["abc"] * 1000})
    sizes = [made.num_rows for made in taken[0](iter([batch]))]
    assert sum(sizes) == 1000 and max(sizes) <= 128


def _most_rows(df) -> int:
    """The most rows that any step of the plan made, as Spark counts them when it runs."""
    df.collect()
    seen, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        metric = node.metrics().get("numOutputRows")
        if metric.isDefined():
            seen = max(seen, metric.get().value())
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif node.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(node.plan())
        children = node.children()
        todo += [children.apply(k) for k in range(children.size())]
    return seen
