"""Small awkward cases of work predicates, citations, turn links and unit tables: nulls, empty tables, ties."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tracelode.functions import secrets
from tracelode.operators import citations, linking, ordered, units, work


def _one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("line", "writes", "inside"),
    [
        ("echo a > /proj/x", True, True), ("echo a > /tmp/x", True, False), ("echo a > x", True, True), ("echo '>' x", False, False), ("A=/tmp; B=/proj; mv q $B/q", True, True), ("A=/proj; A=/tmp; touch $A/q", True, False), ("touch $UNSET/q", True, True),
        ("cat <<EOF > /tmp/a; mv x y; EOF", True, False), ("python - <<EOF; open('/proj/x').write_text('a'); EOF", True, True), ("ls 2>&1 | tee /tmp/log", True, False), ("rm ~/x", True, False), ("", False, False), (None, None, None),
    ],
)
def test_writes(spark, line, writes, inside):
    assert _one(spark, work.writes_files, line) == writes
    assert _one(spark, lambda t: work.writes_files(t, work.below("/proj")), line) == inside


def test_reader_views(spark):
    assert _one(spark, work.output_tail, None) is None and _one(spark, work.output_tail, "") == []
    assert _one(spark, work.output_tail, 'a\n{"output": "x\\n\\ny", "exit_code": 0}\n{broken "output"') == ["a", "x", "y", '{broken "output"']
    assert _one(spark, work.inline_run, "nothing") is None
    assert _one(spark, work.flatten_text, '[{"type":"reasoning","text":"no"},{"type":"text","text":"a"},"b",{"k":1},null]') == 'a\nb\n{"k": 1}\n'
    assert _one(spark, work.flatten_text, None) is None and _one(spark, work.flatten_text, "plain") == "plain"
    shown = _one(spark, lambda t: work.shown_record(t, 4, 4), "aa\nbb\ncc\ndd\n")
    assert tuple(shown) == (1, 1, 2, 3, 5)
    assert tuple(_one(spark, lambda t: work.shown_record(t, 4, 4), ""))[:2] == (0, 0)


def test_secrets_walk(spark):
    for text, wanted in {
        "-----BEGIN RSA PRIVATE KEY-----\nMIIE\nMIIF\nplain words": f"{secrets.HIDDEN}\n{secrets.HIDDEN}\n{secrets.HIDDEN}\nplain words",
        'k = "-----BEGIN PRIVATE KEY-----" and more': f'k = "{secrets.HIDDEN}" and more',
        "token = get_token(x) api_key=self._key max_tokens=128000": "token = get_token(x) api_key=self._key max_tokens=128000",
        '{"client_secret":"abcd1234efgh"}': f'{{"client_secret":"{secrets.HIDDEN}"}}',
        "password:\n   hunter2hunter2\nnext": f"password:\n   {secrets.HIDDEN}\nnext",
        r"a\nghp_" + "a" * 36: r"a\n" + secrets.HIDDEN,
    }.items():
        assert secrets.hide(text) == wanted and secrets.hide(wanted) == wanted
    assert _one(spark, secrets.mask_secrets, None) is None and _one(spark, secrets.mask_secrets, "plain") == "plain"


def test_citations(spark):
    records = spark.createDataFrame([(1, "alpha beta\ngamma delta\nepsilon\n"), (2, None), (3, "same line\nother\nsame line\n")], "source_id long, content string")
    shown = spark.createDataFrame([(1, 1, 2), (1, 3, 3), (3, 1, 3)], "source_id long, lo int, hi int")
    asked = [
        (1, 1, 1, 2, "alpha beta\ngamma delta"), (2, 1, 1, 2, "gamma delta\n"), (3, 1, 1, 2, "beta"), (4, 1, 1, 1, "gamma delta"), (5, 1, 2, 3, "gamma delta"), (6, 1, 9, 9, "nowhere at all"), (7, 2, 1, 1, "x"), (8, 9, 1, 1, "x"),
        (9, 1, 1, 1, None), (10, 3, 1, 3, "same line"), (11, 1, 1, 2, "alpha   beta"), (12, 1, None, None, "gamma delta"),
    ]
    rows = spark.createDataFrame(asked, "cite_id long, source_id long, start_line int, end_line int, quote string")
    found = {r["cite_id"]: (r["first_line"], r["last_line"], r["mode"]) for r in citations.validated(rows, records, shown).collect()}
    assert found[1] == (1, 2, "exact") and found[2] == (2, 2, "narrowed") and found[3] == (1, 1, "inside") and found[4] == (2, 2, "moved") and found[5] == (2, 2, "moved")
    assert found[6][2] == "refused: outside the source" and found[8][2] == "refused: unknown source" and found[9][2] == "refused: no quote"
    assert found[7][2].startswith("refused") and found[10][2].startswith("refused") and found[11] == (1, 1, "white space") and found[12] == (2, 2, "moved")
    assert citations.validated(rows.where("false"), records, shown).count() == 0


def test_turn_links(spark):
    requests = spark.createDataFrame([("r1", "p", 10, "2026-01-01 00:00:10", "e1"), ("r2", "p", 20, "2026-01-01 00:00:20", None), ("r3", "q", 5, None, "e3")], "source_id string, session_id string, pos long, at string, event_id string").withColumn("at", F.col("at").cast("timestamp"))
    events = spark.createDataFrame([(1, "p", 10, None), (2, "p", 9, None), (3, "p", 99, None), (4, "child", 1, "2026-01-01 00:00:15"), (5, "child", 1, "2026-01-01 00:00:01"), (6, None, 1, None), (7, "q", 5, None)], "id long, session_id string, pos long, at string").withColumn("at", F.col("at").cast("timestamp"))
    parents = spark.createDataFrame([("child", "p")], "session_id string, parent_session_id string")
    found = {r["id"]: (r["request_id"], r["request_event"], r["way"]) for r in linking.turn_links(events, requests, parents).collect()}
    assert found == {1: ("r1", "e1", "session"), 2: (None, None, None), 3: ("r2", None, "session"), 4: ("r1", "e1", "parent"), 5: (None, None, None), 6: (None, None, None), 7: ("r3", "e3", "session")}


def test_called_sessions_follow_their_callers(spark):
    sessions = spark.createDataFrame([("s-aa",), ("s-bb",), ("s-cc",), ("s-dd",)], "session_id string")
    texts = spark.createDataFrame([("t1", "main", 1, "started s-aa"), ("t2", "s-aa", 1, "started s-bb"), ("t3", "s-cc", 1, "started s-dd"), ("t4", "s-dd", 1, "started s-cc"), ("t5", "main", 2, "s-aa again")], "source_id string, session_id string, pos int, content string")
    found = {r["session_id"]: (r["parent_session_id"], r["parent_record"]) for r in linking.called_sessions(sessions, texts, r"s-\w\w").collect()}
    assert found == {"s-aa": ("main", "t1"), "s-bb": ("s-aa", "t2")}


def test_previous_crosses_blocks_and_groups(spark, monkeypatch):
    monkeypatch.setattr(ordered, "BLOCK", 3)
    rows = spark.createDataFrame([("s", i, None if i % 4 else i) for i in range(60)] + [(None, 1, 7), (None, 50, None)], "k string, n long, v long")
    got = {(r["k"], r["n"]): (r["b"] and (r["b"]["v"]), r["b"] is None) for r in ordered.previous(rows, ["k"], ["n"], ["v"], "b", F.floor(F.col("n") / 2)).collect()}
    assert got["s", 0] == (None, True) and all(got["s", i] == (None if (i - 1) % 4 else i - 1, False) for i in range(1, 60)) and got[None, 50] == (7, False)
    after = {(r["k"], r["n"]): r["b"] and r["b"]["v"] for r in ordered.previous(rows, ["k"], ["n"], ["v"], "b", F.floor(F.col("n") / 2), backwards=True).collect()}
    assert all(after["s", i] == (None if (i + 1) % 4 else i + 1) for i in range(59)) and after["s", 59] is None
    last = {r["n"]: r["x"] for r in ordered.last_before(rows.where("k = 's'"), ["k"], ["n"], F.col("v"), "x", F.floor(F.col("n") / 2)).collect()}
    assert all(last[i] == i // 4 * 4 for i in range(60))


def test_unit_tables(spark):
    with pytest.raises(ValueError, match="unknown"):
        units.chosen_providers(spark.range(1), "a,x", ("a", "b"), "id")
    empty = spark.createDataFrame([], "source_id string, role string, content string")
    assert [tuple(r) for r in units.fixture_problems(empty, ("user",)).collect()] == [("record count", 1)]
    calls = spark.createDataFrame([(1, "x"), (2, "y")], "call_id int, started_at string")
    closings = spark.createDataFrame([(1, "b", "failed"), (1, "c", "ok")], "call_id int, finished_at string, status string")
    assert sorted(tuple(r) for r in units.closed_calls(calls, closings).collect()) == [(1, "x", "c", "ok"), (2, "y", None, "running")]
    assert sorted(tuple(r) for r in units.closed_calls(calls, closings, F.lit("z")).collect())[1] == (2, "y", "z", "cancelled")
    events = spark.createDataFrame([(1, "note", "done", "a*b", None), (2, "note", "done", "c", "x ``` y")], "pos int, kind string, label string, title string, quote string")
    assert [r["text"] for r in units.markdown(events).orderBy("pos").collect()] == ["- **note** (done) a\\*b", "- **note** (done) c\n````\nx ``` y\n````"]
