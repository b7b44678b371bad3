"""Closest lines against difflib over all lines."""

from __future__ import annotations

import difflib
import random

from tracelode.operators import nearest

RECORDS = "source_id string, session_id string, pos long, content string, quote string"
QUOTES = "quote_id long, session_id string, quote string"


def plain(records, quote, latest, most):
    """(source_id, line) of the closest lines: the 40 with the best quick ratio, ranked by ratio."""
    own = sorted(records, key=lambda r: (r[2], r[0]))[-latest:]
    each = [(r[0], n, x) for r in own for n, x in enumerate((r[3] or "").split("\n"), 1) if x.strip()]
    measure = lambda x: difflib.SequenceMatcher(None, quote, x[2], autojunk=False)
    coarse = sorted(each, key=lambda x: -measure(x).quick_ratio())[:40]
    return [(s, n, measure((s, n, x)).ratio()) for s, n, x in sorted(coarse, key=lambda x: -measure(x).ratio())[:most]]


def test_closest_lines_equal_difflib(spark):
    draw = random.Random(11)
    words = ["alpha", "beta", "gamma", "naïve", "x=1;", "\tend", "the", "row", "😀"]
    text = lambda n: "\n".join(" ".join(draw.choice(words) for _ in range(draw.randint(0, 6))) for _ in range(n))
    records = [(f"{s}-{i:03}", s, i // 2, text(draw.randint(0, 6)), "own column") for s, n in (("a", 60), ("b", 5)) for i in range(n)]
    records += [("n", "a", 99, None, ""), ("e", "b", 99, "", ""), ("z", None, 1, "alpha", "")]
    asked = [(i, s, q) for i, (s, q) in enumerate([("a", "alpha beta the row"), ("b", "gamma naïve 😀 end"), ("a", "nothing like it"), ("b", "x=1; x=1; beta"), ("a", "é" * 30)])]
    rows = nearest.closest_lines(spark.createDataFrame(records, RECORDS), spark.createDataFrame([*asked, (90, "a", None), (91, "a", ""), (92, None, "alpha"), (93, "gone", "alpha")], QUOTES), latest=50).orderBy("quote_id", "place").collect()
    got = {}
    for r in rows:
        got.setdefault(r["quote_id"], []).append((r["source_id"], r["line"], r["ratio"]))
    assert got == {i: plain([r for r in records if r[1] == s], q, 50, 3) for i, s, q in asked}
    assert [r["place"] for r in rows if r["quote_id"] == 0] == [1, 2, 3]


def test_long_lines_are_shown_around_the_match_and_others_left_unaligned(spark):
    line = "-" * 900 + "the wanted words" + "+" * 900
    records = spark.createDataFrame([("s", "a", 1, f"{line}\nthe wanted word\nthe wanted\n" + "q" * 2_000_000, "")], RECORDS)
    rows = nearest.closest_lines(records, spark.createDataFrame([(1, "a", "the wanted words")], QUOTES)).orderBy("place").collect()
    assert [r["line"] for r in rows] == [2, 3, 1]
    assert len(rows[2]["shown"]) == nearest.SHOWN_CHARS and "the wanted words" in rows[2]["shown"]


def test_latest_records_only_and_empty_tables(spark):
    records = spark.createDataFrame([("old", "a", 1, "same words", ""), ("new", "a", 2, "other text", "")], RECORDS)
    quotes = spark.createDataFrame([(1, "a", "same words")], QUOTES)
    assert [r["source_id"] for r in nearest.closest_lines(records, quotes, latest=1).collect()] == ["new"]
    assert nearest.closest_lines(records.limit(0), quotes).count() == 0
    assert nearest.closest_lines(records, quotes.limit(0)).count() == 0


def test_query_over_a_whole_table_equals_difflib(spark, tiny):
    import __spark_entry__

    documents = spark.read.parquet(f"{tiny}/documents.parquet").collect()
    wanted = {}
    for item in spark.read.parquet(f"{tiny}/benchmark.parquet").collect():
        own = [(r["doc_id"], r["source"], r["doc_id"], r["text"]) for r in documents if r["source"] == f"src{item['item_id'] % 10}"]
        wanted |= {(item["item_id"], at): found for at, found in enumerate(plain(own, item["text"], 400, 3), 1)}
    rows = __spark_entry__.queries()["join23_closest_lines"](spark, tiny).collect()
    assert {(r["quote_id"], r["place"]): (r["source_id"], r["line"], r["ratio"]) for r in rows} == wanted
