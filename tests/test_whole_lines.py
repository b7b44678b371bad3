"""Tables that pass through transcript files come back whole: long lines, and texts that begin like a list of blocks."""

from __future__ import annotations

import __spark_entry__
import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tracelode.sources import transcripts

TEXTS = ["be kind", "x" * (transcripts.MOST_LINE + 1), "short", "y\n" * 11_000_000, "[1] see the note", "[]", '[{"type": "text", "text": "a"}]', "[", ""]


@pytest.fixture(scope="module")
def long(tmp_path_factory):
    """Conversations and documents of these texts, two of them longer than what the readers otherwise take."""
    top, n = tmp_path_factory.mktemp("long"), range(len(TEXTS))
    pq.write_table(pa.table({"conv_id": [i // 4 for i in n], "turn": [i % 4 for i in n], "role": [("system", "user", "assistant")[min(i, i % 2 + 1)] for i in n], "text": TEXTS}), f"{top}/conversations.parquet")
    pq.write_table(pa.table({"doc_id": list(n), "text": TEXTS}), f"{top}/documents.parquet")
    return str(top)


def _same_as_sql(spark, folder, name):
    duck = duckdb.connect()
    for table in ("conversations", "documents"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    wanted = duck.sql(__spark_entry__.oracle_sql()[name])
    found = __spark_entry__.queries()[name](spark, folder).select(*wanted.columns)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(wanted.fetchall(), key=repr)


def test_codex_records_are_whole(spark, long):
    _same_as_sql(spark, long, "src06_codex_records")


@pytest.mark.parametrize("name", ["src14_collected_records", "src07_claude_records", "src01_row_types", "src02_line_numbers"])
def test_other_readers_of_lines_are_whole(spark, long, name):
    _same_as_sql(spark, long, name)


def test_strings_and_lists_of_blocks_are_told_apart(spark, tmp_path):
    said = ['"[1] see"', '[{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]', '"[{\\"type\\": \\"text\\", \\"text\\": \\"a\\"}]"', "[]", "null"]
    (tmp_path / "codex.jsonl").write_text("".join('{"type": "response_item", "payload": {"type": "message", "role": "user", "content": %s}}\n' % c for c in said))
    (tmp_path / "claude.jsonl").write_text("".join('{"type": "user", "uuid": "u", "message": {"content": %s}}\n' % c for c in said))
    codex = transcripts.codex_records(transcripts.read_lines(spark, f"file://{tmp_path}/codex.jsonl"))
    assert [r["content"] for r in codex.orderBy("pos").collect()] == ["[1] see", "a\nb", '[{"type": "text", "text": "a"}]', "", ""]
    claude = transcripts.claude_records(transcripts.read_lines(spark, f"file://{tmp_path}/claude.jsonl"))
    assert [(r["pos"], r["content"]) for r in claude.orderBy("pos", "native_id").collect()] == [(1, "[1] see"), (2, "a"), (2, "b"), (3, '[{"type": "text", "text": "a"}]'), (5, "")]
