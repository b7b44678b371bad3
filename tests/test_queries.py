"""Every query with SQL against DuckDB over the same tables."""

from __future__ import annotations

import datetime
import math
import os

import duckdb
import pytest

import __spark_entry__

ORACLES = {k: v for k, v in __spark_entry__.oracle_sql().items() if not k.startswith(("op", "pipeline"))}
QUERIES = __spark_entry__.queries()


def _same(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def _rows(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_same(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck(tiny):
    connection = duckdb.connect()
    for name in os.listdir(tiny):
        connection.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{tiny}/{name}'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, tiny, name):
    found = QUERIES[name](spark, tiny)
    wanted = duck.sql(ORACLES[name])
    assert sorted(found.columns) == sorted(wanted.columns)
    assert _rows([tuple(r) for r in found.collect()], found.columns) == _rows(wanted.fetchall(), wanted.columns)


def test_flagship(spark):
    assert __spark_entry__.entry(spark).columns == ["session_id", "n_records", "n_turns", "n_chars", "n_before", "n_answers"]


def test_rest_works_without_the_optional_parts():
    import subprocess
    import sys
    from pathlib import Path

    code = "import sys; sys.modules['tracelode.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert len(e.queries()) > 60 and not any(k.startswith('op') for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__spark_entry__.__file__).parent)
