"""The union of an order's spans: lines without a part, and spans that stand twice."""

from __future__ import annotations

import __spark_entry__
import duckdb
import pyarrow as pa
import pyarrow.parquet as pq


def test_lines_without_part_and_spans_that_stand_twice(spark, tmp_path):
    lines = [(1, None, 1), (1, None, 2), (2, None, 1), (2, 7, None), (2, 8, 1), (3, 5, 2), (3, 205, 2), (3, 5, 2), (3, 17, 1), (3, 60, 1), (4, 9, None), (5, 3, 7), (5, None, 7)]
    order, part, number = zip(*lines, strict=True)
    path = f"{tmp_path}/lineitem.parquet"
    pq.write_table(pa.table({"l_orderkey": pa.array(order, pa.int64()), "l_partkey": pa.array(part, pa.int64()), "l_linenumber": pa.array(number, pa.int32())}), path)
    found = {r["id"]: r["spans"] for r in __spark_entry__.queries()["agg18_focus_union"](spark, str(tmp_path)).collect()}
    assert found == {1: None, 2: "8-19", 3: "5-28,60-71", 4: None, 5: "3-20"}
    # The SQL leaves the order of equal spans open; one thread of the oracle takes them in one order throughout.
    duck = duckdb.connect(config={"threads": 1})
    duck.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{path}'")
    assert found == dict(duck.execute(__spark_entry__.oracle_sql()["agg18_focus_union"]).fetchall())
