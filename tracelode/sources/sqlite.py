"""Sessions kept in SQLite files, read by a Python data source: one partition for each file and table."""

from __future__ import annotations

import os
import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import content_id

#: Tables and columns that are read; no other table, one with credentials least of all, is opened.
TABLES = {
    "session": "id string, parent_id string, directory string, title string, time_created long, time_updated long",
    "message": "id string, session_id string, time_created long, data string",
    "part": "id string, message_id string, session_id string, time_created long, data string",
}


class SessionFiles(DataSource):
    """``spark.read.format("session_sqlite").option("path", file).option("table", name)``."""

    @classmethod
    def name(cls) -> str:
        return "session_sqlite"

    def schema(self) -> str:
        return TABLES[self.options["table"]]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.options["table"])


class _Reader(DataSourceReader):
    def __init__(self, path: str, table: str):
        self.path, self.table = path.removeprefix("file://"), table

    def partitions(self) -> list[InputPartition]:
        files = [self.path] if not os.path.isdir(self.path) else sorted(os.path.join(self.path, x) for x in os.listdir(self.path) if x.endswith((".db", ".sqlite")))
        return [InputPartition(x) for x in files]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if self.table not in TABLES:
            raise ValueError(f"table {self.table} is not read")
        columns = [c.strip().split(" ")[0] for c in TABLES[self.table].split(",")]
        with sqlite3.connect(f"file:{partition.value}?mode=ro", uri=True) as connection:
            yield from map(tuple, connection.execute(f"SELECT {', '.join(columns)} FROM {self.table}"))


def session_times(spark: SparkSession, path: str) -> DataFrame:
    """(id, time_updated): one table, two columns."""
    spark.dataSource.register(SessionFiles)
    return spark.read.format("session_sqlite").option("path", path).option("table", "session").load().select("id", "time_updated")


def session_records(spark: SparkSession, path: str) -> DataFrame:
    """Records (source_id, session_id, pos_ms, role, content, call_id, cwd) of all parts: texts, and a call and a result for each tool part."""
    spark.dataSource.register(SessionFiles)
    table = lambda name: spark.read.format("session_sqlite").option("path", path).option("table", name).load()
    part = table("part").select(F.col("id").alias("part_id"), "message_id", "session_id", "time_created", F.from_json("data", "type string, text string, callID string, tool string, state struct<status:string,input:string,output:string,error:string>").alias("d"))
    message = table("message").select(F.col("id").alias("message_id"), F.get_json_object("data", "$.role").alias("role"))
    session = table("session").select(F.col("id").alias("session_id"), F.col("directory").alias("cwd"))
    tool = F.array(F.struct(F.lit("tool_call").alias("role"), F.concat(F.lit("Tool: "), F.col("d.tool"), F.lit("\n"), F.coalesce("d.state.input", F.lit("{}"))).alias("content")), F.struct(F.lit("tool_result").alias("role"), F.coalesce("d.state.output", "d.state.error").alias("content")))
    text = F.array(F.struct(F.col("role"), F.col("d.text").alias("content")))
    each = part.join(message, "message_id").join(session, "session_id").select("*", F.posexplode(F.when(F.col("d.type") == "tool", tool).when(F.col("d.type") == "text", text)).alias("k", "r")).where("r.content IS NOT NULL")
    return each.select(content_id("src_", F.lit("opencode"), F.col("session_id"), F.concat("part_id", F.lit(":"), F.col("k").cast("string"))).alias("source_id"), "session_id", F.col("time_created").alias("pos_ms"), F.col("r.role").alias("role"), F.col("r.content").alias("content"), F.col("d.callID").alias("call_id"), "cwd")
