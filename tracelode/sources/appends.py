"""Append-only tables with optimistic commits: many writers, one order.

A commit file names the parts of every table and small notes of the writers; only
one writer can create the file of a version (compare and swap on the version
before). Rows are written before the commit, and what lost the race is read by
nobody. A commit adds parts and never rewrites rows; after MOST_PARTS parts a
table is written anew in one, by the commit that reaches the number.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .versions import VersionConflict, _file_system, latest_version

#: Parts of a table before it is written anew, and attempts against other writers.
MOST_PARTS, ATTEMPTS = 64, 20


class Snapshot:
    """The tables of one version: ``parts`` by table name, and ``notes`` of the writers."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.version = spark, root, latest_version(spark, root)
        commit = {"parts": {}, "notes": {}}
        if self.version:
            commit = json.loads("".join(r["value"] for r in spark.read.text(f"{root}/_commits/{self.version}.json").collect()))
        self.parts, self.notes = commit["parts"], commit["notes"]

    def table(self, name: str, schema: str) -> DataFrame:
        """A table of this version; without rows where nothing was appended."""
        parts = [f"{self.root}/parts/{p}" for p in self.parts.get(name, [])]
        return self.spark.read.schema(schema).parquet(*parts) if parts else self.spark.createDataFrame([], schema)


def commit(snapshot: Snapshot, tables: dict[str, DataFrame], notes: dict) -> int:
    """Append ``tables`` after ``snapshot`` with the writers' ``notes``; VersionConflict if another writer was first."""
    spark, root, version = snapshot.spark, snapshot.root, snapshot.version + 1
    parts = {name: list(known) for name, known in snapshot.parts.items()}
    for name, table in tables.items():
        known = parts.setdefault(name, [])
        part = f"{name}-{version}-{uuid.uuid4().hex}"
        if len(known) + 1 >= MOST_PARTS:
            table = spark.read.schema(table.schema).parquet(*[f"{root}/parts/{p}" for p in known]).unionByName(table)
            known.clear()
        table.write.parquet(f"{root}/parts/{part}")
        known.append(part)
    files, target = _file_system(spark, f"{root}/_commits/{version}.json")
    try:
        out = files.create(target, False)  # fails where the file exists
    except Exception as error:
        raise VersionConflict(f"version {version} is taken") from error
    out.write(bytearray(json.dumps({"version": version, "parts": parts, "notes": notes}).encode()))
    out.close()
    return version


def append(spark: SparkSession, root: str, make: Callable[[Snapshot], tuple[dict[str, DataFrame], dict] | None], attempts: int = ATTEMPTS) -> int:
    """Append what ``make`` gives for the latest version (tables and notes, or None for nothing); where another writer comes first, it is asked again for the version that won. The version that holds the rows."""
    for _ in range(attempts):
        snapshot = Snapshot(spark, root)
        made = make(snapshot)
        if made is None:
            return snapshot.version
        try:
            return commit(snapshot, *made)
        except VersionConflict:
            continue
    raise VersionConflict(f"other writers came first {attempts} times")
