"""Only what was appended to transcript files since they were last read.

The state of a file is (file, lines, end, head, tail): the lines read, the byte
after them, and digests of the first and last EDGE bytes before it. A file is
read on from ``end`` where it is as long as that or longer and both edges are
the same; any other file is read whole. The appended bytes are cut into
ranges, each a partition of a Python data source, so a large append is many
tasks; a line belongs to the range in which it begins. Files must lie where
the executors can open them (a local or mounted folder); files in other
stores are read whole by ``transcripts.read_lines``.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators import ordered
from . import frames, listing

#: Fixed value: bytes of an edge. And bytes of one range.
EDGE, RANGE = 4096, 32 << 20
STATE = "file string, lines long, end long, head string, tail string"


class AppendedLines(DataSource):
    """``spark.read.format("appended_lines").option("ranges", json)``: ranges are (file, from, to, end of the file)."""

    @classmethod
    def name(cls) -> str:
        return "appended_lines"

    def schema(self) -> str:
        return "file string, offset long, line string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(json.loads(self.options["ranges"]))


class _Range(InputPartition):
    def __init__(self, file: str, low: int, high: int, size: int):
        self.file, self.low, self.high, self.size = file, low, high, size


class _Reader(DataSourceReader):
    def __init__(self, ranges: list[list]):
        self.ranges = ranges

    def partitions(self) -> list[InputPartition]:
        return [_Range(*r) for r in self.ranges] or [_Range("", 0, 0, 0)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        if not partition.file:
            return
        with open(partition.file, "rb") as stream:
            at = partition.low
            if at:  # a line that began before is the range's before
                stream.seek(at - 1)
                at += len(stream.readline()) - 1
            stream.seek(at)
            while at < partition.high:
                line = stream.readline(partition.size - at)
                if not line.endswith(b"\n"):  # not finished
                    return
                if line.strip():
                    yield partition.file, at, line[:-1].removesuffix(b"\r").decode("utf-8", "replace")
                at += len(line)


def _edges(path: str, end: int) -> tuple[str, str]:
    with open(path, "rb") as stream:
        head = stream.read(min(EDGE, end))
        stream.seek(max(0, end - EDGE))
        tail = stream.read(min(EDGE, end))
    return hashlib.sha256(head).hexdigest(), hashlib.sha256(tail).hexdigest()


def _complete_end(path: str, start: int, size: int) -> int:
    """The byte after the last line feed between ``start`` and ``size``, looked for from the end."""
    high = size
    with open(path, "rb") as stream:
        while high > start:
            low = max(start, high - (1 << 20))
            stream.seek(low)
            at = stream.read(high - low).rfind(b"\n")
            if at >= 0:
                return low + at + 1
            high = low
    return start


def read_appended(spark: SparkSession, folder: str, state: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(lines, state): the finished lines (file, n, offset, line) that ``state`` (STATE) has not seen, and the state after them.

    The states of the files pass through the driver (a row for each file); the
    listing is made on the executors, and bytes of lines stay there. Files that are gone are left out of the
    state; what cannot be read on is read whole, from line 1.
    """
    spark.dataSource.register(AppendedLines)
    top = folder.removeprefix("file://")
    files = sorted(r["path"] for r in listing.walk(spark, top).where("kind = 'file'").select("path").collect())
    known = {r["file"]: r for r in state.collect()} if state is not None else {}
    ranges, after, base = [], [], {}
    for path in files:
        size, old = os.path.getsize(path), known.get(path)
        goes_on = old is not None and size >= old["end"] and _edges(path, old["end"]) == (old["head"], old["tail"])
        start = old["end"] if goes_on else 0
        base[path] = old["lines"] if goes_on else 0
        end = _complete_end(path, start, size)
        ranges += [[path, low, min(low + RANGE, end), end] for low in range(start, end, RANGE)]
        after.append((path, base[path], end, *_edges(path, end)))
    schema = "file string, offset long, line string"
    rows = spark.read.format("appended_lines").schema(schema).option("ranges", json.dumps(ranges)).load()
    numbered = ordered.running_count(rows, ["file"], ["offset"], F.lit(True), "__n", ordered.block_of(F.col("offset"), RANGE))
    before = spark.createDataFrame(list(base.items()), "file string, __base long")
    lines = numbered.join(before, "file").select("file", (F.col("__base") + F.col("__n")).alias("n"), "offset", "line")
    counts = lines.groupBy("file").agg(F.max("n").alias("__last"))
    states = spark.createDataFrame(after, STATE).join(counts, "file", "left")
    return lines, states.select("file", F.coalesce("__last", "lines").alias("lines"), "end", "head", "tail")


def read_zstd(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(lines, refused) of the ``.zst`` files below a folder, frame by frame (``frames.read_frames``); links are not read."""
    found = listing.walk(spark, folder).where("kind = 'file'").where(F.col("path").endswith(".zst"))
    return frames.read_frames(spark, found.select(F.col("path").alias("file")))
