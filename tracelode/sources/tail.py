"""Transcript files as a stream that goes on at the byte where it stopped.

``spark.readStream.format("transcript_tail")`` gives the finished lines of all
files below ``path`` as (file, generation, offset, line); names that begin with
a dot or an underscore are hidden. What has been read of
a file is (end, head, tail, node): the byte after its last read line, digests of
the first and last EDGE bytes before it, and the file's inode where it has one.
A file goes on from ``end`` where all of them still hold; any other file that
was known begins a new generation, whose first row has offset -1 and no line,
and is read whole.

The stream's own offset is a number only. What a batch reads stands in an entry
of ``log``, a folder that belongs to one checkpoint: an entry names the ranges
of the files that the batch takes, so a batch that is run again reads the same
bytes, and it is as large as the batch, not as the folder. Every COMPACTED
entries the state of all files is written, and entries that the checkpoint no
longer needs are removed. A batch takes at most ``bytes`` bytes (and at least a
line), from the files in turn, so a flood in one does not starve the others.
Ranges of ``range`` bytes are partitions of their own.

``reader`` names what reads the lines (code version, scope): a log that another
one left is not gone on with, all files are read anew.
"""

from __future__ import annotations

import hashlib
import io
import json
import os
from bisect import bisect_right
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Fixed value: bytes of an edge.
EDGE = 4096
#: Bytes of one batch and of one partition, characters of a line that is read, entries between two whole states.
BATCH, RANGE, MOST_LINE, COMPACTED = 1 << 30, 32 << 20, 4 << 20, 16
SCHEMA = "file string, generation int, offset long, line string"
_STEP = 1 << 20


class TranscriptTail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "transcript_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _TailReader(dict(self.options))


class _Range(InputPartition):
    def __init__(self, file: str, generation: int, low: int, high: int, end: int, begins: bool):
        self.file, self.generation, self.low, self.high, self.end, self.begins = file, generation, low, high, end, begins


def _opened(place: str) -> tuple[fs.FileSystem, str]:
    if place.startswith("file:"):
        place = "/" + place.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(place) if "://" in place else (fs.LocalFileSystem(), os.path.abspath(place))


def _edges(stream, end: int) -> list[str]:
    stream.seek(0)
    head = stream.read(min(EDGE, end))
    stream.seek(max(0, end - EDGE))
    return [hashlib.sha256(x).hexdigest() for x in (head, stream.read(min(EDGE, end)))]


def _after_last_line(stream, start: int, high: int) -> int:
    """The byte after the last line feed between the two, looked for from the end; ``start`` if there is none."""
    at = high
    while at > start:
        low = max(start, at - _STEP)
        stream.seek(low)
        found = stream.read(at - low).rfind(b"\n")
        if found >= 0:
            return low + found + 1
        at = low
    return start


def _after_next_line(stream, start: int, size: int) -> int:
    """The byte after the first line feed from ``start`` on; -1 if there is none."""
    at = start
    while at < size:
        stream.seek(at)
        piece = stream.read(min(_STEP, size - at))
        if not piece:
            return -1
        found = piece.find(b"\n")
        if found >= 0:
            return at + found + 1
        at += len(piece)
    return -1


class _Log:
    """Numbered entries in a folder; a name is taken by a rename, after the whole entry is written."""

    def __init__(self, folder: str):
        self.files, self.folder = _opened(folder)
        self.files.create_dir(self.folder, recursive=True)

    def _names(self) -> list[str]:
        return sorted(x.base_name for x in self.files.get_file_info(fs.FileSelector(self.folder)) if x.base_name.endswith(".json"))

    def write(self, name: str, entry: dict) -> None:
        part = f"{self.folder}/{name}.part"
        with self.files.open_output_stream(part) as out:
            out.write(json.dumps(entry).encode())
        self.files.move(part, f"{self.folder}/{name}.json")

    def read(self, name: str) -> dict:
        with self.files.open_input_stream(f"{self.folder}/{name}.json") as stream:
            return json.loads(stream.read())

    def state(self) -> tuple[int, dict[str, dict], str]:
        """(number of the last entry, state of all files, file that was served last)."""
        names = self._names()
        whole = max((x for x in names if x.endswith("-all.json")), default=None)
        number, known, last = 0, {}, ""
        if whole:
            entry = self.read(whole.removesuffix(".json"))
            number, known, last = int(whole[:12]), entry["files"], entry["last"]
        for name in names:
            if not name.endswith("-all.json") and int(name[:12]) > number:
                entry = self.read(name.removesuffix(".json"))
                known, number, last = known | entry["files"], int(name[:12]), entry["last"]
        return number, known, last

    def forget(self, before: int) -> None:
        """Removes the entries below the last whole state that is not above ``before``."""
        names = self._names()
        whole = max((int(x[:12]) for x in names if x.endswith("-all.json") and int(x[:12]) <= before), default=0)
        for name in names:
            if int(name[:12]) < whole or (int(name[:12]) == whole and not name.endswith("-all.json")):
                self.files.delete_file(f"{self.folder}/{name}")


class _TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.place, self.log_place, self.reader = options["path"], options["log"], options.get("reader", "")
        self.batch, self.range = int(options.get("bytes", BATCH)), int(options.get("range", RANGE))
        self.log: _Log | None = None

    def _load(self) -> None:
        if self.log is None:
            self.log = _Log(self.log_place)
            self.number, self.known, self.last = self.log.state()

    def initialOffset(self) -> dict:
        return {"entry": 0}

    def latestOffset(self) -> dict:
        self._load()
        found = self._grown()
        if found:
            self.number += 1
            self.known |= found
            self.last = next(reversed(found))
            self.log.write(f"{self.number:012d}", {"files": found, "last": self.last})
            if self.number % COMPACTED == 0:
                self.log.write(f"{self.number:012d}-all", {"files": self.known, "last": self.last})
        return {"entry": self.number}

    def _grown(self) -> dict[str, dict]:
        """The next ranges, by file: at most ``batch`` bytes, the files after the one served last first."""
        files, top = _opened(self.place)
        infos = {x.path: x for x in files.get_file_info(fs.FileSelector(top, allow_not_found=True, recursive=True)) if x.type == fs.FileType.File and not any(p[:1] in (".", "_") for p in x.path.removeprefix(top).split("/"))}
        paths = sorted(infos)
        turn = bisect_right(paths, self.last)
        left, out = self.batch, {}
        for path in paths[turn:] + paths[:turn]:
            if left <= 0:
                break
            info, old = infos[path], self.known.get(path)
            mark = [info.size, info.mtime_ns or 0]
            if old and old["seen"] == mark and old["reader"] == self.reader and not old["more"]:
                continue
            try:
                step = self._step(files, path, info.size, old, left)
            except FileNotFoundError:
                continue
            if step is None:
                continue
            out[path] = step | {"seen": mark, "reader": self.reader}
            left -= step["end"] - step["start"]
        return out

    def _step(self, files: fs.FileSystem, path: str, size: int, old: dict | None, left: int) -> dict | None:
        node = os.stat(path).st_ino if isinstance(files, fs.LocalFileSystem) else 0
        with files.open_input_file(path) as stream:
            goes_on = bool(old) and size >= old["end"] and node == old["node"] and old["reader"] == self.reader and _edges(stream, old["end"]) == old["edges"]
            start = old["end"] if goes_on else 0
            high = min(size, start + left)
            end = _after_last_line(stream, start, high)
            if end == start and high < size:
                end = max(start, _after_next_line(stream, high, size))  # a line longer than the batch
            if end == start and (goes_on or not old):
                return None
            begins = bool(old) and not goes_on
            generation = old["generation"] + begins if old else 0
            # Whether finished lines may be left beyond this step.
            return {"start": start, "end": end, "generation": generation, "begins": begins, "edges": _edges(stream, end), "node": node, "more": high < size}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self._load()
        out = []
        for number in range(start["entry"] + 1, end["entry"] + 1):
            for path, step in self.log.read(f"{number:012d}")["files"].items():
                cuts = [*range(step["start"], step["end"], self.range)] or [step["start"]]
                out += [_Range(path, step["generation"], low, min(low + self.range, step["end"]), step["end"], step["begins"] and low == 0) for low in cuts]
        return out

    def read(self, partition: _Range) -> Iterator[tuple]:
        """The lines that begin in the range; none of a file that is gone."""
        if partition.begins:
            yield partition.file, partition.generation, -1, None
        files = _opened(self.place)[0]
        try:
            opened = files.open_input_file(partition.file)
        except FileNotFoundError:
            return
        with io.BufferedReader(opened, _STEP) as stream:
            at = partition.low
            if at:  # a line that began before belongs to the range before
                at = _after_next_line(stream, at - 1, partition.end)
                if at < 0:
                    return
            while at < partition.high:
                line, after = self._line(stream, at, partition.end)
                if after < 0:
                    return
                yield partition.file, partition.generation, at, line
                at = after

    @staticmethod
    def _line(stream, at: int, end: int) -> tuple[str | None, int]:
        """(line, byte after it); the line is null if it is longer than MOST_LINE, and the byte -1 if it has no end."""
        stream.seek(at)
        raw = stream.readline(min(end - at, 4 * MOST_LINE + 2))
        if raw.endswith(b"\n"):
            text = raw[:-1].removesuffix(b"\r").decode("utf-8", "replace")
            return (text if len(text) <= MOST_LINE else None), at + len(raw)
        return None, _after_next_line(stream, at + len(raw), end)

    def commit(self, end: dict) -> None:
        if self.log is not None:
            self.log.forget(end["entry"])


def read_tail(spark: SparkSession, folder: str, log: str, *, most_bytes: int = BATCH, range_bytes: int = RANGE, reader: str = "") -> DataFrame:
    """The stream of (file, generation, offset, line) of the files below ``folder``."""
    spark.dataSource.register(TranscriptTail)
    return spark.readStream.format("transcript_tail").option("path", folder).option("log", log).option("bytes", most_bytes).option("range", range_bytes).option("reader", reader).load()
