"""Zstandard transcripts, frame by frame: a file of many frames is many tasks, and one that is not whole is refused.

Where frames begin and end is read from their block headers alone, without
decompressing. Each frame is then decompressed by itself, as a stream, twice:
once for its number of bytes and line feeds, once for its pieces of lines. A
line that runs over frames is put together from the pieces that have its number.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import written
from .tail import _opened

#: Bytes read at once, bytes of a line that is kept, bytes that a file may become.
STEP, MOST_LINE, MOST_BYTES = 1 << 20, 4 << 20, 64 << 30
#: Fixed values of the format: first bytes of a frame, and of one that is to be skipped (its last half byte is free).
MAGIC, SKIPPED = 0xFD2FB528, 0x184D2A50
FRAME = "file string, frame int, low long, high long, problem string"
CUT_OFF, DAMAGED, NO_FRAME, TOO_LARGE = "ends inside a frame", "damaged", "not zstandard", "over the size limit"


def frames_of(stream, size: int) -> Iterator[tuple[int, int, str | None]]:
    """(low, high, problem) of each frame, from its headers; nothing follows a frame with a problem."""
    at = 0
    while at < size:
        stream.seek(at)
        head = stream.read(18)
        magic = int.from_bytes(head[:4], "little")
        if len(head) >= 8 and magic & 0xFFFFFFF0 == SKIPPED:
            at += 8 + int.from_bytes(head[4:8], "little")
            if at > size:
                yield at, size, CUT_OFF
            continue
        if magic != MAGIC:
            # The first bytes of a frame may be all there is.
            yield at, size, CUT_OFF if len(head) < 4 and MAGIC.to_bytes(4, "little").startswith(head) else NO_FRAME if at == 0 else DAMAGED
            return
        if len(head) < 5:
            yield at, size, CUT_OFF
            return
        flags = head[4]
        single, checksum = flags >> 5 & 1, flags >> 2 & 1
        content = (single, 2, 4, 8)[flags >> 6]
        place = at + 5 + (1 - single) + (0, 1, 2, 4)[flags & 3] + content
        last = False
        while not last:
            stream.seek(place)
            block = stream.read(3)
            if len(block) < 3:
                yield at, size, CUT_OFF
                return
            number = int.from_bytes(block, "little")
            last, kind, length = bool(number & 1), number >> 1 & 3, number >> 3
            if kind == 3:
                yield at, size, DAMAGED
                return
            place += 3 + (1 if kind == 1 else length)
        place += 4 * checksum
        if place > size:
            yield at, size, CUT_OFF
            return
        yield at, place, None
        at = place


def frame_index(files: DataFrame) -> DataFrame:
    """FRAME rows of ``files`` (file): a task for each file, which reads a few bytes for each block of it."""

    def run(batches):
        for batch in batches:
            for file in batch.column(0).to_pylist():
                source, path = _opened(file)
                size = source.get_file_info(path).size or 0
                with io.BufferedReader(source.open_input_file(path), 4096) as stream:
                    found = [(file, k, *x) for k, x in enumerate(frames_of(stream, size))]
                columns = [*zip(*found, strict=True)] or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["file", "frame", "low", "high", "problem"])

    many = max(1, min(files.count(), 4096))
    return files.select("file").repartition(many, "file").mapInArrow(run, FRAME)


class _Slice:
    """The bytes of one frame, to be read from a stream that stands at its first."""

    def __init__(self, stream, left: int):
        self.stream, self.left = stream, left

    def read(self, size: int = -1) -> bytes:
        data = self.stream.read(self.left if size < 0 else min(size, self.left))
        self.left -= len(data)
        return data


def _content(file: str, low: int, high: int) -> Iterator[bytes]:
    import zstandard

    source, path = _opened(file)
    with io.BufferedReader(source.open_input_file(path), STEP) as stream:
        stream.seek(low)
        reader = zstandard.ZstdDecompressor().stream_reader(_Slice(stream, high - low), read_size=1 << 16)
        while piece := reader.read(STEP):
            yield piece


def _sums(frames: DataFrame, most: int) -> DataFrame:
    """(file, frame, low, high, bytes, feeds, problem) of every frame; none is decompressed further than ``most`` bytes."""

    def run(batches):
        import zstandard

        for batch in batches:
            out = []
            for file, frame, low, high in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                size, feeds, problem = 0, 0, None
                try:
                    for piece in _content(file, low, high):
                        size, feeds = size + len(piece), feeds + piece.count(b"\n")
                        if size > most:
                            problem = TOO_LARGE
                            break
                except zstandard.ZstdError:
                    problem = DAMAGED
                out.append((file, frame, low, high, size, feeds, problem))
            kinds = (pa.string(), pa.int32(), *[pa.int64()] * 4, pa.string())
            columns = [*zip(*out, strict=True)] or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["file", "frame", "low", "high", "bytes", "feeds", "problem"])

    return frames.mapInArrow(run, "file string, frame int, low long, high long, bytes long, feeds long, problem string")


def _pieces(frames: DataFrame) -> DataFrame:
    """(file, n, at, size, part, whole): pieces of lines of each frame, with the line's number; null parts are longer than MOST_LINE."""
    schema = "file string, n long, at long, size long, part binary, whole boolean"

    def run(batches):
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_())
        for batch in batches:
            for file, low, high, n, at in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                out, held, size, weight, whole = [], [], 0, 0, False
                # `whole`: the piece began after a line feed of this frame, so its end makes it a line.
                for piece in _content(file, low, high):
                    *ended, rest = piece.split(b"\n")
                    for part in ended:
                        size += len(part)
                        kept = b"".join([*held, part]) if size <= MOST_LINE else None
                        out.append((file, n, at, size, kept, whole))
                        n, at, held, size, whole = n + 1, at + size + 1, [], 0, True
                        weight += len(kept or b"") + 64
                        if weight > STEP:
                            yield _batch(out, kinds)
                            out, weight = [], 0
                    size += len(rest)
                    held = [*held, rest] if size <= MOST_LINE else []
                out.append((file, n, at, size, b"".join(held) if size <= MOST_LINE else None, False))
                yield _batch(out, kinds)

    return frames.select("file", "low", "high", "n", "at").mapInArrow(run, schema)


def _batch(rows: list[tuple], kinds: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["file", "n", "at", "size", "part", "whole"])


def read_frames(spark: SparkSession, files: DataFrame, most_bytes: int = MOST_BYTES) -> tuple[DataFrame, DataFrame]:
    """(lines, refused): finished lines (file, n, offset, line) of zstandard ``files`` (file), and (file, problem) of those that are refused as a whole.

    A file is refused that ends inside a frame, is damaged, is none, or would
    become more than ``most_bytes``; nothing of it is read as lines. ``n`` counts
    from 1, ``offset`` in decompressed bytes; blank lines are left out, and a
    line over MOST_LINE bytes is null. A last line without a line feed is left
    for later. An empty file has no lines.
    """
    index = written(frame_index(files), "zstd-index")
    sums = written(_sums(index.where("problem IS NULL").repartition("file", "frame"), most_bytes), "zstd-sums")
    total = sums.groupBy("file").agg(F.sum("bytes").alias("__total")).where(F.col("__total") > most_bytes).select("file", F.lit(TOO_LARGE).alias("problem"))
    problems = index.where("problem IS NOT NULL").select("file", "problem").unionByName(sums.where("problem IS NOT NULL").select("file", "problem")).unionByName(total)
    refused = written(problems.groupBy("file").agg(F.min("problem").alias("problem")), "zstd-refused")
    earlier = Window.partitionBy("file").orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each frame: a file's frames are numbered in one task, their text is not there.
    starts = sums.join(refused, "file", "left_anti").select("file", "frame", "low", "high", (F.coalesce(F.sum("feeds").over(earlier), F.lit(0)) + 1).alias("n"), F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("at"), F.sum("feeds").over(Window.partitionBy("file")).alias("feeds"))
    starts = written(starts, "zstd-starts")
    parts = _pieces(starts.repartition("file", "frame"))
    line = lambda part: F.regexp_replace(part.cast("string"), r"\r$", "")
    inner = parts.where("whole").select("file", "n", F.col("at").alias("offset"), line(F.col("part")).alias("line"))
    edges = parts.where("NOT whole").groupBy("file", "n").agg(F.min("at").alias("offset"), F.sum("size").alias("__size"), F.sort_array(F.collect_list(F.struct("at", F.when(F.col("size") <= MOST_LINE, F.col("part")).alias("part")))).alias("__parts"))
    bytes_of = F.aggregate("__parts", F.lit(b"").cast("binary"), lambda done, p: F.concat(done, p["part"]))
    across = edges.join(starts.select("file", "feeds").distinct(), "file").where(F.col("n") <= F.col("feeds")).select("file", "n", "offset", F.when(F.col("__size") <= MOST_LINE, line(bytes_of)).alias("line"))
    return inner.unionByName(across).where("line IS NULL OR trim(line) <> ''"), refused
