"""The files below a folder, listed on the executors: one round for each level, no folder twice, links kept inside.

Each round lists the folders of a level in as many tasks as there are folders.
A folder is known by device and inode, so a link that leads back to it ends
there. A linked folder is entered where its target lies in one of the roots;
one that leads elsewhere is told, not entered. Folders must lie where the
executors can open them (a local or mounted folder).
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import written

#: Tasks of a round at most.
TASKS = 256
ENTRY = "path string, level int, kind string, node string, real string, size long, mtime_us long"
#: Levels before a walk is taken for endless.
MOST_LEVELS = 1000


def _entry(path: str, level: int, roots: list[str]) -> tuple | None:
    """A path as a row: folder, link to a folder (inside or outside of the roots), file, link or broken link; None for hidden names and what cannot be read."""
    try:
        own = os.lstat(path)
        linked = stat.S_ISLNK(own.st_mode)
        info = os.stat(path) if linked else own
    except FileNotFoundError:
        return path, level, "broken link", None, None, None, None
    except OSError:
        return None
    real = os.path.realpath(path)
    inside = any(real == r or real.startswith(r.rstrip("/") + "/") for r in roots)
    folder = stat.S_ISDIR(info.st_mode)
    kind = ("folder" if inside else "outside") if folder else ("link" if linked else "file")
    return path, level, kind, f"{info.st_dev}:{info.st_ino}", real, None if folder else info.st_size, int(info.st_mtime_ns // 1000)


def walk(spark: SparkSession, folder: str, roots: list[str] | None = None, hidden: bool = False) -> DataFrame:
    """ENTRY rows of everything below ``folder``: each folder that was entered once, its files and links, and links that lead out of ``roots`` (by default the folder's own target) as ``outside``.

    Of several ways to a folder the shortest is taken, of equally long ones the
    first by name. Names that begin with a dot or an underscore are left out
    unless ``hidden``. A folder that is not there has no rows; one that cannot
    be read has no entries.
    """
    top = os.path.abspath("/" + folder.removeprefix("file:").lstrip("/") if folder.startswith("file:") else folder)
    allowed = [os.path.realpath(r) for r in [top, *(roots or [])]]
    first = spark.createDataFrame([(top,)], "path string").select("path", F.lit(0).alias("level"))

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _rows([e for p in batch.column(0).to_pylist() if (e := _entry(p, 0, allowed)) and e[2] == "folder"])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, level in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                found = []
                try:
                    with os.scandir(path) as entries:
                        for entry in entries:
                            if (hidden or entry.name[0] not in "._") and (row := _entry(entry.path, level + 1, allowed)):
                                found.append(row)
                            if len(found) == 4096:
                                yield _rows(found)
                                found = []
                except OSError:
                    pass
                yield _rows(found)

    level = written(first.mapInArrow(begin, ENTRY), "listing")
    seen, every = level, level.where("false")
    for _ in range(MOST_LEVELS):
        folders = level.where("kind = 'folder'")
        many = folders.count()
        if not many:
            return every.unionByName(seen)
        met = written(folders.select("path", "level").repartition(min(TASKS, many), "path").mapInArrow(look, ENTRY), "listing")
        every = every.unionByName(met.where("kind <> 'folder'"))
        new = met.where("kind = 'folder'").join(seen.select("node"), "node", "left_anti")
        best = new.groupBy("node").agg(F.min("path").alias("path"))
        level = written(new.join(best, ["node", "path"]).select(*level.columns), "listing")
        seen = seen.unionByName(level)
    raise RuntimeError(f"folders below {top} are more than {MOST_LEVELS} levels deep")


def _rows(found: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
    columns = [*zip(*found, strict=True)] or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in ENTRY.split(", ")])


def transcripts(entries: DataFrame, suffix: str = ".jsonl", packed: str = ".zst") -> DataFrame:
    """(path, size, mtime_us, packed) of the files to read: those that end in ``suffix``, and packed ones whose plain twin is not there. Links are not read."""
    files = entries.where("kind = 'file'")
    plain = files.where(F.col("path").endswith(suffix)).select("path", "size", "mtime_us", F.lit(False).alias("packed"))
    zipped = files.where(F.col("path").endswith(suffix + packed)).withColumn("__plain", F.substring("path", F.lit(1), F.length("path") - len(packed)))
    alone = zipped.join(plain.select(F.col("path").alias("__plain")), "__plain", "left_anti")
    return plain.unionByName(alone.select("path", "size", "mtime_us", F.lit(True).alias("packed")))


def skipped(entries: DataFrame) -> DataFrame:
    """(path, why) of what was met and is not read: links, broken ones, and links to folders elsewhere."""
    return entries.where(F.col("kind").isin("link", "broken link", "outside")).select("path", F.col("kind").alias("why"))
