"""The queue of notes as a stream: each batch is checked, linked and appended once, whatever is run again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import notes as rules
from ..sources import appends
from ..sources.store import written

#: Fixed value: refusals that are kept to be told.
MOST_REFUSALS = 10


def write_notes(notes: DataFrame, records: DataFrame, root: str, batch: tuple[str, int] | None = None) -> int:
    """Store ``notes`` (rules.NOTE) below ``root``: events, edges and aliases of those that pass, the last MOST_REFUSALS reasons of the others. The version that holds them.

    ``batch`` is (queue, number): a batch of a number that the queue has
    stored changes nothing, and neither does a note that has become an event.
    What another writer stores in between is read before the notes are judged
    again. Notes with the same id in one batch are one.
    """
    spark = notes.sparkSession
    latest = appends.Snapshot(spark, root)
    if batch and latest.notes.get("batches", {}).get(batch[0], -1) >= batch[1]:
        return latest.version
    once = written(rules.checked(notes.where("note_id IS NOT NULL").dropDuplicates(["note_id"]), records), "notes-queued")

    def make(snapshot: appends.Snapshot):
        done = snapshot.notes.get("batches", {})
        if batch and done.get(batch[0], -1) >= batch[1]:
            return None
        events, aliases = snapshot.table("events", rules.EVENT), snapshot.table("aliases", rules.ALIAS)
        fresh = once.join(events.select("note_id"), "note_id", "left_anti")
        judged, rows, edges = rules.stored(fresh, events, aliases)
        judged = written(judged, "notes-judged")
        rows, edges = written(rows, "notes-events"), written(edges, "notes-edges")
        told = judged.where("reason IS NOT NULL").orderBy(F.desc("queued_at"), F.desc("note_id")).limit(MOST_REFUSALS).select("note_id", "title", "reason").collect()
        refusals = (snapshot.notes.get("refusals", []) + [list(r) for r in reversed(told)])[-MOST_REFUSALS:]
        new = rules.compressed(aliases, rows.select(F.col("note_id").alias("alias"), "event_id"), snapshot.version + 1)
        batches = done | ({batch[0]: batch[1]} if batch else {})
        return {"events": rows, "edges": edges, "aliases": new}, {"batches": batches, "refusals": refusals}

    return appends.append(spark, root, make)


def flush_each_batch(records: DataFrame, root: str, queue: str = "notes") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that stores the queued notes; oldest first by their time."""

    def run(batch: DataFrame, number: int) -> None:
        write_notes(batch.select(*[c.split()[0] for c in rules.NOTE.split(", ")]), records, root, (queue, number))

    return run


def stored(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame, list]:
    """(events, edges, aliases, refusals) of the latest version."""
    snapshot = appends.Snapshot(spark, root)
    return snapshot.table("events", rules.EVENT), snapshot.table("edges", rules.EDGE), rules.latest(snapshot.table("aliases", rules.ALIAS)), snapshot.notes.get("refusals", [])
