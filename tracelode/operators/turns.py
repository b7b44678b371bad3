"""Turns, requests and gaps of sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ordered
from .records import is_prompt, person_text

#: Fixed values, in seconds: a gap that cuts a session, one that does so across a date, and the quiet time of a session.
CUT_GAP, DATE_GAP, QUIET = 3 * 3600, 3600, 3600


def number_turns(records: DataFrame) -> DataFrame:
    """``records`` (session_id, pos, role, content) with turn: how many prompts came so far."""
    prompt = is_prompt(person_text(F.col("role"), F.col("content")))
    return ordered.running_count(records, ["session_id"], ["pos"], prompt, "turn", ordered.block_of(F.col("pos")))


def link_prompts(records: DataFrame) -> DataFrame:
    """``records`` with prompt_id: the source_id of the last prompt up to each."""
    prompt = is_prompt(person_text(F.col("role"), F.col("content")))
    return ordered.last_before(records, ["session_id"], ["pos"], F.when(prompt, F.col("source_id")), "prompt_id", ordered.block_of(F.col("pos")))


def next_written(records: DataFrame) -> DataFrame:
    """``records`` with next_id: the first assistant record after each, in its session."""
    flipped = records.withColumn("__back", -F.col("pos"))
    found = ordered.last_before(flipped, ["session_id"], ["__back"], F.when(F.col("role") == "assistant", F.col("source_id")), "next_id", ordered.block_of(F.col("__back")), strict=True)
    return found.drop("__back")


def roll_up(records: DataFrame) -> DataFrame:
    """One row for each session: records, turns, characters, and records that come before any prompt."""
    turned = number_turns(records)
    return turned.groupBy("session_id").agg(F.count("*").alias("n_records"), F.max("turn").alias("n_turns"), F.sum(F.length("content")).alias("n_chars"), F.count_if(F.col("turn") == 0).alias("n_before"), F.count_if(F.col("role") == "assistant").alias("n_answers"))


def latest_request(events: DataFrame, is_request: Column, time: str = "at") -> DataFrame:
    """``events`` (id, session_id, at) with request_id: the session's latest request up to each event."""
    return ordered.last_before(events, ["session_id"], [time, "id"], F.when(is_request, F.col("id")), "request_id", ordered.block_of(F.unix_micros(F.col(time).cast("timestamp")) / 1e6, 86_400))


def fill_times(events: DataFrame) -> DataFrame:
    """``events`` (pos, session_id, at or null) with filled_at: the own time, else the session's last time before, else the filled time of the row before.

    Both are as-of steps over blocks of positions; a row before any time stays null.
    """
    own = ordered.last_before(events, ["session_id"], ["pos"], F.col("at"), "__session_at", ordered.block_of(F.col("pos")))
    # Sequences of all rows: the key is a constant, the blocks are the tasks.
    every = ordered.last_before(own.withColumn("__all", F.lit(0)), ["__all"], ["pos"], F.col("__session_at"), "__any_at", ordered.block_of(F.col("pos"), 4096))
    return every.withColumn("filled_at", F.coalesce("at", "__session_at", "__any_at")).select(*events.columns, "filled_at")


def gap_cuts(events: DataFrame, compaction: Column | None = None) -> DataFrame:
    """``events`` (id, session_id, at) with gap_s, cut (whether a part of the session begins here), reason and part (from 1).

    A part begins at the session's start, at a compaction, after a gap of three
    hours, or after one of an hour across a date. Rows without a time begin no
    part.
    """
    block = ordered.block_of(F.unix_micros(F.col("at").cast("timestamp")) / 1e6, 86_400)
    seen = ordered.previous(events, ["session_id"], ["at", "id"], ["at"], "__before", block)
    before = F.col("__before.at")
    seconds = (F.unix_micros(F.col("at").cast("timestamp")) - F.unix_micros(before.cast("timestamp"))) / F.lit(1e6)
    gaps = seen.withColumn("gap_s", seconds).withColumn("__date", F.to_date(before) != F.to_date("at"))
    first = F.col("__before").isNull()
    reason = F.when(first, "start").when(compaction if compaction is not None else F.lit(False), "compaction").when(F.col("gap_s") >= CUT_GAP, "gap").when((F.col("gap_s") >= DATE_GAP) & F.col("__date"), "date")
    marked = gaps.withColumn("reason", reason).withColumn("cut", F.col("reason").isNotNull()).drop("__date", "__before")
    return ordered.running_count(marked, ["session_id"], ["at", "id"], F.col("cut"), "part", block)


def quiet_intervals(notes: DataFrame, records: DataFrame, now: Column) -> DataFrame:
    """The stretch (tail_start, tail_end] after each noted session's last note, where the session has been quiet for an hour.

    ``notes`` is (session_id, noted_at), ``records`` (session_id, at).
    """
    noted = notes.groupBy("session_id").agg(F.max("noted_at").alias("noted_at"))
    last = records.groupBy("session_id").agg(F.max("at").alias("last_at"))
    joined = noted.join(last, "session_id").where(F.col("last_at") > F.col("noted_at"))
    idle = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last_at").cast("timestamp"))) / F.lit(1e6)
    return joined.where(idle >= QUIET).select("session_id", F.col("noted_at").alias("tail_start"), F.col("last_at").alias("tail_end"))


def recent_sessions(records: DataFrame, n: int) -> DataFrame:
    """The ``n`` sessions with the latest records, oldest of them first in ``place``."""
    last = records.groupBy("session_id").agg(F.max("at").alias("last_at"), F.count("*").alias("n_records"))
    top = last.orderBy(F.desc("last_at"), "session_id").limit(n)
    return top.withColumn("place", F.row_number().over(Window.orderBy("last_at", F.desc("session_id"))))
