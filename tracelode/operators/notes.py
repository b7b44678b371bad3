"""Notes that an agent writes about its own session: checked against the records, linked to events, stored once.

A note (note_id, session_id, kind, title, quotes, status, relations, queued_at)
quotes its session; relations map a relation's name to ids of events, or of
notes that were queued before and have become events since. Checks are columns
and joins; a note's refusal refuses the notes that link to it, round by round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_id
from ..sources.store import written
from .texts import quote_places

NOTE = "note_id string, session_id string, kind string, title string, quotes array<string>, status string, relations map<string,array<string>>, queued_at timestamp"
EVENT = "event_id string, note_id string, session_id string, kind string, title string, status string, basis string, recorded_at timestamp, tool_at timestamp, record_ids array<string>"
EDGE = "from_id string, to_id string, relation string"
ALIAS = "alias string, event_id string, step long"
#: Kinds, the status a kind has by default, all statuses, and relations a note may name.
KINDS = ("decision", "proposal", "goal", "action", "revision", "outcome")
DEFAULTS = {"decision": "adopted", "proposal": "proposed", "goal": "adopted", "action": "applied", "revision": "applied"}
STATUSES = ("proposed", "adopted", "in_progress", "asked", "applied", "reported_complete", "observed_success", "observed_failure", "withdrawn", "unknown")
RELATIONS = ("verifies", "revises", "answers", "motivates")
OBSERVED = ("observed_success", "observed_failure")
#: Characters that a quote must have.
LEAST_QUOTE = 8
BAD_KIND, NO_STATUS, BAD_STATUS, NO_QUOTE, BAD_RELATION = "unknown kind", "an outcome needs a status", "unknown status", "no quote", "unknown relation"
NOT_OBSERVED, GOAL_ANSWERS, SHORT_QUOTE, NOT_FOUND = "verifies needs an observed outcome", "a goal answers nothing", "quote too short", "quote not found in the session"
NO_RESULT, RUN_FAILED, RAN_BEFORE, NO_EVENT = "observed, but no tool result is quoted", "the quoted result failed", "the quoted result is older than the change", "no event to link to"


def _first(*cases: tuple[Column, str]) -> Column:
    out = F
    for condition, reason in cases:
        out = out.when(F.coalesce(condition, F.lit(False)), F.lit(reason))
    return out.otherwise(F.lit(None).cast("string"))


def checked(notes: DataFrame, records: DataFrame) -> DataFrame:
    """``notes`` with the status that holds, reason, basis, recorded_at, tool_at and record_ids: all that the session's records decide.

    ``records`` is (record_id, session_id, pos, role, content, recorded_at,
    failed). A quote is found in the latest record that holds it, tool results
    first for an observed status, calls and results first for an applied
    change. An observed result must quote a tool result, and a success none
    that failed.
    """
    own = notes.withColumn("status", F.coalesce("status", *[F.when(F.col("kind") == k, s) for k, s in DEFAULTS.items()]))
    named = F.coalesce(F.map_keys(F.map_filter("relations", lambda _, v: F.size(v) > 0)), F.array().cast("array<string>"))
    has = lambda name: F.array_contains(named, name)
    observed = F.col("status").isin(*OBSERVED)
    static = _first(
        (~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)), BAD_KIND), (F.col("status").isNull(), NO_STATUS), (~F.col("status").isin(*STATUSES), BAD_STATUS), (F.coalesce(F.size("quotes"), F.lit(0)) <= 0, NO_QUOTE),
        (F.size(F.array_except(named, F.array(*map(F.lit, RELATIONS)))) > 0, BAD_RELATION), (has("verifies") & ~((F.col("kind") == "outcome") & observed), NOT_OBSERVED), (has("answers") & (F.col("kind") == "goal"), GOAL_ANSWERS),
        (F.exists("quotes", lambda q: F.length(F.trim(F.coalesce(q, F.lit("")))) < LEAST_QUOTE), SHORT_QUOTE),
    )
    own = written(own.withColumn("reason", static), "notes")
    asked = own.where("reason IS NULL").select("note_id", "session_id", "status", F.explode(F.array_distinct("quotes")).alias("quote"))
    wanted = asked.select("quote").distinct().select(F.sha2("quote", 256).alias("quote_id"), "quote")
    here = records.join(asked.select("session_id").distinct(), "session_id", "left_semi")
    places = quote_places(here.select("record_id", F.col("content").alias("text")), wanted).select("quote_id", "record_id")
    facts = records.select("record_id", "session_id", "pos", "role", "recorded_at", F.coalesce("failed", F.lit(False)).alias("failed"))
    met = asked.withColumn("quote_id", F.sha2("quote", 256)).join(places.join(facts, "record_id"), ["quote_id", "session_id"])
    first = F.when(F.col("status").isin(*OBSERVED), F.col("role") == "tool_result").when(F.col("status") == "applied", F.col("role").isin("tool_call", "tool_result")).otherwise(F.lit(False))
    best = met.groupBy("note_id", "quote_id").agg(F.max_by(F.struct("record_id", "role", "recorded_at", "failed"), F.struct(first, "pos", "record_id")).alias("r"))
    result = F.col("r.role") == "tool_result"
    cited = best.groupBy("note_id").agg(F.count("*").alias("n"), F.count_if(result).alias("n_results"), F.max(result & F.col("r.failed")).alias("any_failed"), F.max(F.col("r.role").isin("tool_call", "tool_result")).alias("tool"), F.max("r.recorded_at").alias("recorded_at"), F.max(F.when(result, F.col("r.recorded_at"))).alias("tool_at"), F.array_sort(F.collect_set("r.record_id")).alias("record_ids"))
    joined = own.join(cited, "note_id", "left")
    late = _first((F.coalesce("n", F.lit(0)) < F.size(F.array_distinct("quotes")), NOT_FOUND), (observed & (F.col("n_results") == 0), NO_RESULT), ((F.col("status") == "observed_success") & F.col("any_failed"), RUN_FAILED))
    return written(joined.select(*notes.columns, F.coalesce("reason", late).alias("reason"), F.when(F.col("tool"), "tool_record").otherwise("explicit_statement").alias("basis"), "recorded_at", "tool_at", "record_ids"), "notes-checked")


def compressed(known: DataFrame, new: DataFrame, step: int) -> DataFrame:
    """ALIAS rows to append to ``known``, so that every alias leads to its end in one step: the new ones, led on by what is known, and the known ones whose end has become an alias itself.

    ``new`` may hold chains of its own; they are shortened by doubling. An alias
    that leads to itself, alone or in a circle, is refused with an error.
    """
    current = latest(known)
    both = new.select("alias", "event_id").unionByName(current.join(new.select("alias"), "alias", "left_anti").select("alias", "event_id"))
    both = written(both, "aliases")
    rounds = 0
    while not both.join(both.select(F.col("alias").alias("event_id")), "event_id", "left_semi").isEmpty():
        onward = both.select(F.col("alias").alias("__a"), F.col("event_id").alias("__e"))
        both = written(both.join(onward, F.col("event_id") == F.col("__a"), "left").select("alias", F.coalesce("__e", "event_id").alias("event_id")), "aliases")
        rounds += 1
        if rounds > 64:
            raise ValueError("aliases lead in a circle")
    return both.join(current, ["alias", "event_id"], "left_anti").select("alias", "event_id", F.lit(step).cast("long").alias("step"))


def latest(aliases: DataFrame) -> DataFrame:
    return aliases.groupBy("alias").agg(F.max_by("event_id", "step").alias("event_id"))


def stored(notes: DataFrame, events: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(judged, events, edges): ``notes`` of ``checked`` with event_id and reason, and the rows to store.

    The event of a note is named by the note's id. A relation's target is an
    event, a queued id that an alias leads from, or another of these notes that
    was queued before; a note whose target is refused is refused with it. A
    check older than its change is refused where both times are known.
    """
    named = notes.withColumn("event_id", content_id("ev_", F.col("note_id")))
    edges = named.where("reason IS NULL").select("note_id", "event_id", "queued_at", "tool_at", F.explode("relations").alias("relation", "targets")).select("note_id", "event_id", "queued_at", "tool_at", "relation", F.explode(F.array_distinct("targets")).alias("target"))
    known = events.select(F.col("event_id").alias("target"), F.col("event_id").alias("end"), F.col("tool_at").alias("changed"), F.col("recorded_at").alias("said"))
    by_alias = latest(aliases).select(F.col("alias").alias("target"), F.col("event_id").alias("end")).join(known.select("end", "changed", "said"), "end")
    beside = named.where("reason IS NULL").select(F.col("note_id").alias("target"), F.col("event_id").alias("end"), F.col("tool_at").alias("changed"), F.col("recorded_at").alias("said"), F.col("queued_at").alias("__before"), F.lit(True).alias("here"))
    ends = known.unionByName(by_alias).unionByName(beside, allowMissingColumns=True)
    order = lambda at, key: F.struct(at, key)
    met = edges.join(ends, "target", "left").where(F.col("here").isNull() | (order("__before", "target") < order("queued_at", "note_id")))
    old = (F.col("relation") == "verifies") & (F.col("tool_at") < F.coalesce("changed", "said"))
    met = written(met.select("note_id", "event_id", "relation", "target", "end", "here", F.coalesce(old, F.lit(False)).alias("old")), "note-edges")
    lost = edges.select("note_id", "relation", "target").join(met.where("end IS NOT NULL").select("note_id", "relation", "target"), ["note_id", "relation", "target"], "left_anti").select("note_id", F.lit(NO_EVENT).alias("why"))
    late = met.where("old").select("note_id", F.lit(RAN_BEFORE).alias("why"))
    refused = written(notes.where("reason IS NOT NULL").select("note_id", F.col("reason").alias("why")).unionByName(late).unionByName(lost).groupBy("note_id").agg(F.max("why").alias("why")), "note-refusals")
    new = refused
    while not new.isEmpty():
        hit = met.where("here").join(new.select(F.col("note_id").alias("target")), "target").select("note_id").distinct()
        new = written(hit.join(refused, "note_id", "left_anti").withColumn("why", F.lit(NO_EVENT)), "note-refused")
        refused = written(refused.unionByName(new), "note-refusals")
    judged = named.drop("reason").join(refused.withColumnRenamed("why", "reason"), "note_id", "left")
    kept = judged.where("reason IS NULL")
    rows = kept.select("event_id", "note_id", "session_id", "kind", "title", "status", "basis", "recorded_at", "tool_at", "record_ids")
    links = met.join(kept.select("note_id"), "note_id", "left_semi").where("end IS NOT NULL").select(F.col("end").alias("from_id"), F.col("event_id").alias("to_id"), "relation").distinct()
    return judged, rows, links
