"""What a story answer claims about its unit, and which claims the records bear out.

An answer (JSON) tells events, and links between events, work items, runs and
requests. Claims become rows, are joined with the records, items and blocks they
name, and carry the reason for which they are refused, or none. A refusal is
then handed on, round by round and by the newly refused only, to the events and
links that rest on what was refused.

Tables, all by ``unit_id``: records (source_id, pos, session_id, role, prompt);
items (item_id, edit, run, delegate, status, inline, sources); blocks (block_id,
source_id); earlier, the open requests of former stretches (request_id,
session_id).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import written
from . import ordered

ANSWER = """story array<struct<id:string,kind:string,title:string,why:string,summary:string,status:string,blocks:array<string>,work:array<string>>>,
 work array<struct<id:string,title:string,summary:string,checked_by:array<struct<run:string,blocks:array<string>>>>>,
 requests array<struct<id:string,answered_by:array<struct<item:string,blocks:array<string>>>>>,
 links array<struct<`from`:string,`to`:string,relation:string,blocks:array<string>>>"""
#: Results that are known, and the reasons of refused claims.
KNOWN_RESULTS = ("passed", "failed", "observed_success", "observed_failure")
NOT_EDIT, NOT_RUN, UNKNOWN, OTHER_SESSION = "not from an edit", "not to a run", "the run's result is unknown", "not in the edit's session"
TOO_EARLY, NO_REPORT = "the run came before the edit", "no block where the assistant reports the run"
HANDED_OVER, NOT_REQUEST, NOT_HERE = "a task handed to another agent is not the answer", "not from a request", "not to an event of this stretch"
NO_REPLY, NO_REPLY_AFTER, NO_REPLY_IN, LATE_REPLY = "no block of the assistant's reply", "no reply after the request in its session", "no reply in the request's session", "the reply came after a later request"
NOT_KEPT, SAME_REPLY, LOST_END = "its answer was not kept", "the same reply answers it through another event", "an end was not kept"
TAKEN, NO_EVIDENCE = "its id is taken", "no evidence left"


@dataclass
class Judged:
    """links (unit_id, from_id, to_id, relation, turned, blocks, reason), events (unit_id, id, kind, title, status, blocks, reason, round), unclaimed (unit_id, block_id)."""

    links: DataFrame
    events: DataFrame
    unclaimed: DataFrame


def request_ids(records: DataFrame) -> DataFrame:
    """(unit_id, request_id, source_id, pos, session_id): the prompts of each unit as Q1, Q2 and so on."""
    counted = ordered.running_count(records.where("prompt"), ["unit_id"], ["pos"], F.lit(True), "__k", ordered.block_of(F.col("pos")))
    return counted.select("unit_id", F.concat(F.lit("Q"), F.col("__k").cast("string")).alias("request_id"), "source_id", "pos", "session_id")


def told(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, links) of answers (unit_id, answer): story events with their place k, and links with theirs, claims of checks and replies among them. Unreadable answers tell nothing."""
    rows = answers.select("unit_id", F.from_json("answer", ANSWER).alias("a"))
    entries = rows.select("unit_id", F.posexplode("a.story").alias("k", "e")).select("unit_id", "k", "e.*").where("id IS NOT NULL")
    flat = lambda place, link: (rows.select("unit_id", F.explode(link).alias("l")).select("unit_id", F.lit(place).alias("part"), "l.*"))
    row = lambda a, b, relation, blocks, i, j: F.struct(i.cast("long").alias("i"), j.cast("long").alias("j"), a.alias("from_id"), b.alias("to_id"), relation.alias("relation"), F.coalesce(blocks, F.array().cast("array<string>")).alias("blocks"))
    links = F.transform("a.links", lambda x, i: row(x["from"], x["to"], x["relation"], x["blocks"], i, F.lit(0)))
    checks = F.flatten(F.transform("a.work", lambda w, i: F.transform(F.coalesce(w["checked_by"], F.array().cast("array<struct<run:string,blocks:array<string>>>")), lambda c, j: row(w["id"], c["run"], F.lit("verifies"), c["blocks"], i, j))))
    replies = F.flatten(F.transform("a.requests", lambda q, i: F.transform(F.coalesce(q["answered_by"], F.array().cast("array<struct<item:string,blocks:array<string>>>")), lambda c, j: row(q["id"], c["item"], F.lit("answers"), c["blocks"], i, j))))
    every = flat(0, links).unionByName(flat(1, checks)).unionByName(flat(2, replies))
    return entries, every.where("from_id IS NOT NULL AND to_id IS NOT NULL AND relation IS NOT NULL")


def _facts(items: DataFrame, records: DataFrame) -> DataFrame:
    """Items with what their records say: session (null if there are several or none), last place, place and id of the call."""
    each = items.select("unit_id", "item_id", F.posexplode("sources").alias("k", "source_id")).join(records.select("unit_id", "source_id", "pos", "session_id", "role"), ["unit_id", "source_id"])
    first = F.min(F.struct(F.when(F.col("role") == "tool_call", 0).otherwise(1), "k", "pos", "source_id"))
    facts = each.groupBy("unit_id", "item_id").agg(F.min("session_id").alias("session_id"), F.max("session_id").alias("__other"), F.max("pos").alias("last_pos"), first.alias("__call"))
    facts = facts.select("unit_id", "item_id", F.when(F.col("session_id") == F.col("__other"), F.col("session_id")).alias("session_id"), "last_pos", F.col("__call.pos").alias("call_pos"), F.col("__call.source_id").alias("call_source"))
    return items.dropDuplicates(["unit_id", "item_id"]).join(facts, ["unit_id", "item_id"], "left")


def _first(*cases: tuple[Column, str]) -> Column:
    out = F
    for condition, reason in cases:
        out = out.when(F.coalesce(condition, F.lit(False)), F.lit(reason))
    return out.otherwise(F.lit(None).cast("string"))


def judge(answers: DataFrame, records: DataFrame, items: DataFrame, blocks: DataFrame, earlier: DataFrame) -> Judged:
    """The claims of ``answers`` (unit_id, answer) with the reason of each that is not kept.

    A check runs from an edit to a later run of its session with a known result
    and rests on a block that the assistant wrote after it. An answer runs from
    a request to an event of the stretch and rests on a block that the assistant
    wrote after the request, in its session, for an earlier request before the
    session's next prompt. A link written the wrong way round is turned; equal
    links are one, with the blocks of both. An event needs an id of its own, and
    a block, a work item with records, or another event that is kept. Of several
    answers to a request that rest on the same blocks, those to story events
    stay, else that to the latest item. No claims give no rows; ids that name
    nothing refuse the claims that use them.
    """
    records, blocks = records.dropDuplicates(["unit_id", "source_id"]), blocks.dropDuplicates(["unit_id", "block_id"])
    entries, links = told(answers)
    entries, facts, asked = written(entries, "story-entries"), written(_facts(items, records), "story-items"), request_ids(records)
    requests = written(asked.select("unit_id", F.col("request_id").alias("id"), "session_id", F.col("pos").alias("asked_pos"), F.lit(True).alias("here")).unionByName(earlier.select("unit_id", F.col("request_id").alias("id"), "session_id", F.lit(None).cast("bigint").alias("asked_pos"), F.lit(False).alias("here"))).dropDuplicates(["unit_id", "id"]), "story-requests")
    shown = written(blocks.join(records.select("unit_id", "source_id", "pos", "session_id", "role"), ["unit_id", "source_id"]), "story-blocks")

    events = _events(entries, facts, requests, blocks)
    ends = facts.select("unit_id", F.col("item_id").alias("id"), F.lit("item").alias("what"), *[F.coalesce(c, F.lit(False)).alias(c) for c in ("edit", "run", "delegate", "inline")], "status", "sources", "session_id", "last_pos", "call_pos", "call_source", F.lit(None).cast("bigint").alias("asked_pos"), F.lit(None).cast("boolean").alias("here"))
    ends = ends.unionByName(requests.withColumn("what", F.lit("request")), allowMissingColumns=True)
    ends = ends.unionByName(entries.select("unit_id", "id", F.lit("story").alias("what")).distinct(), allowMissingColumns=True)
    # An id that names several things is a request before an item before a story event.
    ends = ends.withColumn("__rank", F.when(F.col("what") == "request", 0).when(F.col("what") == "item", 1).otherwise(2))
    best = ends.groupBy("unit_id", "id").agg(F.min("__rank").alias("__rank"))
    ends = written(ends.join(best, ["unit_id", "id", "__rank"]).drop("__rank"), "story-ends")
    side = lambda name: ends.select(F.col("unit_id"), F.col("id").alias(f"{name}_id"), F.struct(*[c for c in ends.columns if c not in ("unit_id", "id")]).alias(name))

    met = links.join(side("from"), ["unit_id", "from_id"], "left").join(side("to"), ["unit_id", "to_id"], "left")
    is_run = lambda end: F.coalesce(F.col(f"{end}.run") & ~F.col(f"{end}.edit"), F.lit(False))
    asks = lambda end: F.coalesce(F.col(f"{end}.what") == "request", F.lit(False))
    turned = ((F.col("relation") == "verifies") & is_run("from") & F.coalesce(F.col("to.edit"), F.lit(False))) | ((F.col("relation") == "answers") & asks("to") & ~asks("from"))
    met = met.withColumn("turned", turned)
    swap = lambda a, b: F.when(F.col("turned"), F.col(b)).otherwise(F.col(a))
    met = met.select("unit_id", swap("from_id", "to_id").alias("from_id"), swap("to_id", "from_id").alias("to_id"), "relation", "turned", swap("from", "to").alias("from"), swap("to", "from").alias("to"), F.struct("part", "i", "j", "blocks").alias("b"))
    once = met.groupBy("unit_id", "from_id", "to_id", "relation").agg(F.max("turned").alias("turned"), F.first("from").alias("from"), F.first("to").alias("to"), F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list("b")), lambda b: b["blocks"]))).alias("blocks"))
    once = written(once, "story-links")

    cited = once.select("unit_id", "from_id", "to_id", "relation", "from", "to", F.posexplode("blocks").alias("place", "block_id")).join(shown.select("unit_id", "block_id", "pos", "session_id", "role"), ["unit_id", "block_id"]).where("role = 'assistant'")
    turn_end = records.where("prompt").groupBy("unit_id", "session_id").agg(F.min("pos").alias("turn_end"))
    cited = cited.join(turn_end, ["unit_id", "session_id"], "left")
    inside = F.col("session_id") == F.col("from.session_id")
    after = F.when(F.col("from.here"), F.col("pos") > F.col("from.asked_pos")).otherwise(F.coalesce(F.col("pos") < F.col("turn_end"), F.lit(True)))
    report, reply = F.col("pos") > F.col("to.last_pos"), inside & after
    good = F.when(F.col("relation") == "verifies", report).when(F.col("relation") == "answers", reply).otherwise(F.lit(True))
    sums = cited.groupBy("unit_id", "from_id", "to_id", "relation").agg(F.count("*").alias("n_own"), F.count_if(inside).alias("n_inside"), F.transform(F.sort_array(F.collect_list(F.when(good, F.struct("place", "block_id")))), lambda b: b["block_id"]).alias("kept_blocks"))
    joined = once.join(sums, ["unit_id", "from_id", "to_id", "relation"], "left").fillna(0, ["n_own", "n_inside"]).withColumn("kept_blocks", F.coalesce("kept_blocks", F.array().cast("array<string>")))
    same_call = F.col("to.inline") & F.array_contains("from.sources", F.col("to.call_source"))
    early = (F.col("to.call_pos") < F.col("from.last_pos")) & ~F.coalesce(same_call, F.lit(False))
    lost = lambda c: ~F.coalesce(c, F.lit(False))
    check = _first(
        (lost(F.col("from.edit")), NOT_EDIT), (lost(F.col("to.run")), NOT_RUN), (lost(F.col("to.status").isin(*KNOWN_RESULTS)), UNKNOWN),
        (lost(F.col("from.session_id") == F.col("to.session_id")), OTHER_SESSION), (early, TOO_EARLY), (F.size("kept_blocks") == 0, NO_REPORT),
    )
    answer = _first(
        (F.col("to.delegate"), HANDED_OVER), (lost(F.col("from.what") == "request"), NOT_REQUEST), (asks("to") | F.col("to.what").isNull(), NOT_HERE), (F.col("n_own") == 0, NO_REPLY),
        (F.col("from.here") & (F.size("kept_blocks") == 0), NO_REPLY_AFTER), (F.col("n_inside") == 0, NO_REPLY_IN), (F.size("kept_blocks") == 0, LATE_REPLY),
    )
    judged = joined.withColumn("reason", F.when(F.col("relation") == "verifies", check).when(F.col("relation") == "answers", answer))
    gone = events.where("reason IS NOT NULL").select("unit_id", "id").distinct().join(events.where("reason IS NULL").select("unit_id", "id"), ["unit_id", "id"], "left_anti")
    for end in ("from", "to"):
        judged = judged.join(gone.select("unit_id", F.col("id").alias(f"{end}_id"), F.lit(True).alias(f"__{end}")), ["unit_id", f"{end}_id"], "left")
    story = lambda end: F.coalesce(F.col(f"__{end}"), F.lit(False)) & (F.col(f"{end}.what") == "story")
    unknown = F.col("from.what").isNull() | F.col("to.what").isNull()
    other = ~F.col("relation").isin("verifies", "answers")
    judged = judged.withColumn("reason", F.coalesce("reason", _first(((F.col("relation") == "answers") & story("to"), NOT_KEPT), (other & (story("from") | story("to") | unknown), LOST_END))))
    judged = written(judged.select("unit_id", "from_id", "to_id", "relation", "turned", F.col("kept_blocks").alias("blocks"), F.col("to.what").alias("__what"), F.coalesce("to.last_pos", F.lit(-1)).alias("__last"), "reason"), "story-judged")
    links = _one_answer(judged)
    used = events.where("reason IS NULL").select("unit_id", F.explode("blocks").alias("block_id")).union(links.where("reason IS NULL").select("unit_id", F.explode("blocks")))
    unclaimed = shown.where("role = 'assistant'").select("unit_id", "block_id").join(used, ["unit_id", "block_id"], "left_anti")
    return Judged(links, events, unclaimed)


def _one_answer(judged: DataFrame) -> DataFrame:
    """Kept answers of one request that rest on the same blocks: the story events among them stay, else the latest item."""
    key = ["unit_id", "from_id", "blocks"]
    answers = judged.where("relation = 'answers' AND reason IS NULL")
    best = answers.groupBy(*key).agg(F.max(F.col("__what") == "story").alias("__told"), F.max(F.struct("__last", "to_id")).alias("__best"))
    beside = answers.join(best, key).where(F.when(F.col("__told"), F.col("__what") != "story").otherwise(F.col("to_id") != F.col("__best.to_id"))).select("unit_id", "from_id", "to_id", "relation", F.lit(SAME_REPLY).alias("__same"))
    out = judged.join(beside, ["unit_id", "from_id", "to_id", "relation"], "left")
    return out.select("unit_id", "from_id", "to_id", "relation", "turned", "blocks", F.coalesce("reason", "__same").alias("reason"))


def _events(entries: DataFrame, facts: DataFrame, requests: DataFrame, blocks: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """Story events with their reasons. ``round`` says how far a lost event stands from what it rested on: 0 for its own fault."""
    reserved = requests.select("unit_id", "id").union(facts.select("unit_id", "item_id")).union(blocks.select("unit_id", "block_id")).distinct().withColumn("__reserved", F.lit(True))
    first = entries.groupBy("unit_id", "id").agg(F.min("k").alias("__first"))
    rows = entries.join(reserved, ["unit_id", "id"], "left").join(first, ["unit_id", "id"])
    taken = F.coalesce("__reserved", F.lit(False)) | F.col("id").startswith("ev_") | (F.col("k") > F.col("__first"))
    rows = written(rows.select("unit_id", "k", "id", "kind", "title", "status", "blocks", "work", taken.alias("taken")), "story-events")
    own = rows.where("NOT taken")
    by_block = own.select("unit_id", "id", F.explode("blocks").alias("block_id")).join(blocks.select("unit_id", "block_id"), ["unit_id", "block_id"]).select("unit_id", "id").distinct()
    rests = own.select("unit_id", "id", F.explode(F.array_distinct("work")).alias("on")).where("id <> on")
    by_item = rests.join(facts.where("last_pos IS NOT NULL").select("unit_id", F.col("item_id").alias("on")), ["unit_id", "on"]).select("unit_id", "id").distinct()
    sound = by_block.union(by_item).distinct()
    # What has no evidence of its own stands as long as another event that it rests on does.
    leaning = written(own.select("unit_id", "id").join(sound, ["unit_id", "id"], "left_anti"), "story-leaning")
    edges = written(rests.join(leaning, ["unit_id", "id"]).join(own.select("unit_id", F.col("id").alias("on")), ["unit_id", "on"]), "story-rests")
    left = edges.groupBy("unit_id", "id").agg(F.count("*").alias("left"))
    state = written(leaning.join(left, ["unit_id", "id"], "left").fillna(0, ["left"]), "story-left")
    fallen = written(state.where("left = 0").select("unit_id", "id", F.lit(0).alias("round")), "story-fallen")
    new = fallen
    for number in range(1, most_rounds):
        if new.isEmpty():
            break
        hit = edges.join(new.select("unit_id", F.col("id").alias("on")), ["unit_id", "on"]).groupBy("unit_id", "id").agg(F.count("*").alias("__hit"))
        state = written(state.join(hit, ["unit_id", "id"], "left").withColumn("left", F.col("left") - F.coalesce("__hit", F.lit(0))).drop("__hit"), "story-left")
        new = written(state.where("left = 0").select("unit_id", "id").join(fallen, ["unit_id", "id"], "left_anti").withColumn("round", F.lit(number)), "story-new")
        fallen = written(fallen.unionByName(new), "story-fallen")
    # Events that rest on each other only, in a circle, stand on nothing.
    grounded = _grounded(edges, state, fallen)
    out = rows.join(fallen, ["unit_id", "id"], "left").join(grounded, ["unit_id", "id"], "left")
    reason = F.when(F.col("taken"), TAKEN).when(F.col("round").isNotNull() | F.coalesce("__circle", F.lit(False)), NO_EVIDENCE)
    return written(out.select("unit_id", "id", "kind", "title", "status", "blocks", reason.alias("reason"), F.when(~F.col("taken"), F.col("round")).alias("round")), "story-events")


def _grounded(edges: DataFrame, state: DataFrame, fallen: DataFrame) -> DataFrame:
    """(unit_id, id, __circle) of leaning events that no path leads from to an event with evidence of its own."""
    open_ = written(state.select("unit_id", "id").join(fallen, ["unit_id", "id"], "left_anti"), "story-open")
    inner = written(edges.join(open_, ["unit_id", "id"]), "story-inner")
    rooted = inner.join(open_.select("unit_id", F.col("id").alias("on")), ["unit_id", "on"], "left_anti").join(fallen.select("unit_id", F.col("id").alias("on")), ["unit_id", "on"], "left_anti").select("unit_id", "id").distinct()
    new = known = written(rooted, "story-rooted")
    while not new.isEmpty():
        then = inner.join(new.select("unit_id", F.col("id").alias("on")), ["unit_id", "on"]).select("unit_id", "id").distinct()
        new = written(then.join(known, ["unit_id", "id"], "left_anti"), "story-rooted")
        known = written(known.union(new), "story-rooted")
    return open_.join(known, ["unit_id", "id"], "left_anti").withColumn("__circle", F.lit(True))
