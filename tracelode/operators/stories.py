"""The story view: a few boxes that people read, with all other events folded into them.

``events`` is (id, pos, session_id, at, kind, status, actor, delegated_by,
tool_based), ``edges`` (from_id, to_id, relation, active, origin).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import written
from . import ordered
from .graph import connected

#: Kinds that a story is read by, and relations that tell a cause.
INTENT = ("question", "goal", "proposal", "decision", "revision")
CAUSES = ("motivates", "revises", "answers", "produces")


def boxes(events: DataFrame, edges: DataFrame) -> DataFrame:
    """id of the events that are boxes: the person's, intentions, stated findings, and observed failures that lead nowhere and that no passing check outweighs."""
    active = edges.where("active")
    causes = active.where(F.col("relation").isin(*CAUSES)).select(F.col("from_id").alias("id")).distinct()
    checks = active.where("relation = 'verifies'").select("from_id", "to_id")
    passed = checks.join(events.where("status = 'observed_success'").select(F.col("id").alias("to_id")), "to_id").select("from_id").distinct()
    outweighed = checks.join(passed, "from_id").select(F.col("to_id").alias("id")).distinct()
    own = F.col("delegated_by").isNull()
    plain = events.where((F.col("actor") == "user") | (own & F.col("kind").isin(*INTENT)) | (own & (F.col("kind") == "outcome") & ~F.col("tool_based"))).select("id")
    failures = events.where("kind = 'outcome' AND status = 'observed_failure'").select("id").join(causes, "id", "left_anti").join(outweighed, "id", "left_anti")
    return plain.union(failures).distinct()


def _order() -> list[str]:
    return ["at", "pos"]


def homes(events: DataFrame, edges: DataFrame, most_rounds: int = 30) -> DataFrame:
    """(id, box): the box of every event.

    A box is its own. Others go, in this order, to the box of their delegation,
    to the earliest box an edge leads from, to the earliest box an edge leads
    to, to the latest box before them in their session, to the session's first.
    What has none of these joins what it is connected with, and a group
    without any box gathers in its last event.
    """
    box = written(boxes(events, edges), "story-boxes").withColumn("is_box", F.lit(True))
    marked = events.join(box, "id", "left").fillna(False, ["is_box"])
    order = F.struct("at", "pos")
    told = edges.where("active").where(~F.coalesce(F.col("origin").isin("dialog_turn", "delegation"), F.lit(False)))
    ends = marked.where("is_box").select(F.col("id").alias("__box"), order.alias("__order"))
    source = told.join(ends, F.col("from_id") == F.col("__box")).groupBy(F.col("to_id").alias("id")).agg(F.min_by("__box", "__order").alias("by_source"))
    target = told.join(ends, F.col("to_id") == F.col("__box")).groupBy(F.col("from_id").alias("id")).agg(F.min_by("__box", "__order").alias("by_target"))
    block = ordered.block_of(F.unix_micros(F.col("at").cast("timestamp")) / 1e6, 86_400)
    near = ordered.last_before(marked, ["session_id"], _order(), F.when(F.col("is_box"), F.col("id")), "by_time", block)
    first = marked.where("is_box").groupBy("session_id").agg(F.min_by("id", order).alias("by_session"))
    found = near.join(source, "id", "left").join(target, "id", "left").join(first, "session_id", "left")
    own = F.when(F.col("is_box"), F.col("id")).otherwise(F.coalesce("by_source", "by_target", "by_time", "by_session"))
    state = written(found.select("id", "is_box", "delegated_by", own.alias("box")), "story-homes")
    # A delegated event goes where its delegation goes, however deep: only those below a delegated one go round again.
    moves = F.col("delegated_by").isNotNull() & ~F.col("is_box")
    above = state.select(F.col("id").alias("__by"), F.col("box").alias("__box"), moves.alias("__moves"))
    led = written(state.where(moves).join(above, F.col("delegated_by") == F.col("__by"), "left").select("id", "delegated_by", F.coalesce("__box", "box").alias("box"), F.coalesce("__moves", F.lit(False)).alias("deep")), "story-led")
    settled, deep = led.where("NOT deep").select("id", "box"), led.where("deep").select("id", "delegated_by", "box")
    ends = written(settled.join(deep.select(F.col("delegated_by").alias("id")).distinct(), "id", "left_semi"), "story-ends")
    for _ in range(most_rounds):
        onward = ends.union(deep.select("id", "box")).select(F.col("id").alias("__by"), F.col("box").alias("__box"))
        then = written(deep.join(onward, F.col("delegated_by") == F.col("__by"), "left").select("id", "delegated_by", F.coalesce("__box", "box").alias("box"), (~F.coalesce("__box", "box").eqNullSafe(F.col("box"))).alias("moved")), "story-deep")
        deep = then.select("id", "delegated_by", "box")
        if then.where("moved").isEmpty():
            break
    state = state.where(~moves).select("id", "box").union(settled).union(deep.select("id", "box"))
    lost = state.where("box IS NULL").select("id")
    links = edges.where("active").select("from_id", "to_id").join(lost.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(lost.withColumnRenamed("id", "to_id"), "to_id", "left_semi")
    same = events.join(lost, "id").groupBy("session_id").agg(F.min("id").alias("to_id"))
    links = links.union(events.join(lost, "id").join(same, "session_id").select(F.col("id").alias("from_id"), "to_id"))
    groups = connected(links)
    last = groups.join(events.select("id", "at", "pos"), "id").groupBy("flow").agg(F.max_by("id", order).alias("gathered"))
    gathered = groups.join(last, "flow").select("id", "gathered")
    return state.join(gathered, "id", "left").select("id", F.coalesce("box", "gathered", "id").alias("box"))


def story(events: DataFrame, edges: DataFrame) -> DataFrame:
    """(box, n_events, n_failed, n_passed, n_agents): each box with what is folded into it."""
    # Both are read many times below: what they are made of is shuffled once.
    events, edges = written(events, "story-events"), written(edges, "story-edges")
    home = written(homes(events, edges), "story")
    count = lambda c: F.count_if(c)
    inside = events.join(home, "id")
    return inside.groupBy("box").agg(F.count("*").alias("n_events"), count(F.col("status") == "observed_failure").alias("n_failed"), count(F.col("status") == "observed_success").alias("n_passed"), count(F.col("delegated_by").isNotNull()).alias("n_agents"))


def story_edges(home: DataFrame, edges: DataFrame) -> DataFrame:
    """Active relations between different boxes, each (from_box, to_box, relation) once, with how many edges it stands for."""
    a, b = (home.select(F.col("id").alias(f"{side}_id"), F.col("box").alias(f"{side}_box")) for side in ("from", "to"))
    return edges.where("active").join(a, "from_id").join(b, "to_id").where("from_box <> to_box").groupBy("from_box", "to_box", "relation").agg(F.count("*").alias("n"))


def is_detail(step: Column, delegated_by: Column) -> Column:
    """Whether an event is a detail beside the main line: a check, a document edit, or a sub-agent's work."""
    return F.coalesce(step.isin("check", "doc"), F.lit(False)) | delegated_by.isNotNull()
