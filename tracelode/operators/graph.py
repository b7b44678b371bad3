"""The event graph: checks of changes, labels, views, relations and reachability.

``events`` has id, pos, session_id, kind, status, actor, title, at, and
optionally delegated_by, step, folded_into, invalidated; ``edges`` has id,
from_id, to_id, relation, basis, active.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import written
from . import ordered

#: Kinds that change something, statuses of a change, and what a check saw.
CHANGE_KINDS = ("action", "revision")
CHANGE_STATUSES = ("applied", "reported_complete", "observed_success")
OBSERVED = ("observed_success", "observed_failure")
CAUSES = ("motivates", "revises", "answers", "produces")
#: The words shown for a status.
STATUS_WORDS = {"proposed": "proposed", "adopted": "adopted", "in_progress": "in progress", "asked": "asked", "applied": "applied", "reported_complete": "reported done", "observed_success": "passed", "observed_failure": "failed", "withdrawn": "withdrawn", "unknown": "unknown"}


def is_change() -> Column:
    return F.col("kind").isin(*CHANGE_KINDS) & F.col("status").isin(*CHANGE_STATUSES)


def retired(status: Column, invalidated: Column) -> Column:
    """Set aside by code: withdrawn and carrying an invalidation."""
    return (status == "withdrawn") & F.coalesce(invalidated, F.lit(False))


def is_request(actor: Column, kind: Column, status: Column, invalidated: Column) -> Column:
    """A person's message that starts a turn: not a decision, not retired."""
    return (actor == "user") & (kind != "decision") & ~retired(status, invalidated)


def checks_of_changes(events: DataFrame, edges: DataFrame) -> DataFrame:
    """For each event that active ``verifies`` edges leave: id, passed, failed, n_checks and the title of the check with the first edge."""
    verifies = edges.where("active AND relation = 'verifies'").select(F.col("from_id").alias("id"), F.col("to_id"), F.col("id").alias("edge_id"))
    outcomes = events.select(F.col("id").alias("to_id"), F.col("status"), F.col("title"))
    return verifies.join(outcomes, "to_id").groupBy("id").agg(F.count_if(F.col("status") == "observed_success").alias("passed"), F.count_if(F.col("status") == "observed_failure").alias("failed"), F.count("*").alias("n_checks"), F.min_by("title", "edge_id").alias("check_title"))


def unlinked_outcomes(events: DataFrame, edges: DataFrame) -> DataFrame:
    """id of observed outcomes that no active edge reaches."""
    observed = events.where((F.col("kind") == "outcome") & F.col("status").isin(*OBSERVED))
    return observed.join(edges.where("active").select(F.col("to_id").alias("id")), "id", "left_anti").select("id")


def _with_relations(events: DataFrame, edges: DataFrame) -> DataFrame:
    leaving = edges.where("active").groupBy(F.col("from_id").alias("id")).agg(F.bool_or(F.col("relation") == "answers").alias("answered"), F.bool_or(F.col("relation") != "answers").alias("followed"))
    joined = events.join(checks_of_changes(events, edges), "id", "left").join(leaving, "id", "left").join(unlinked_outcomes(events, edges).withColumn("unlinked", F.lit(True)), "id", "left")
    if "delegated_by" in events.columns:
        handed = events.where("delegated_by IS NOT NULL").groupBy(F.col("delegated_by").alias("id")).agg(F.count("*").alias("handed"))
        joined = joined.join(handed, "id", "left")
    else:
        joined = joined.withColumn("handed", F.lit(None).cast("bigint"))
    return joined.fillna(0, ["passed", "failed", "n_checks", "handed"]).fillna(False, ["answered", "followed", "unlinked"])


def _optional(events: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in events.columns else F.lit(None).cast(kind)


def status_labels(events: DataFrame, edges: DataFrame) -> DataFrame:
    """id, label and tone (ok, warn, fail, plain) of every event, from its status and its relations."""
    step, invalid = _optional(events, "step", "string"), _optional(events, "invalidated", "boolean")
    words = F.element_at(F.create_map(*[F.lit(x) for pair in STATUS_WORDS.items() for x in pair]), F.col("status"))
    delegate, asked = F.coalesce(step == "delegate", F.lit(False)), (F.col("kind") == "question") & (F.col("status") == "asked")
    base = F.when(F.col("status") == "reported_complete", "reported done").otherwise("applied")
    short = F.when(F.length("check_title") > 40, F.concat(F.substring("check_title", 1, 39), F.lit("…"))).otherwise(F.col("check_title"))
    lone = F.concat(base, F.lit(" · "), F.when(F.col("passed") > 0, "verified").otherwise("check failed"), F.lit(": "), short)
    counts = F.concat_ws(" · ", F.when(F.col("passed") > 0, F.concat(F.col("passed").cast("string"), F.lit(" checks passed"))), F.when(F.col("failed") > 0, F.concat(F.col("failed").cast("string"), F.lit(" checks failed"))))
    label = F.when(retired(F.col("status"), invalid), "not a request · not the person's request under the current rules")
    label = label.when(delegate, F.concat(F.lit("delegated · "), F.when(F.col("handed") > 0, F.concat(F.col("handed").cast("string"), F.lit(" sub-agent events"))).otherwise("no sub-agent work linked")))
    label = label.when(asked, F.concat(F.lit("request · "), F.when(F.col("answered"), "answered").when(F.col("followed"), "no answer linked").otherwise("nothing linked")))
    label = label.when(is_change(), F.when(F.col("n_checks") == 1, lone).otherwise(F.concat(base, F.lit(" · "), F.when(counts == "", "unverified").otherwise(counts))))
    label = label.when(F.col("unlinked"), F.concat(words, F.lit(" · not linked to what it checked"))).otherwise(words)
    tone = F.when(delegate, "plain").when(asked, F.when(F.col("answered"), "ok").otherwise("plain"))
    tone = tone.when(is_change(), F.when(F.col("failed") > 0, "fail").when(F.col("n_checks") > 0, "ok").otherwise("warn"))
    tone = tone.when(F.col("status") == "observed_failure", "fail").when(F.col("unlinked") | (F.col("status") == "reported_complete"), "warn").when(F.col("status") == "observed_success", "ok").otherwise("plain")
    return _with_relations(events, edges).select("id", label.alias("label"), tone.alias("tone"))


def summary(events: DataFrame, edges: DataFrame) -> DataFrame:
    """(measure, value): how the graph is shaped; counts by kind, status and relation have measures such as ``kind:action``."""
    full = _with_relations(events, edges)
    revised = edges.where("active AND relation = 'revises'").select(F.col("to_id").alias("id")).distinct().withColumn("revised", F.lit(True))
    sums = full.join(revised, "id", "left").agg(
        F.count("*").alias("events"),
        F.count_if(is_change() & (F.col("n_checks") > 0)).alias("changes_verified"),
        F.count_if(is_change() & (F.col("n_checks") == 0)).alias("changes_unverified"),
        F.count_if("unlinked").alias("observed_results_unlinked"),
        F.count_if((F.col("kind") == "revision") & F.col("revised").isNull()).alias("revisions_unlinked"),
        F.count_if((F.col("kind") == "question") & F.col("answered")).alias("questions_answered"),
        F.count_if((F.col("kind") == "question") & ~F.col("answered")).alias("questions_unanswered"),
    )
    names = sums.columns
    tall = sums.select(F.explode(F.array(*[F.struct(F.lit(n).alias("measure"), F.col(n).alias("value")) for n in names])).alias("x")).select("x.*")
    by = lambda df, c: df.groupBy(c).agg(F.count("*").alias("value")).select(F.concat(F.lit(f"{c}:"), F.col(c)).alias("measure"), "value")
    return tall.union(by(events, "kind")).union(by(events, "status")).union(by(edges.where("active"), "relation"))


def oriented(edges: DataFrame, events: DataFrame) -> DataFrame:
    """``edges`` with reversed ``verifies`` and ``answers`` turned, and ``turned``. Edges whose ends are unknown stay as they are."""
    end = lambda side: events.select(F.col("id").alias(f"{side}_id"), F.col("kind").alias(f"__{side}_kind"), F.col("status").alias(f"__{side}_status"))
    joined = edges.join(end("from"), "from_id", "left").join(end("to"), "to_id", "left")
    check = (F.col("relation") == "verifies") & (F.col("__from_kind") == "outcome") & F.col("__from_status").isin(*OBSERVED) & F.col("__to_kind").isin(*CHANGE_KINDS)
    answer = (F.col("relation") == "answers") & (F.col("__to_kind") == "question") & (F.col("__from_kind") != "question")
    turned = joined.withColumn("turned", F.coalesce(check | answer, F.lit(False)))
    swap = lambda a, b: F.when(F.col("turned"), F.col(b)).otherwise(F.col(a))
    return turned.withColumn("__f", swap("from_id", "to_id")).withColumn("__t", swap("to_id", "from_id")).select(*[F.col({"from_id": "__f", "to_id": "__t"}.get(c, c)).alias(c) for c in edges.columns], "turned")


def relation_faults(edges: DataFrame, events: DataFrame) -> DataFrame:
    """(id, fault) of active edges whose ends do not fit their relation."""
    end = lambda side: events.select(F.col("id").alias(f"{side}_id"), F.col("kind").alias(f"{side}_kind"), F.col("status").alias(f"{side}_status"))
    joined = edges.where("active").join(end("from"), "from_id", "left").join(end("to"), "to_id", "left")
    fault = F.when(F.col("from_kind").isNull() | F.col("to_kind").isNull(), "unknown end")
    fault = fault.when((F.col("relation") == "verifies") & ~(F.col("from_kind").isin(*CHANGE_KINDS) & (F.col("to_kind") == "outcome") & F.col("to_status").isin(*OBSERVED)), "verifies must lead from a change to an observed outcome")
    fault = fault.when((F.col("relation") == "verifies") & (F.col("basis") == "inferred"), "verifies must not be inferred")
    fault = fault.when((F.col("relation") == "answers") & ((F.col("from_kind") != "question") | (F.col("to_kind") == "question")), "answers must lead from a question")
    return joined.select("id", fault.alias("fault")).where("fault IS NOT NULL")


def folded_edges(events: DataFrame, edges: DataFrame) -> DataFrame:
    """``edges`` with ends moved to the events their events are folded into; loops and repeated active triples go, the first by id stays."""
    known = events.select("id", "folded_into").where("folded_into IS NOT NULL")
    final = known.join(events.where("folded_into IS NULL").select(F.col("id").alias("folded_into")), "folded_into", "left_semi").select(F.col("id").alias("__id"), F.col("folded_into").alias("__into"))
    moved = edges
    for side in ("from_id", "to_id"):
        moved = moved.join(final, F.col(side) == F.col("__id"), "left").withColumn(side, F.coalesce("__into", side)).drop("__id", "__into")
    moved = moved.where(F.col("from_id") != F.col("to_id"))
    first = F.row_number().over(Window.partitionBy("from_id", "to_id", "relation", "active").orderBy("id")) == 1
    return moved.withColumn("__first", first | ~F.col("active")).where("__first").select(*edges.columns)


def folded_events(events: DataFrame) -> DataFrame:
    """Events in the order they happened, without folded ones, with n_received (reports folded into each) and place."""
    final = events.where("folded_into IS NOT NULL").join(events.where("folded_into IS NULL").select(F.col("id").alias("folded_into")), "folded_into", "left_semi")
    received = final.groupBy(F.col("folded_into").alias("id")).agg(F.count("*").alias("n_received"))
    kept = events.join(final.select("id"), "id", "left_anti").join(received, "id", "left").fillna(0, ["n_received"])
    return kept.select("id", "session_id", "kind", "status", "at", "n_received")


def neighbours(edges: DataFrame) -> DataFrame:
    """id, n_out, n_in, n_checks and n_linked (different other ends) over active edges."""
    active = edges.where("active AND from_id <> to_id")
    both = active.select(F.col("from_id").alias("id"), F.col("to_id").alias("other"), F.lit(1).alias("out"), (F.col("relation") == "verifies").alias("check")).union(active.select("to_id", "from_id", F.lit(0), F.lit(False)))
    return both.groupBy("id").agg(F.sum("out").alias("n_out"), F.count_if(F.col("out") == 0).alias("n_in"), F.count_if("check").alias("n_checks"), F.count_distinct("other").alias("n_linked"))


def connected(edges: DataFrame, a: str = "from_id", b: str = "to_id", most_rounds: int = 50) -> DataFrame:
    """(id, flow): events that edges connect, named by their smallest id.

    Each round every node takes the smallest name among its neighbours and
    that name's own name; rounds grow with the logarithm of the longest path.
    Each round is written to the shared folder, so lineage stays short.
    """
    both = written(edges.select(F.col(a).alias("id"), F.col(b).alias("other")).union(edges.select(b, a)).where("id IS NOT NULL AND other IS NOT NULL").distinct(), "flow-edges")
    now = written(both.groupBy("id").agg(F.least(F.col("id"), F.min("other")).alias("flow")), "flow-names")
    for _ in range(most_rounds):
        seen = both.join(now.select(F.col("id").alias("other"), F.col("flow").alias("theirs")), "other").groupBy("id").agg(F.min("theirs").alias("theirs"))
        nearer = now.join(seen, "id", "left").select("id", F.least("flow", "theirs").alias("flow"))
        jumped = nearer.join(nearer.select(F.col("id").alias("flow"), F.col("flow").alias("further")), "flow", "left").select("id", F.least("flow", "further").alias("flow"))
        then = written(jumped, "flow-names")
        if then.join(now.withColumnRenamed("flow", "before"), "id").where("flow <> before").isEmpty():
            return then
        now = then
    raise RuntimeError(f"flows did not settle in {most_rounds} rounds")


def descendants(children: DataFrame, roots: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(root, id, depth): everything below each root in a forest of (parent, id); self links are left out."""
    links = children.where("parent IS NOT NULL AND parent <> id").select("parent", "id")
    found = level = written(roots.select(F.col("id").alias("root"), "id", F.lit(0).alias("depth")), "descendants")
    for depth in range(1, most_rounds + 1):
        level = written(level.select("root", F.col("id").alias("parent")).join(links, "parent").select("root", "id", F.lit(depth).alias("depth")), "descendants")
        if level.isEmpty():
            return found
        found = found.union(level)
    raise RuntimeError(f"more than {most_rounds} levels")


def short_ids(events: DataFrame, least: int = 8) -> DataFrame:
    """id and the shortest prefix of at least ``least`` signs after its first underscore that no other id shares.

    Only the neighbours in sorted order can share the longest prefix. Ids are
    dealt by their first signs, as many as ``least``: ids that differ there
    need no longer prefix.
    """
    split = events.select("id", F.substring_index("id", "_", 1).alias("head"), F.substring_index("id", "_", -1).alias("tail")).distinct()
    order = Window.partitionBy("head", F.substring("tail", 1, least)).orderBy("tail")
    size = lambda a, b: F.length(F.regexp_extract(F.concat(a, F.lit("\n"), b), r"^(.*).*\n\1", 1))
    near = split.withColumn("__b", F.lag("tail").over(order)).withColumn("__a", F.lead("tail").over(order))
    longest = F.greatest(F.coalesce(size(F.col("tail"), F.col("__b")), F.lit(0)), F.coalesce(size(F.col("tail"), F.col("__a")), F.lit(0)))
    n = F.least(F.length("tail"), F.greatest(F.lit(least), longest + 1))
    return near.select("id", F.concat("head", F.lit("_"), F.substring(F.col("tail"), F.lit(1), n)).alias("short_id"))


def delegated(events: DataFrame, calls: DataFrame) -> DataFrame:
    """(id, delegated_by): for each sub-agent event (id, key, at) the latest delegation (call_id, key, at) up to it, else the first."""
    block = ordered.block_of(F.unix_micros(F.col("__o").cast("timestamp")) / 1e6, 86_400)
    before = ordered.as_of(events.select("id", "key", "at"), calls, "key", "key", "at", "at", ["call_id"], "__before", block)
    first = calls.groupBy("key").agg(F.min_by("call_id", F.struct("at", "call_id")).alias("__first"))
    return before.join(first, "key").select("id", F.coalesce("__before.call_id", "__first").alias("delegated_by"))
