"""How events hang from the messages they were made under, and what a publish derives from the rest of the graph.

``requests`` are the messages that start a turn: (source_id, session_id, pos,
at, event_id), event_id null where the message has no event.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ordered
from .graph import retired


def _as_of(rows: DataFrame, requests: DataFrame, session: str, order: str, name: str) -> DataFrame:
    """``rows`` with ``name``: the last request of the row's ``session`` with ``order`` up to the row's."""
    known = requests.select("session_id", order, F.col("source_id").cast("string").alias("source_id"), F.col("event_id").cast("string").alias("event_id"))
    timed = dict(rows.dtypes)[order].startswith("timestamp")
    block = ordered.block_of(F.unix_micros(F.col("__o").cast("timestamp")) / 1e6, 86_400) if timed else ordered.block_of(F.col("__o"))
    return ordered.as_of(rows, known, session, "session_id", order, order, ["source_id", "event_id"], name, block)


def turn_links(events: DataFrame, requests: DataFrame, parents: DataFrame) -> DataFrame:
    """(id, request_id, request_event, way) of events (id, session_id, pos, at): the session's last request at or before the event's first record (``session``); for a session without one before it, the parent session's last request at or before its time (``parent``).

    ``parents`` is (session_id, parent_session_id). Events without any request
    have nulls.
    """
    own = _as_of(events.select("id", "session_id", "pos", "at"), requests, "session_id", "pos", "__own")
    open_ = own.where("__own IS NULL AND at IS NOT NULL").join(parents, "session_id").select("id", "parent_session_id", "at")
    above = _as_of(open_, requests.where("at IS NOT NULL"), "parent_session_id", "at", "__above").select("id", "__above")
    found = own.join(above, "id", "left")
    chosen = F.coalesce("__own", "__above")
    way = F.when(F.col("__own").isNotNull(), "session").when(F.col("__above").isNotNull(), "parent")
    return found.select("id", chosen["source_id"].alias("request_id"), chosen["event_id"].alias("request_event"), way.alias("way"))


def request_events(prompts: DataFrame, cited: DataFrame) -> DataFrame:
    """New events (id, session_id, title, source_id) for the prompts (source_id, session_id, content) that no event of the person cites."""
    from ..functions.text import content_id, one_line

    missing = prompts.join(cited.select("source_id").distinct(), "source_id", "left_anti")
    return missing.select(content_id("ev_", F.lit("user_request"), F.col("source_id").cast("string")).alias("id"), "session_id", one_line(F.col("content"), 240).alias("title"), "source_id")


def hang_new(events: DataFrame, edges: DataFrame, links: DataFrame) -> DataFrame:
    """Structural edges (from_id, to_id) of new events (id, actor) that no active edge reaches, from the event of their turn's request; none from an event to itself, none for a person's own events."""
    free = events.where("actor IS NULL OR actor <> 'user'").select("id").join(edges.where("active").select(F.col("to_id").alias("id")).distinct(), "id", "left_anti")
    linked = free.join(links.where("request_event IS NOT NULL").select("id", "request_event"), "id")
    return linked.where(F.col("request_event") != F.col("id").cast("string")).select(F.col("request_event").alias("from_id"), F.col("id").cast("string").alias("to_id"))


def rehung(events: DataFrame, edges: DataFrame, links: DataFrame) -> DataFrame:
    """Edges (id, active, replaced_by, change) that change when events that hang only from retired ones hang again from their turn's request.

    ``events`` is (id, status, invalidated), ``edges`` (id, from_id, to_id,
    active, origin), ``links`` (id, request_event) by today's rules. The old
    link is closed and names the new one where there is one (``closed``); the
    new one is added (``added``).
    """
    set_aside = events.where(retired(F.col("status"), F.col("invalidated"))).select(F.col("id").alias("from_id"), F.lit(True).alias("__gone"))
    active = edges.where("active").join(set_aside, "from_id", "left")
    loose = active.groupBy("to_id").agg(F.bool_and((F.col("origin") == "dialog_turn") & F.coalesce("__gone", F.lit(False))).alias("__loose")).where("__loose").select("to_id")
    loose = loose.join(set_aside.select(F.col("from_id").alias("to_id")), "to_id", "left_anti")
    target = links.where("request_event IS NOT NULL").select(F.col("id").alias("to_id"), F.col("request_event").alias("__new"))
    key = F.when(F.col("__new").isNotNull(), F.concat_ws(":", F.lit("turn"), F.col("__new").cast("string"), F.col("to_id").cast("string")))
    moved = loose.join(target, "to_id", "left").withColumn("replaced_by", key)
    closed = active.join(moved, "to_id").select(F.col("id").cast("string").alias("id"), F.lit(False).alias("active"), "replaced_by", F.lit("closed").alias("change"))
    added = moved.where("replaced_by IS NOT NULL").select(F.col("replaced_by").alias("id"), F.lit(True), F.lit(None).cast("string"), F.lit("added"))
    return closed.union(added)


def derived(events: DataFrame, records: DataFrame, edges: DataFrame) -> DataFrame:
    """What a publish derives for each event (id, kind, evidence: array of source_id), in order: who made it, its step, its fork, its caller and the report it folds into.

    ``records`` is (source_id, session_id, provider, hint, fork_of, parent_call);
    ``edges`` (from_id, to_id, relation, active). authoring is the sorted list
    of providers; step is the only hint of all cited records, else null;
    folded_into is the one event that an active ``reports`` edge leads to.
    """
    cited = events.select("id", F.explode_outer("evidence").alias("source_id")).join(records, "source_id", "left")
    rolled = cited.groupBy("id").agg(F.array_join(F.sort_array(F.collect_set("provider")), ",").alias("authoring"), F.when((F.count_distinct("hint") == 1) & (F.count("hint") == F.count("*")), F.min("hint")).alias("step"), F.min("fork_of").alias("fork_of"), F.min("parent_call").alias("delegated_by"))
    folds = edges.where("active AND relation = 'reports'").groupBy(F.col("from_id").alias("id")).agg(F.min("to_id").alias("__to"), F.count_distinct("to_id").alias("__n"))
    return events.select("id").join(rolled, "id").join(folds, "id", "left").select("id", "authoring", "step", "fork_of", "delegated_by", F.when(F.col("__n") == 1, F.col("__to")).alias("folded_into"))


def resolved_references(references: DataFrame, now: DataFrame, versions: DataFrame, current: int) -> DataFrame:
    """(ref, state, event_id, changes) of references ``prefix`` or ``prefix@vN``: current, changed, gone, ambiguous, or unknown.

    ``now`` and ``versions`` (with version) have id, title, status. The ids
    that a prefix may mean meet it by their first PREFIX signs, so no prefix
    is held against all ids; shorter prefixes are unknown.
    """
    prefix = F.regexp_extract("ref", r"^(?:\w+:)?(\w+?)(?:@v(\d+))?$", 1)
    version = F.regexp_extract("ref", r"@v(\d+)$", 1)
    asked = references.select("ref", prefix.alias("prefix"), F.when(version != "", version.cast("int")).alias("version")).withColumn("__k", F.substring("prefix", 1, PREFIX))
    key = F.substring("id", 1, PREFIX).alias("__k")
    ids = now.select("id", F.col("title").alias("__title"), F.col("status").alias("__status"), key)
    found = asked.join(ids, "__k").where(F.col("id").startswith(F.col("prefix"))).groupBy("ref").agg(F.count("*").alias("n_now"), F.min("id").alias("event_id"), F.min(F.struct("id", "__title", "__status")).alias("n"))
    old = versions.select("version", "id", "title", "status", key)
    was = asked.where((F.col("version") != current) & F.col("version").between(1, current)).join(old, ["__k", "version"]).where(F.col("id").startswith(F.col("prefix"))).groupBy("ref").agg(F.count("*").alias("n_old"), F.min(F.struct("id", "title", "status")).alias("o"))
    joined = asked.join(found, "ref", "left").join(was, "ref", "left")
    one_old = F.coalesce(F.col("n_old") == 1, F.lit(False))
    changes = F.when(one_old & (F.col("n_now") == 1), F.concat_ws(",", F.when(~F.col("n.__title").eqNullSafe(F.col("o.title")), F.lit("title")), F.when(~F.col("n.__status").eqNullSafe(F.col("o.status")), F.lit("status"))))
    state = F.when(F.col("n_now") > 1, "ambiguous").when(F.col("n_now").isNull() & one_old, "gone").when(F.col("n_now").isNull(), "unknown").when(changes != "", "changed").otherwise("current")
    return joined.select("ref", state.alias("state"), F.when(state.isin("current", "changed"), F.col("event_id")).when(state == "gone", F.col("o.id")).alias("event_id"), F.coalesce(changes, F.lit("")).alias("changes"))


#: Signs of an id that a reference gives at least.
PREFIX = 6


def called_sessions(sessions: DataFrame, texts: DataFrame, shape: str) -> DataFrame:
    """(session_id, parent_session_id, parent_record): unattended sessions whose id stands in another session's tool text; the earliest such record counts.

    Ids have the pattern ``shape``; all strings of that pattern are taken from
    ``texts`` (source_id, session_id, pos, content) and meet the ids by
    equality. A caller that is unattended itself only counts once its own
    caller is found, so the join is repeated until nothing is added.
    """
    from ..sources.store import written

    words = texts.select("source_id", F.col("session_id").alias("caller"), "pos", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(shape), F.lit(0)))).alias("session_id"))
    open_ = sessions.select("session_id").distinct()
    hits = written(words.join(open_, "session_id").where("caller <> session_id"), "called-hits")
    known = hits.select("session_id", F.lit(None).cast("string").alias("parent_session_id"), F.lit(None).cast("string").alias("parent_record")).limit(0)
    while True:
        left = open_.join(known.select("session_id"), "session_id", "left_anti")
        ready = hits.join(left.select("session_id"), "session_id", "left_semi").join(left.select(F.col("session_id").alias("caller")), "caller", "left_anti")
        first = ready.groupBy("session_id").agg(F.min_by(F.struct("caller", "source_id"), F.struct("pos", "source_id")).alias("x"))
        new = written(first.select("session_id", F.col("x.caller").cast("string").alias("parent_session_id"), F.col("x.source_id").cast("string").alias("parent_record")), "called-sessions")
        if new.isEmpty():
            return known
        known = known.union(new)


def family(sessions: DataFrame, wanted: str) -> DataFrame:
    """session_id of the one session that ``wanted`` names, whole or by an unambiguous prefix, and of all it started, at any depth; none for an unknown or ambiguous name.

    ``sessions`` is (session_id, parent_session_id), a forest. A recursive
    query: a level costs a join with the last level's rows.
    """
    from ..sources.store import written

    named = sessions.where(F.col("session_id").cast("string").startswith(wanted)).select("session_id").distinct()
    exact = named.where(F.col("session_id").cast("string") == wanted)
    start = exact if not exact.isEmpty() else named.where(F.lit(named.limit(2).count() == 1))
    level = whole = written(start, "family")
    while not level.isEmpty():
        below = sessions.join(level.select(F.col("session_id").alias("parent_session_id")), "parent_session_id", "left_semi").select("session_id").distinct()
        level = written(below.join(whole, "session_id", "left_anti"), "family")
        whole = whole.union(level)
    return whole


def family_recency(sessions: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, last_at, n_sessions): latest record time of each family; ``roots`` is (session_id, root), sessions without a row are their own root."""
    joined = sessions.join(roots, "session_id", "left").withColumn("root", F.coalesce("root", "session_id"))
    return joined.groupBy("root").agg(F.max("at").alias("last_at"), F.count_distinct("session_id").alias("n_sessions"))


def audit_problems(delta: dict[str, DataFrame], open_items: DataFrame) -> DataFrame:
    """(problem, n): what an audit may not do; an audit adds only.

    ``delta`` has updates, invalidations, resolutions and items, each with id.
    """
    closed = [delta[k].select(F.lit(f"{k} must be empty").alias("problem")) for k in ("updates", "invalidations", "resolutions")]
    known = delta["items"].join(open_items.select("id").distinct(), "id", "left_semi").select(F.lit("items may only add").alias("problem"))
    rows = closed[0].union(closed[1]).union(closed[2]).union(known)
    return rows.groupBy("problem").agg(F.count("*").alias("n"))


def settled_duplicates(resolutions: DataFrame, added: DataFrame) -> DataFrame:
    """``resolutions`` (candidate_id, kind, disposition, targets) in which a duplicate or update of items that the same delta adds is ``added``; only where all its targets are such items of its kind."""
    each = resolutions.where("disposition IN ('duplicate', 'updated')").select("candidate_id", "kind", F.explode("targets").alias("id"))
    own = each.join(added.select("kind", "id").distinct().withColumn("__new", F.lit(True)), ["kind", "id"], "left").groupBy("candidate_id").agg(F.bool_and(F.coalesce("__new", F.lit(False))).alias("__all"))
    joined = resolutions.join(own, "candidate_id", "left")
    return joined.select(*[F.when(F.coalesce("__all", F.lit(False)), F.lit("added")).otherwise(F.col("disposition")).alias("disposition") if c == "disposition" else c for c in resolutions.columns])


def unchecked_documents(verifies: DataFrame, files: DataFrame, runs: DataFrame) -> DataFrame:
    """edge_id of ``verifies`` (edge_id, change_id, outcome_id) that tie a documentation-only change to runs that never name its files.

    ``files`` is (change_id, file), ``runs`` (outcome_id, command). Changes
    without files, and outcomes without runs, keep their edge.
    """
    docs = files.groupBy("change_id").agg(F.collect_set("file").alias("files"), F.bool_and(F.lower("file").rlike(r"\.(?:md|rst|txt|adoc)$")).alias("__docs")).where("__docs")
    named = lambda command: F.exists("files", lambda f: command.contains(f) | command.contains(F.element_at(F.split(f, "/"), -1)))
    seen = verifies.join(docs, "change_id").join(runs, "outcome_id").groupBy("edge_id").agg(F.bool_or(named(F.col("command"))).alias("__named"))
    return seen.where("NOT __named").select("edge_id")


def latest_notes(events: DataFrame, cited: DataFrame, most: int = 40) -> DataFrame:
    """(id, pos, n_left_out): the latest ``most`` notes (id, pos, origin) that cite any wanted record, oldest first, and how many are left out."""
    notes = events.where("origin = 'note'").join(cited.select("id").distinct(), "id", "left_semi").select("id", "pos")
    top = notes.orderBy(F.desc("pos"), F.desc("id")).limit(most)
    n = notes.agg(F.count("*").alias("n")).select(F.greatest(F.col("n") - most, F.lit(0)).cast("bigint").alias("n_left_out"))
    return top.crossJoin(F.broadcast(n)).orderBy("pos", "id")


def next_flagged(events: DataFrame, here: int) -> Column:
    """The row (pos, id) of the next flagged event after ``here``, else the first one: to be used in an aggregation over flagged events."""
    after = F.min(F.when(F.col("pos") > here, F.struct("pos", "id")))
    return F.coalesce(after, F.min(F.struct("pos", "id")))


def event_rows(events: DataFrame, labels: DataFrame, out_of_order: DataFrame) -> DataFrame:
    """The listing row of each event (id, short, occurred_at, recorded_at, kind, step, status, title): when, label, and whether it stands out of order."""
    odd = out_of_order.select("id").distinct().withColumn("__odd", F.lit(True))
    joined = events.join(labels.select("id", "label"), "id", "left").join(odd, "id", "left")
    return joined.select("id", "short", F.coalesce("occurred_at", "recorded_at").alias("when"), "kind", "step", "status", "label", "title", F.coalesce("__odd", F.lit(False)).alias("out_of_order"))


def sequence_by(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``rows`` with place: their number within ``key``."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("bigint"))
