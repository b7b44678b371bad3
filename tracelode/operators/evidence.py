"""Evidence: which records events cite, what is covered, what is missing, and what follows from it.

``citations`` is (event_id, source_id), one row for each; ``records`` has
source_id and what an operator names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import written
from . import ordered


def originals(citations: DataFrame, records: DataFrame) -> DataFrame:
    """(event_id, source_id, state) of citations (with content_hash): available, changed or missing, by the records now (source_id, content_hash, available)."""
    now = records.select("source_id", F.col("content_hash").alias("__now"), "available")
    state = F.when(F.col("__now").isNull() | ~F.coalesce("available", F.lit(False)), "missing").when(F.col("__now") != F.col("content_hash"), "changed").otherwise("available")
    return citations.join(now, "source_id", "left").select("event_id", "source_id", state.alias("state"))


def uncovered(records: DataFrame, citations: DataFrame) -> DataFrame:
    """``records`` that no event cites."""
    return records.join(citations.select("source_id").distinct(), "source_id", "left_anti")


def uncovered_edits(calls: DataFrame, results: DataFrame, citations: DataFrame) -> DataFrame:
    """source_id of edit calls (source_id, call_id) of which neither the call nor any result (source_id, call_id) is cited."""
    cited = citations.select("source_id").distinct()
    by_result = results.join(cited, "source_id", "left_semi").select("call_id").distinct()
    return calls.join(cited, "source_id", "left_anti").join(by_result, "call_id", "left_anti").select("source_id")


def new_records(found: DataFrame, stored: DataFrame, noted: DataFrame) -> DataFrame:
    """(provider, n, newest): records not stored with their hash, and not in a noted session, by provider."""
    fresh = found.join(stored.select("source_id", "content_hash"), ["source_id", "content_hash"], "left_anti").join(noted.select("session_id").distinct(), "session_id", "left_anti")
    return fresh.groupBy("provider").agg(F.count("*").alias("n"), F.max("recorded_at").alias("newest"))


def merged_tallies(*parts: DataFrame) -> DataFrame:
    """Tallies (provider, n, newest) of several reads as one."""
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    return every.groupBy("provider").agg(F.sum("n").alias("n"), F.max("newest").alias("newest"))


def overlap_matches(candidates: DataFrame, notes: DataFrame, edits: DataFrame | None = None) -> DataFrame:
    """(event_id, note_id): candidates (event_id, kind, source_id) that share a cited record with exactly one note of their kind (note_id, kind, source_id), and cite no edit (source_id) that this note does not cite.

    The notes of a record are summed before the join, so a record that very
    many notes cite is one row.
    """
    by_record = notes.groupBy("kind", "source_id").agg(F.min("note_id").alias("__first"), F.max("note_id").alias("__last"))
    shared = candidates.join(by_record, ["kind", "source_id"]).groupBy("event_id").agg(F.min("__first").alias("note_id"), F.max("__last").alias("__last"))
    one = shared.where(F.col("note_id") == F.col("__last")).select("event_id", "note_id")
    if edits is None:
        return one
    cited = candidates.join(edits.select("source_id").distinct(), "source_id", "left_semi").select("event_id", "source_id").join(one, "event_id")
    loose = cited.join(notes.select("note_id", "source_id").distinct(), ["note_id", "source_id"], "left_anti").select("event_id").distinct()
    return one.join(loose, "event_id", "left_anti")


def folded_reports(citations: DataFrame, calls: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(event_id, folded_into): events all of whose sources belong to one delegation's call or result (source_id, agent), and the agent's last outcome (id, agent, at)."""
    marked = citations.join(calls.select("source_id", "agent"), "source_id", "left").groupBy("event_id").agg(F.count("*").alias("n"), F.count("agent").alias("of_agents"), F.min("agent").alias("agent"), F.max("agent").alias("__other"))
    reports = marked.where((F.col("n") == F.col("of_agents")) & (F.col("agent") == F.col("__other")))
    last = outcomes.groupBy("agent").agg(F.max_by("id", F.struct("at", "id")).alias("folded_into"))
    return reports.join(last, "agent").where("event_id <> folded_into").select("event_id", "folded_into")


def fork_links(forks: DataFrame, requests: DataFrame) -> DataFrame:
    """(from_id, to_id): the parent's last request up to the fork's point and the fork's first request.

    ``forks`` is (session_id, parent_id, point_at), ``requests`` (id, session_id, at).
    """
    first = requests.groupBy("session_id").agg(F.min_by("id", F.struct("at", "id")).alias("to_id"))
    block = ordered.block_of(F.unix_micros(F.col("__o").cast("timestamp")) / 1e6, 86_400)
    before = ordered.as_of(forks.select("session_id", "parent_id", "point_at"), requests, "parent_id", "session_id", "point_at", "at", ["id"], "__before", block)
    return before.where("__before IS NOT NULL").join(first, "session_id").select(F.col("__before.id").alias("from_id"), "to_id")


def verified_links(launches: DataFrame, calls: DataFrame, results: DataFrame) -> DataFrame:
    """agent and call_id of sub-agents (agent, call_id) whose call and whose launch result both exist and name the same call."""
    return launches.join(calls.select("call_id").distinct(), "call_id").join(results.select("agent", "call_id").distinct(), ["agent", "call_id"]).select("agent", "call_id")


def accounted(records: DataFrame, noted: DataFrame, tails: DataFrame) -> DataFrame:
    """``records`` (session_id, parent_id, at) with in_notes: whether notes account for them.

    The owner is the session if it is noted, else its parent; noted sessions
    (session_id, since) account for records from ``since`` on (all where it is
    null, and all without a time), but not for those inside the quiet tail
    (session_id, tail_start, tail_end], which is half-open.
    """
    own = noted.select(F.col("session_id").alias("__own"), F.col("since").alias("__own_since"), F.lit(True).alias("__is_own"))
    up = noted.select(F.col("session_id").alias("__up"), F.col("since").alias("__up_since"), F.lit(True).alias("__is_up"))
    joined = records.join(own, F.col("session_id") == F.col("__own"), "left").join(up, F.col("parent_id") == F.col("__up"), "left")
    owner = F.when(F.col("__is_own"), F.col("session_id")).when(F.col("__is_up"), F.col("parent_id"))
    since = F.when(F.col("__is_own"), F.col("__own_since")).otherwise(F.col("__up_since"))
    quiet = tails.select(F.col("session_id").alias("__owner"), "tail_start", "tail_end")
    joined = joined.withColumn("__o", owner).withColumn("__since", since).join(quiet, F.col("__o") == F.col("__owner"), "left")
    inside = F.coalesce((F.col("at") > F.col("tail_start")) & (F.col("at") <= F.col("tail_end")), F.lit(False))
    known = F.col("__o").isNotNull() & ~inside & (F.col("__since").isNull() | F.col("at").isNull() | (F.col("at") >= F.col("__since")))
    return joined.select(*records.columns, known.alias("in_notes"))


def authoring(citations: DataFrame, records: DataFrame) -> DataFrame:
    """(event_id, agents): the different (model, effort) of the records each event cites, sorted."""
    used = citations.join(records.select("source_id", "model", "effort").where("model IS NOT NULL"), "source_id")
    return used.groupBy("event_id").agg(F.sort_array(F.collect_set(F.struct("model", "effort"))).alias("agents"))


def step_of_events(citations: DataFrame, steps: DataFrame) -> DataFrame:
    """(event_id, step): check, delegate or doc where all tool steps (source_id, hint, doc) that an event cites are; else null."""
    used = citations.join(steps.select("source_id", "hint", "doc"), "source_id")
    all_of = lambda c: F.bool_and(F.coalesce(c, F.lit(False)))
    return used.groupBy("event_id").agg(F.when(all_of(F.col("hint") == "test"), "check").when(all_of(F.col("hint") == "delegate"), "delegate").when(all_of((F.col("hint") == "edit") & F.col("doc")), "doc").alias("step"))


def style(events: DataFrame, citations: DataFrame, steps: DataFrame, limit: int = 72) -> DataFrame:
    """One row: events, mean_title, over_limit, and only_reads (events all of whose citations are read steps)."""
    reads = citations.join(steps.select("source_id", "hint"), "source_id", "left").groupBy(F.col("event_id").alias("id")).agg(F.bool_and(F.coalesce(F.col("hint") == "read", F.lit(False))).alias("__reads"))
    return events.join(reads, "id", "left").agg(F.count("*").alias("events"), F.bround(F.avg(F.length("title")), 4).alias("mean_title"), F.count_if(F.length("title") > limit).alias("over_limit"), F.count_if("__reads").alias("only_reads"))


def error_kinds(messages: DataFrame, message: str) -> DataFrame:
    """(kind, n): heads of the parts of "; "-joined messages that are a few plain words."""
    part = messages.select(F.explode(F.split(F.col(message), "; ")).alias("part"))
    head = F.trim(F.substring_index("part", ":", 1))
    return part.select(head.alias("kind")).where(F.col("kind").rlike(r"^[A-Za-z][A-Za-z ]{2,60}$")).groupBy("kind").agg(F.count("*").alias("n"))


def first_seen(nested: DataFrame, key: str, ids: str, pos: str) -> DataFrame:
    """(id, key, pos): the first row, by ``pos``, that holds each id of an array column."""
    each = nested.select(F.explode(ids).alias("id"), F.col(key), F.col(pos))
    return each.groupBy("id").agg(F.min_by(key, F.struct(pos, key)).alias(key), F.min(pos).alias(pos))


def newest_version(names: DataFrame, family: str, slug: str) -> DataFrame:
    """(family, slug) with the highest version, its numbers compared one by one; names without a number are no versions."""
    numbers = F.transform(F.regexp_extract_all(F.col(slug), F.lit(r"(\d+)"), F.lit(1)), lambda x: x.cast("int"))
    return names.where(F.size(numbers) > 0).groupBy(family).agg(F.max_by(slug, F.struct(numbers, F.col(slug))).alias(slug))


def sum_maps(rows: DataFrame, by: str, column: str) -> DataFrame:
    """(by, name, total): sums of a map column's values by key."""
    return rows.select(by, F.explode(column).alias("name", "value")).groupBy(by, "name").agg(F.sum("value").alias("total"))


def numeric_fields(rows: DataFrame, key: str, text: str, fields: list[str]) -> DataFrame:
    """``key`` and the numbers of JSON ``fields``; what is not a number in the JSON, a boolean or a string too, is null."""
    value = F.try_parse_json(F.col(text))
    out = []
    for name in fields:
        kind = F.schema_of_variant(F.try_variant_get(value, f"$.{name}", "variant"))
        out.append(F.when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(value, f"$.{name}", "double")).alias(name))
    return rows.select(key, *out)


def context_ranking(units: DataFrame, events: DataFrame, most: int = 6) -> DataFrame:
    """(unit_id, id, place): the ``most`` events that help a unit most: named paths first, then shared words (8 at most), the same session, another, an unknown one, the newest.

    Paths and words give every unit with the same terms the same score for an
    event, and every event with the same terms the same score for a unit. So
    kinds of units meet kinds of events, one row for each set of terms, and of
    a kind of events only the ``most`` newest, of all and of each session, can
    be among the first: units and events are never paired.
    """
    sides = F.concat(F.transform("paths", lambda x: F.struct(F.lit(True).alias("path"), x.alias("term"))), F.transform("words", lambda x: F.struct(F.lit(False).alias("path"), x.alias("term"))))

    def kinds(df: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        rows = df.withColumn("__terms", F.array_sort(F.filter(sides, lambda t: t["term"].isNotNull()))).where(F.size("__terms") > 0).withColumn(name, F.sha2(F.to_json("__terms"), 256))
        return rows.drop("__terms"), rows.groupBy(name).agg(F.first("__terms").alias("__terms")).select(name, F.explode("__terms").alias("t")).select(name, "t.*")

    def first(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
        return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= most)

    of_units, unit_terms = kinds(units.select("unit_id", F.col("session_id").alias("__s"), "paths", "words"), "__u")
    of_events, event_terms = kinds(events.select("id", "session_id", F.col("pos").alias("__pos"), "paths", "words"), "__e")
    of_units, of_events = of_units.select("unit_id", "__s", "__u"), of_events.select("id", "session_id", F.col("session_id").isNull().alias("__lost"), "__pos", "__e")
    met = unit_terms.join(event_terms, ["path", "term"]).groupBy("__u", "__e").agg((F.count_if("path") > 0).alias("named"), F.least(F.count_if(~F.col("path")), F.lit(8)).alias("words"))
    met = written(met, "met-kinds")
    newest, score = [F.desc("__pos"), F.col("id")], [F.desc("named"), F.desc("words")]
    of_all = first(met.join(first(of_events, ["__e", "__lost"], newest).drop("place"), "__e"), ["__u", "__lost"], score + newest)
    near = first(of_events.where("NOT __lost"), ["__e", "session_id"], newest).drop("place", "__lost")
    own = of_units.join(met, "__u").join(near.withColumnRenamed("session_id", "__s"), ["__e", "__s"]).select("unit_id", "id", "__pos", "named", "words", F.lit(1).alias("__own"))
    others = of_units.join(of_all, "__u").select("unit_id", "id", "__pos", "named", "words", F.coalesce((F.col("__s") == F.col("session_id")).cast("int"), F.lit(-1)).alias("__own"))
    # What is among the first of all and of its own session stands once.
    candidates = others.where("__own < 1").unionByName(own)
    ranked = first(candidates, ["unit_id"], [*score, F.desc("__own"), *newest])
    return ranked.select("unit_id", "id", F.col("place").cast("bigint").alias("place"))


def tails_first(units: DataFrame) -> DataFrame:
    """unit_id with place: units of quiet tails first, each part by its oldest record (unit_id, is_tail, pos)."""
    first = units.groupBy("unit_id").agg(F.bool_or("is_tail").alias("is_tail"), F.min("pos").alias("pos"))
    return first.orderBy(F.desc("is_tail"), "pos", "unit_id").select("unit_id", "is_tail", "pos")


def polls(runs: DataFrame, followers: DataFrame) -> DataFrame:
    """(id, n_polls, exit_id): for each run that went on (id, handle, at) the polls of its handle after it up to the first that tells an exit (id, handle, at, exited).

    Runs and polls stand on one line for each handle: polls are counted along
    it and the next exit is looked up, so no run meets its polls one by one.
    """
    # Polls at the time of a run come before it, so all that stands behind a run is later.
    line = followers.select("handle", "at", F.lit(0).alias("__side"), "id", F.coalesce("exited", F.lit(False)).alias("exited")).unionByName(runs.select("handle", "at", F.lit(1).alias("__side"), "id", F.lit(False).alias("exited"))).where("handle IS NOT NULL AND at IS NOT NULL")
    block, order = ordered.block_of(F.unix_micros(F.col("at").cast("timestamp")) / 1e6, 86_400), ["at", "__side", "id"]
    counted = ordered.running_count(line, ["handle"], order, F.col("__side") == 0, "__n", block)
    ended = ordered.last_before(counted, ["handle"], order, F.when(F.col("exited"), F.struct("id", "__n")), "__end", block, backwards=True)
    total = followers.where("at IS NOT NULL").groupBy("handle").agg(F.count("*").alias("__all"))
    after = F.coalesce("__end.__n", "__all") - F.col("__n")
    return ended.where("__side = 1").join(total, "handle").select("id", after.alias("n_polls"), F.col("__end.id").alias("exit_id")).where("n_polls > 0")


def out_of_order(added: DataFrame, waiting: DataFrame) -> DataFrame:
    """id of added events (id, session_id, at) while older records of their session (session_id, at) still wait."""
    oldest = waiting.groupBy("session_id").agg(F.min("at").alias("__oldest"))
    return added.join(oldest, "session_id").where(F.col("at") > F.col("__oldest")).select("id")


def decide(state: Column, now: Column) -> Column:
    """Why an automatic update does not run now, or ``run``: disabled, self_run, lock, cooldown, daily_cap, failing, nothing_pending, in this order.

    ``state`` is a struct (enabled, self_run, locked, last_start, cooldown_s, runs_today, daily_cap, failures, most_failures, pending).
    """
    since = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(state["last_start"].cast("timestamp"))) / F.lit(1e6)
    reason = F.when(~state["enabled"], "disabled").when(state["self_run"], "self_run").when(state["locked"], "lock").when(since < state["cooldown_s"], "cooldown")
    return reason.when(state["runs_today"] >= state["daily_cap"], "daily_cap").when(state["failures"] >= state["most_failures"], "failing").when(state["pending"] <= 0, "nothing_pending").otherwise("run")


def salvaged(candidates: DataFrame, faults: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates (id) without a fault (id), and the edges (from_id, to_id) whose ends both stay."""
    kept = candidates.join(faults.select("id").distinct(), "id", "left_anti")
    ids = kept.select("id")
    stay = edges.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi")
    return kept, stay


def apply_delta(events: DataFrame, delta: DataFrame) -> DataFrame:
    """``events`` (id, title, status, evidence) after a delta (id, action: add or update, title, status, evidence).

    An update keeps old evidence and adds the new; fields it leaves null stay.
    Adding a known id or updating an unknown one stops the job with its id,
    and nothing is written.
    """
    side = delta.select("id", F.col("action").alias("__action"), *[F.col(c).alias(f"__{c}") for c in ("title", "status", "evidence")])
    joined = events.withColumn("__known", F.lit(True)).join(side, "id", "full_outer")
    wrong = (F.col("__known").isNotNull() & (F.col("__action") == "add")) | (F.col("__known").isNull() & (F.col("__action") == "update"))
    checked = F.when(F.coalesce(wrong, F.lit(False)), F.raise_error(F.concat(F.lit("delta does not fit event "), F.col("id").cast("string")))).otherwise(F.col("id"))
    none = F.array().cast(dict(events.dtypes)["evidence"])
    evidence = F.array_distinct(F.concat(F.coalesce("evidence", none), F.coalesce("__evidence", none)))
    return joined.select(checked.alias("id"), F.coalesce("__title", "title").alias("title"), F.coalesce("__status", "status").alias("status"), evidence.alias("evidence"))
