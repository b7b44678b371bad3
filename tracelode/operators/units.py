"""Work units and what is kept between runs: manifests, unit and call tables, slices, exports and comparisons of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import written
from . import ordered
from .texts import quote_places


def chosen_providers(rows: DataFrame, text: str, known: tuple[str, ...], column: str = "provider") -> DataFrame:
    """Rows of the providers that ``text`` lists (``a,b``); all known ones for an empty list. An unknown name is an error. On a table partitioned by provider the other partitions are not read."""
    names = [x.strip() for x in text.split(",") if x.strip()] or list(known)
    if unknown := sorted(set(names) - set(known)):
        raise ValueError(f"unknown providers: {', '.join(unknown)}")
    return rows.where(F.col(column).isin(*names))


def files_to_scan(listing: DataFrame, manifest: DataFrame, code: str) -> DataFrame:
    """Files (path, bytes, mtime) that must be read: all but those that gave no record while size, time and the reader's ``code`` digest are the same. ``manifest`` is (path, bytes, mtime, code, n_records)."""
    empty = manifest.where((F.col("n_records") == 0) & (F.col("code") == code)).select("path", "bytes", "mtime")
    return listing.join(empty, ["path", "bytes", "mtime"], "left_anti")


def merged_index(fresh: DataFrame, previous: DataFrame, scanned: list[str]) -> DataFrame:
    """The change index after a scan of some providers: their fresh rows, and the previous rows of the others."""
    return fresh.where(F.col("provider").isin(*scanned)).unionByName(previous.where(~F.col("provider").isin(*scanned)))


def fixture_problems(records: DataFrame, roles: tuple[str, ...], least: int = 1, most: int = 2000) -> DataFrame:
    """(problem, n): what makes a fixture's records (source_id, role, content) unusable: unknown roles, missing ids or contents, ids that stand twice, too few or too many records."""
    each = records.select(F.explode(F.filter(F.array(F.when(F.col("source_id").isNull(), "no id"), F.when(~F.coalesce(F.col("role").isin(*roles), F.lit(False)), "bad role"), F.when(F.col("content").isNull(), "no content")), lambda x: x.isNotNull())).alias("problem"))
    twice = records.where("source_id IS NOT NULL").groupBy("source_id").count().where("count > 1").select(F.lit("duplicate id").alias("problem"))
    size = records.agg(F.count("*").alias("n")).where(~F.col("n").between(least, most)).select(F.lit("record count").alias("problem"))
    return each.union(twice).union(size).groupBy("problem").agg(F.count("*").alias("n"))


def session_with_quotes(records: DataFrame, quotes: DataFrame, candidates: DataFrame) -> DataFrame:
    """session_id of the first candidate (session_id, rank) each of whose wanted quotes (quote) stands in one of its records (session_id, content).

    All quotes count, however many; they are looked for in the candidates'
    records only, which are selected before any text is searched.
    """
    wanted = written(quotes.where("length(quote) > 0").select(F.sha2("quote", 256).alias("quote_id"), "quote").distinct(), "wanted-quotes")
    own = records.join(candidates.select("session_id").distinct(), "session_id", "left_semi")
    places = quote_places(own.select(F.col("session_id").alias("record_id"), F.col("content").alias("text")), wanted)
    held = places.groupBy(F.col("record_id").alias("session_id")).agg(F.count_distinct("quote_id").alias("n"))
    many = wanted.count()
    full = held.where(F.col("n") == many) if many else own.select("session_id").distinct()
    return candidates.join(full, "session_id", "left_semi").orderBy("rank", "session_id").limit(1).select("session_id")


def session_slice(records: DataFrame, offset: int, limit: int, most_records: int = 100, most_chars: int = 120_000) -> DataFrame:
    """Records (session_id, pos, content) number ``offset`` + 1 to ``offset`` + ``limit`` of each session, ``most_records`` and ``most_chars`` at most, with place."""
    numbered = ordered.running_count(records, ["session_id"], ["pos"], F.lit(True), "place", ordered.block_of(F.col("pos")))
    cut = numbered.where(F.col("place").between(offset + 1, offset + min(limit, most_records)))
    so_far = F.sum(F.length("content")).over(Window.partitionBy("session_id").orderBy("place"))  # most_records rows of a session at most
    return cut.withColumn("__chars", so_far).where(F.col("__chars") <= most_chars).drop("__chars")


def upserted_units(before: DataFrame, now: DataFrame, kept: list[str]) -> DataFrame:
    """Units after an upsert by unit_id: new values win, the columns ``kept`` stay as they were where the unit was known."""
    old = before.select("unit_id", *[F.col(c).alias(f"__{c}") for c in before.columns if c != "unit_id"], F.lit(True).alias("__was"))
    new = now.withColumn("__is", F.lit(True))
    joined = old.join(new, "unit_id", "full_outer")

    def value(c: str) -> Column:
        if c in kept:
            return F.when(F.col("__was"), F.col(f"__{c}")).otherwise(F.col(c))
        return F.when(F.col("__is"), F.col(c)).otherwise(F.col(f"__{c}"))

    return joined.select("unit_id", *[value(c).alias(c) for c in now.columns if c != "unit_id"])


def closed_calls(opened: DataFrame, closings: DataFrame, cancelled_at: Column | None = None) -> DataFrame:
    """The call ledger: opened calls (call_id, started_at) with the last closing (call_id, finished_at, status) of each; one without is running, or cancelled where a new run starts at ``cancelled_at``."""
    last = closings.groupBy("call_id").agg(F.max_by(F.struct("finished_at", "status"), F.struct("finished_at", "status")).alias("c"))
    rest = F.lit("running") if cancelled_at is None else F.lit("cancelled")
    return opened.join(last, "call_id", "left").select(*opened.columns, F.coalesce("c.finished_at", cancelled_at if cancelled_at is not None else F.lit(None)).alias("finished_at"), F.coalesce("c.status", rest).alias("status"))


def latest_values(writes: DataFrame) -> DataFrame:
    """(key, value): of writes (key, value, at, n) the last one by time and number; a null value stands."""
    return writes.groupBy("key").agg(F.max_by("value", F.struct("at", "n")).alias("value"))


def markdown(events: DataFrame) -> DataFrame:
    """(pos, text): events (pos, kind, label, title, quote) as Markdown items, signs of Markdown escaped, the quote in a fence longer than any in it."""
    escaped = F.regexp_replace("title", r"([\\`*_{}\[\]<>#|])", r"\\$1")
    longest = F.aggregate(F.regexp_extract_all("quote", F.lit(r"`+"), F.lit(0)), F.lit(2), lambda n, x: F.greatest(n, F.length(x)))
    fence = F.repeat(F.lit("`"), longest + 1)
    body = F.when(F.col("quote").isNotNull(), F.concat(F.lit("\n"), fence, F.lit("\n"), "quote", F.lit("\n"), fence)).otherwise("")
    return events.select("pos", F.concat(F.lit("- **"), "kind", F.lit("** ("), "label", F.lit(") "), escaped, body).alias("text"))


def mermaid(edges: DataFrame) -> DataFrame:
    """(pos, text): edges (pos, from_id, relation, to_id) as lines of a Mermaid flow chart."""
    return edges.select("pos", F.concat(F.lit("  "), F.col("from_id").cast("string"), F.lit(" -->|"), F.regexp_replace("relation", r"[|\"\n]", " "), F.lit("| "), F.col("to_id").cast("string")).alias("text"))


def api_rows(rows: DataFrame, schema: str, columns: list[str]) -> DataFrame:
    """(body): each row as JSON with the name of its schema first; nulls are left out."""
    return rows.select(F.to_json(F.struct(F.lit(schema).alias("schema"), *columns)).alias("body"))


def unaudited(records: DataFrame, units: DataFrame, noted: DataFrame) -> DataFrame:
    """(sessions, records): available records (source_id, session_id, at, available) of noted sessions (session_id, since) from then on that no integrated unit (status, sources) covers."""
    covered = units.where("status = 'integrated'").select(F.explode("sources").alias("source_id")).distinct()
    left = records.where("available").join(noted, "session_id").where("at >= since").join(covered, "source_id", "left_anti")
    return left.agg(F.count_distinct("session_id").alias("sessions"), F.count("*").alias("records"))


def provider_differences(before: DataFrame, now: DataFrame, scanned: list[str]) -> DataFrame:
    """(source_id, state): present, changed, new, or missing; only records of ``scanned`` providers can be missing."""
    old = before.select("source_id", F.col("provider").alias("__p"), F.col("content_hash").alias("__old"))
    new = now.select("source_id", F.col("content_hash").alias("__new"))
    state = F.when(F.col("__old").isNull(), "new").when(F.col("__new").isNull(), F.when(F.col("__p").isin(*scanned), "missing")).when(F.col("__old") != F.col("__new"), "changed").otherwise("present")
    return old.join(new, "source_id", "full_outer").select("source_id", state.alias("state")).where("state IS NOT NULL")


def units_by_age(units: DataFrame, records: DataFrame) -> DataFrame:
    """(unit_id, first_pos, n_sources) of units (unit_id, sources) by their oldest source, units without a known source last."""
    each = units.select("unit_id", F.explode_outer("sources").alias("source_id")).join(records.select("source_id", "pos"), "source_id", "left")
    return each.groupBy("unit_id").agg(F.min("pos").alias("first_pos"), F.count("source_id").alias("n_sources")).orderBy(F.col("first_pos").asc_nulls_last(), "unit_id")


def call_timeline(calls: DataFrame, shown: list[str]) -> DataFrame:
    """Calls in order of their start, only the columns ``shown``, with duration_ms; texts of requests and answers are not among them."""
    ms = (F.unix_millis(F.col("finished_at").cast("timestamp")) - F.unix_millis(F.col("started_at").cast("timestamp"))).alias("duration_ms")
    return calls.select(*shown, ms).orderBy("started_at", "call_id")


def compared_runs(calls: DataFrame, since: Column) -> DataFrame:
    """(unit_id, path, calls, seconds, tokens) of the calls (unit_id, n, stage, status, started_at, seconds, usage) from ``since`` on.

    The path is first, repair, salvage or skipped: that of the last call that
    ended well, skipped without one. ``usage`` has either total_tokens or
    input_tokens and output_tokens.
    """
    tokens = F.coalesce(F.col("usage.total_tokens"), F.col("usage.input_tokens") + F.col("usage.output_tokens"))
    rows = calls.where(F.col("started_at") >= since)
    return rows.groupBy("unit_id").agg(F.coalesce(F.max_by(F.when(F.col("status") == "ok", F.col("stage")), F.when(F.col("status") == "ok", F.col("n"))), F.lit("skipped")).alias("path"), F.count("*").alias("calls"), F.sum("seconds").alias("seconds"), F.sum(tokens).alias("tokens"))


def unit_input(units: DataFrame, records: DataFrame) -> DataFrame:
    """(unit_id, request): the nested input of each unit (unit_id, sources) as JSON: its records (source_id, pos, role, content) in order."""
    each = units.select("unit_id", F.explode("sources").alias("source_id")).join(records, "source_id")
    return each.groupBy("unit_id").agg(F.to_json(F.struct(F.sort_array(F.collect_list(F.struct("pos", "source_id", "role", "content"))).alias("records"))).alias("request"))
