"""Queries on manifests, unit and call tables, slices, exports and comparisons of runs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import turns
from ..operators import units as ops
from ..sources.store import shared_dir
from .bindings import table
from .registry import query


@query("src05_provider_selection", "SELECT doc_id FROM documents WHERE source IN ('src1', 'src3')")
def provider_selection(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return ops.chosen_providers(docs, "src1, src3", tuple(f"src{i}" for i in range(20)), "source").select("doc_id")


@query("src13_scan_cache", "SELECT p_partkey AS path FROM part WHERE NOT (p_partkey % 2 = 0 AND p_partkey % 3 <> 0 AND p_partkey % 5 <> 0 AND p_size % 7 <> 0)")
def scan_cache(spark, sf_dir):
    key = F.col("p_partkey")
    files = table(spark, sf_dir, "part").select(key.alias("path"), F.col("p_size").alias("bytes"), (key % 100).alias("mtime"))
    # Every second file gave no record; every third changed since, every fifth was read by another reader, and one size in seven is unknown.
    manifest = files.where("bytes % 7 <> 0").select("path", "bytes", F.when(F.col("path") % 3 == 0, F.col("mtime") - 1).otherwise(F.col("mtime")).alias("mtime"), F.when(F.col("path") % 5 == 0, "old").otherwise("now").alias("code"), (F.col("path") % 2).alias("n_records"))
    return ops.files_to_scan(files, manifest, "now").select("path")


@query("src16_change_index", "SELECT p_partkey AS path, CASE WHEN p_partkey % 3 = 0 THEN 'a' ELSE 'b' END AS provider, CAST(CASE WHEN p_partkey % 3 = 0 THEN p_size + 1 ELSE p_size END AS BIGINT) AS bytes FROM part WHERE p_partkey % 3 <> 0 OR p_partkey % 2 = 0")
def change_index(spark, sf_dir):
    provider = F.when(F.col("p_partkey") % 3 == 0, "a").otherwise("b").alias("provider")
    part = table(spark, sf_dir, "part")
    previous = part.select(F.col("p_partkey").alias("path"), provider, F.col("p_size").cast("bigint").alias("bytes"))
    fresh = part.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("path"), provider, (F.col("p_size") + 1).cast("bigint").alias("bytes"))
    return ops.merged_index(fresh, previous, ["a"])


@query("src17_fixture_problems", "SELECT 'bad role' AS problem, count(*) AS n FROM conversations WHERE role = 'system' UNION ALL SELECT 'no content', count(*) FROM conversations WHERE turn = 3 UNION ALL SELECT 'duplicate id', count(*) FROM (SELECT conv_id FROM conversations GROUP BY 1 HAVING count(*) > 1) HAVING count(*) > 0 UNION ALL SELECT 'record count', 1 FROM conversations HAVING count(*) > 500")
def fixture_problems(spark, sf_dir):
    records = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("source_id"), "role", F.when(F.col("turn") != 3, F.col("text")).alias("content"))
    return ops.fixture_problems(records, ("user", "assistant"), most=500)


@query("src19_session_with_quotes", "WITH q AS (SELECT substr(text, 1, 20) AS quote FROM conversations WHERE conv_id = (SELECT max(conv_id) FROM conversations)), h AS (SELECT conv_id, quote, bool_or(contains(text, quote)) AS has FROM conversations, (SELECT DISTINCT quote FROM q) GROUP BY ALL), f AS (SELECT conv_id FROM h GROUP BY 1 HAVING bool_and(has)) SELECT min(conv_id) AS session_id FROM f")
def session_with_quotes(spark, sf_dir):
    records = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("text").alias("content"))
    last = records.agg(F.max("session_id").alias("session_id"))
    quotes = records.join(F.broadcast(last), "session_id").select(F.substring("content", 1, 20).alias("quote"))
    candidates = records.select("session_id", F.col("session_id").alias("rank")).distinct()
    return ops.session_with_quotes(records, quotes, candidates)


@query("src21_session_slices", "WITH n AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations), c AS (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY place) AS chars FROM n WHERE place BETWEEN 2 AND 4) SELECT conv_id AS session_id, turn AS pos, place FROM c WHERE chars <= 300")
def session_slices(spark, sf_dir):
    records = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("pos"), F.col("text").alias("content"))
    return ops.session_slice(records, 1, 3, most_chars=300).select("session_id", "pos", "place")


@query("snk03_unit_upsert", "SELECT o_orderkey AS unit_id, CASE WHEN o_orderkey % 2 = 0 THEN 'new' ELSE 'old' END AS status, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority ELSE 'fresh' END AS note FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 <> 0")
def unit_upsert(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    before = orders.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("unit_id"), F.lit("old").alias("status"), F.col("o_orderpriority").alias("note"))
    now = orders.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("unit_id"), F.lit("new").alias("status"), F.lit("fresh").alias("note"))
    return ops.upserted_units(before, now, ["note"])


@query("snk04_call_ledger", "WITH c AS (SELECT l_orderkey, max(l_shipdate) AS f FROM lineitem WHERE l_linenumber > 1 GROUP BY 1) SELECT o_orderkey AS call_id, CAST(coalesce(f, DATE '2030-01-01') AS DATE) AS finished_at, CASE WHEN f IS NULL THEN 'cancelled' ELSE 'ok' END AS status FROM orders LEFT JOIN c ON l_orderkey = o_orderkey")
def call_ledger(spark, sf_dir):
    opened = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("call_id"), F.col("o_orderdate").alias("started_at"))
    closings = table(spark, sf_dir, "lineitem").where("l_linenumber > 1").select(F.col("l_orderkey").alias("call_id"), F.col("l_shipdate").alias("finished_at"), F.lit("ok").alias("status"))
    kind = dict(closings.dtypes)["finished_at"]
    closed = ops.closed_calls(opened, closings, F.lit("2030-01-01").cast(kind))
    return closed.select("call_id", F.to_date("finished_at").alias("finished_at"), "status")


@query("snk05_key_values", "SELECT user_id AS key, arg_max(event_type, event_id) AS value FROM events GROUP BY 1")
def key_values(spark, sf_dir):
    writes = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("value"), F.lit(0).alias("at"), F.col("event_id").alias("n"))
    return ops.latest_values(writes)


@query("snk06_markdown_export", r"""SELECT doc_id AS pos, sha256('- **note** (done) doc\_' || doc_id || chr(10) || '````' || chr(10) || '```' || text || chr(10) || '````') AS text_hash FROM documents WHERE text IS NOT NULL AND NOT contains(text, '`')""")
def markdown_export(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL AND NOT contains(text, '`')")
    events = docs.select(F.col("doc_id").alias("pos"), F.lit("note").alias("kind"), F.lit("done").alias("label"), F.concat(F.lit("doc_"), "doc_id").alias("title"), F.concat(F.lit("```"), "text").alias("quote"))
    return ops.markdown(events).select("pos", F.sha2("text", 256).alias("text_hash"))


@query("snk06_mermaid_export", "SELECT event_id AS pos, '  ' || user_id || ' -->|' || event_type || '| ' || event_id AS text FROM events")
def mermaid_export(spark, sf_dir):
    return ops.mermaid(table(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), F.col("user_id").alias("from_id"), F.col("event_type").alias("relation"), F.col("event_id").alias("to_id")))


@query("snk10_api_rows", """SELECT '{"schema":"find.v1","event_id":' || event_id || CASE WHEN event_id % 2 = 0 THEN ',"kind":"' || event_type || '"' ELSE '' END || '}' AS body FROM events""")
def api_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("kind"))
    return ops.api_rows(rows, "find.v1", ["event_id", "kind"])


@query("snk11_state_copy", "SELECT p_partkey AS id, p_size AS value FROM part WHERE p_partkey % 2 = 0")
def state_copy(spark, sf_dir):
    from ..sources import versions

    home, branch = (f"{shared_dir(spark)}/state-{uuid.uuid4().hex}" for _ in range(2))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("value"))
    first = versions.publish({"state": part.where("id % 2 = 0")}, home, 0)
    versions.publish({"state": part}, home, first)
    versions.copy_version(spark, home, branch, first)
    return versions.read_version(spark, branch, "state")


@query("join20_unaudited", "WITH s AS (SELECT user_id, min(ts) FILTER (event_type = 'signup') AS since FROM events GROUP BY 1), u AS (SELECT event_id FROM events WHERE event_id % 4 = 0) SELECT count(DISTINCT user_id) AS sessions, count(*) AS records FROM events JOIN s USING (user_id) WHERE ts >= since AND event_id % 10 <> 0 AND event_id % 4 <> 0")
def unaudited(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    records = events.select(F.col("event_id").alias("source_id"), F.col("user_id").alias("session_id"), F.col("ts").alias("at"), (F.col("event_id") % 10 != 0).alias("available"))
    units = events.where("event_id % 4 = 0 OR event_id % 4 = 1").groupBy("user_id", (F.col("event_id") % 4).alias("m")).agg(F.collect_list("event_id").alias("sources")).select(F.when(F.col("m") == 0, "integrated").otherwise("failed").alias("status"), "sources")
    noted = events.where("event_type = 'signup'").groupBy(F.col("user_id").alias("session_id")).agg(F.min("ts").alias("since"))
    return ops.unaudited(records, units, noted)


@query("set02_provider_difference", "WITH o AS (SELECT p_partkey AS id, p_size AS h, p_partkey % 3 AS p FROM part WHERE p_partkey % 6 <> 0), n AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN p_size + 1 ELSE p_size END AS h FROM part WHERE p_partkey % 7 <> 0) SELECT coalesce(o.id, n.id) AS source_id, CASE WHEN o.id IS NULL THEN 'new' WHEN n.id IS NULL THEN 'missing' WHEN o.h <> n.h THEN 'changed' ELSE 'present' END AS state FROM o FULL JOIN n ON o.id = n.id WHERE NOT (n.id IS NULL AND o.p = 2)")
def provider_difference(spark, sf_dir):
    key = F.col("p_partkey")
    part = table(spark, sf_dir, "part")
    before = part.where(key % 6 != 0).select(key.alias("source_id"), F.concat(F.lit("p"), key % 3).alias("provider"), F.col("p_size").alias("content_hash"))
    now = part.where(key % 7 != 0).select(key.alias("source_id"), F.when(key % 5 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("content_hash"))
    return ops.provider_differences(before, now, ["p0", "p1"])


@query("sort09_oldest_units", "SELECT l_orderkey AS unit_id, min(l_partkey) AS first_pos, count(*) AS n_sources FROM lineitem GROUP BY 1")
def oldest_units(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    units = line.groupBy(F.col("l_orderkey").alias("unit_id")).agg(F.collect_list("l_partkey").alias("sources"))
    return ops.units_by_age(units, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("source_id"), F.col("p_partkey").alias("pos")).union(line.select("l_partkey", "l_partkey")).distinct())


@query("sort07_call_timeline", "SELECT event_id AS call_id, event_type AS stage, ts AS started_at, CAST(event_id % 1000 AS BIGINT) AS duration_ms FROM events")
def call_timeline(spark, sf_dir):
    finish = F.timestamp_millis(F.unix_millis(F.col("ts").cast("timestamp")) + F.col("event_id") % 1000)
    calls = table(spark, sf_dir, "events").select(F.col("event_id").alias("call_id"), F.col("event_type").alias("stage"), F.col("ts").alias("started_at"), finish.alias("finished_at"), F.col("props").alias("prompt"))
    return ops.call_timeline(calls, ["call_id", "stage", "started_at"])


@query("agg22_compared_runs", """WITH c AS (SELECT l_orderkey AS unit_id, l_linenumber * 100000 + l_partkey AS n, CASE l_linenumber % 3 WHEN 1 THEN 'first' WHEN 2 THEN 'repair' ELSE 'salvage' END AS stage, l_returnflag <> 'N' AS ok, CAST(round(l_quantity) AS BIGINT) AS s FROM lineitem WHERE l_shipdate >= DATE '1995-01-01')
 SELECT unit_id, coalesce(arg_max(stage, n) FILTER (ok), 'skipped') AS path, count(*) AS calls, CAST(sum(s) AS BIGINT) AS seconds, CAST(sum(3 * s) AS BIGINT) AS tokens FROM c GROUP BY 1""")
def compared_runs(spark, sf_dir):
    number, q = F.col("l_linenumber"), F.round("l_quantity").cast("bigint")
    stage = F.when(number % 3 == 1, "first").when(number % 3 == 2, "repair").otherwise("salvage")
    even = number % 2 == 0
    usage = F.struct(F.when(even, 3 * q).alias("total_tokens"), F.when(~even, q).alias("input_tokens"), F.when(~even, 2 * q).alias("output_tokens"))
    calls = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("unit_id"), (number * 100000 + F.col("l_partkey")).alias("n"), stage.alias("stage"), F.when(F.col("l_returnflag") != "N", "ok").otherwise("failed").alias("status"), F.col("l_shipdate").alias("started_at"), q.alias("seconds"), usage.alias("usage"))
    return ops.compared_runs(calls, F.lit("1995-01-01").cast("date"))


@query("win14_journal_tails", "WITH s AS (SELECT user_id, max(ts) FILTER (event_type = 'signup') AS a, max(ts) AS b FROM events GROUP BY 1) SELECT user_id AS session_id, a AS tail_start, b AS tail_end FROM s WHERE a < b AND b <= TIMESTAMP '2100-01-01' - INTERVAL 1 HOUR")
def journal_tails(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.col("ts").alias("at"), "event_type")
    notes = events.where("event_type = 'signup'").select("session_id", F.col("at").alias("noted_at"))
    return turns.quiet_intervals(notes, events.select("session_id", "at"), F.lit("2100-01-01").cast("timestamp"))
