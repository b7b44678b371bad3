"""Queries on how events hang from requests, on references, families and repairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import linking as ops
from .bindings import table
from .registry import query

#: Events as work (all but sign-ups) and requests (sign-ups; every fifth has no event); odd users above 75 are sub-agents of the user 75 below.
_WORK = """w AS (SELECT event_id AS id, user_id AS session_id, ts AS tm FROM events WHERE event_type <> 'signup'), rq AS (SELECT 'r' || event_id AS source_id, user_id AS session_id, ts AS tm, CASE WHEN event_id % 5 <> 0 THEN CAST(event_id AS VARCHAR) END AS event_id FROM events WHERE event_type = 'signup'),
 own AS (SELECT w.id, w.session_id, w.tm, rq.source_id, rq.event_id FROM w ASOF LEFT JOIN rq ON w.session_id = rq.session_id AND w.tm >= rq.tm),
 up AS (SELECT own.id, rq.source_id, rq.event_id FROM (SELECT * FROM own WHERE source_id IS NULL AND session_id > 75 AND session_id % 2 = 1) own ASOF JOIN rq ON own.session_id - 75 = rq.session_id AND own.tm >= rq.tm),
 lk AS (SELECT own.id, coalesce(own.source_id, up.source_id) AS request_id, CASE WHEN own.source_id IS NOT NULL THEN own.event_id ELSE up.event_id END AS request_event, CASE WHEN own.source_id IS NOT NULL THEN 'session' WHEN up.source_id IS NOT NULL THEN 'parent' END AS way FROM own LEFT JOIN up USING (id))"""


def _work(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    work = events.where("event_type <> 'signup'").select(F.col("event_id").alias("id"), F.col("user_id").alias("session_id"), micros.alias("pos"), F.col("ts").alias("at"))
    requests = events.where("event_type = 'signup'").select(F.concat(F.lit("r"), "event_id").alias("source_id"), F.col("user_id").alias("session_id"), micros.alias("pos"), F.col("ts").alias("at"), F.when(F.col("event_id") % 5 != 0, F.col("event_id").cast("string")).alias("event_id"))
    parents = events.where("user_id > 75 AND user_id % 2 = 1").select(F.col("user_id").alias("session_id"), (F.col("user_id") - 75).alias("parent_session_id")).distinct()
    return work, requests, parents


@query("join03_turn_links", f"WITH {_WORK} SELECT id, request_id, request_event, way FROM lk")
def turn_links(spark, sf_dir):
    return ops.turn_links(*_work(spark, sf_dir))


@query("grf06_request_events", """WITH p AS (SELECT conv_id, turn, 'conv:' || conv_id || ':' || turn AS source_id, text FROM conversations WHERE role = 'user' AND (conv_id + turn) % 3 <> 0), f AS (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS flat FROM p)
 SELECT 'ev_' || substr(sha256('["user_request","' || source_id || '"]'), 1, 24) AS id, conv_id AS session_id, CASE WHEN length(flat) <= 240 THEN flat ELSE rtrim(substr(flat, 1, 239)) || '…' END AS title, source_id FROM f""")
def request_events(spark, sf_dir):
    prompts = table(spark, sf_dir, "conversations").where("role = 'user'").select(F.concat_ws(":", F.lit("conv"), "conv_id", "turn").alias("source_id"), F.col("conv_id").alias("session_id"), "turn", F.col("text").alias("content"))
    return ops.request_events(prompts, prompts.where("(session_id + turn) % 3 = 0"))


@query("grf06_turn_edges", f"WITH {_WORK} SELECT request_event AS from_id, CAST(id AS VARCHAR) AS to_id FROM lk WHERE request_event IS NOT NULL AND id % 4 <> 0")
def turn_edges(spark, sf_dir):
    work, requests, parents = _work(spark, sf_dir)
    edges = work.select((F.col("id") + 1).alias("from_id"), F.col("id").alias("to_id"), (F.col("id") % 4 == 0).alias("active"))
    return ops.hang_new(work.select("id", F.lit("assistant").alias("actor")), edges, ops.turn_links(work, requests, parents))


@query("grf05_rehang", f"""WITH {_WORK}, ret AS (SELECT id FROM w WHERE id % 7 = 0), e AS (SELECT b.id AS from_id, a.id AS to_id, a.id % 5 <> 1 AS active, CASE WHEN a.id % 3 = 0 THEN 'model' ELSE 'dialog_turn' END AS origin FROM w a JOIN w b ON b.id = a.id - 1),
 lo AS (SELECT to_id FROM e WHERE active AND origin = 'dialog_turn' AND from_id IN (SELECT id FROM ret) AND to_id NOT IN (SELECT id FROM ret)), mv AS (SELECT to_id, CASE WHEN request_event IS NOT NULL THEN 'turn:' || request_event || ':' || to_id END AS new_id FROM lo LEFT JOIN lk ON lk.id = to_id)
 SELECT CAST(to_id AS VARCHAR) AS id, false AS active, new_id AS replaced_by, 'closed' AS change FROM mv UNION ALL SELECT new_id, true, NULL, 'added' FROM mv WHERE new_id IS NOT NULL""")
def rehang(spark, sf_dir):
    work, requests, parents = _work(spark, sf_dir)
    gone = F.col("id") % 7 == 0
    events = work.select("id", F.when(gone, "withdrawn").otherwise("applied").alias("status"), gone.alias("invalidated"))
    edges = work.select(F.col("id"), (F.col("id") - 1).alias("from_id"), F.col("id").alias("to_id"), (F.col("id") % 5 != 1).alias("active"), F.when(F.col("id") % 3 == 0, "model").otherwise("dialog_turn").alias("origin")).join(work.select(F.col("id").alias("from_id")), "from_id", "left_semi")
    return ops.rehung(events, edges, ops.turn_links(work, requests, parents))


@query("grf07_derived_fields", """WITH r AS (SELECT l_orderkey AS id, l_shipmode0 AS provider, CASE l_returnflag WHEN 'A' THEN 'edit' ELSE 'run' END AS hint, CASE WHEN l_suppkey % 11 = 0 THEN l_suppkey END AS fork_of, CASE WHEN l_suppkey % 13 = 0 THEN l_suppkey END AS parent_call FROM (SELECT *, 'p' || l_linestatus AS l_shipmode0 FROM lineitem)),
 g AS (SELECT id, string_agg(DISTINCT provider, ',' ORDER BY provider) AS authoring, CASE WHEN count(DISTINCT hint) = 1 THEN min(hint) END AS step, min(fork_of) AS fork_of, min(parent_call) AS delegated_by FROM r GROUP BY id)
 SELECT o_orderkey AS id, coalesce(authoring, '') AS authoring, step, fork_of, delegated_by, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey + 1 END AS folded_into FROM orders LEFT JOIN g ON id = o_orderkey""")
def derived_fields(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").withColumn("source_id", F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate"))
    supplier = F.col("l_suppkey")
    records = line.select("source_id", F.concat(F.lit("p"), "l_linestatus").alias("provider"), F.when(F.col("l_returnflag") == "A", "edit").otherwise("run").alias("hint"), F.when(supplier % 11 == 0, supplier).alias("fork_of"), F.when(supplier % 13 == 0, supplier).alias("parent_call"))
    orders = table(spark, sf_dir, "orders")
    events = orders.join(line.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list("source_id").alias("evidence")), "o_orderkey", "left").select(F.col("o_orderkey").alias("id"), "evidence")
    key = F.col("o_orderkey")
    edge = lambda to: orders.select(key.alias("from_id"), to.alias("to_id"), F.lit("reports").alias("relation"), (key % 4 != 3).alias("active"))
    # One report for every fourth order, two (so none counts) for the next, an inactive one for the last.
    edges = edge(key + 1).where("from_id % 4 IN (0, 1, 3)").union(edge(key + 2).where("from_id % 4 = 1"))
    return ops.derived(events, records, edges)


@query("grf13_references", """WITH n AS (SELECT o_orderkey AS k, md5(CAST(o_orderkey AS VARCHAR)) AS id FROM orders), c AS (SELECT k, id, k % 5 AS way FROM n)
 SELECT CASE WHEN way = 0 THEN 'ctx:' || id WHEN way = 1 THEN id || '@v1' WHEN way = 2 THEN substr(id, 1, 20) || '@v1' WHEN way = 3 THEN id || '@v1' ELSE 'zzzzzzzz' || k END AS ref,
 CASE way WHEN 0 THEN 'current' WHEN 1 THEN 'current' WHEN 2 THEN 'changed' WHEN 3 THEN 'gone' ELSE 'unknown' END AS state, CASE WHEN way < 4 THEN id END AS event_id, CASE WHEN way = 2 THEN 'title' ELSE '' END AS changes FROM c""")
def references(spark, sf_dir):
    key = F.col("o_orderkey")
    base = table(spark, sf_dir, "orders").select(key.alias("k"), F.md5(key.cast("string")).alias("id"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("status"), (key % 5).alias("way"))
    ref = F.when(F.col("way") == 0, F.concat(F.lit("ctx:"), "id")).when(F.col("way").isin(1, 3), F.concat("id", F.lit("@v1"))).when(F.col("way") == 2, F.concat(F.substring("id", 1, 20), F.lit("@v1"))).otherwise(F.concat(F.lit("zzzzzzzz"), "k"))
    now = base.where("way <> 3").select("id", F.when(F.col("way") == 2, "other").otherwise(F.col("title")).alias("title"), "status")
    return ops.resolved_references(base.select(ref.alias("ref")), now, base.select(F.lit(1).alias("version"), "id", "title", "status"), 2)


@query("join06_called_tools", """WITH RECURSIVE s AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 3 <> 0), h AS (SELECT k AS child, k + 1 AS caller, k AS rec FROM s)
 SELECT 'sess-' || lpad(CAST(child AS VARCHAR), 9, '0') AS session_id, 'sess-' || lpad(CAST(caller AS VARCHAR), 9, '0') AS parent_session_id, 'rec' || rec AS parent_record FROM h""")
def called_tools(spark, sf_dir):
    key = F.col("o_orderkey")
    name = lambda k: F.concat(F.lit("sess-"), F.lpad(k.cast("string"), 9, "0"))
    orders = table(spark, sf_dir, "orders")
    # Sessions of every third order have a person; the others are each called from the session after them, which may be called itself.
    alone = orders.where(key % 3 != 0).select(name(key).alias("session_id"))
    texts = orders.where(key % 3 != 0).select(F.concat(F.lit("rec"), key).alias("source_id"), name(key + 1).alias("session_id"), key.alias("pos"), F.concat(F.lit('{"thread": "'), name(key), F.lit('"}')).alias("content"))
    return ops.called_sessions(alone, texts, r"sess-\d{9}")


@query("prj13_session_family", "WITH RECURSIVE p AS (SELECT DISTINCT c_custkey AS k, CASE WHEN c_custkey > 1 THEN c_custkey // 2 END AS up FROM customer), f AS (SELECT k FROM p WHERE k = 12 UNION ALL SELECT p.k FROM p JOIN f ON p.up = f.k) SELECT CAST(k AS VARCHAR) AS session_id FROM f")
def session_family(spark, sf_dir):
    key = F.col("c_custkey")
    sessions = table(spark, sf_dir, "customer").select(key.cast("string").alias("session_id"), F.when(key > 1, F.floor(key / 2)).cast("string").alias("parent_session_id"))
    return ops.family(sessions, "12")


@query("agg09_family_recency", "SELECT user_id % 50 AS root, max(ts) AS last_at, count(DISTINCT user_id) AS n_sessions FROM events GROUP BY 1")
def family_recency(spark, sf_dir):
    sessions = table(spark, sf_dir, "events").select(F.col("user_id").cast("bigint").alias("session_id"), F.col("ts").alias("at"))
    roots = sessions.where("session_id >= 50").select("session_id", (F.col("session_id") % 50).alias("root")).distinct()
    return ops.family_recency(sessions, roots)


@query("set06_audit_guard", "SELECT 'updates must be empty' AS problem, count(*) AS n FROM orders WHERE o_orderkey % 9 = 0 UNION ALL SELECT 'items may only add', count(*) FROM orders WHERE o_orderkey % 6 = 0")
def audit_guard(spark, sf_dir):
    ids = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    delta = {"updates": ids.where("id % 9 = 0"), "invalidations": ids.where("id < 0"), "resolutions": ids.where("id < 0"), "items": ids.where("id % 2 = 0")}
    return ops.audit_problems(delta, ids.where("id % 3 = 0"))


@query("set08_settled_duplicates", """WITH t AS (SELECT l_orderkey AS k, bool_and(l_partkey % 10 < 9) AS own FROM lineitem GROUP BY 1) SELECT k AS candidate_id, CASE WHEN k % 3 = 0 THEN 'excluded' WHEN own THEN 'added' WHEN k % 3 = 1 THEN 'duplicate' ELSE 'updated' END AS disposition FROM t""")
def settled_duplicates(spark, sf_dir):
    key = F.col("l_orderkey")
    rows = table(spark, sf_dir, "lineitem").groupBy(key.alias("candidate_id")).agg(F.collect_set("l_partkey").alias("targets"))
    kind = F.when(F.col("candidate_id") % 3 == 0, "excluded").when(F.col("candidate_id") % 3 == 1, "duplicate").otherwise("updated")
    resolutions = rows.select("candidate_id", F.lit("event").alias("kind"), kind.alias("disposition"), "targets")
    added = table(spark, sf_dir, "lineitem").where("l_partkey % 10 < 9").select(F.lit("event").alias("kind"), F.col("l_partkey").alias("id"))
    return ops.settled_duplicates(resolutions, added).select("candidate_id", "disposition")


@query("set08_unchecked_documents", "SELECT o_orderkey AS edge_id FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0")
def unchecked_documents(spark, sf_dir):
    key = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders")
    verifies = orders.select(key.alias("edge_id"), key.alias("change_id"), (-key - 1).alias("outcome_id"))
    files = orders.select(key.alias("change_id"), F.concat(F.lit("docs/n"), key, F.when(key % 2 == 0, ".md").otherwise(".py")).alias("file"))
    # Every third run names the file by its name, every fifth outcome has no run.
    runs = orders.where(key % 5 != 0).select((-key - 1).alias("outcome_id"), F.when(key % 3 == 0, F.concat(F.lit("cat n"), key, F.lit(".md"))).otherwise("pytest").alias("command"))
    return ops.unchecked_documents(verifies, files, runs)


@query("sort06_latest_notes", "WITH c AS (SELECT event_id AS id, count(*) OVER () AS n FROM events WHERE event_type = 'view' AND user_id % 2 = 0) SELECT id, id AS pos, CAST(n - 40 AS BIGINT) AS n_left_out FROM c ORDER BY id DESC LIMIT 40")
def latest_notes(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_id").alias("pos"), F.when(F.col("event_type") == "view", "note").otherwise("scan").alias("origin"), "user_id")
    return ops.latest_notes(events, events.where("user_id % 2 = 0"))


@query("sort10_next_flagged", "SELECT user_id, coalesce(min(event_id) FILTER (event_id > 5000), min(event_id)) AS id FROM events WHERE event_type = 'error' GROUP BY 1")
def next_flagged(spark, sf_dir):
    flagged = table(spark, sf_dir, "events").where("event_type = 'error'").select("user_id", F.col("event_id").alias("id"), F.col("event_id").alias("pos"))
    return flagged.groupBy("user_id").agg(ops.next_flagged(flagged, 5000).alias("n")).select("user_id", "n.id")


@query("sort03_event_rows", """SELECT event_id AS id, substr(md5(CAST(event_id AS VARCHAR)), 1, 8) AS short, coalesce(CASE WHEN event_id % 2 = 0 THEN ts END, ts + INTERVAL 1 HOUR) AS "when", event_type AS kind, CASE WHEN event_id % 3 = 0 THEN 'check' END AS step, 'applied' AS status, CASE WHEN event_id % 4 <> 0 THEN 'done' END AS label, 'event ' || event_id AS title, event_id % 9 = 0 AS out_of_order FROM events""")
def event_rows(spark, sf_dir):
    n = F.col("event_id")
    events = table(spark, sf_dir, "events").select(n.alias("id"), F.substring(F.md5(n.cast("string")), 1, 8).alias("short"), F.when(n % 2 == 0, F.col("ts")).alias("occurred_at"), (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("recorded_at"), F.col("event_type").alias("kind"), F.when(n % 3 == 0, "check").alias("step"), F.lit("applied").alias("status"), F.concat(F.lit("event "), n).alias("title"))
    return ops.event_rows(events, events.where("id % 4 <> 0").select("id", F.lit("done").alias("label")), events.where("id % 9 = 0"))
