"""Queries on evidence: orders are events, their line items citations of parts, parts the records."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evidence as ops
from ..operators import model_call, quotes, stories
from .bindings import GRAPH, STEPS, graph_edges, graph_events, steps, table
from .registry import query

_CITED = """ci AS (SELECT l_orderkey AS event_id, l_partkey AS source_id, 'h' || (l_partkey % 50 + CAST(l_linenumber = 7 AS INTEGER)) AS content_hash, l_linenumber AS n FROM lineitem),
 rc AS (SELECT p_partkey AS source_id, 'h' || p_partkey % 50 AS content_hash, p_size % 9 <> 0 AS available, p_brand AS session_id, p_size AS size FROM part WHERE p_partkey % 13 <> 0)"""


def _citations(spark, sf_dir):
    changed = (F.col("l_linenumber") == 7).cast("int")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.col("l_partkey").alias("source_id"), F.concat(F.lit("h"), (F.col("l_partkey") % 50 + changed).cast("string")).alias("content_hash"), F.col("l_linenumber").alias("n"))


def _records(spark, sf_dir):
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").where(key % 13 != 0).select(key.alias("source_id"), F.concat(F.lit("h"), (key % 50).cast("string")).alias("content_hash"), (F.col("p_size") % 9 != 0).alias("available"), F.col("p_brand").alias("session_id"), F.col("p_size").alias("size"))


@query("join14_missing_originals", f"WITH {_CITED} SELECT CASE WHEN rc.source_id IS NULL OR NOT available THEN 'missing' WHEN rc.content_hash <> ci.content_hash THEN 'changed' ELSE 'available' END AS state, count(*) AS n FROM ci LEFT JOIN rc USING (source_id) GROUP BY 1")
def missing_originals(spark, sf_dir):
    return ops.originals(_citations(spark, sf_dir), _records(spark, sf_dir)).groupBy("state").agg(F.count("*").alias("n"))


@query("join15_evidence_lookup", f"WITH {_CITED} SELECT source_id, content_hash FROM rc WHERE source_id IN (SELECT source_id FROM ci)")
def evidence_lookup(spark, sf_dir):
    wanted = _citations(spark, sf_dir).select("source_id").distinct()
    return _records(spark, sf_dir).join(wanted, "source_id", "left_semi").select("source_id", "content_hash")


@query("set05_uncovered_records", f"WITH {_CITED} SELECT source_id FROM rc WHERE source_id NOT IN (SELECT source_id FROM ci WHERE n = 7)")
def uncovered_records(spark, sf_dir):
    return ops.uncovered(_records(spark, sf_dir), _citations(spark, sf_dir).where("n = 7")).select("source_id")


@query("join21_uncovered_edits", f"""WITH {STEPS}, cited AS (SELECT id FROM st WHERE id % 3 = 0) SELECT e.id AS source_id FROM st e WHERE hint = 'edit' AND id NOT IN (SELECT id FROM cited)
 AND (session_id, key) NOT IN (SELECT (session_id, key) FROM st WHERE hint = 'test' AND id IN (SELECT id FROM cited))""")
def uncovered_edits(spark, sf_dir):
    rows = steps(spark, sf_dir).select(F.col("id").alias("source_id"), F.concat_ws(":", "session_id", "key").alias("call_id"), "hint")
    return ops.uncovered_edits(rows.where("hint = 'edit'"), rows.where("hint = 'test'"), rows.where("source_id % 3 = 0").select("source_id"))


@query("join18_new_record_tally", """SELECT event_type AS provider, count(*) AS n, max(CAST(ts AS VARCHAR)) AS newest FROM events WHERE NOT (event_id % 4 <> 0 AND value < 40) AND user_id % 7 <> 0 GROUP BY 1""")
def new_record_tally(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("source_id"), F.lit("h").alias("content_hash"), F.col("event_type").alias("provider"), F.col("user_id").alias("session_id"), F.col("ts").cast("string").alias("recorded_at"), "value")
    return ops.new_records(rows, rows.where("source_id % 4 <> 0 AND value < 40"), rows.where("session_id % 7 = 0"))


@query("dt06_merged_tallies", "SELECT event_type AS provider, count(*) AS n, max(CAST(ts AS VARCHAR)) AS newest FROM events WHERE user_id % 7 <> 0 GROUP BY 1")
def merged_tallies(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("source_id"), F.lit("h").alias("content_hash"), F.col("event_type").alias("provider"), F.col("user_id").alias("session_id"), F.col("ts").cast("string").alias("recorded_at"))
    part = lambda c: ops.new_records(rows.where(c), rows.where("false"), rows.where("session_id % 7 = 0"))
    return ops.merged_tallies(part("source_id % 2 = 0"), part("source_id % 2 = 1"))


@query("join13_overlap_match", """WITH c AS (SELECT l_orderkey AS event_id, l_linestatus AS kind, l_partkey AS s FROM lineitem), n AS (SELECT p_partkey // 4 AS note_id, CASE WHEN p_size % 2 = 0 THEN 'F' ELSE 'O' END AS kind, p_partkey AS s FROM part WHERE p_size > 10),
 m AS (SELECT event_id, min(note_id) AS note_id FROM c JOIN n USING (kind, s) GROUP BY event_id HAVING min(note_id) = max(note_id)), e AS (SELECT p_partkey AS s FROM part WHERE p_brand = 'Brand#11')
 SELECT event_id, note_id FROM m WHERE event_id NOT IN (SELECT c.event_id FROM c JOIN e USING (s) JOIN m USING (event_id) WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.note_id = m.note_id AND n.s = c.s))""")
def overlap_match(spark, sf_dir):
    events = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.col("l_linestatus").alias("kind"), F.col("l_partkey").alias("source_id"))
    part = table(spark, sf_dir, "part")
    notes = part.where("p_size > 10").select(F.floor(F.col("p_partkey") / 4).alias("note_id"), F.when(F.col("p_size") % 2 == 0, "F").otherwise("O").alias("kind"), F.col("p_partkey").alias("source_id"))
    return ops.overlap_matches(events, notes, part.where("p_brand = 'Brand#11'").select(F.col("p_partkey").alias("source_id")))


@query("join09_report_fold", """WITH c AS (SELECT l_orderkey AS event_id, CASE WHEN l_suppkey % 3 <> 0 THEN l_suppkey % 3 END AS agent FROM lineitem), r AS (SELECT event_id, min(agent) AS agent FROM c GROUP BY event_id HAVING count(*) = count(agent) AND min(agent) = max(agent)),
 o AS (SELECT o_custkey % 3 AS agent, arg_max(o_orderkey, struct_pack(a := o_orderdate, i := o_orderkey)) AS folded_into FROM orders GROUP BY 1) SELECT event_id, folded_into FROM r JOIN o USING (agent) WHERE event_id <> folded_into""")
def report_fold(spark, sf_dir):
    cited = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.col("l_suppkey").alias("source_id"))
    calls = table(spark, sf_dir, "supplier").where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("source_id"), (F.col("s_suppkey") % 3).alias("agent"))
    outcomes = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 3).alias("agent"), F.col("o_orderdate").alias("at"))
    return ops.folded_reports(cited, calls, outcomes)


@query("join08_fork_links", f"""WITH {STEPS}, r AS (SELECT id, session_id, tm FROM st WHERE hint = 'prompt'), f AS (SELECT session_id, session_id - 1 AS parent_id, min(tm) AS point_at FROM st WHERE session_id % 2 = 1 GROUP BY 1, 2),
 a AS (SELECT session_id, arg_min(id, struct_pack(a := tm, i := id)) AS to_id FROM r GROUP BY 1), b AS (SELECT f.session_id, arg_max(r.id, struct_pack(a := r.tm, i := r.id)) AS from_id FROM f JOIN r ON r.session_id = f.parent_id AND r.tm <= f.point_at GROUP BY 1) SELECT from_id, to_id FROM a JOIN b USING (session_id)""")
def fork_links(spark, sf_dir):
    rows = steps(spark, sf_dir)
    forks = rows.where("session_id % 2 = 1").groupBy("session_id").agg(F.min("at").alias("point_at")).withColumn("parent_id", F.col("session_id") - 1)
    return ops.fork_links(forks, rows.where("hint = 'prompt'").select("id", "session_id", "at"))


@query("join05_verified_subagents", f"WITH {STEPS} SELECT DISTINCT session_id AS agent, key AS call_id FROM st a WHERE hint = 'read' AND key IN (SELECT key FROM st WHERE hint = 'prompt') AND (session_id, key) IN (SELECT session_id, key FROM st WHERE hint = 'test')")
def verified_subagents(spark, sf_dir):
    rows = steps(spark, sf_dir).select(F.col("session_id").alias("agent"), F.col("key").alias("call_id"), "hint")
    return ops.verified_links(rows.where("hint = 'read'").select("agent", "call_id").distinct(), rows.where("hint = 'prompt'"), rows.where("hint = 'test'"))


@query("prj12_notes_account", f"""WITH {STEPS}, nt AS (SELECT session_id, CASE WHEN session_id % 2 = 0 THEN min(tm) + INTERVAL 5 DAY END AS since FROM st WHERE session_id % 3 = 0 GROUP BY session_id), tl AS (SELECT session_id, min(tm) + INTERVAL 10 DAY AS tail_start, min(tm) + INTERVAL 12 DAY AS tail_end FROM st WHERE session_id % 6 = 0 GROUP BY session_id),
 o AS (SELECT st.id, tm, CASE WHEN a.session_id IS NOT NULL THEN st.session_id WHEN b.session_id IS NOT NULL THEN st.session_id - 1 END AS owner, CASE WHEN a.session_id IS NOT NULL THEN a.since ELSE b.since END AS since FROM st LEFT JOIN nt a ON a.session_id = st.session_id LEFT JOIN nt b ON b.session_id = st.session_id - 1)
 SELECT id, owner IS NOT NULL AND NOT coalesce(tm > tail_start AND tm <= tail_end, false) AND (since IS NULL OR tm >= since) AS in_notes FROM o LEFT JOIN tl ON tl.session_id = owner""")
def notes_account(spark, sf_dir):
    rows = steps(spark, sf_dir).withColumn("parent_id", F.col("session_id") - 1)
    first = rows.groupBy("session_id").agg(F.min("at").alias("first"))
    noted = first.where("session_id % 3 = 0").select("session_id", F.when(F.col("session_id") % 2 == 0, F.expr("first + INTERVAL 5 DAY")).alias("since"))
    tails = first.where("session_id % 6 = 0").select("session_id", F.expr("first + INTERVAL 10 DAY").alias("tail_start"), F.expr("first + INTERVAL 12 DAY").alias("tail_end"))
    return ops.accounted(rows, noted, tails).select("id", "in_notes")


@query("agg13_authoring_rollup", "SELECT l_orderkey AS event_id, string_agg(DISTINCT p_brand || '/' || p_size % 3, ',' ORDER BY p_brand || '/' || p_size % 3) AS agents FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1")
def authoring_rollup(spark, sf_dir):
    agents = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("source_id"), F.col("p_brand").alias("model"), (F.col("p_size") % 3).cast("string").alias("effort"))
    found = ops.authoring(_citations(spark, sf_dir), agents)
    return found.select("event_id", F.array_join(F.transform("agents", lambda x: F.concat(x["model"], F.lit("/"), x["effort"])), ",").alias("agents"))


_HINT = "CASE WHEN p_size % 4 < 2 THEN 'test' WHEN p_size % 4 = 2 THEN 'read' ELSE 'edit' END"


def _hints(spark, sf_dir):
    size = F.col("p_size") % 4
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("source_id"), F.when(size < 2, "test").when(size == 2, "read").otherwise("edit").alias("hint"), (F.col("p_size") % 8 == 3).alias("doc"))


@query("agg14_event_steps", f"WITH h AS (SELECT p_partkey AS source_id, {_HINT} AS hint, p_size % 8 = 3 AS doc FROM part) SELECT l_orderkey AS event_id, CASE WHEN bool_and(hint = 'test') THEN 'check' WHEN bool_and(hint = 'edit' AND doc) THEN 'doc' END AS step FROM lineitem JOIN h ON source_id = l_partkey GROUP BY 1")
def event_steps(spark, sf_dir):
    return ops.step_of_events(_citations(spark, sf_dir), _hints(spark, sf_dir))


@query("agg12_style_counts", f"WITH h AS (SELECT p_partkey AS source_id, {_HINT} AS hint FROM part), r AS (SELECT l_orderkey AS id, bool_and(hint = 'read') AS reads FROM lineitem JOIN h ON source_id = l_partkey GROUP BY 1) SELECT count(*) AS events, round_even(avg(length(o_orderpriority)), 4) AS mean_title, count(*) FILTER (length(o_orderpriority) > 8) AS over_limit, count(*) FILTER (reads) AS only_reads FROM orders LEFT JOIN r ON id = o_orderkey")
def style_counts(spark, sf_dir):
    events = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"))
    return ops.style(events, _citations(spark, sf_dir), _hints(spark, sf_dir), limit=8)


@query("agg17_error_kinds", "SELECT kind, count(*) AS n FROM (SELECT unnest(string_split('bad quote: ' || o_orderkey || '; ' || CASE o_orderstatus WHEN 'F' THEN 'Unknown event' WHEN 'O' THEN 'x9: y' ELSE 'Unknown event; bad quote' END, '; ')) AS part FROM orders) CROSS JOIN LATERAL (SELECT trim(string_split(part, ':')[1]) AS kind) WHERE regexp_matches(kind, '^[A-Za-z][A-Za-z ]{2,60}$') GROUP BY kind")
def error_kinds(spark, sf_dir):
    message = F.concat(F.lit("bad quote: "), F.col("o_orderkey").cast("string"), F.lit("; "), F.when(F.col("o_orderstatus") == "F", "Unknown event").when(F.col("o_orderstatus") == "O", "x9: y").otherwise("Unknown event; bad quote"))
    return ops.error_kinds(table(spark, sf_dir, "orders").select(message.alias("message")), "message")


@query("set03_first_seen", "SELECT l_partkey AS id, min(l_orderkey) AS event_id, min(l_orderkey) AS pos FROM lineitem GROUP BY 1")
def first_seen(spark, sf_dir):
    nested = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("event_id")).agg(F.collect_set("l_partkey").alias("ids")).withColumn("pos", F.col("event_id"))
    return ops.first_seen(nested, "event_id", "ids", "pos")


@query("agg24_newest_version", "SELECT s_nationkey AS family, arg_max('m-' || s_suppkey % 12 || '.' || s_suppkey % 30, struct_pack(a := s_suppkey % 12, b := s_suppkey % 30)) AS slug FROM supplier GROUP BY 1")
def newest_version(spark, sf_dir):
    key = F.col("s_suppkey")
    names = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("family"), F.concat(F.lit("m-"), (key % 12).cast("string"), F.lit("."), (key % 30).cast("string")).alias("slug"))
    return ops.newest_version(names, "family", "slug")


@query("dt06_map_sums", "SELECT l_returnflag AS role, l_linestatus AS name, CAST(sum(l_linenumber) AS BIGINT) AS total FROM lineitem GROUP BY ALL")
def map_sums(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("role"), F.create_map("l_linestatus", "l_linenumber").alias("usage"))
    return ops.sum_maps(rows, "role", "usage")


@query("dt05_json_numbers", "SELECT event_id, CASE WHEN event_id % 4 < 2 THEN CAST(event_id % 4 + 0.5 * (event_id % 4) AS DOUBLE) END AS k FROM events")
def json_numbers(spark, sf_dir):
    texts = F.array(F.lit('{"k": 0}'), F.lit('{"k": 1.5}'), F.lit('{"k": true}'), F.lit('{"k": "3"}'))
    rows = table(spark, sf_dir, "events").select("event_id", F.get(texts, (F.col("event_id") % 4).cast("int")).alias("t"))
    return ops.numeric_fields(rows, "event_id", "t", ["k"])


@query("win08_poll_following", f"""WITH {STEPS}, l AS (SELECT r.id AS run_id, p.id, p.tm, p.status = 'observed_failure' AS exited FROM st r JOIN st p ON p.key = r.key AND p.session_id % 10 = r.session_id % 10 AND p.tm > r.tm WHERE r.hint = 'prompt' AND p.hint = 'test'),
 e AS (SELECT run_id, min(struct_pack(a := tm, i := id)) FILTER (exited) AS en FROM l GROUP BY 1) SELECT run_id AS id, count(*) AS n_polls, min(en.i) AS exit_id FROM l JOIN e USING (run_id) WHERE en IS NULL OR struct_pack(a := tm, i := id) <= en GROUP BY run_id""")
def poll_following(spark, sf_dir):
    rows = steps(spark, sf_dir).withColumn("handle", F.concat_ws("/", F.col("key").cast("string"), (F.col("session_id") % 10).cast("string")))
    followers = rows.where("hint = 'test'").select("id", "handle", "at", (F.col("status") == "observed_failure").alias("exited"))
    return ops.polls(rows.where("hint = 'prompt'"), followers)


@query("win13_out_of_order", f"WITH {STEPS}, w AS (SELECT session_id, min(tm) AS oldest FROM st WHERE id % 5 = 0 GROUP BY 1) SELECT id FROM st JOIN w USING (session_id) WHERE id % 5 <> 0 AND tm > oldest")
def out_of_order(spark, sf_dir):
    rows = steps(spark, sf_dir)
    return ops.out_of_order(rows.where("id % 5 <> 0"), rows.where("id % 5 = 0"))


@query("prj21_update_decisions", """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 = 0 THEN 'disabled' WHEN o_orderkey % 7 = 0 THEN 'self_run' WHEN o_orderkey % 5 = 0 THEN 'lock' WHEN o_orderkey % 3 = 0 THEN 'cooldown' WHEN o_orderkey % 10 >= 8 THEN 'daily_cap' WHEN o_orderkey % 4 = 3 THEN 'failing' WHEN o_orderkey % 2 = 0 THEN 'nothing_pending' ELSE 'run' END AS decision FROM orders""")
def update_decisions(spark, sf_dir):
    key = F.col("o_orderkey")
    now = F.expr("TIMESTAMP '2024-02-01 00:00:00'")
    last = F.when(key % 3 == 0, F.expr("TIMESTAMP '2024-01-31 23:59:00'")).otherwise(F.expr("TIMESTAMP '2024-01-01 00:00:00'"))
    state = F.struct((key % 11 != 0).alias("enabled"), (key % 7 == 0).alias("self_run"), (key % 5 == 0).alias("locked"), last.alias("last_start"), F.lit(600).alias("cooldown_s"), (key % 10).alias("runs_today"), F.lit(8).alias("daily_cap"), (key % 4).alias("failures"), F.lit(3).alias("most_failures"), (key % 2).alias("pending"))
    return table(spark, sf_dir, "orders").select(key.alias("id"), ops.decide(state, now).alias("decision"))


@query("sort08_tails_first", "SELECT l_orderkey AS unit_id, bool_or(l_linenumber = 7) AS is_tail, min(l_partkey) AS pos FROM lineitem GROUP BY 1")
def tails_first(spark, sf_dir):
    return ops.tails_first(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("unit_id"), (F.col("l_linenumber") == 7).alias("is_tail"), F.col("l_partkey").alias("pos")))


_FAULTS = f"WITH {GRAPH}, bad AS (SELECT DISTINCT from_id AS id FROM ed WHERE basis = 'inferred'), kept AS (SELECT id FROM ev WHERE id NOT IN (SELECT id FROM bad))"


@query("set07_salvage", f"{_FAULTS} SELECT relation, count(*) AS n FROM ed WHERE from_id IN (SELECT id FROM kept) AND to_id IN (SELECT id FROM kept) GROUP BY relation")
def salvage(spark, sf_dir):
    events = graph_events(spark, sf_dir)
    edges = graph_edges(events)
    _, stay = ops.salvaged(events, edges.where("basis = 'inferred'").select(F.col("from_id").alias("id")), edges)
    return stay.groupBy("relation").agg(F.count("*").alias("n"))


@query("set01_delta_apply", """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 = 0 THEN 'new title' ELSE o_orderpriority END AS title, CASE WHEN o_orderkey % 10 = 1 THEN 'X' ELSE o_orderstatus END AS status, CAST(CASE WHEN o_orderkey % 10 = 1 OR o_orderkey % 10 = 0 THEN 2 ELSE 1 END AS BIGINT) AS n_evidence FROM orders WHERE o_orderkey % 10 <> 9
 UNION ALL SELECT o_orderkey, 'added', 'A', 1 FROM orders WHERE o_orderkey % 10 = 9""")
def delta_apply(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    events = orders.where(key % 10 != 9).select(key.alias("id"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("status"), F.array(F.lit("old")).alias("evidence"))
    delta = orders.where(key % 10 == 0).select(key.alias("id"), F.lit("update").alias("action"), F.lit("new title").alias("title"), F.lit(None).cast("string").alias("status"), F.array(F.lit("more")).alias("evidence"))
    delta = delta.union(orders.where(key % 10 == 1).select(key, F.lit("update"), F.lit(None).cast("string"), F.lit("X"), F.array(F.lit("old"), F.lit("more"))))
    delta = delta.union(orders.where(key % 10 == 9).select(key, F.lit("add"), F.lit("added"), F.lit("A"), F.array(F.lit("own"))))
    return ops.apply_delta(events, delta).select("id", "title", "status", F.size("evidence").cast("bigint").alias("n_evidence"))


def _story(spark, sf_dir):
    events = graph_events(spark, sf_dir)
    full = events.select("id", "pos", "session_id", "at", "kind", "status", "actor", F.lit(None).cast("bigint").alias("delegated_by"), F.lit(True).alias("tool_based"))
    return full, graph_edges(events).withColumn("origin", F.lit(None).cast("string"))


@query("grf03_story_boxes", f"""WITH {GRAPH}, ca AS (SELECT DISTINCT from_id AS id FROM ed WHERE active AND relation IN ('motivates', 'revises', 'answers', 'produces')), ck AS (SELECT from_id, to_id FROM ed WHERE active AND relation = 'verifies'),
 ps AS (SELECT DISTINCT from_id FROM ck JOIN ev ON ev.id = to_id WHERE status = 'observed_success'), ow AS (SELECT DISTINCT to_id AS id FROM ck WHERE from_id IN (SELECT from_id FROM ps))
 SELECT id FROM ev WHERE actor = 'user' OR kind IN ('question', 'goal', 'proposal', 'decision', 'revision') OR (kind = 'outcome' AND status = 'observed_failure' AND id NOT IN (SELECT id FROM ca) AND id NOT IN (SELECT id FROM ow))""")
def story_boxes(spark, sf_dir):
    return stories.boxes(*_story(spark, sf_dir))


@query("grf03_story_view", f"""WITH RECURSIVE {GRAPH}, se AS (SELECT ev.id, ev.session_id, ev.kind, ev.status, ev.actor, ev.tm, CASE WHEN ev.kind = 'action' AND ev.id % 9 = 0 THEN seen.action END AS del FROM ev JOIN seen ON seen.id = ev.id),
 act AS (SELECT from_id, to_id, relation FROM ed WHERE active), ca AS (SELECT DISTINCT from_id AS id FROM act WHERE relation IN ('motivates', 'revises', 'answers', 'produces')), ck AS (SELECT from_id, to_id FROM act WHERE relation = 'verifies'),
 ps AS (SELECT DISTINCT from_id FROM ck JOIN se ON se.id = to_id WHERE status = 'observed_success'), ow AS (SELECT DISTINCT to_id AS id FROM ck WHERE from_id IN (SELECT from_id FROM ps)),
 bx AS (SELECT id, session_id, tm FROM se WHERE actor = 'user' OR (del IS NULL AND kind IN ('question', 'goal', 'proposal', 'decision', 'revision')) OR (kind = 'outcome' AND status = 'observed_failure' AND id NOT IN (SELECT id FROM ca) AND id NOT IN (SELECT id FROM ow))),
 src AS (SELECT act.to_id AS id, bx.id AS box FROM act JOIN bx ON bx.id = act.from_id QUALIFY row_number() OVER (PARTITION BY act.to_id ORDER BY bx.tm, bx.id) = 1), tgt AS (SELECT act.from_id AS id, bx.id AS box FROM act JOIN bx ON bx.id = act.to_id QUALIFY row_number() OVER (PARTITION BY act.from_id ORDER BY bx.tm, bx.id) = 1),
 fst AS (SELECT session_id, id AS box FROM bx QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY tm, id) = 1), lst AS (SELECT session_id, id AS box FROM se QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY tm DESC, id DESC) = 1),
 own AS (SELECT se.*, bx.id IS NOT NULL AS is_box, last_value(bx.id IGNORE NULLS) OVER (PARTITION BY se.session_id ORDER BY se.tm, se.id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS near FROM se LEFT JOIN bx ON bx.id = se.id),
 o AS (SELECT own.id, own.session_id, own.status, own.del, own.is_box, CASE WHEN own.is_box THEN own.id ELSE coalesce(src.box, tgt.box, own.near, fst.box) END AS box FROM own LEFT JOIN src ON src.id = own.id LEFT JOIN tgt ON tgt.id = own.id LEFT JOIN fst ON fst.session_id = own.session_id),
 f AS (SELECT id, box FROM o WHERE del IS NULL OR is_box UNION ALL SELECT o.id, coalesce(f.box, o.box) FROM f JOIN o ON o.del = f.id AND NOT o.is_box)
 SELECT coalesce(f.box, lst.box) AS box, count(*) AS n_events, count(*) FILTER (WHERE o.status = 'observed_failure') AS n_failed, count(*) FILTER (WHERE o.status = 'observed_success') AS n_passed, count(o.del) AS n_agents FROM f JOIN o ON o.id = f.id JOIN lst ON lst.session_id = o.session_id GROUP BY 1""")
def story_view(spark, sf_dir):
    """Every ninth action was delegated by the action before it, some of these by delegated ones."""
    events, edges = _story(spark, sf_dir)
    order = Window.partitionBy("session_id").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(F.when(F.col("kind") == "action", F.col("id")), ignorenulls=True).over(order)
    return stories.story(events.withColumn("delegated_by", F.when((F.col("kind") == "action") & (F.col("id") % 9 == 0), before)), edges)


#: Quotes of every text, by its length modulo 4: as they stand, with doubled spaces, and words that stand nowhere.
_QUOTES = r"""q AS (SELECT doc_id, text, length(text) % 4 AS way, CASE WHEN length(text) >= 400 THEN substr(text, 101, 200) ELSE coalesce(text, '') END AS base FROM documents),
 h AS (SELECT doc_id, way, base, len(regexp_extract_all(regexp_replace(text, '\s+', ' ', 'g'), regexp_escape(trim(regexp_replace(base, '\s+', ' ', 'g'))))) AS loose FROM q)"""


@query("strf07_quote_resolution", f"""WITH {_QUOTES} SELECT doc_id AS quote_id, CASE WHEN base = '' OR way IN (2, 3) THEN 'none' WHEN way = 0 OR (way = 1 AND NOT contains(base, ' ')) THEN 'exact' WHEN way = 1 AND loose = 1 THEN 'white space' WHEN way = 1 THEN 'ambiguous' ELSE 'none' END AS mode FROM h WHERE length(base) >= 8 OR base = ''""")
def quote_resolution(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("way", F.length("text") % 4).withColumn("base", F.when(F.length("text") >= 400, F.substring("text", 101, 200)).otherwise(F.coalesce("text", F.lit("")))).where("length(base) >= 8 OR base = ''")
    quote = F.when(F.col("way") == 0, F.col("base")).when(F.col("way") == 1, F.replace("base", F.lit(" "), F.lit("  "))).otherwise(F.when(F.col("base") == "", "").otherwise("words that stand nowhere at all"))
    resolved = quotes.resolve_quotes(docs.select(F.col("doc_id").alias("quote_id"), quote.alias("quote"), "text"))
    return resolved.select("quote_id", "mode")


#: A quote made of every text and its id, planted below the whole text in one of sixteen ways; lines of the text before it are counted.
_PLANTED = r"""b AS (SELECT doc_id, coalesce(text, '') AS t, doc_id % 16 AS way, '[' || doc_id || '] ' || substr(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9]+', ' ', 'g'), 1, 60) || ' stands here' AS q, length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) + 2 AS n FROM documents)"""


@query("strf07_quote_views", f"""WITH {_PLANTED} SELECT doc_id AS quote_id, CASE way WHEN 0 THEN 'inside' WHEN 1 THEN 'same lines' WHEN 2 THEN 'diff hunk' WHEN 3 THEN 'close repeats' WHEN 4 THEN 'refused: several' WHEN 5 THEN 'decoded inside' WHEN 6 THEN 'unescaped inside' WHEN 7 THEN 'white space' WHEN 8 THEN 'ellipsis'
  WHEN 9 THEN 'tail' WHEN 10 THEN 'refused: not found' WHEN 11 THEN 'short' WHEN 12 THEN 'refused: short' WHEN 13 THEN 'decoded diff hunk' WHEN 14 THEN 'decoded same lines' ELSE 'unescaped close repeats' END AS mode,
 CASE WHEN way IN (4, 10, 12) THEN NULL ELSE n END AS first_line, CASE WHEN way IN (4, 10, 12) THEN NULL WHEN way IN (2, 13, 15) THEN n + 1 WHEN way IN (3, 8) THEN n + 2 ELSE n END AS last_line, CAST(CASE WHEN way = 10 THEN 0 WHEN way IN (1, 2, 3, 4, 8, 12, 13, 14, 15) THEN 2 ELSE 1 END AS BIGINT) AS n_hits FROM b""")
def quote_views_query(spark, sf_dir):
    from ..operators import quote_views

    text, way = F.coalesce("text", F.lit("")), F.col("doc_id") % 16
    name = F.concat(F.lit("["), F.col("doc_id").cast("string"), F.lit("] "))
    q = F.concat(name, F.substring(F.regexp_replace(text, "[^A-Za-z0-9]+", " "), 1, 60), F.lit(" stands here"))
    cat, said = F.concat, cat_quoted(q, '"')
    hidden, short = cat_quoted(q, '\\"'), cat(F.lit("§"), F.col("doc_id") % 100, F.lit("§"))
    below = [cat(F.lit("before "), q, F.lit(" after")), cat(q, F.lit(" and "), q), cat(F.lit("-"), q, F.lit("\n+"), q), cat(q, F.lit("\nbetween\n"), q), cat(q, F.lit("\nx\ny\nz\n"), q), hidden, said, q, cat(q, F.lit("\nskipped\nlast words of it")), q, F.lit("nothing"), cat(F.lit("a "), short, F.lit(" b")), cat(short, F.lit(" "), short), cat(F.lit("-"), hidden, F.lit("\n+"), hidden), cat(hidden, F.lit(" "), hidden), cat(said, F.lit("\n"), said)]
    asked = [q] * 5 + [said, hidden, F.replace(q, F.lit(" "), F.lit("  ")), cat(q, F.lit(" ... last words of it")), cat(q, F.lit(" more")), F.lit("words that stand nowhere at all"), short, short, said, said, hidden]
    pick = lambda cases: F.get(F.array(*cases), way.cast("int"))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("quote_id"), F.col("doc_id").alias("region_id"), pick(asked).alias("quote"), F.lit(True).alias("close"), cat(text, F.lit("\n"), pick(below)).alias("text"))
    return quote_views.resolve_in_regions(rows.select("quote_id", "region_id", "quote", "close"), rows.select("region_id", "text")).drop("spans")


def cat_quoted(q, mark: str):
    return F.concat(F.lit(f"say {mark}"), q, F.lit(f"{mark} now"))


@query("udf01_model_claims", "SELECT CASE role WHEN 'user' THEN 'question' ELSE 'outcome' END AS kind, count(*) AS n FROM conversations GROUP BY 1")
def model_claims(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("unit_id")).agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("lines"))
    units = turns.select("unit_id", F.to_json(F.struct("lines")).alias("request"))
    return model_call.claims(model_call.ask(units)).groupBy("kind").agg(F.count("*").alias("n"))
