"""Queries on the event graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as ops
from ..operators.ledger import version_changes
from .bindings import GRAPH, graph_edges, graph_events, table
from .registry import query


def _graph(spark, sf_dir):
    events = graph_events(spark, sf_dir)
    return events, graph_edges(events)


_REL = f"""WITH {GRAPH}, chk AS (SELECT d.from_id AS id, count(*) FILTER (o.status = 'observed_success') AS passed, count(*) FILTER (o.status = 'observed_failure') AS failed, count(*) AS n, arg_min(o.title, d.id) AS title
  FROM ed d JOIN ev o ON o.id = d.to_id WHERE d.active AND d.relation = 'verifies' GROUP BY 1),
 lv AS (SELECT from_id AS id, bool_or(relation = 'answers') AS answered, bool_or(relation <> 'answers') AS followed FROM ed WHERE active GROUP BY 1),
 un AS (SELECT id FROM ev WHERE kind = 'outcome' AND status IN ('observed_success', 'observed_failure') AND id NOT IN (SELECT to_id FROM ed WHERE active)),
 rl AS (SELECT ev.*, coalesce(passed, 0) AS passed, coalesce(failed, 0) AS failed, coalesce(n, 0) AS n, chk.title AS check_title, coalesce(answered, false) AS answered, coalesce(followed, false) AS followed, un.id IS NOT NULL AS unlinked
  FROM ev LEFT JOIN chk ON chk.id = ev.id LEFT JOIN lv ON lv.id = ev.id LEFT JOIN un ON un.id = ev.id)"""
_WORD = "CASE status WHEN 'adopted' THEN 'adopted' WHEN 'asked' THEN 'asked' WHEN 'applied' THEN 'applied' WHEN 'observed_success' THEN 'passed' ELSE 'failed' END"
_CHANGE = "kind IN ('action', 'revision') AND status IN ('applied', 'reported_complete', 'observed_success')"


@query("grf11_status_labels", f"""{_REL} SELECT id, CASE WHEN kind = 'question' THEN 'request · ' || CASE WHEN answered THEN 'answered' WHEN followed THEN 'no answer linked' ELSE 'nothing linked' END
 WHEN {_CHANGE} THEN CASE WHEN n = 1 THEN 'applied · ' || CASE WHEN passed > 0 THEN 'verified' ELSE 'check failed' END || ': ' || CASE WHEN length(check_title) > 40 THEN substr(check_title, 1, 39) || '…' ELSE check_title END
  ELSE 'applied · ' || CASE WHEN passed + failed = 0 THEN 'unverified' ELSE concat_ws(' · ', CASE WHEN passed > 0 THEN passed || ' checks passed' END, CASE WHEN failed > 0 THEN failed || ' checks failed' END) END END
 WHEN unlinked THEN {_WORD} || ' · not linked to what it checked' ELSE {_WORD} END AS label FROM rl""")
def status_labels(spark, sf_dir):
    return ops.status_labels(*_graph(spark, sf_dir)).select("id", "label")


@query("grf12_status_tones", f"""{_REL} SELECT id, CASE WHEN kind = 'question' THEN CASE WHEN answered THEN 'ok' ELSE 'plain' END WHEN {_CHANGE} THEN CASE WHEN failed > 0 THEN 'fail' WHEN n > 0 THEN 'ok' ELSE 'warn' END
 WHEN status = 'observed_failure' THEN 'fail' WHEN unlinked THEN 'warn' WHEN status = 'observed_success' THEN 'ok' ELSE 'plain' END AS tone FROM rl""")
def status_tones(spark, sf_dir):
    return ops.status_labels(*_graph(spark, sf_dir)).select("id", "tone")


@query("agg02_graph_summary", f"""{_REL} SELECT 'events' AS measure, count(*) AS value FROM rl UNION ALL SELECT 'changes_verified', count(*) FROM rl WHERE {_CHANGE} AND n > 0 UNION ALL SELECT 'changes_unverified', count(*) FROM rl WHERE {_CHANGE} AND n = 0
 UNION ALL SELECT 'observed_results_unlinked', count(*) FROM un UNION ALL SELECT 'revisions_unlinked', count(*) FROM rl WHERE kind = 'revision' UNION ALL SELECT 'questions_answered', count(*) FROM rl WHERE kind = 'question' AND answered
 UNION ALL SELECT 'questions_unanswered', count(*) FROM rl WHERE kind = 'question' AND NOT answered UNION ALL SELECT 'kind:' || kind, count(*) FROM ev GROUP BY kind UNION ALL SELECT 'status:' || status, count(*) FROM ev GROUP BY status
 UNION ALL SELECT 'relation:' || relation, count(*) FROM ed WHERE active GROUP BY relation""")
def graph_summary(spark, sf_dir):
    return ops.summary(*_graph(spark, sf_dir))


@query("agg03_verification_rollup", f"{_REL} SELECT id, passed, failed, n AS n_checks, title AS check_title FROM chk")
def verification_rollup(spark, sf_dir):
    return ops.checks_of_changes(*_graph(spark, sf_dir))


@query("agg03_unlinked_outcomes", f"{_REL} SELECT id FROM un")
def unlinked_outcomes(spark, sf_dir):
    return ops.unlinked_outcomes(*_graph(spark, sf_dir))


_TURNED = "(e.relation = 'verifies' AND a.kind = 'outcome' AND a.status IN ('observed_success', 'observed_failure') AND b.kind IN ('action', 'revision')) OR (e.relation = 'answers' AND b.kind = 'question' AND a.kind <> 'question')"
_ORIENTED = f"WITH {GRAPH}, o AS (SELECT e.id, CASE WHEN {_TURNED} THEN e.to_id ELSE e.from_id END AS from_id, CASE WHEN {_TURNED} THEN e.from_id ELSE e.to_id END AS to_id, e.relation, e.basis, e.active, {_TURNED} AS turned FROM ed e JOIN ev a ON a.id = e.from_id JOIN ev b ON b.id = e.to_id)"


@query("join10_relation_repair", f"{_ORIENTED} SELECT id, from_id, to_id, relation, turned FROM o")
def relation_repair(spark, sf_dir):
    events, edges = _graph(spark, sf_dir)
    return ops.oriented(edges, events).select("id", "from_id", "to_id", "relation", "turned")


@query("join11_endpoint_rules", f"""WITH {GRAPH} SELECT e.id, CASE WHEN relation = 'verifies' AND NOT (a.kind IN ('action', 'revision') AND b.kind = 'outcome' AND b.status IN ('observed_success', 'observed_failure')) THEN 'verifies must lead from a change to an observed outcome'
  WHEN relation = 'verifies' THEN 'verifies must not be inferred' ELSE 'answers must lead from a question' END AS fault FROM ed e JOIN ev a ON a.id = e.from_id JOIN ev b ON b.id = e.to_id
 WHERE e.active AND ((relation = 'verifies' AND (basis = 'inferred' OR NOT (a.kind IN ('action', 'revision') AND b.kind = 'outcome' AND b.status IN ('observed_success', 'observed_failure')))) OR (relation = 'answers' AND (a.kind <> 'question' OR b.kind = 'question')))""")
def endpoint_rules(spark, sf_dir):
    events, edges = _graph(spark, sf_dir)
    return ops.relation_faults(edges, events)


_FOLD = f"WITH {GRAPH}, fin AS (SELECT id, folded_into FROM ev WHERE folded_into IN (SELECT id FROM ev WHERE folded_into IS NULL))"


@query("set04_edge_rewire", f"""{_FOLD}, mv AS (SELECT e.id, coalesce(a.folded_into, e.from_id) AS from_id, coalesce(b.folded_into, e.to_id) AS to_id, relation, active FROM ed e LEFT JOIN fin a ON a.id = e.from_id LEFT JOIN fin b ON b.id = e.to_id),
 k AS (SELECT *, row_number() OVER (PARTITION BY from_id, to_id, relation, active ORDER BY id) AS n FROM mv WHERE from_id <> to_id) SELECT id, from_id, to_id, relation, active FROM k WHERE n = 1 OR NOT active""")
def edge_rewire(spark, sf_dir):
    return ops.folded_edges(*_graph(spark, sf_dir)).select("id", "from_id", "to_id", "relation", "active")


@query("grf04_folded_view", f"{_FOLD}, rc AS (SELECT folded_into AS id, count(*) AS n FROM fin GROUP BY 1) SELECT ev.id, session_id, kind, status, tm AS \"at\", coalesce(n, 0) AS n_received FROM ev LEFT JOIN rc ON rc.id = ev.id WHERE ev.id NOT IN (SELECT id FROM fin)")
def folded_view(spark, sf_dir):
    return ops.folded_events(graph_events(spark, sf_dir))


@query("grf09_linked_events", f"WITH {GRAPH}, b AS (SELECT from_id AS id, to_id AS other, 1 AS o, relation = 'verifies' AS c FROM ed WHERE active UNION ALL SELECT to_id, from_id, 0, false FROM ed WHERE active) SELECT id, CAST(sum(o) AS BIGINT) AS n_out, count(*) FILTER (o = 0) AS n_in, count(*) FILTER (c) AS n_checks, count(DISTINCT other) AS n_linked FROM b GROUP BY id")
def linked_events(spark, sf_dir):
    return ops.neighbours(_graph(spark, sf_dir)[1])


@query("grf01_connected_flows", """WITH RECURSIVE l AS (SELECT DISTINCT o_custkey AS a, o_custkey % 97 + 1000000 AS b FROM orders), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l), n AS (SELECT DISTINCT a AS id FROM e),
 r AS (SELECT id, id AS via FROM n UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.via) SELECT id, min(via) AS flow FROM r GROUP BY id""")
def connected_flows(spark, sf_dir):
    links = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("from_id"), (F.col("o_custkey") % 97 + 1_000_000).alias("to_id")).distinct()
    return ops.connected(links)


@query("grf02_session_closure", """WITH RECURSIVE c AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey // 5 * 5 WHEN o_orderkey % 35 <> 0 THEN o_orderkey // 35 * 35 END AS parent FROM orders),
 d AS (SELECT id AS root, id, 0 AS depth FROM c WHERE parent IS NULL UNION ALL SELECT d.root, c.id, d.depth + 1 FROM d JOIN c ON c.parent = d.id AND c.parent <> c.id) SELECT root, id, depth FROM d""")
def session_closure(spark, sf_dir):
    key = F.col("o_orderkey")
    parent = F.when(key % 5 != 0, F.floor(key / 5) * 5).when(key % 35 != 0, F.floor(key / 35) * 35)
    children = table(spark, sf_dir, "orders").select(key.alias("id"), parent.cast("bigint").alias("parent"))
    return ops.descendants(children, children.where("parent IS NULL"))


@query("win15_short_ids", """WITH i AS (SELECT DISTINCT sha256(CAST(doc_id AS VARCHAR)) AS t FROM documents), p AS (SELECT a.t, max(CASE WHEN b.t IS NULL THEN 0 ELSE list_max(list_transform(range(0, 65), lambda x: CASE WHEN substr(a.t, 1, x) = substr(b.t, 1, x) THEN x ELSE 0 END)) END) AS n
  FROM i a LEFT JOIN i b ON substr(a.t, 1, 3) = substr(b.t, 1, 3) AND a.t <> b.t GROUP BY a.t) SELECT 'ev_' || t AS id, 'ev_' || substr(t, 1, CAST(greatest(3, n + 1) AS INTEGER)) AS short_id FROM p""")
def short_ids(spark, sf_dir):
    return ops.short_ids(table(spark, sf_dir, "documents").select(F.concat(F.lit("ev_"), F.sha2(F.col("doc_id").cast("string"), 256)).alias("id")), least=3)


@query("join04_delegation_pairing", """WITH e AS (SELECT event_id AS id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS key, ts AS tm, event_type FROM events), c AS (SELECT * FROM e WHERE event_type = 'signup'),
 j AS (SELECT e.id, arg_max(c.id, struct_pack(a := c.tm, i := c.id)) FILTER (c.tm <= e.tm) AS before, arg_min(c.id, struct_pack(a := c.tm, i := c.id)) AS first FROM e JOIN c USING (key) WHERE e.event_type = 'error' GROUP BY e.id) SELECT id, coalesce(before, first) AS delegated_by FROM j""")
def delegation_pairing(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.get_json_object("props", "$.k").cast("bigint").alias("key"), F.col("ts").alias("at"), "event_type")
    return ops.delegated(rows.where("event_type = 'error'"), rows.where("event_type = 'signup'").withColumnRenamed("id", "call_id"))


@query("prj14_requests", f"WITH {GRAPH} SELECT session_id, count(*) AS n FROM ev WHERE actor = 'user' AND kind <> 'decision' GROUP BY session_id")
def requests(spark, sf_dir):
    events = graph_events(spark, sf_dir)
    return events.where(ops.is_request(F.col("actor"), F.col("kind"), F.col("status"), F.lit(False))).groupBy("session_id").agg(F.count("*").alias("n"))


@query("snk07_edge_delta", f"{_ORIENTED} SELECT id, CASE WHEN id % 23 = 0 THEN 'added' WHEN id % 19 = 0 THEN 'removed' ELSE 'updated' END AS change FROM o WHERE (id % 23 = 0 AND id % 19 <> 0) OR (id % 19 = 0 AND id % 23 <> 0) OR (id % 19 <> 0 AND id % 23 <> 0 AND turned AND from_id <> to_id)")
def edge_delta(spark, sf_dir):
    events, edges = _graph(spark, sf_dir)
    columns = ["id", "from_id", "to_id", "relation", "basis", "active"]
    return version_changes(edges.where("id % 23 <> 0").select(columns), ops.oriented(edges, events).where("id % 19 <> 0").select(columns), "id")
