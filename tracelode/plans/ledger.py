"""Queries on ledgers: orders are work units, line items their calls, parts a file manifest."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ledger as ops
from .bindings import table
from .registry import query

_CALLS = "cl AS (SELECT l_orderkey AS unit_id, l_returnflag AS role, l_linestatus AS status, CASE WHEN l_linenumber <> 7 THEN CAST(round(l_quantity) AS BIGINT) END AS tokens_in, CASE WHEN l_suppkey % 9 <> 0 THEN CAST(round(l_extendedprice) AS BIGINT) END AS tokens_out, CASE WHEN l_linenumber % 2 = 0 THEN CAST(round(l_extendedprice * 100) AS BIGINT) END AS cost FROM lineitem)"


def _calls(spark, sf_dir):
    n = F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("unit_id"), F.col("l_returnflag").alias("role"), F.col("l_linestatus").alias("status"), F.when(n != 7, F.round("l_quantity").cast("bigint")).alias("tokens_in"), F.when(F.col("l_suppkey") % 9 != 0, F.round("l_extendedprice").cast("bigint")).alias("tokens_out"), F.when(n % 2 == 0, F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("cost"))


@query("agg04_token_totals", f"WITH {_CALLS} SELECT count(*) FILTER (tokens_in IS NOT NULL AND tokens_out IS NOT NULL) AS reported, CAST(sum(tokens_in) FILTER (tokens_out IS NOT NULL) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) FILTER (tokens_in IS NOT NULL) AS BIGINT) AS tokens_out, CAST(sum(cost) AS BIGINT) AS cost FROM cl")
def token_totals(spark, sf_dir):
    return ops.token_totals(_calls(spark, sf_dir), "tokens_in", "tokens_out", "cost")


@query("agg05_call_summary", f"""WITH {_CALLS} SELECT 'role' AS dimension, role AS value, count(*) AS n, CAST(sum(tokens_in) AS BIGINT) AS tokens, CAST(sum(cost) AS BIGINT) AS cost FROM cl GROUP BY role
 UNION ALL SELECT 'status', status, count(*), CAST(sum(tokens_in) AS BIGINT), CAST(sum(cost) AS BIGINT) FROM cl GROUP BY status""")
def call_summary(spark, sf_dir):
    return ops.call_summary(_calls(spark, sf_dir), ["role", "status"], "tokens_in", "cost")


@query("agg07_plan_figures", """WITH u AS (SELECT o_orderkey AS pos, 1 + o_orderkey % 3 AS calls, CAST(floor(o_totalprice) AS BIGINT) AS chars, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders),
 s AS (SELECT n, sum(calls) OVER (ORDER BY n) AS calls, sum(calls * 30000 + chars / 4) OVER (ORDER BY n) AS tokens FROM u WHERE n <= 30) SELECT n, CAST(calls AS BIGINT) AS calls, CAST(floor(tokens) AS BIGINT) AS tokens, CAST(ceil(tokens / 15000) AS BIGINT) AS minutes FROM s WHERE n IN (5, 15, 30)""")
def plan_figures(spark, sf_dir):
    units = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos"), (1 + F.col("o_orderkey") % 3).cast("bigint").alias("calls"), F.floor("o_totalprice").cast("bigint").alias("chars"))
    return ops.plan_figures(units)


@query("agg06_calibration", f"WITH {_CALLS}, u AS (SELECT unit_id, sum(tokens_in) AS actual FROM cl GROUP BY 1 HAVING bool_and(tokens_in IS NOT NULL)) SELECT count(*) AS units, round_even(CAST(sum(actual) AS DOUBLE) / CAST(sum(CAST(floor(o_totalprice / 1000) AS BIGINT)) AS DOUBLE), 4) AS ratio FROM u JOIN orders ON o_orderkey = unit_id")
def calibration(spark, sf_dir):
    units = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("unit_id"), F.floor(F.col("o_totalprice") / 1000).cast("bigint").alias("estimated"))
    return ops.calibration(units, _calls(spark, sf_dir).select("unit_id", F.col("tokens_in").alias("tokens")))


@query("join16_pending_anti", "SELECT o_orderkey AS source_id FROM orders WHERE o_custkey % 10 <> 0 AND (o_orderkey % 4 = 0 OR o_orderstatus <> 'F')")
def pending_records(spark, sf_dir):
    key = F.col("o_orderkey")
    done = F.when(key % 4 != 0, F.when(F.col("o_orderstatus") == "F", F.md5(key.cast("string"))).otherwise("old"))
    rows = table(spark, sf_dir, "orders").select(key.alias("source_id"), F.md5(key.cast("string")).alias("content_hash"), done.alias("processed_hash"), (F.col("o_custkey") % 10 != 0).alias("available"))
    return ops.pending(rows).select("source_id")


@query("join19_held_failures", """WITH u AS (SELECT l_orderkey AS unit_id, l_partkey AS source_id, CASE WHEN l_partkey % 40 = 0 AND l_suppkey % 2 = 0 THEN 'new' ELSE 'h' || l_partkey END AS content_hash FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F'),
 r AS (SELECT p_partkey AS source_id, 'h' || p_partkey AS content_hash, p_size <> 13 AS available FROM part) SELECT unit_id FROM u LEFT JOIN r USING (source_id) GROUP BY unit_id HAVING bool_and(coalesce(r.content_hash = u.content_hash AND available, false))""")
def held_failures(spark, sf_dir):
    failed = F.when(F.col("o_orderstatus") == "F", "failed").otherwise("done")
    changed = (F.col("l_partkey") % 40 == 0) & (F.col("l_suppkey") % 2 == 0)
    units = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("l_orderkey").alias("unit_id"), failed.alias("status"), F.col("l_partkey").alias("source_id"), F.when(changed, "new").otherwise(F.concat(F.lit("h"), "l_partkey")).alias("content_hash"))
    now = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("source_id"), F.concat(F.lit("h"), "p_partkey").alias("content_hash"), (F.col("p_size") != 13).alias("available"))
    return ops.held_units(units, now)


@query("snk02_record_upsert", """WITH o AS (SELECT p_partkey AS id, p_size AS h FROM part WHERE p_partkey % 6 <> 0), n AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN p_size + 1 ELSE p_size END AS h FROM part WHERE p_partkey % 7 <> 0)
 SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'insert' WHEN n.id IS NULL THEN 'missing' WHEN o.h = n.h THEN 'unchanged' ELSE 'update' END AS action FROM o FULL JOIN n ON o.id = n.id""")
def record_upsert(spark, sf_dir):
    key = F.col("p_partkey")
    part = table(spark, sf_dir, "part")
    before = part.where(key % 6 != 0).select(key.alias("id"), F.col("p_size").alias("content_hash"))
    now = part.where(key % 7 != 0).select(key.alias("id"), F.when(key % 5 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("content_hash"))
    return ops.upsert_actions(before, now, "id")


@query("join17_file_diff", """WITH o AS (SELECT p_partkey AS path, p_size AS bytes, p_partkey % 3 AS mtime FROM part WHERE p_partkey % 6 <> 0), n AS (SELECT p_partkey AS path, p_size + p_partkey % 4 - 1 AS bytes, p_partkey % 3 + CAST(p_partkey % 8 = 0 AS INTEGER) AS mtime FROM part WHERE p_partkey % 7 <> 0)
 SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'deleted' WHEN o.bytes <> n.bytes OR o.mtime <> n.mtime THEN 'changed' ELSE 'same' END AS state,
 CAST(CASE WHEN o.path IS NULL THEN n.bytes WHEN n.path IS NULL THEN 0 WHEN n.bytes > o.bytes THEN n.bytes - o.bytes WHEN n.bytes < o.bytes OR o.mtime <> n.mtime THEN n.bytes ELSE 0 END AS BIGINT) AS bytes_to_read FROM o FULL JOIN n ON o.path = n.path""")
def file_diff(spark, sf_dir):
    key = F.col("p_partkey")
    part = table(spark, sf_dir, "part")
    index = part.where(key % 6 != 0).select(key.alias("path"), F.col("p_size").cast("bigint").alias("bytes"), (key % 3).alias("mtime"))
    listing = part.where(key % 7 != 0).select(key.alias("path"), (F.col("p_size") + key % 4 - 1).cast("bigint").alias("bytes"), (key % 3 + (key % 8 == 0).cast("int")).alias("mtime"))
    return ops.file_changes(listing, index)


@query("snk07_graph_cdc", """WITH o AS (SELECT o_orderkey AS id, o_orderstatus AS s, o_totalprice AS p FROM orders WHERE o_orderkey % 9 <> 0), n AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS s, CASE WHEN o_orderkey % 8 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS p FROM orders WHERE o_orderkey % 11 <> 0)
 SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' WHEN n.s = 'X' THEN 'invalidated' ELSE 'updated' END AS change FROM o FULL JOIN n ON o.id = n.id WHERE o.id IS NULL OR n.id IS NULL OR n.s <> o.s OR n.p <> o.p""")
def graph_cdc(spark, sf_dir):
    key = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders")
    old = orders.where(key % 9 != 0).select(key.alias("id"), F.col("o_orderstatus").alias("s"), F.col("o_totalprice").alias("p"))
    new = orders.where(key % 11 != 0).select(key.alias("id"), F.when(key % 5 == 0, "X").otherwise(F.col("o_orderstatus")).alias("s"), F.when(key % 8 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("p"))
    return ops.version_changes(old, new, "id", closed=F.col("s") == "X")


@query("agg16_field_changes", "SELECT 's' AS field, count(*) FILTER (o_orderkey % 5 = 0) AS n FROM orders WHERE o_orderkey % 9 <> 0 UNION ALL SELECT 'p', count(*) FILTER (o_orderkey % 8 = 0) FROM orders WHERE o_orderkey % 9 <> 0")
def field_changes(spark, sf_dir):
    key = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders")
    old = orders.where(key % 9 != 0).select(key.alias("id"), F.col("o_orderstatus").alias("s"), F.col("o_totalprice").alias("p"))
    new = orders.select(key.alias("id"), F.when(key % 5 == 0, "X").otherwise(F.col("o_orderstatus")).alias("s"), F.when(key % 8 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("p"))
    return ops.field_changes(old, new, "id")


@query("agg23_comparison_pivot", "SELECT l_returnflag AS measure, CAST(sum(l_linenumber) FILTER (l_linestatus = 'F') AS BIGINT) AS F, CAST(sum(l_linenumber) FILTER (l_linestatus = 'O') AS BIGINT) AS O FROM lineitem GROUP BY 1")
def comparison_pivot(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("measure"), "l_linestatus", "l_linenumber")
    return ops.comparison(rows, "measure", "l_linestatus", "l_linenumber", ["F", "O"])


@query("agg18_focus_union", """WITH p AS (SELECT l_orderkey AS id, CAST(l_partkey % 200 AS BIGINT) AS s, CAST(l_partkey % 200 + 10 + l_linenumber AS BIGINT) AS e FROM lineitem),
 m AS (SELECT *, max(e) OVER (PARTITION BY id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM p), g AS (SELECT *, sum(CAST(top IS NULL OR s > top AS INTEGER)) OVER (PARTITION BY id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM m),
 u AS (SELECT id, k, min(s) AS s, max(e) AS e FROM g GROUP BY id, k) SELECT id, string_agg(s || '-' || e, ',' ORDER BY s) AS spans FROM u GROUP BY id""")
def focus_union(spark, sf_dir):
    from ..functions.text import merge_spans

    start = (F.col("l_partkey") % 200).cast("bigint")
    spans = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(F.struct(start.alias("s"), (start + 10 + F.col("l_linenumber")).cast("bigint").alias("e"))).alias("spans"))
    shown = F.array_join(F.transform(merge_spans(F.col("spans")), lambda x: F.concat(x["s"].cast("string"), F.lit("-"), x["e"].cast("string"))), ",")
    # An order whose lines name no part has no span, and null for their list.
    return spans.select("id", F.nullif(shown, F.lit("")).alias("spans"))


@query("sort02_open_items", """WITH r AS (SELECT l_orderkey AS item_id, max(l_shipdate) AS last_at, count(*) AS n FROM lineitem GROUP BY 1) SELECT o_orderkey AS item_id, last_at, coalesce(n, 0) AS n_events FROM orders LEFT JOIN r ON item_id = o_orderkey WHERE o_orderstatus = 'O'""")
def open_items(spark, sf_dir):
    from ..operators.texts import open_items as op

    items = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id"), F.when(F.col("o_orderstatus") == "O", "open").otherwise("resolved").alias("status"))
    return op(items, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item_id"), F.col("l_shipdate").alias("at")))


#: Rows that one task sorts, about.
TASK_ROWS = 1 << 17


def parts_of(rows: int) -> int:
    """Parts of about TASK_ROWS rows each."""
    return max(1, -(-rows // TASK_ROWS))


@query("join12_duplicate_match", """WITH s AS (SELECT o_orderkey AS id, o_orderstatus AS kind, list_sort(list_distinct(list(l_partkey % 5))) AS c FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL), f AS (SELECT kind, c, min(id) AS twin FROM s GROUP BY ALL)
 SELECT id, twin FROM s JOIN f USING (kind, c) WHERE id <> twin""")
def duplicate_match(spark, sf_dir):
    """Both tables are dealt into as many parts as their rows need, so that a task's sort and sets do not grow with the tables."""
    from ..operators.texts import same_citations

    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    parts = parts_of(items.count())
    cited = orders.repartition(parts, "o_orderkey").join(items.repartition(parts, "l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("kind"), (F.col("l_partkey") % 5).alias("source_id"))
    return same_citations(cited)


@query("src15_source_summary", "SELECT 'codex' AS provider, count(DISTINCT s_nationkey) AS n_files, count(DISTINCT s_nationkey) FILTER (s_suppkey % 2 = 0) AS n_with_records, count(*) FILTER (s_suppkey % 2 = 0) AS n_records FROM supplier UNION ALL SELECT 'claude', 0, 0, 0")
def source_summary(spark, sf_dir):
    from ..sources.transcripts import source_summary as op

    rows = table(spark, sf_dir, "supplier").select(F.lit("codex").alias("provider"), F.col("s_nationkey").alias("file"), F.col("s_suppkey").alias("k"))
    return op(rows.where("k % 2 = 0"), rows, ["codex", "claude"])


_WORDS = ", ".join(f"CAST(sum(CAST('0x' || substr(h, {1 + 15 * k}, 15) AS HUGEINT)) AS VARCHAR)" for k in range(4))


@query("agg21_snapshot_id", f"""WITH r AS (SELECT sha256(o_orderkey || chr(10) || md5(o_orderstatus)) AS h FROM orders), s AS (SELECT count(*) AS n, concat_ws(',', count(*), {_WORDS}) AS t FROM r) SELECT 'snap_' || substr(sha256(t), 1, 24) AS id, n FROM s""")
def snapshot_id(spark, sf_dir):
    return ops.snapshot_id(table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("source_id"), F.md5(F.col("o_orderstatus")).alias("content_hash")))
