"""Queries on sessions: turns, gaps, steps and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import one_line
from ..functions.times import ago, epoch_ms_to_iso, instant
from ..operators import ordered, records as rules
from ..operators import steps as ops
from ..operators import turns
from .bindings import RECORDS, STEPS, records, steps, table
from .registry import query

_TURNS = f"WITH {RECORDS}, t AS (SELECT *, sum(CAST(prompt AS BIGINT)) OVER (PARTITION BY session_id ORDER BY pos) AS turn FROM rec)"


@query("min00_session_rollup", f"{_TURNS} SELECT session_id, count(*) AS n_records, CAST(max(turn) AS BIGINT) AS n_turns, CAST(sum(length(content)) AS BIGINT) AS n_chars, count(*) FILTER (turn = 0) AS n_before, count(*) FILTER (role = 'assistant') AS n_answers FROM t GROUP BY session_id")
def session_rollup(spark, sf_dir):
    return turns.roll_up(records(spark, sf_dir))


@query("win01_turn_numbering", f"{_TURNS} SELECT source_id, session_id, pos, role, CAST(turn AS BIGINT) AS turn FROM t")
def turn_numbering(spark, sf_dir):
    return turns.number_turns(records(spark, sf_dir)).select("source_id", "session_id", "pos", "role", "turn")


@query("win02_request_turns", f"WITH {RECORDS} SELECT source_id, last_value(CASE WHEN prompt THEN source_id END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY pos) AS prompt_id FROM rec")
def request_turns(spark, sf_dir):
    return turns.link_prompts(records(spark, sf_dir)).select("source_id", "prompt_id")


@query("win07_next_written_block", f"WITH {RECORDS} SELECT source_id, first_value(CASE WHEN role = 'assistant' THEN source_id END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_id FROM rec")
def next_written_block(spark, sf_dir):
    return turns.next_written(records(spark, sf_dir)).select("source_id", "next_id")


@query("strf15_content_ids", f"WITH {RECORDS} SELECT source_id, sha256(content) AS content_hash FROM rec")
def content_ids(spark, sf_dir):
    return records(spark, sf_dir).select("source_id", F.sha2("content", 256).alias("content_hash"))


@query("strf16_one_line_titles", r"SELECT conv_id, turn, CASE WHEN length(flat) <= 72 THEN flat ELSE rtrim(substr(flat, 1, 71)) || '…' END AS title FROM (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS flat FROM conversations)")
def one_line_titles(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", one_line(F.col("text")).alias("title"))


@query("prj03_person_text", f"WITH {RECORDS} SELECT source_id, prompt AS is_prompt FROM rec")
def person_prompts(spark, sf_dir):
    return records(spark, sf_dir).select("source_id", rules.is_prompt(rules.person_text(F.col("role"), F.col("content"))).alias("is_prompt"))


@query("prj02_role_normalisation", "SELECT CASE WHEN role = 'system' THEN 'metadata' ELSE role END AS role, count(*) AS n FROM conversations GROUP BY 1")
def role_normalisation(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy(rules.normal_role(F.col("role"), F.col("text")).alias("role")).agg(F.count("*").alias("n"))


@query("win03_event_time_fill", "WITH e AS (SELECT event_id AS pos, user_id AS session_id, CASE WHEN event_id % 3 <> 0 THEN ts END AS tm FROM events), f AS (SELECT pos, last_value(tm IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY pos) AS own FROM e) SELECT pos, last_value(own IGNORE NULLS) OVER (ORDER BY pos) AS filled_at FROM f")
def event_time_fill(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), F.col("user_id").alias("session_id"), F.when(F.col("event_id") % 3 != 0, F.col("ts")).alias("at"))
    return turns.fill_times(events).select("pos", "filled_at")


_GAPS = f"""WITH {STEPS}, g AS (SELECT *, (epoch_us(tm) - epoch_us(lag(tm) OVER w)) / 1e6 AS gap_s, lag(tm) OVER w AS before, row_number() OVER w AS k FROM st WINDOW w AS (PARTITION BY session_id ORDER BY tm, id)),
 r AS (SELECT *, CASE WHEN k = 1 THEN 'start' WHEN gap_s >= 10800 THEN 'gap' WHEN gap_s >= 3600 AND CAST(before AS DATE) <> CAST(tm AS DATE) THEN 'date' END AS reason FROM g),
 p AS (SELECT *, sum(CAST(reason IS NOT NULL AS BIGINT)) OVER (PARTITION BY session_id ORDER BY tm, id) AS part FROM r)"""


@query("win09_session_gap_cuts", f"{_GAPS} SELECT id, session_id, CAST(round(gap_s * 1000) AS BIGINT) AS gap_ms, reason, CAST(part AS BIGINT) AS part FROM p")
def session_gap_cuts(spark, sf_dir):
    return turns.gap_cuts(steps(spark, sf_dir)).select("id", "session_id", F.round(F.col("gap_s") * 1000).cast("bigint").alias("gap_ms"), "reason", "part")


@query("prj22_boundary_reasons", f"{_GAPS} SELECT coalesce(reason, 'none') AS reason, count(*) AS n FROM p GROUP BY 1")
def boundary_reasons(spark, sf_dir):
    return turns.gap_cuts(steps(spark, sf_dir)).groupBy(F.coalesce("reason", F.lit("none")).alias("reason")).agg(F.count("*").alias("n"))


@query("win12_recent_sessions", f"WITH {STEPS}, l AS (SELECT session_id, max(tm) AS last_at, count(*) AS n_records FROM st GROUP BY session_id ORDER BY last_at DESC, session_id LIMIT 20) SELECT session_id, last_at, n_records, row_number() OVER (ORDER BY last_at, session_id DESC) AS place FROM l")
def recent_sessions(spark, sf_dir):
    return turns.recent_sessions(steps(spark, sf_dir), 20).withColumn("place", F.col("place").cast("bigint"))


_NOW = "TIMESTAMP '2024-02-01 00:00:00'"


@query("str03_quiet_sessions", f"WITH {STEPS}, n AS (SELECT session_id, max(tm) AS noted_at FROM st WHERE event_type = 'view' GROUP BY 1), l AS (SELECT session_id, max(tm) AS last_at FROM st GROUP BY 1) SELECT n.session_id, noted_at AS tail_start, last_at AS tail_end FROM n JOIN l USING (session_id) WHERE last_at > noted_at AND epoch_us({_NOW}) - epoch_us(last_at) >= 3600000000")
def quiet_sessions(spark, sf_dir):
    rows = steps(spark, sf_dir)
    return turns.quiet_intervals(rows.where("event_type = 'view'").select("session_id", F.col("at").alias("noted_at")), rows, F.expr(_NOW))


@query("win11_open_requests", f"WITH {STEPS} SELECT id, last_value(CASE WHEN hint = 'prompt' THEN id END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY tm, id) AS request_id FROM st")
def latest_requests(spark, sf_dir):
    return turns.latest_request(steps(spark, sf_dir), F.col("hint") == "prompt").select("id", "request_id")


@query("join01_call_result_join", f"WITH {STEPS}, s AS (SELECT id, key, session_id, hint, lead(id) OVER w AS next_id, lead(hint) OVER w AS next_hint FROM st WHERE hint IN ('edit', 'test') WINDOW w AS (PARTITION BY session_id, key ORDER BY tm, id)) SELECT id, CASE WHEN next_hint = 'test' THEN next_id END AS result_id FROM s WHERE hint = 'edit'")
def call_result_join(spark, sf_dir):
    return ops.next_results(steps(spark, sf_dir), F.col("hint") == "edit", F.col("hint") == "test").select("id", "result_id")


@query("join01_paired_results", f"WITH {STEPS}, r AS (SELECT session_id, key, arg_max(id, struct_pack(a := tm, i := id)) AS result_id, arg_max(status, struct_pack(a := tm, i := id)) AS result_status FROM st WHERE hint = 'test' GROUP BY ALL) SELECT st.id, result_id, result_status FROM st LEFT JOIN r USING (session_id, key) WHERE hint = 'edit'")
def paired_results(spark, sf_dir):
    rows = steps(spark, sf_dir).withColumnRenamed("key", "call_id")
    results = rows.where("hint = 'test'").select("session_id", "call_id", F.col("id").alias("result_id"), F.col("status").alias("result_status"), "at")
    return ops.pair_results(rows.where("hint = 'edit'").select("session_id", "call_id", "id"), results).select("id", "result_id", "result_status")


@query("join02_turn_context_asof", f"WITH {STEPS} SELECT id, last_value(CASE WHEN hint = 'read' THEN value END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY tm, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS context FROM st")
def turn_context_asof(spark, sf_dir):
    from ..operators import ordered

    block = ordered.block_of(F.unix_micros(F.col("at").cast("timestamp")) / 1e6, 86_400)
    return ordered.last_before(steps(spark, sf_dir), ["session_id"], ["at", "id"], F.when(F.col("hint") == "read", F.col("value")), "context", block, strict=True).select("id", "context")


@query("win05_latest_edit_before_check", f"WITH {STEPS}, s AS (SELECT id, hint, last_value(CASE WHEN hint = 'edit' THEN id END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY tm, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS edit_id FROM st) SELECT id, edit_id FROM s WHERE hint = 'test'")
def latest_edit_before_check(spark, sf_dir):
    return ops.latest_edit(steps(spark, sf_dir), F.col("hint") == "edit", F.col("hint") == "test").select("id", "edit_id")


@query("win06_first_runs_after_edit", f"WITH {STEPS}, p AS (SELECT e.id AS edit_id, r.id AS run_id, row_number() OVER (PARTITION BY e.id ORDER BY r.tm, r.id) AS place FROM st e JOIN st r ON e.session_id = r.session_id AND (r.tm, r.id) > (e.tm, e.id) WHERE e.hint = 'edit' AND r.hint = 'test') SELECT edit_id, run_id, place FROM p WHERE place <= 3")
def first_runs_after_edit(spark, sf_dir):
    return ops.runs_after_edits(steps(spark, sf_dir), F.col("hint") == "edit", F.col("hint") == "test")


@query("win04_edit_runs", f"""WITH {STEPS}, m AS (SELECT *, coalesce(hint <> 'edit' OR lag(hint) OVER w <> 'edit', true) AS fresh FROM st WHERE hint IN ('edit', 'test') WINDOW w AS (PARTITION BY session_id ORDER BY tm, id)),
 n AS (SELECT *, sum(CAST(fresh AS BIGINT)) OVER (PARTITION BY session_id ORDER BY tm, id) AS item FROM m)
 SELECT session_id, CAST(item AS BIGINT) AS item, min(hint) AS hint, count(*) AS n_steps, arg_min(id, struct_pack(a := tm, i := id)) AS first_id, arg_max(id, struct_pack(a := tm, i := id)) AS last_id FROM n GROUP BY session_id, item""")
def edit_runs(spark, sf_dir):
    return ops.edit_groups(steps(spark, sf_dir))


@query("win04_repeated_checks", f"""WITH {STEPS}, m AS (SELECT *, event_type AS target, coalesce(lag(event_type) OVER w <> event_type, true) AS fresh FROM st WHERE hint = 'test' WINDOW w AS (PARTITION BY session_id ORDER BY tm, id)),
 n AS (SELECT *, sum(CAST(fresh AS BIGINT)) OVER (PARTITION BY session_id ORDER BY tm, id) AS run FROM m)
 SELECT session_id, CAST(run AS BIGINT) AS run, target, arg_max(status, struct_pack(a := tm, i := id)) AS status, count(*) AS n_records FROM n GROUP BY session_id, run, target""")
def repeated_checks(spark, sf_dir):
    return ops.repeated_checks(steps(spark, sf_dir).where("hint = 'test'").withColumn("target", F.col("event_type")))


@query("agg01_step_class_counts", f"WITH {STEPS} SELECT hint, count(*) AS n, count(DISTINCT key) AS n_targets, round_even(count(*) / (SELECT count(*) FROM st), 3) AS share FROM st GROUP BY hint")
def step_class_counts(spark, sf_dir):
    return ops.hint_counts(steps(spark, sf_dir), "key")


@query("join22_proximity_join", f"""WITH {STEPS}, p AS (SELECT a.id, b.id AS other_id, abs(epoch_us(a.tm) - epoch_us(b.tm)) AS apart_us, row_number() OVER (PARTITION BY a.id ORDER BY abs(epoch_us(a.tm) - epoch_us(b.tm)), b.id) AS place
 FROM st a JOIN st b ON a.key = b.key AND a.session_id <> b.session_id AND abs(epoch_us(a.tm) - epoch_us(b.tm)) <= 900000000) SELECT id, other_id, apart_us, place FROM p WHERE place <= 3""")
def proximity_join(spark, sf_dir):
    rows = steps(spark, sf_dir).withColumn("tree", F.col("key"))
    return ops.near_in_time(rows, rows, 900, 3).select("id", "other_id", F.round(F.col("apart_s") * 1e6).cast("bigint").alias("apart_us"), "place")


@query("str04_count_or_time", f"""WITH RECURSIVE {STEPS}, r AS (SELECT session_id, tm, epoch_us(tm) AS us, event_type = 'purchase' AS c, row_number() OVER (PARTITION BY session_id ORDER BY tm, id) AS i FROM st),
 f AS (SELECT session_id, CAST(0 AS BIGINT) AS i, NULL::TIMESTAMP AS tm, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS first, CAST(0 AS BIGINT) AS late, CAST(0 AS BIGINT) AS due FROM (SELECT DISTINCT session_id FROM r)
  UNION ALL SELECT session_id, i, tm, CASE WHEN due > 0 THEN 0 ELSE m END, first, late, due FROM (SELECT *, CASE WHEN c OR m >= 10 THEN m ELSE 0 END AS due FROM (SELECT r.session_id, r.i, r.tm, r.c,
   CASE WHEN f.n > 0 AND r.us - f.first >= 1800000000 THEN f.n ELSE 0 END AS late, CASE WHEN f.n > 0 AND r.us - f.first >= 1800000000 THEN 1 ELSE f.n + 1 END AS m, CASE WHEN f.n = 0 OR r.us - f.first >= 1800000000 THEN r.us ELSE f.first END AS first
   FROM f JOIN r ON r.session_id = f.session_id AND r.i = f.i + 1)))
 SELECT session_id, tm AS fired_at, late AS n_items FROM f WHERE late > 0 UNION ALL SELECT session_id, tm, due FROM f WHERE due > 0""")
def count_or_time(spark, sf_dir):
    return ops.due_points(steps(spark, sf_dir), 10, 1800, F.col("event_type") == "purchase")


@query("win10_unit_packing", """WITH RECURSIVE g AS (SELECT event_id AS id, user_id AS session_id, ts, CAST(value * 100 AS BIGINT) AS chars, trunc(value * 100) AS exact, lag(ts) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 p AS (SELECT *, sum(CAST(b IS NULL OR epoch_us(ts) - epoch_us(b) >= 10800000000 OR (epoch_us(ts) - epoch_us(b) >= 3600000000 AND CAST(ts AS DATE) <> CAST(b AS DATE)) AS BIGINT)) OVER (PARTITION BY session_id ORDER BY ts, id) AS part FROM g),
 r AS (SELECT session_id, CAST(part AS BIGINT) AS part, id AS pos, CAST(exact AS BIGINT) AS chars, row_number() OVER (PARTITION BY session_id, part ORDER BY id) AS i FROM p),
 f AS (SELECT session_id, part, pos, i, CAST(0 AS BIGINT) AS unit, CAST(1 AS BIGINT) AS n, chars AS size FROM r WHERE i = 1
  UNION ALL SELECT r.session_id, r.part, r.pos, r.i, CASE WHEN f.n >= 5 OR f.size + r.chars > 20000 THEN f.unit + 1 ELSE f.unit END, CASE WHEN f.n >= 5 OR f.size + r.chars > 20000 THEN 1 ELSE f.n + 1 END, CASE WHEN f.n >= 5 OR f.size + r.chars > 20000 THEN r.chars ELSE f.size + r.chars END
  FROM f JOIN r ON r.session_id = f.session_id AND r.part = f.part AND r.i = f.i + 1) SELECT session_id, part, pos, unit FROM f""")
def unit_packing(spark, sf_dir):
    from ..operators.texts import budget_units

    rows = turns.gap_cuts(table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("session_id"), F.col("ts").alias("at"), "value"))
    return budget_units(rows.select("session_id", "part", F.col("id").alias("pos"), (F.col("value") * 100).cast("bigint").alias("chars")), 20_000, 5)


@query("win10_best_cut_units", """WITH RECURSIVE e AS (SELECT event_id AS pos, user_id AS session_id, ts, event_type AS ty, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(trunc(value * 100) AS BIGINT) AS cost, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events),
 c AS (SELECT *, last_value(CASE WHEN ty = 'click' THEN i END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY i) AS click FROM e),
 t AS (SELECT session_id, click, max(i) AS till FROM c WHERE ty IN ('purchase', 'error') AND k % 2 = 0 AND click IS NOT NULL GROUP BY 1, 2),
 b AS (SELECT *, lag(ty) OVER w AS bty, lag(k) OVER w AS bk, lag(ts) OVER w AS bts, lag(click) OVER w AS held, CAST(sum(cost) OVER w - cost AS BIGINT) AS total FROM c WINDOW w AS (PARTITION BY session_id ORDER BY i)),
 s AS (SELECT b.*, i > 0 AND coalesce(t.till, -1) < i AS safe FROM b LEFT JOIN t ON t.session_id = b.session_id AND t.click = b.held),
 f AS (SELECT session_id, i, total, safe, safe AND ((ty = 'view' AND k % 20 = 0) OR epoch_us(ts) - epoch_us(bts) >= 10800000000 OR (epoch_us(ts) - epoch_us(bts) >= 3600000000 AND CAST(ts AS DATE) <> CAST(bts AS DATE))) AS natural_, safe AND ty = 'signup' AS turn_,
   safe AND bty IN ('purchase', 'error') AND bk % 3 < 2 AS result_, safe AND bty = 'purchase' AND bk % 3 = 0 AS commit_ FROM s
  UNION ALL SELECT session_id, max(i) + 1, CAST(sum(cost) AS BIGINT), false, false, false, false, false FROM e GROUP BY 1),
 n AS (SELECT session_id, max(i) AS n FROM f GROUP BY 1),
 m AS (SELECT a.session_id, a.i, a.total, max(z.i) FILTER (WHERE z.total - a.total <= 20000 AND (3 * (z.total - a.total)) // 2 + 500 * (z.i - a.i) + 30000 <= 61000) AS most FROM f a JOIN n ON n.session_id = a.session_id AND a.i < n.n JOIN f z ON z.session_id = a.session_id AND z.i > a.i AND z.i <= a.i + 12 GROUP BY 1, 2, 3),
 l AS (SELECT session_id, i, total, greatest(i + 1, coalesce(most, 0)) AS lim FROM m),
 w AS (SELECT l.*, f.total - l.total AS span FROM l JOIN f ON f.session_id = l.session_id AND f.i = l.lim),
 p AS (SELECT w.session_id, w.i, w.lim, min(z.i) FILTER (WHERE z.natural_) AS na, max(z.i) FILTER (WHERE z.commit_ AND 5 * (z.total - w.total) >= 2 * span) AS co, max(z.i) FILTER (WHERE z.turn_ AND 5 * (z.total - w.total) >= 2 * span) AS tu, max(z.i) FILTER (WHERE z.result_ AND 5 * (z.total - w.total) >= 2 * span) AS re, max(z.i) FILTER (WHERE z.safe) AS sa
  FROM w JOIN f z ON z.session_id = w.session_id AND z.i > w.i AND z.i <= w.lim GROUP BY 1, 2, 3),
 x AS (SELECT p.session_id, p.i, CASE WHEN na IS NOT NULL THEN na WHEN lim = n.n THEN lim ELSE coalesce(co, tu, re, sa, lim) END AS till,
  CASE WHEN na IS NOT NULL THEN 'natural' WHEN lim = n.n THEN 'end' WHEN co IS NOT NULL THEN 'commit' WHEN tu IS NOT NULL THEN 'turn' WHEN re IS NOT NULL THEN 'result' WHEN sa IS NOT NULL THEN 'safe' ELSE 'limit' END AS why FROM p JOIN n USING (session_id)),
 u AS (SELECT session_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS unit, '' AS why FROM n UNION ALL SELECT u.session_id, x.till, u.unit + 1, x.why FROM u JOIN x ON x.session_id = u.session_id AND x.i = u.i)
 SELECT e.session_id, e.pos, u.unit, u.i = e.i AS begun, CASE WHEN u.i = e.i THEN u.why END AS why FROM e JOIN u ON u.session_id = e.session_id AND u.i <= e.i QUALIFY row_number() OVER (PARTITION BY e.session_id, e.pos ORDER BY u.i DESC) = 1""")
def best_cut_units(spark, sf_dir):
    """Clicks call tools, purchases and errors are results, of which every second belongs to the last click, sign-ups are prompts."""
    from ..operators import unit_cuts

    k, kind = F.get_json_object("props", "$.k").cast("bigint"), F.col("event_type")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("pos"), F.col("ts").alias("at"), "event_type", k.alias("k"), (F.col("value") * 100).cast("bigint").alias("cost"))
    rows = ordered.last_before(rows, ["session_id"], ["pos"], F.when(kind == "click", F.col("pos")), "click", ordered.block_of(F.col("pos")))
    result = kind.isin("purchase", "error")
    hint = F.when(F.col("k") % 3 == 0, "commit").when(F.col("k") % 3 == 1, "test").otherwise("read")
    links = F.array(F.when((kind == "click") | (result & (F.col("k") % 2 == 0)), F.col("click").cast("string")))
    records = rows.select("session_id", "pos", F.when(kind == "click", "tool_call").when(result, "tool_result").when(kind == "signup", "user").otherwise("assistant").alias("role"), "at", "cost", links.alias("links"), (kind == "signup").alias("prompt"), ((kind == "view") & (F.col("k") % 20 == 0)).alias("compaction"), F.when(result, hint).alias("hint"), (kind == "error").alias("failed"))
    return unit_cuts.best_units(unit_cuts.boundaries(records), unit_cuts.Limits(records=12, chars=20_000, payload=61_000))


@query("dt01_iso_instants", "SELECT event_id, epoch_us(ts) AS micros FROM events")
def iso_instants(spark, sf_dir):
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.when(F.col("event_id") % 2 == 0, "Z").otherwise("+00:00"))
    return table(spark, sf_dir, "events").select("event_id", F.unix_micros(instant(text)).alias("micros"))


@query("dt03_epoch_ms", "SELECT event_id, strftime(make_timestamp(epoch_us(ts) // 1000 * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') AS iso FROM events")
def epoch_ms(spark, sf_dir):
    ms = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000)
    return table(spark, sf_dir, "events").select("event_id", epoch_ms_to_iso(F.when(F.col("event_id") % 2 == 0, ms).otherwise(ms * 1_000_000)).alias("iso"))


@query("dt02_relative_age", f"WITH a AS (SELECT event_id, greatest(0, (epoch_us({_NOW}) - epoch_us(ts)) // 1000000) AS s FROM events) SELECT event_id, CASE WHEN s < 3600 THEN (s // 60) || ' min ago' WHEN s < 172800 THEN (s // 3600) || ' h ago' ELSE (s // 86400) || ' d ago' END AS age FROM a")
def relative_age(spark, sf_dir):
    seconds = F.floor((F.unix_micros(F.expr(_NOW).cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 1e6)
    return table(spark, sf_dir, "events").select("event_id", ago(seconds).alias("age"))


@query("str02_daily_activity", "SELECT date_trunc('day', ts) AS began, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def daily_activity(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy(F.window(F.col("ts"), "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return rows.select(F.col("w.start").cast("timestamp_ntz").alias("began"), "event_type", "n", "total")


@query("agg10_fixture_integrity", f"WITH {STEPS}, k AS (SELECT session_id, key, count(*) FILTER (hint = 'edit') AS c, count(*) FILTER (hint = 'test') AS r FROM st GROUP BY ALL) SELECT CAST(coalesce(sum(c) FILTER (r = 0), 0) AS BIGINT) AS calls_without_result, CAST(coalesce(sum(r) FILTER (c = 0), 0) AS BIGINT) AS results_without_call FROM k")
def fixture_integrity(spark, sf_dir):
    by_call = steps(spark, sf_dir).groupBy("session_id", "key").agg(F.count_if(F.col("hint") == "edit").alias("c"), F.count_if(F.col("hint") == "test").alias("r"))
    return by_call.agg(F.coalesce(F.sum(F.when(F.col("r") == 0, F.col("c"))), F.lit(0)).alias("calls_without_result"), F.coalesce(F.sum(F.when(F.col("c") == 0, F.col("r"))), F.lit(0)).alias("results_without_call"))


@query("prj20_id_aliases", f"WITH {RECORDS}, f AS (SELECT role, source_id, row_number() OVER (PARTITION BY role ORDER BY session_id, pos) AS n FROM rec) SELECT source_id, upper(substr(role, 1, 1)) || n AS alias FROM f")
def id_aliases(spark, sf_dir):
    from ..operators import ordered

    numbered = ordered.running_count(records(spark, sf_dir), ["role"], ["session_id", "pos"], F.lit(True), "n", ordered.block_of(F.col("session_id"), 1024))
    return numbered.select("source_id", F.concat(F.upper(F.substring("role", 1, 1)), F.col("n").cast("string")).alias("alias"))


@query("src11_scope_filter", r"""WITH p AS (SELECT page_id, regexp_replace(regexp_extract(url, '^[a-z]+://([^?#]*)', 1), '/+$', '') AS path FROM pages),
 r AS (SELECT DISTINCT regexp_extract(path, '^[^/]+', 0) AS root FROM p WHERE page_id % 5 = 0 UNION SELECT DISTINCT regexp_extract(path, '^[^/]+/[^/]+', 0) FROM p WHERE page_id % 7 = 0),
 j AS (SELECT p.page_id, r.root, row_number() OVER (PARTITION BY page_id ORDER BY length(r.root) DESC) AS k FROM p JOIN r ON r.root <> '' AND (p.path = r.root OR starts_with(p.path, r.root || '/')))
 SELECT p.page_id, j.root FROM p LEFT JOIN j ON p.page_id = j.page_id AND k = 1""")
def scope_filter(spark, sf_dir):
    from ..sources.transcripts import in_scope

    path = F.regexp_replace(F.regexp_extract("url", r"^[a-z]+://([^?#]*)", 1), r"/+$", "")
    pages = table(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    hosts = pages.where("page_id % 5 = 0").select(F.regexp_extract("path", r"^[^/]+", 0).alias("root"))
    parts = pages.where("page_id % 7 = 0").select(F.regexp_extract("path", r"^[^/]+/[^/]+", 0).alias("root"))
    return in_scope(pages, hosts.union(parts).where("root <> ''")).select("page_id", "root")


