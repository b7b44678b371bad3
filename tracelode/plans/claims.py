"""Queries on story answers: claims about conversations, made from their turns, and what the records bear out."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import story_claims
from .bindings import table
from .registry import query

#: The SQL twin of the tables below: turns, what is lost of the story, and all claims with their reasons.
_TOLD = """t AS (SELECT conv_id AS u, turn AS p, role, CASE WHEN turn >= 5 THEN 'b' ELSE 'a' END AS s, length(text) AS n FROM conversations),
 w AS (SELECT *, p % 4 = 1 AS edit, p % 4 = 3 AS run, p % 4 = 1 AND n % 5 = 0 AS agent, CASE n % 3 WHEN 0 THEN 'passed' WHEN 1 THEN 'failed' ELSE 'unknown' END AS status, n % 4 <> 1 AS leaning FROM t WHERE role = 'assistant'),
 lost AS (SELECT u, p, 0 AS round FROM w WHERE leaning AND NOT EXISTS (SELECT 1 FROM w b WHERE b.u = w.u AND b.p = w.p - 2) UNION ALL SELECT w.u, w.p, lost.round + 1 FROM lost JOIN w ON w.u = lost.u AND w.p = lost.p + 2 AND w.leaning),
 q AS (SELECT u, p, s, 'Q' || row_number() OVER (PARTITION BY u ORDER BY p) AS id FROM t WHERE role = 'user'), ends AS (SELECT u, min(p) AS p FROM t WHERE role = 'user' AND s = 'a' GROUP BY 1)"""

_LINKS = f"""WITH RECURSIVE {_TOLD},
 v AS (SELECT a.u, a.p AS a, b.p AS b, a.run AND b.edit AS turned, a.edit AS ae, b.run AS br, b.status, a.s AS asn, b.s AS bsn, EXISTS (SELECT 1 FROM w c WHERE c.u = b.u AND c.p = b.p + 2) AS report FROM w a JOIN w b ON b.u = a.u AND a.p < b.p),
 x AS (SELECT v.u, CASE WHEN turned THEN 'W' || b ELSE 'W' || a END AS from_id, CASE WHEN turned THEN 'W' || a ELSE 'W' || b END AS to_id, 'verifies' AS relation, turned,
   CASE WHEN report THEN 'B' || (b + 2) ELSE '' END AS blocks, CASE WHEN NOT turned AND NOT ae THEN 'not from an edit' WHEN NOT turned AND NOT br THEN 'not to a run' WHEN (CASE WHEN turned THEN r.status ELSE v.status END) = 'unknown' THEN 'the run''s result is unknown'
    WHEN asn <> bsn THEN 'not in the edit''s session' WHEN turned THEN 'the run came before the edit' WHEN NOT report THEN 'no block where the assistant reports the run' END AS reason FROM v JOIN w r ON r.u = v.u AND r.p = v.a
  UNION ALL SELECT q.u, q.id, 'S' || w.p, 'answers', false, CASE WHEN w.p > q.p AND w.s = q.s THEN 'B' || w.p ELSE '' END, CASE WHEN w.p < q.p OR w.s <> q.s THEN 'no reply after the request in its session' WHEN lost.u IS NOT NULL THEN 'its answer was not kept' END FROM q JOIN w ON w.u = q.u LEFT JOIN lost ON lost.u = w.u AND lost.p = w.p
  UNION ALL SELECT q.u, q.id, 'W' || w.p, 'answers', false, CASE WHEN w.p > q.p AND w.s = q.s THEN 'B' || w.p ELSE '' END, CASE WHEN agent THEN 'a task handed to another agent is not the answer' WHEN w.p < q.p OR w.s <> q.s THEN 'no reply after the request in its session' WHEN lost.u IS NULL THEN 'the same reply answers it through another event' END FROM q JOIN w ON w.u = q.u LEFT JOIN lost ON lost.u = w.u AND lost.p = w.p
  UNION ALL SELECT q.u, q.id, 'N0', 'answers', false, '', 'no block of the assistant''s reply' FROM q
  UNION ALL SELECT q.u, q.id, 'gone', 'answers', false, '', 'not to an event of this stretch' FROM q
  UNION ALL SELECT w.u, 'P1', 'S' || w.p, 'answers', false, CASE WHEN w.s = 'a' AND w.p < coalesce(ends.p, 1000000) THEN 'B' || w.p ELSE '' END, CASE WHEN w.s <> 'a' THEN 'no reply in the request''s session' WHEN w.p >= coalesce(ends.p, 1000000) THEN 'the reply came after a later request' WHEN lost.u IS NOT NULL THEN 'its answer was not kept' END FROM w LEFT JOIN ends ON ends.u = w.u LEFT JOIN lost ON lost.u = w.u AND lost.p = w.p
  UNION ALL SELECT u, 'nobody', 'S' || p, 'answers', false, '', 'not from a request' FROM w
  UNION ALL SELECT a.u, 'S' || a.p, 'S' || b.p, 'motivates', false, '', CASE WHEN x.u IS NOT NULL OR y.u IS NOT NULL THEN 'an end was not kept' END FROM w a JOIN w b ON b.u = a.u AND b.p = a.p + 2 LEFT JOIN lost x ON x.u = a.u AND x.p = a.p LEFT JOIN lost y ON y.u = b.u AND y.p = b.p)
 SELECT u AS unit_id, from_id, to_id, relation, turned, blocks, reason FROM x"""


def _judged(spark, sf_dir) -> story_claims.Judged:
    """Every answering turn is a work item (edits and runs in turn) and a story event that rests on its block or on the event before; all pairs are claimed as checks, all requests as answered by all events."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("unit_id"), "turn", "role", F.length("text").alias("n"))
    name = lambda letter, turn="turn": F.concat(F.lit(letter), F.col(turn).cast("string"))
    records = turns.select("unit_id", name("r").alias("source_id"), F.col("turn").alias("pos"), F.when(F.col("turn") >= 5, "b").otherwise("a").alias("session_id"), "role", (F.col("role") == "user").alias("prompt"))
    work = turns.where("role = 'assistant'")
    status = F.when(F.col("n") % 3 == 0, "passed").when(F.col("n") % 3 == 1, "failed").otherwise("unknown")
    no = F.lit(False)
    items = work.select("unit_id", name("W").alias("item_id"), (F.col("turn") % 4 == 1).alias("edit"), (F.col("turn") % 4 == 3).alias("run"), ((F.col("turn") % 4 == 1) & (F.col("n") % 5 == 0)).alias("delegate"), status.alias("status"), no.alias("inline"), F.array(name("r")).alias("sources"))
    units = turns.select("unit_id").distinct()
    items = items.unionByName(units.select("unit_id", F.lit("N0").alias("item_id"), no.alias("edit"), no.alias("run"), no.alias("delegate"), F.lit("noted").alias("status"), no.alias("inline"), F.array(F.lit("r0")).alias("sources")))
    blocks = turns.select("unit_id", name("B").alias("block_id"), name("r").alias("source_id"))
    earlier = units.select("unit_id", F.explode(F.array(F.struct(F.lit("P1").alias("request_id"), F.lit("a").alias("session_id")), F.struct(F.lit("P2").alias("request_id"), F.lit("c").alias("session_id")))).alias("e")).select("unit_id", "e.*").where("request_id = 'P1'")
    # The answer of a unit, from its turns in order.
    said = turns.groupBy("unit_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "n"))).alias("all"))
    of = lambda letter, t: F.concat(F.lit(letter), t.cast("string"))
    done, asked = F.filter("all", lambda x: x["role"] == "assistant"), F.filter("all", lambda x: x["role"] == "user")
    none = F.array().cast("array<string>")
    story = F.transform(done, lambda x: F.struct(of("S", x["turn"]).alias("id"), F.lit("outcome").alias("kind"), of("turn ", x["turn"]).alias("title"), F.lit("told").alias("status"), F.when(x["n"] % 4 == 1, F.array(of("B", x["turn"]))).otherwise(none).alias("blocks"), F.array(of("S", x["turn"] - 2)).alias("work")))
    pair = lambda a, b, relation, shown: F.struct(a.alias("from"), b.alias("to"), F.lit(relation).alias("relation"), shown.alias("blocks"))
    checks = F.flatten(F.transform(done, lambda x: F.transform(F.filter(done, lambda y: y["turn"] > x["turn"]), lambda y: pair(of("W", x["turn"]), of("W", y["turn"]), "verifies", F.array(of("B", y["turn"] + 2))))))
    leads = F.flatten(F.transform(done, lambda x: F.transform(F.filter(done, lambda y: y["turn"] == x["turn"] + 2), lambda y: pair(of("S", x["turn"]), of("S", y["turn"]), "motivates", none))))
    reply = lambda item, *shown: F.struct(item.alias("item"), F.array(*shown).alias("blocks"))
    every = F.flatten(F.transform(done, lambda x: F.array(reply(of("S", x["turn"]), of("B", x["turn"])), reply(of("W", x["turn"]), of("B", x["turn"])))))
    requests = F.transform(asked, lambda x, i: F.struct(of("Q", i + 1).alias("id"), F.concat(every, F.array(reply(F.lit("N0"), of("B", x["turn"])), reply(F.lit("gone"), of("B", x["turn"])))).alias("answered_by")))
    beside = F.transform(F.array(F.lit("P1"), F.lit("nobody")), lambda x: F.struct(x.alias("id"), F.transform(done, lambda y: reply(of("S", y["turn"]), of("B", y["turn"]))).alias("answered_by")))
    answer = F.to_json(F.struct(story.alias("story"), F.concat(checks, leads).alias("links"), F.concat(requests, beside).alias("requests")))
    return story_claims.judge(said.select("unit_id", answer.alias("answer")), records, items, blocks, earlier)


@query("udf02_story_links", _LINKS)
def story_links(spark, sf_dir):
    links = _judged(spark, sf_dir).links
    return links.select("unit_id", "from_id", "to_id", "relation", "turned", F.array_join("blocks", ",").alias("blocks"), "reason")


@query("udf02_story_events", f"WITH RECURSIVE {_TOLD} SELECT w.u AS unit_id, 'S' || w.p AS id, CASE WHEN lost.u IS NOT NULL THEN 'no evidence left' END AS reason, CAST(lost.round AS INTEGER) AS round FROM w LEFT JOIN lost ON lost.u = w.u AND lost.p = w.p")
def story_events(spark, sf_dir):
    return _judged(spark, sf_dir).events.select("unit_id", "id", "reason", "round")
