"""Queries on what model processes print and on the shape of JSON values."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.shapes import shape_errors
from ..operators import model_output
from .bindings import table
from .registry import query

#: What a conversation's run holds besides its turns, by its id modulo 8: (place, line).
_BESIDE = {1: (1, '{"type": "item.started", "item": {"type": "command_execution"}}'), 3: (1, "broken {"), 4: (1_000_001, '{"type": "item.completed", "item": {"type": "agent_message", "text": "words"}}'), 5: (1_000_001, '{"type": "turn.failed", "error": {"message": "out of  credits"}}'), 6: (1, "[1]"), 7: (1, '{"type": "item.updated", "item": "x"}')}


@query("src20_run_verdicts", """WITH t AS (SELECT conv_id AS c, max(turn) FILTER (WHERE role = 'assistant') AS last, count(*) AS n FROM conversations GROUP BY 1),
 w AS (SELECT t.*, c % 8 AS way, a.text FROM t LEFT JOIN conversations a ON a.conv_id = t.c AND a.turn = t.last),
 v AS (SELECT *, CASE way WHEN 1 THEN 'a forbidden item' WHEN 2 THEN 'partial output' WHEN 3 THEN 'unreadable output' WHEN 4 THEN 'unreadable answer' WHEN 5 THEN 'the run failed: out of credits' WHEN 6 THEN 'an event of unknown shape' WHEN 7 THEN 'an item of unknown shape' ELSE CASE WHEN last IS NULL THEN 'unreadable answer' END END AS reason FROM w)
 SELECT c AS run_id, CASE WHEN reason IS NULL THEN 'ok' WHEN reason = 'unreadable answer' THEN 'retry' ELSE 'refused' END AS verdict, reason, CASE WHEN reason IS NULL THEN sha256(text) END AS answer_hash, CASE WHEN reason IS NULL THEN '{"turns":' || n || '}' END AS usage FROM v""")
def run_verdicts(spark, sf_dir):
    """Each conversation as the event stream of a run: its answers are messages, what the person says is reasoning."""
    turns = table(spark, sf_dir, "conversations")
    answer = F.to_json(F.struct("turn", "text"))
    item = F.struct(F.when(F.col("role") == "assistant", "agent_message").otherwise("reasoning").alias("type"), F.when(F.col("role") == "assistant", answer).alias("text"))
    said = turns.select(F.col("conv_id").alias("run_id"), (F.col("turn") * 2 + 2).alias("n"), F.to_json(F.struct(F.lit("item.completed").alias("type"), item.alias("item"))).alias("line"))
    runs = turns.groupBy(F.col("conv_id").alias("run_id")).agg(F.count("*").alias("turns"))
    done = runs.where("run_id % 8 <> 2").select("run_id", F.lit(1_000_000).cast("long").alias("n"), F.to_json(F.struct(F.lit("turn.completed").alias("type"), F.struct("turns").alias("usage"))).alias("line"))
    way = F.col("run_id") % 8
    line, place = (F.coalesce(*[F.when(way == k, F.lit(x[i])) for k, x in _BESIDE.items()]) for i in (1, 0))
    beside = runs.select("run_id", place.cast("long").alias("n"), line.alias("line")).where("line IS NOT NULL")
    read = model_output.read_events(said.unionByName(done).unionByName(beside))
    return read.select("run_id", "verdict", "reason", F.sha2(F.get_json_object("answer", "$.text"), 256).alias("answer_hash"), "usage")


_EVENT_SHAPE = {
    "type": "object", "required": ["type", "value", "props"], "additionalProperties": False,
    "properties": {"type": {"enum": ["click", "view", "purchase", "signup"]}, "value": {"type": "number", "maximum": 50}, "props": {"$ref": "#/$defs/props"}},
    "$defs": {"props": {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "maximum": 89, "oneOf": [{"multipleOf": 2}, {"multipleOf": 3}]}}, "additionalProperties": False}},
}


@query("udf08_event_shapes", """WITH e AS (SELECT event_id, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
 SELECT event_id, array_to_string(list_filter([CASE WHEN (k % 2 = 0) = (k % 3 = 0) THEN '/props/k: fits none or several' END, CASE WHEN k > 89 THEN '/props/k: too large' END, CASE WHEN event_type NOT IN ('click', 'view', 'purchase', 'signup') THEN '/type: not one of the values' END, CASE WHEN value > 50 THEN '/value: too large' END], lambda x: x IS NOT NULL), '; ') AS errors FROM e""")
def event_shapes(spark, sf_dir):
    """Every event as a JSON value, its properties as they stand in the table, under a schema with a reference."""
    text = F.concat(F.lit('{"type": "'), "event_type", F.lit('", "value": '), F.col("value").cast("string"), F.lit(', "props": '), "props", F.lit("}"))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(F.sort_array(shape_errors(text, _EVENT_SHAPE)), "; ").alias("errors"))
