"""Queries that run a stream over tables written as transcript files, with a restart in between."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..sources import tail
from ..sources.store import shared_dir, written
from ..streaming import carried, notes
from .bindings import table
from .files import MASKED
from .registry import query

#: Bytes of one batch of the streams below.
BATCH = 64 << 20


def _lines(turns):
    """Each turn as a line: its text; an answer calls a tool, and the person's next turn holds the result. Only a conversation's first line names the folder."""
    name = lambda turn: F.concat_ws("-", F.lit("call"), "conv_id", turn)
    block = lambda kind, **more: F.struct(F.lit(kind).alias("type"), *[more.get(c, F.lit(None).cast("string")).alias(c) for c in ("text", "id", "name", "tool_use_id", "content")], *([more["input"].alias("input")] if "input" in more else [F.lit(None).cast("struct<command:string>").alias("input")]))
    text = F.array(block("text", text=F.col("text")))
    call = F.when(F.col("role") == "assistant", F.array(block("tool_use", id=name(F.col("turn")), name=F.lit("Bash"), input=F.struct(F.concat(F.lit("turn "), F.col("turn")).alias("command")))))
    result = F.when((F.col("role") == "user") & (F.col("before") == "assistant"), F.array(block("tool_result", tool_use_id=name(F.col("turn") - 1), content=F.col("text"))))
    none = F.array().cast(f"array<struct<type:string,text:string,id:string,name:string,tool_use_id:string,content:string,input:struct<command:string>>>")
    content = F.concat(text, F.coalesce(call, none), F.coalesce(result, none))
    message = F.struct(F.when(F.col("role") == "assistant", F.concat(F.lit("m"), F.col("turn") % 3)).alias("model"), content.alias("content"))
    row = F.struct(F.col("role").alias("type"), F.concat_ws("-", "conv_id", "turn").alias("uuid"), F.col("conv_id").cast("string").alias("sessionId"), F.when(F.col("turn") == F.col("first"), F.concat(F.lit("/w/"), F.col("conv_id"))).alias("cwd"), message.alias("message"))
    return turns.select((F.col("conv_id") % 16).alias("file"), "conv_id", "turn", F.to_json(row).alias("line"))


@query("str01_resumed_records", f"""WITH t AS (SELECT conv_id, turn, role, {MASKED} AS text, lag(role) OVER w AS b, lag(turn) OVER w AS bt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
 k AS (SELECT *, CASE WHEN role = 'assistant' THEN 'm' || turn % 3 END AS model FROM t WHERE role IN ('user', 'assistant')),
 r AS (SELECT conv_id, turn, 0 AS part, role, text AS content, model FROM k
  UNION ALL SELECT conv_id, turn, 1, 'tool_call', 'Tool: Bash' || chr(10) || '{{"command":"turn ' || turn || '"}}', model FROM k WHERE role = 'assistant'
  UNION ALL SELECT conv_id, turn, 1, 'tool_result', text, CASE WHEN bt = turn - 1 THEN 'm' || bt % 3 END FROM k WHERE role = 'user' AND b = 'assistant')
 SELECT CAST(conv_id AS VARCHAR) AS session_id, conv_id || '-' || turn || ':' || part AS native_id, role, '/w/' || conv_id AS cwd, model, true AS relevant, sha256(content) AS content_hash FROM r WHERE content <> ''""")
def resumed_records(spark, sf_dir):
    """Half of the files are read, the stream is stopped, and goes on with the other half."""
    turns = table(spark, sf_dir, "conversations")
    of_conversation = Window.partitionBy("conv_id")
    turns = turns.withColumn("first", F.min("turn").over(of_conversation)).withColumn("before", F.lag("role").over(of_conversation.orderBy("turn")))
    lines = _lines(turns).repartition("file").sortWithinPartitions("file", "conv_id", "turn")
    top = f"{shared_dir(spark)}/tail-{uuid.uuid4().hex}"
    for half in (0, 1):
        lines.where(F.col("file") % 2 == half).select("file", "line").write.partitionBy("file").text(f"{top}/files/half={half}")
        stream = carried.carried_lines(tail.read_tail(spark, f"{top}/files", f"{top}/log", most_bytes=BATCH), ["/w"])
        carried.append_available(stream, f"{top}/rows", f"{top}/checkpoint")
    rows = spark.read.parquet(f"{top}/rows")
    return carried.records_of(carried.last_generation(rows, rows), ["/w"]).select("session_id", "native_id", "role", "cwd", "model", "relevant", F.sha2("content", 256).alias("content_hash"))


@query("str06_note_flush", """WITH RECURSIVE t AS (SELECT conv_id AS c, turn AS p, text, length(text) AS n, CASE WHEN role <> 'assistant' THEN role WHEN turn % 4 = 3 THEN 'tool_result' ELSE 'assistant' END AS role, role = 'assistant' AS mine FROM conversations),
 q AS (SELECT c, p, n, substr(text, 1, 60) AS quote, CASE WHEN p % 4 = 3 THEN 'outcome' ELSE 'decision' END AS kind, CASE WHEN p % 4 <> 3 THEN CASE WHEN n % 7 = 0 THEN 'bogus' ELSE 'adopted' END WHEN n % 2 = 0 THEN 'observed_success' ELSE 'observed_failure' END AS status FROM t WHERE mine),
 f AS (SELECT q.c, q.p, t.p AS r, t.role, t.n % 3 = 0 AS failed FROM q JOIN t ON t.c = q.c AND contains(t.text, q.quote) QUALIFY row_number() OVER (PARTITION BY q.c, q.p ORDER BY CASE WHEN q.kind = 'outcome' AND t.role = 'tool_result' THEN 0 ELSE 1 END, t.p DESC) = 1),
 g AS (SELECT q.*, f.role AS found, q.status <> 'bogus' AND length(trim(quote)) >= 8 AND (kind <> 'outcome' OR (f.role = 'tool_result' AND NOT (q.status = 'observed_success' AND f.failed))) AS good FROM q LEFT JOIN f ON f.c = q.c AND f.p = q.p),
 k AS (SELECT c, p FROM g WHERE good AND p < 3 UNION ALL SELECT g.c, g.p FROM k JOIN g ON g.c = k.c AND g.p = k.p + 2 AND g.good)
 SELECT 'q_' || g.c || '_' || g.p AS note_id, 'ev_' || substr(sha256('["q_' || g.c || '_' || g.p || '"]'), 1, 24) AS event_id, g.kind, g.status, CASE WHEN g.found = 'tool_result' THEN 'tool_record' ELSE 'explicit_statement' END AS basis,
  CASE WHEN g.p >= 3 THEN 'ev_' || substr(sha256('["q_' || g.c || '_' || (g.p - 2) || '"]'), 1, 24) END AS from_id, CASE WHEN g.p >= 3 THEN CASE WHEN g.kind = 'outcome' THEN 'verifies' ELSE 'motivates' END END AS relation FROM g JOIN k ON k.c = g.c AND k.p = g.p""")
def note_flush(spark, sf_dir):
    """Every answering turn queues a note that quotes it and links to the note of the turn before; the later turns come in a second batch, and the first one is run again."""
    turns = table(spark, sf_dir, "conversations")
    at = F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.col("turn") * 60_000_000)
    role = F.when(F.col("role") != "assistant", F.col("role")).when(F.col("turn") % 4 == 3, "tool_result").otherwise("assistant")
    records = written(turns.select(F.concat_ws("-", "conv_id", "turn").alias("record_id"), F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("pos"), role.alias("role"), F.col("text").alias("content"), at.alias("recorded_at"), (F.length("text") % 3 == 0).alias("failed")), "note-records")
    outcome, n = F.col("turn") % 4 == 3, F.length("text")
    status = F.when(outcome & (n % 2 == 0), "observed_success").when(outcome, "observed_failure").when(n % 7 == 0, "bogus")
    link = F.when(F.col("turn") >= 3, F.create_map(F.when(outcome, "verifies").otherwise("motivates"), F.array(F.concat_ws("_", F.lit("q"), "conv_id", F.col("turn") - 2))))
    queue = turns.where("role = 'assistant'").select(F.concat_ws("_", F.lit("q"), "conv_id", "turn").alias("note_id"), F.col("conv_id").cast("string").alias("session_id"), F.when(outcome, "outcome").otherwise("decision").alias("kind"), F.lit("a note").alias("title"), F.array(F.substring("text", 1, 60)).alias("quotes"), status.alias("status"), link.alias("relations"), at.alias("queued_at"), "turn")
    top = f"{shared_dir(spark)}/notes-{uuid.uuid4().hex}"
    flush = notes.flush_each_batch(records, f"{top}/store")
    for part, chosen in enumerate(("turn < 4", "turn >= 4")):
        queue.where(chosen).drop("turn").write.parquet(f"{top}/queue/part={part}")
        stream = spark.readStream.schema(spark.read.parquet(f"{top}/queue").drop("part").schema).parquet(f"{top}/queue")
        started = stream.writeStream.foreachBatch(flush).option("checkpointLocation", f"{top}/checkpoint").start()
        try:
            started.processAllAvailable()
        finally:
            started.stop()
    flush(spark.read.parquet(f"{top}/queue/part=0"), 0)
    events, edges, _, _ = notes.stored(spark, f"{top}/store")
    return events.join(edges.withColumnRenamed("to_id", "event_id"), "event_id", "left").select("note_id", "event_id", "kind", "status", "basis", "from_id", "relation")
