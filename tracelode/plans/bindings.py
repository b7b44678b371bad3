"""How the test tables play the engine's model; the SQL twins are common table expressions for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import content_id


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as records."""
    source = content_id("src_", F.lit("conv"), F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return table(spark, sf_dir, "conversations").select(source.alias("source_id"), F.col("conv_id").alias("session_id"), F.col("turn").alias("pos"), F.when(F.col("role") == "system", "metadata").otherwise(F.col("role")).alias("role"), F.col("text").alias("content"))


RECORDS = """rec AS (SELECT 'src_' || substr(sha256('["conv","' || conv_id || '","' || turn || '"]'), 1, 24) AS source_id, conv_id AS session_id,
 turn AS pos, CASE role WHEN 'system' THEN 'metadata' ELSE role END AS role, text AS content,
 coalesce(role = 'user' AND trim(text) <> '', false) AS prompt FROM conversations)"""

#: What each type of event is as a tool step.
HINTS = {"click": "edit", "purchase": "test", "error": "test", "view": "read", "signup": "prompt"}


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as tool steps of sessions: clicks edit, purchases and errors are checks that passed and failed."""
    hint = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in HINTS.items()])
    status = F.when(F.col("event_type") == "purchase", "observed_success").when(F.col("event_type") == "error", "observed_failure")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("session_id"), F.col("ts").alias("at"), "event_type", hint.alias("hint"), status.alias("status"), F.get_json_object("props", "$.k").cast("bigint").alias("key"), "value")


STEPS = """st AS (SELECT event_id AS id, user_id AS session_id, ts AS tm, event_type,
 CASE event_type WHEN 'click' THEN 'edit' WHEN 'purchase' THEN 'test' WHEN 'error' THEN 'test' WHEN 'view' THEN 'read' WHEN 'signup' THEN 'prompt' END AS hint,
 CASE event_type WHEN 'purchase' THEN 'observed_success' WHEN 'error' THEN 'observed_failure' END AS status,
 CAST(json_extract_string(props, '$.k') AS BIGINT) AS key, value FROM events)"""


def graph_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as graph events: sign-ups ask, clicks are actions, views decisions, errors and purchases outcomes; every tenth outcome is folded into the next one of its session."""
    kind = F.when(F.col("event_type") == "signup", "question").when(F.col("event_type") == "click", "action").when(F.col("event_type") == "view", "decision").otherwise("outcome")
    status = F.when(F.col("event_type") == "signup", "asked").when(F.col("event_type") == "click", "applied").when(F.col("event_type") == "view", "adopted").when(F.col("event_type") == "error", "observed_failure").otherwise("observed_success")
    base = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_id").alias("pos"), F.col("user_id").alias("session_id"), kind.alias("kind"), status.alias("status"), F.when(F.col("event_type") == "signup", "user").otherwise("assistant").alias("actor"), F.concat("event_type", F.lit(" of user "), "user_id", F.lit(" number "), "event_id").alias("title"), F.col("ts").alias("at"))
    later = F.first(F.when(F.col("kind") == "outcome", F.col("id")), ignorenulls=True).over(Window.partitionBy("session_id").orderBy("at", "id").rowsBetween(1, Window.unboundedFollowing))
    return base.withColumn("folded_into", F.when((F.col("kind") == "outcome") & (F.col("id") % 10 == 0), later))


def graph_edges(events: DataFrame) -> DataFrame:
    """Edges of ``graph_events``: an outcome verifies the action before it (every eleventh inactive, every thirteenth written the wrong way), an event follows the question before it, the first decision after a question answers it, a failure motivates the action right after it."""
    back = Window.partitionBy("session_id").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda kind: F.last(F.when(F.col("kind") == kind, F.col("id")), ignorenulls=True).over(back)
    seen = events.select("id", "kind", "status", last("action").alias("action"), last("question").alias("question"), last("decision").alias("decision"), F.lag("id").over(Window.partitionBy("session_id").orderBy("at", "id")).alias("before"), F.lag("status").over(Window.partitionBy("session_id").orderBy("at", "id")).alias("status_before"), F.last(F.when(F.col("kind") == "question", F.col("at")), ignorenulls=True).over(back).alias("asked"), F.last(F.when(F.col("kind") == "decision", F.col("at")), ignorenulls=True).over(back).alias("decided"))
    turned = F.col("id") % 13 == 0
    checks = seen.where("kind = 'outcome' AND action IS NOT NULL").select((F.col("id") * 4).alias("id"), F.when(turned, F.col("id")).otherwise(F.col("action")).alias("from_id"), F.when(turned, F.col("action")).otherwise(F.col("id")).alias("to_id"), F.lit("verifies").alias("relation"), F.when(F.col("id") % 17 == 0, "inferred").otherwise("structural").alias("basis"), (F.col("id") % 11 != 0).alias("active"))
    follows = seen.where("kind <> 'question' AND question IS NOT NULL").select(F.col("id") * 4 + 1, "question", "id", F.lit("follows"), F.lit("structural"), F.lit(True))
    answers = seen.where("kind = 'decision' AND question IS NOT NULL AND (decided IS NULL OR decided < asked)").select(F.col("id") * 4 + 2, "question", "id", F.lit("answers"), F.lit("explicit"), F.lit(True))
    causes = seen.where("kind = 'action' AND status_before = 'observed_failure'").select(F.col("id") * 4 + 3, "before", "id", F.lit("motivates"), F.lit("inferred"), F.lit(True))
    return checks.union(follows).union(answers).union(causes)


GRAPH = """ev0 AS (SELECT event_id AS id, event_id AS pos, user_id AS session_id,
 CASE event_type WHEN 'signup' THEN 'question' WHEN 'click' THEN 'action' WHEN 'view' THEN 'decision' ELSE 'outcome' END AS kind,
 CASE event_type WHEN 'signup' THEN 'asked' WHEN 'click' THEN 'applied' WHEN 'view' THEN 'adopted' WHEN 'error' THEN 'observed_failure' ELSE 'observed_success' END AS status,
 CASE event_type WHEN 'signup' THEN 'user' ELSE 'assistant' END AS actor, event_type || ' of user ' || user_id || ' number ' || event_id AS title, ts AS tm FROM events),
ev AS (SELECT *, CASE WHEN kind = 'outcome' AND id % 10 = 0 THEN
  first_value(CASE WHEN kind = 'outcome' THEN id END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY tm, id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) END AS folded_into FROM ev0),
seen AS (SELECT id, kind, status, last_value(CASE WHEN kind = 'action' THEN id END IGNORE NULLS) OVER b AS action,
  last_value(CASE WHEN kind = 'question' THEN id END IGNORE NULLS) OVER b AS question, lag(id) OVER w AS before, lag(status) OVER w AS status_before,
  last_value(CASE WHEN kind = 'question' THEN tm END IGNORE NULLS) OVER b AS asked, last_value(CASE WHEN kind = 'decision' THEN tm END IGNORE NULLS) OVER b AS decided
 FROM ev WINDOW w AS (PARTITION BY session_id ORDER BY tm, id), b AS (PARTITION BY session_id ORDER BY tm, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
ed AS (SELECT id * 4 AS id, CASE WHEN id % 13 = 0 THEN id ELSE action END AS from_id, CASE WHEN id % 13 = 0 THEN action ELSE id END AS to_id, 'verifies' AS relation,
  CASE WHEN id % 17 = 0 THEN 'inferred' ELSE 'structural' END AS basis, id % 11 <> 0 AS active FROM seen WHERE kind = 'outcome' AND action IS NOT NULL
 UNION ALL SELECT id * 4 + 1, question, id, 'follows', 'structural', true FROM seen WHERE kind <> 'question' AND question IS NOT NULL
 UNION ALL SELECT id * 4 + 2, question, id, 'answers', 'explicit', true FROM seen WHERE kind = 'decision' AND question IS NOT NULL AND (decided IS NULL OR decided < asked)
 UNION ALL SELECT id * 4 + 3, before, id, 'motivates', 'inferred', true FROM seen WHERE kind = 'action' AND status_before = 'observed_failure')"""
