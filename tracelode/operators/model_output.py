"""Reading what a model process printed: the answer, its usage, and whether it may be used.

``outputs`` are lines (run_id, n, line) of an event stream, or one envelope
(run_id, text) a run. What decides is the first event that does not belong, by
its place; all is one aggregation over parsed columns, so a run of any length
is summed before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import one_line, safe_text

#: Item kinds that an answer may hold, kinds that are tools, and events that are failures.
ALLOWED_ITEMS, ITEM_EVENTS, FAILURES = ("agent_message", "reasoning"), ("item.started", "item.updated", "item.completed"), ("turn.failed", "error")
UNREADABLE, NO_EVENT, NO_ITEM, FORBIDDEN, FAILED, PARTIAL, NO_ANSWER = "unreadable output", "an event of unknown shape", "an item of unknown shape", "a forbidden item", "the run failed", "partial output", "unreadable answer"
DENIED, NOT_SUCCESS = "an error or a denied tool", "not a successful result"
#: Characters of a failure's own words.
MOST_REASON = 200
OUTPUT = "run_id, verdict, reason, answer, usage"


def _shape(value: Column) -> Column:
    """OBJECT, ARRAY, STRING and so on; null for a null variant."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def _is_object(value: Column) -> Column:
    return F.coalesce(_shape(value) == "OBJECT", F.lit(False))


def _said(value: Column, path: str) -> Column:
    """A text at a path; null where it is none or blank."""
    part = F.try_variant_get(value, path, "variant")
    text = F.when(_shape(part) == "STRING", F.try_variant_get(value, path, "string"))
    return F.when(F.trim(text) != "", one_line(safe_text(text, multiline=False), MOST_REASON))


def read_events(outputs: DataFrame) -> DataFrame:
    """OUTPUT rows of event streams (run_id, n, line): verdict ok, refused or retry.

    Refused, by the first line that is no JSON, no event, an item of unknown
    shape, an item that is neither message nor reasoning (tools above all), or
    a failure, whose last own words follow the reason; refused too without the
    event that ends the turn. The last message is the answer; if it is no JSON
    object the run may be tried again. Blank lines are nothing; a run of blank
    lines only is partial.
    """
    lines = outputs.select("run_id", "n", F.coalesce("line", F.lit("")).alias("line"))
    rows = lines.withColumn("v", F.when(F.trim("line") != "", F.try_parse_json("line")))
    kind, item = F.try_variant_get("v", "$.type", "string"), F.try_variant_get("v", "$.item", "variant")
    item_kind = F.try_variant_get("v", "$.item.type", "string")
    of_item = kind.isin(*ITEM_EVENTS)
    why = (
        F.when((F.trim("line") != "") & F.col("v").isNull(), UNREADABLE)
        .when(F.col("v").isNotNull() & ~_is_object(F.col("v")), NO_EVENT)
        .when(of_item & item.isNotNull() & ~_is_object(item), NO_ITEM)
        .when(of_item & ~F.coalesce(item_kind.isin(*ALLOWED_ITEMS), F.lit(False)), FORBIDDEN)
        .when(kind.isin(*FAILURES), FAILED)
    )
    own = F.when(kind == "error", _said(F.col("v"), "$.message")).when(kind == "turn.failed", _said(F.col("v"), "$.error.message"))
    message = (kind == "item.completed") & (item_kind == "agent_message")
    rows = rows.select("run_id", "n", why.alias("why"), F.when(kind.isin(*FAILURES), own).alias("own"), F.when(message, F.struct(F.try_variant_get("v", "$.item.text", "string").alias("text"))).alias("said"), F.when(kind == "turn.completed", F.struct(F.to_json(F.try_variant_get("v", "$.usage", "variant")).alias("usage"))).alias("done"))
    bad = F.when(F.col("why").isNotNull(), F.struct("n", "why", "own"))
    runs = rows.groupBy("run_id").agg(F.min(bad).alias("bad"), F.max_by("said.text", F.when(F.col("said").isNotNull(), F.col("n"))).alias("text"), F.max_by("done.usage", F.when(F.col("done").isNotNull(), F.col("n"))).alias("usage"), F.count("done").alias("n_done"))
    answer = F.try_parse_json(F.coalesce("text", F.lit("")))
    reason = F.when(F.col("bad").isNotNull(), F.concat_ws(": ", "bad.why", F.when(F.col("bad.why") == FAILED, F.col("bad.own")))).when(F.col("n_done") == 0, PARTIAL)
    return _judged(runs.withColumn("refusal", reason).withColumn("value", answer), F.col("usage"))


def _judged(runs: DataFrame, usage: Column) -> DataFrame:
    good = _is_object(F.col("value"))
    verdict = F.when(F.col("refusal").isNotNull(), "refused").when(good, "ok").otherwise("retry")
    reason = F.coalesce("refusal", F.when(~good, NO_ANSWER))
    done = verdict == "ok"
    return runs.select("run_id", verdict.alias("verdict"), reason.alias("reason"), F.when(done, F.to_json("value")).alias("answer"), F.when(done, usage).alias("usage"))


def _holds(value: Column) -> Column:
    """Whether a value counts as something: not null, false, zero, or empty."""
    shape = _shape(value)
    nothing = value.isNull() | (shape == "VOID") | F.to_json(value).isin("false", "0", "0.0", '""', "[]", "{}")
    return ~F.coalesce(nothing, F.lit(True))


def read_envelopes(outputs: DataFrame) -> DataFrame:
    """OUTPUT rows of envelopes (run_id, text): a JSON object with ``structured_output``, or an older ``result`` that is JSON text.

    An envelope that tells an error, a denied tool or a result other than
    success is refused; one that cannot be read, or whose answer is no object,
    may be tried again. The cost that it reports goes into the usage.
    """
    rows = outputs.select("run_id", F.try_parse_json(F.coalesce("text", F.lit(""))).alias("v"))
    part = lambda path: F.try_variant_get("v", path, "variant")
    sub = part("$.subtype")
    denied = ~_is_object(F.col("v")) | _holds(part("$.is_error")) | _holds(part("$.permission_denials"))
    odd = sub.isNotNull() & (_shape(sub) != "VOID") & ~F.coalesce(F.try_variant_get("v", "$.subtype", "string") == "success", F.lit(False))
    refusal = F.when(F.col("v").isNotNull() & denied, DENIED).when(F.col("v").isNotNull() & odd, NOT_SUCCESS)
    given = part("$.structured_output")
    older = F.when(_shape(part("$.result")) == "STRING", F.try_parse_json(F.try_variant_get("v", "$.result", "string")))
    value = F.when(given.isNotNull() & (_shape(given) != "VOID"), given).otherwise(older)
    cost = part("$.total_cost_usd")
    paid = F.when(_shape(cost).isin("BIGINT", "DOUBLE", "DECIMAL"), F.to_json(cost))
    usage = F.to_json(part("$.usage"))
    full = F.when(_is_object(part("$.usage")) & paid.isNotNull(), F.concat(F.regexp_replace(usage, r"\}$", ""), F.when(usage != "{}", ",").otherwise(""), F.lit('"reported_cost_usd":'), paid, F.lit("}"))).otherwise(usage)
    return _judged(rows.select("run_id", "v", refusal.alias("refusal"), value.alias("value"), full.alias("full")), F.col("full"))
