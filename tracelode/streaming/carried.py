"""Records of a transcript stream, with what a reader carries from line to line.

A line's working folder holds until another is named, and a tool's result has
the folder and the model of its call, which may stand in an earlier batch.
Both are kept for each file in keyed state; JSON is parsed by column
expressions before and after. ``whole_records`` gives the same rows of a whole
table of lines, by as-of joins: what was read in parts equals what is read at
once, whatever was appended, cut or rewritten in between.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.secrets import mask_secrets
from ..functions.text import content_id
from ..operators import ordered
from ..sources.transcripts import BLOCKS, CLAUDE, plain_text

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CARRIED = "file string, generation int, n long, line string, cwd string, relevant boolean, owner_cwd array<string>, owner_model array<string>"
#: A place in a file: line and block as one number.
_PLACE = 1 << 20


def parsed(lines: DataFrame) -> DataFrame:
    """``lines`` (line, ...) with r, the typed row of a conversation line, and blocks, its parts."""
    rows = lines.withColumn("r", F.from_json("line", CLAUDE))
    content = F.col("r.message.content")
    single = F.array(F.struct(F.lit("text").alias("type"), content.alias("text"), *[F.lit(None).cast(t).alias(c) for c, t in (("id", "string"), ("name", "string"), ("input", "string"), ("tool_use_id", "string"), ("content", "string"), ("is_error", "boolean"))]))
    blocks = F.when(content.startswith("["), F.from_json(content, BLOCKS)).when(content.isNotNull(), single)
    return rows.withColumn("blocks", F.when(F.col("r.type").isin("user", "assistant"), F.coalesce(blocks, F.from_json(F.lit("[]"), BLOCKS))))


def _model() -> Column:
    """The model of an answer; a name in angle brackets stands for no model."""
    model = F.col("r.message.model")
    return F.when((F.col("r.type") == "assistant") & ~model.startswith("<"), model)


def _call_folder(block: Column) -> Column:
    """The folder that a tool call names, if it is a whole path."""
    named = F.coalesce(F.get_json_object(block["input"], "$.cwd"), F.get_json_object(block["input"], "$.workdir"))
    return F.when(named.startswith("/"), named)


def _within(folder: Column, roots: list[str]) -> Column:
    inside = F.lit(False)
    for root in roots:
        inside = inside | (folder == root) | folder.startswith(root.rstrip("/") + "/")
    return F.coalesce(inside, F.lit(False))


class Carrier(StatefulProcessor):
    """Numbers the lines of a file and hands on folder, relevance and calls. A new generation begins with nothing."""

    def __init__(self, roots: list[str]):
        self.roots = [r.rstrip("/") for r in roots]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "generation int, lines long, cwd string, relevant boolean")
        self.calls = handle.getMapState("calls", "call_id string", "cwd string, model string")

    def _inside(self, folder: str | None) -> bool:
        return folder is not None and any(folder == r or folder.startswith(r + "/") for r in self.roots)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # A batch of the source bounds what a key has here; lines of a file come from several ranges.
        every = pd.concat(list(rows)).sort_values(["generation", "offset"])
        generation, lines, cwd, relevant = self.held.get() if self.held.exists() else (-1, 0, None, False)
        known: dict[str, tuple] = {}
        out = []
        for row in every.itertuples(index=False):
            if row.generation < generation:
                continue
            if row.generation > generation:
                if generation >= 0:
                    self.calls.clear()
                    known.clear()
                generation, lines, cwd, relevant = int(row.generation), 0, None, False
            if row.offset < 0:
                out.append((key[0], generation, 0, None, None, False, [], []))
                continue
            lines += 1
            cwd = cwd if row.named is None else row.named
            relevant = relevant or self._inside(cwd)
            if row.kinds is None:
                continue
            folders, models = [], []
            for kind, call, named in zip(row.kinds, row.call_ids, row.folders, strict=True):
                folder, model = cwd, row.model
                if kind == "tool_use":
                    folder = cwd if named is None else named
                    if call is not None:
                        known[call] = (folder, model)
                        self.calls.updateValue((call,), (folder, model))
                elif kind == "tool_result":
                    if call is not None and call not in known and self.calls.containsKey((call,)):
                        known[call] = tuple(self.calls.getValue((call,)))
                    folder, model = known.get(call, (cwd, None))
                folders.append(folder)
                models.append(model)
            out.append((key[0], generation, lines, row.line, cwd, relevant, folders, models))
        self.held.update((generation, lines, cwd, relevant))
        yield pd.DataFrame(out, columns=["file", "generation", "n", "line", "cwd", "relevant", "owner_cwd", "owner_model"])

    def close(self) -> None:
        pass


def carried_lines(lines: DataFrame, roots: list[str]) -> DataFrame:
    """CARRIED rows of a stream (file, generation, offset, line): its conversation lines, and a row without a line where a generation begins. Needs STATE_STORE."""
    rows = parsed(lines)
    small = rows.select("file", "generation", "offset", F.when(F.col("blocks").isNotNull(), F.col("line")).alias("line"), F.col("r.cwd").alias("named"), _model().alias("model"), F.transform("blocks", lambda b: b["type"]).alias("kinds"), F.transform("blocks", lambda b: F.coalesce(b["id"], b["tool_use_id"])).alias("call_ids"), F.transform("blocks", _call_folder).alias("folders"))
    return small.groupBy("file").transformWithStateInPandas(Carrier(roots), CARRIED, "append", "none")


def append_available(frame: DataFrame, path: str, checkpoint: str) -> None:
    """Runs a stream until it has taken what stands in its source, appends its rows as Parquet below ``path``, and stops; a later call goes on from ``checkpoint``."""
    spark, key = frame.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, STATE_STORE)
    try:
        query = frame.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def records_of(carried: DataFrame, roots: list[str]) -> DataFrame:
    """The records of CARRIED rows: one for each text, tool call and tool result whose folder lies in ``roots`` (all of them if there are none)."""
    rows = parsed(carried.where("line IS NOT NULL"))
    each = rows.select("file", "generation", "n", "relevant", "r", "owner_cwd", "owner_model", F.posexplode("blocks").alias("k", "b")).where(F.col("b.type").isin("text", "tool_use", "tool_result"))
    role = F.when(F.col("b.type") == "tool_use", "tool_call").when(F.col("b.type") == "tool_result", "tool_result").when(F.coalesce("r.isCompactSummary", F.lit(False)), "metadata").otherwise(F.col("r.type"))
    text = F.when(F.col("b.type") == "tool_use", F.concat(F.lit("Tool: "), F.coalesce("b.name", F.lit("unknown")), F.lit("\n"), F.coalesce("b.input", F.lit("{}")))).when(F.col("b.type") == "tool_result", plain_text(F.col("b.content"))).otherwise(F.col("b.text"))
    native = F.concat(F.coalesce("r.uuid", F.concat(F.lit("line:"), F.col("n").cast("string"))), F.lit(":"), F.col("k").cast("string"))
    made = each.select("file", "generation", "n", "k", "relevant", F.col("r.sessionId").alias("session_id"), role.alias("role"), mask_secrets(text).alias("content"), native.alias("native_id"), F.col("r.timestamp").alias("recorded_at"), F.get("owner_cwd", F.col("k")).alias("cwd"), F.get("owner_model", F.col("k")).alias("model"), F.coalesce("b.id", "b.tool_use_id").alias("call_id"))
    named = made.where(F.coalesce("content", F.lit("")) != "").withColumn("source_id", content_id("src_", F.lit("claude"), F.coalesce("session_id", F.lit("")), F.col("native_id")))
    return named.where(_within(F.col("cwd"), roots)) if roots else named


def whole_records(lines: DataFrame, roots: list[str]) -> DataFrame:
    """The same records of a table of lines (file, generation, n, line), each file from its first line on."""
    rows = parsed(lines.select("file", "generation", "n", "line"))
    block = ordered.block_of(F.col("n"))
    rows = ordered.last_before(rows, ["file", "generation"], ["n"], F.col("r.cwd"), "cwd", block)
    rows = ordered.running_count(rows, ["file", "generation"], ["n"], _within(F.col("cwd"), roots), "__inside", block)
    each = rows.where("blocks IS NOT NULL").select("file", "generation", "n", "line", "cwd", (F.col("__inside") > 0).alias("relevant"), _model().alias("__model"), F.posexplode_outer("blocks").alias("k", "b"))
    each = each.withColumn("__place", F.col("n") * _PLACE + F.coalesce("k", F.lit(0))).withColumn("__call", F.to_json(F.array("file", F.col("generation").cast("string"), F.coalesce("b.id", "b.tool_use_id"))))
    folder = F.when(F.col("b.type") == "tool_use", F.coalesce(_call_folder(F.col("b")), F.col("cwd"))).otherwise(F.col("cwd"))
    each = each.withColumn("__folder", folder)
    named = F.coalesce("b.id", "b.tool_use_id").isNotNull()
    calls = each.where((F.col("b.type") == "tool_use") & named).select(F.col("__call").alias("__of"), F.col("__place").alias("__at"), F.col("__folder").alias("folder"), F.col("__model").alias("model"))
    results = ordered.as_of(each.where((F.col("b.type") == "tool_result") & named), calls, "__call", "__of", "__place", "__at", ["folder", "model"], "__owner", ordered.block_of(F.col("__o"), _PLACE * ordered.BLOCK))
    owned = results.unionByName(each.where(~F.coalesce((F.col("b.type") == "tool_result") & named, F.lit(False))), allowMissingColumns=True)
    result = F.coalesce(F.col("b.type") == "tool_result", F.lit(False))
    owned = owned.withColumn("__cwd", F.when(result & F.col("__owner").isNotNull(), F.col("__owner.folder")).otherwise(F.col("__folder"))).withColumn("__by", F.when(result, F.col("__owner.model")).otherwise(F.col("__model")))
    whole = owned.groupBy("file", "generation", "n").agg(*[F.first(c).alias(c) for c in ("line", "cwd", "relevant")], F.sort_array(F.collect_list(F.struct("k", F.col("__cwd").alias("c"), F.col("__by").alias("m")))).alias("__parts"))
    return records_of(whole.select("file", "generation", "n", "line", "cwd", "relevant", F.transform("__parts", lambda p: p["c"]).alias("owner_cwd"), F.transform("__parts", lambda p: p["m"]).alias("owner_model")), roots)


def last_generation(rows: DataFrame, begun: DataFrame) -> DataFrame:
    """``rows`` of the newest generation of each file; ``begun`` is (file, generation) of every generation, those without rows too."""
    newest = begun.groupBy("file").agg(F.max("generation").alias("generation"))
    return rows.join(newest, ["file", "generation"])
