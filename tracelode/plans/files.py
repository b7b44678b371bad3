"""Queries that write tables as transcript files or versions and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import appended, listing, transcripts, versions
from ..sources.store import bounded_batches, shared_dir
from .bindings import table
from .registry import query

MASKED = r"""regexp_replace(text, '(token = ")[0-9a-f]{40}"', '\1[secret hidden]"', 'g')"""


def _as_files(lines: DataFrame, key: str, order: list[str]) -> str:
    """Writes ``lines`` (key, ..., line) as text files, one for each value of ``key``, lines in order; returns the folder."""
    folder = f"{shared_dir(lines.sparkSession)}/transcripts-{uuid.uuid4().hex}"
    lines.repartition(key).sortWithinPartitions(key, *order).select(key, "line").write.partitionBy(key).text(folder)
    return folder


@query("src02_line_numbers", "SELECT doc_id, row_number() OVER (PARTITION BY doc_id % 64 ORDER BY doc_id) AS n, sha256(text) AS text_hash FROM documents WHERE text IS NOT NULL")
def line_numbers(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", (F.col("doc_id") % 64).alias("file"), F.to_json(F.struct("doc_id", "text")).alias("line"))
    lines = transcripts.read_lines(spark, _as_files(docs, "file", ["doc_id"]), whole=True)
    row = F.from_json("line", "doc_id bigint, text string", transcripts.JSON)
    return lines.select(row["doc_id"].alias("doc_id"), "n", F.sha2(row["text"], 256).alias("text_hash"))


def _as_frames(lines: DataFrame, most: int = 1 << 16) -> str:
    """Writes ``lines`` (line) as zstandard files, one for each partition, in frames of ``most`` bytes that end anywhere in a line; returns the folder."""
    import io

    import pyarrow as pa
    import zstandard
    from pyspark import TaskContext

    from ..sources.tail import _opened

    folder = f"{shared_dir(lines.sparkSession)}/zstd-{uuid.uuid4().hex}"
    _opened(folder)[0].create_dir(_opened(folder)[1], recursive=True)

    def run(batches):
        source, top = _opened(folder)
        task = TaskContext.get()
        name, part = f"{top}/{task.partitionId()}.jsonl.zst", f"{top}/_{task.partitionId()}-{task.attemptNumber()}"
        with source.open_output_stream(part) as out:
            held, packer = io.BytesIO(), zstandard.ZstdCompressor()
            for batch in batches:
                for line in batch.column(0).to_pylist():
                    held.write(line.encode() + b"\n")
                    while held.tell() >= most:
                        data = held.getvalue()
                        out.write(packer.compress(data[:most]))
                        held = io.BytesIO()
                        held.write(data[most:])
            out.write(packer.compress(held.getvalue()))
        source.move(part, name)
        yield pa.RecordBatch.from_arrays([pa.array([name])], names=["file"])

    lines.select("line").mapInArrow(run, "file string").count()
    return folder


@query("src03_zstd_lines", "SELECT doc_id, sha256(text) AS text_hash FROM documents WHERE text IS NOT NULL")
def zstd_lines(spark, sf_dir):
    """All documents as zstandard files of many frames, read back frame by frame; none is refused."""
    bounded_batches(spark)
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.to_json(F.struct("doc_id", "text")).alias("line"))
    lines, refused = appended.read_zstd(spark, _as_frames(docs))
    if not refused.isEmpty():
        raise AssertionError("a file that was just written is refused")
    return lines.select(F.get_json_object("line", "$.doc_id").cast("bigint").alias("doc_id"), F.sha2(F.get_json_object("line", "$.text"), 256).alias("text_hash"))


@query("src04_listing", "SELECT 'lang=' || lang || '/source=' || source AS folder, CAST(1 AS BIGINT) AS n_files, true AS filled FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL GROUP BY lang, source")
def listed_files(spark, sf_dir):
    """All documents as text files in folders of folders, which are then walked."""
    top = f"{shared_dir(spark)}/listed-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL")
    docs.select("lang", "source", F.regexp_replace("text", "\n", " ").alias("line")).repartition("lang", "source").write.partitionBy("lang", "source").text(top)
    found = listing.transcripts(listing.walk(spark, top), ".txt")
    return found.groupBy(F.regexp_extract("path", "(lang=[^/]*/source=[^/]*)/[^/]*$", 1).alias("folder")).agg(F.count("*").alias("n_files"), F.min(F.col("size") > 0).alias("filled"))


def _claude(spark, sf_dir) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    row = F.struct(F.col("role").alias("type"), F.concat_ws("-", "conv_id", "turn").alias("uuid"), F.col("conv_id").cast("string").alias("sessionId"), F.struct(F.col("text").alias("content")).alias("message"))
    lines = turns.select((F.col("conv_id") % 16).alias("file"), "conv_id", "turn", F.to_json(row).alias("line"))
    return transcripts.claude_records(transcripts.read_lines(spark, _as_files(lines, "file", ["conv_id", "turn"]), whole=True))


@query("src07_claude_records", f"SELECT CAST(conv_id AS VARCHAR) AS session_id, conv_id || '-' || turn || ':0' AS native_id, role, sha256({MASKED}) AS content_hash FROM conversations WHERE role IN ('user', 'assistant')")
def claude_records(spark, sf_dir):
    return _claude(spark, sf_dir).select("session_id", "native_id", "role", "content_hash")


def _codex(spark, sf_dir) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    payload = F.struct(F.lit("message").alias("type"), F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("role"), F.col("text").alias("content"))
    said = turns.select(F.col("conv_id").alias("file"), "turn", F.to_json(F.struct(F.lit("response_item").alias("type"), payload.alias("payload"))).alias("line"))
    meta = turns.select("conv_id").distinct().select(F.col("conv_id").alias("file"), F.lit(-1).alias("turn"), F.to_json(F.struct(F.lit("session_meta").alias("type"), F.struct(F.concat(F.lit("c"), "conv_id").alias("id"), F.lit("/w").alias("cwd")).alias("payload"))).alias("line"))
    return transcripts.codex_records(transcripts.read_lines(spark, _as_files(said.unionByName(meta), "file", ["turn"]), whole=True))


@query("src06_codex_records", f"SELECT 'c' || conv_id AS session_id, conv_id || '-' || turn AS native_id, CASE role WHEN 'system' THEN 'metadata' ELSE role END AS role, sha256({MASKED}) AS content_hash, '/w' AS cwd FROM conversations")
def codex_records(spark, sf_dir):
    return _codex(spark, sf_dir).select("session_id", "native_id", "role", "content_hash", "cwd")


@query("src14_collected_records", "SELECT provider, count(*) AS n FROM (SELECT 'claude' AS provider FROM conversations WHERE role IN ('user', 'assistant') UNION ALL SELECT 'codex' FROM conversations) GROUP BY 1")
def collected(spark, sf_dir):
    claude = _claude(spark, sf_dir)
    every = transcripts.collect_records(claude, _codex(spark, sf_dir), claude.withColumn("file", F.concat(F.lit("copy-of-"), "file")))
    return every.groupBy("provider").agg(F.count("*").alias("n"))


@query("src01_row_types", "SELECT role AS type, CASE role WHEN 'system' THEN 'known' ELSE 'known' END AS bucket, count(*) AS n FROM conversations GROUP BY role UNION ALL SELECT 'corrupt', 'unreadable', count(DISTINCT conv_id) FROM conversations UNION ALL SELECT 'mystery', 'unknown', count(DISTINCT conv_id) FROM conversations")
def row_types(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    said = turns.select((F.col("conv_id") % 16).alias("file"), "conv_id", "turn", F.to_json(F.struct(F.col("role").alias("type"), "text")).alias("line"))
    odd = turns.select("conv_id").distinct().select((F.col("conv_id") % 16).alias("file"), "conv_id", F.explode(F.array(F.lit("broken {"), F.lit('{"type": "mystery"}'))).alias("line")).withColumn("turn", F.lit(-1))
    lines = transcripts.read_lines(spark, _as_files(said.unionByName(odd), "file", ["conv_id", "turn"]), whole=True)
    return transcripts.row_types(lines)


@query("snk01_published_versions", "SELECT o_orderkey AS id, 'first' AS title FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, 'second' FROM orders")
def published_versions(spark, sf_dir):
    root = f"{shared_dir(spark)}/graph-{uuid.uuid4().hex}"
    orders = table(spark, sf_dir, "orders")
    first = versions.publish({"events": orders.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("id"), F.lit("first").alias("title"))}, root, 0)
    second = versions.publish({"events": orders.select(F.col("o_orderkey").alias("id"), F.lit("second").alias("title"))}, root, first)
    try:
        versions.publish({"events": orders.select(F.col("o_orderkey").alias("id"), F.lit("third").alias("title"))}, root, first)
        raise AssertionError("a version was published twice")
    except versions.VersionConflict:
        pass
    return versions.read_version(spark, root, "events", first).union(versions.read_version(spark, root, "events", second))
