"""Token ids in a binary format made for reading single short documents.

A table of shards, each a row of a Parquet file: the documents' ids as
unsigned 32-bit little-endian integers, compressed one by one with zstandard
against one shared dictionary, one after the other in ``payload``; ``index``
holds each document's doc_id, place and number of ids, ``dictionary_hash`` names
the dictionary, which lies beside the shards in ``dictionary``. Shards follow
each other by (part, shard) in ascending doc_id order; a document is read by
slicing its shard's payload. Shards end at SHARD_BYTES, so that a task holds
one of them or one document. Spark writes the files, so they can lie in any
store that Spark reaches, and a lost executor's shards are written again.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import shared_dir, written
from .textkernel import pieces
from .tokens import encoder

SHARD_BYTES = 2 << 20
#: The dictionary is fitted on at most so many documents and ids of each.
SAMPLE_DOCUMENTS, SAMPLE_IDS = 400, 4096
DICTIONARY_BYTES = 32 << 10
LEVEL = 3
#: Bytes of text encoded at once: a run is looked up once for each such piece.
ENCODED_BYTES = 1 << 20
INDEX = "array<struct<doc_id:long,at:long,size:long,n_tokens:long>>"
SHARDS = f"part int, shard int, n_tokens long, dictionary_hash string, payload binary, index {INDEX}"


def train_dictionary(docs: DataFrame, path: str, end_id: int | None) -> bytes:
    """A zstandard dictionary from a bounded sample, the documents whose hash is smallest.

    The hashes are ranked first, so only the texts of the sample travel. A
    sample too small to fit a dictionary is itself the dictionary, as raw
    content; without any document it is empty, and there are no frames.
    """
    import zstandard

    hashed = F.xxhash64("doc_id", "text")
    least = docs.select(hashed.alias("h")).distinct().orderBy("h").limit(SAMPLE_DOCUMENTS).agg(F.max("h").alias("h")).first()["h"]
    sample = docs.where(hashed <= F.lit(least)).select(F.col("text").cast("string").alias("text")).limit(SAMPLE_DOCUMENTS).toArrow().column(0).combine_chunks()
    ids, sizes = encoder(path).encode(sample)
    ends = np.cumsum(sizes)
    serialized = [np.append(ids[b - n : b], [end_id] if end_id is not None else []).astype("<u4")[:SAMPLE_IDS].tobytes() for b, n in zip(ends, sizes, strict=True)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, serialized).as_bytes()
    except zstandard.ZstdError:  # too few or too short
        return b"".join(serialized)[-DICTIONARY_BYTES:]


def _compressor(dictionary: bytes):
    import zstandard

    return zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def _decompressor(dictionary: bytes):
    import zstandard

    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def frames(docs: DataFrame, path: str, dictionary: bytes, end_id: int | None) -> DataFrame:
    """One row for each document: doc_id, n_tokens, its compressed ids."""
    wide = docs.sparkSession.sparkContext.broadcast(dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, compressor = encoder(path), _compressor(wide.value)
        for batch in batches:
            column = batch.column(1)
            for low, high in pieces(column, ENCODED_BYTES):
                ids, sizes = known.encode(column.slice(low, high - low))
                out, at = [], 0
                for n in sizes.tolist():
                    own = ids[at : at + n]
                    out.append(compressor.compress((own if end_id is None else np.append(own, np.uint32(end_id))).astype("<u4").tobytes()))
                    at += n
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(sizes + (end_id is not None)), pa.array(out, pa.binary())], names=["doc_id", "n_tokens", "frame"])
        known.forget()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, frame binary")


def write_tokens(docs: DataFrame, target: str, tokenizer: str, end_id: int | None = None) -> None:
    """Write the ids of every row's whole text (null: empty) below ``target``, rows by ascending doc_id.

    A null doc_id comes first; rows with equal ids are ordered by their number
    of tokens and bytes. Repeated rows are written each. An empty table gives
    no shards. Other columns are not read.
    """
    spark = docs.sparkSession
    dictionary = train_dictionary(docs, tokenizer, end_id)
    digest = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(digest, dictionary)], "dictionary_hash string, dictionary binary").write.parquet(f"{target}/dictionary")
    compressed = written(frames(docs, tokenizer, dictionary, end_id), "token-frames")
    # Equal ids, nulls among them, may be many: the bytes part them.
    ordered = compressed.withColumn("h", F.xxhash64("frame")).repartitionByRange("doc_id", "n_tokens", "h").sortWithinPartitions("doc_id", "n_tokens", "h", "frame")

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, index, tokens, size = TaskContext.get().partitionId(), 0, [], [], 0, 0

        def row() -> pa.RecordBatch:
            kind = pa.list_(pa.struct([(k, pa.int64()) for k in ("doc_id", "at", "size", "n_tokens")]))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([tokens]), pa.array([digest]), pa.array([b"".join(held)], pa.binary()), pa.array([index], kind)], names=["part", "shard", "n_tokens", "dictionary_hash", "payload", "index"])

        for batch in batches:
            for doc_id, n, frame in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if held and size + len(frame) > SHARD_BYTES:
                    yield row()
                    number, held, index, tokens, size = number + 1, [], [], 0, 0
                index.append({"doc_id": doc_id, "at": size, "size": len(frame), "n_tokens": n})
                held.append(frame)
                tokens, size = tokens + n, size + len(frame)
        if held:
            yield row()

    ordered.drop("h").mapInArrow(shard, SHARDS).write.parquet(f"{target}/shards")


def read_tokens(spark: SparkSession, target: str, with_ids: bool = True) -> DataFrame:
    """Every document of ``target``: doc_id, start (ids before it), n_tokens, ids_crc32 and, if asked for, ids."""
    rows = spark.read.parquet(f"{target}/dictionary").limit(1).collect()  # one row, DICTIONARY_BYTES at most
    digest, dictionary = rows[0]["dictionary_hash"], bytes(rows[0]["dictionary"])
    wide = spark.sparkContext.broadcast(dictionary)
    shards = spark.read.schema(SHARDS).parquet(f"{target}/shards")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decompressor = _decompressor(wide.value)
        for batch in batches:
            for part, number, named, payload, index in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if named != digest:
                    raise ValueError(f"shard {part}/{number} needs dictionary {named}, found {digest}")
                ids = [decompressor.decompress(payload[x["at"] : x["at"] + x["size"]]) for x in index]
                n = np.array([x["n_tokens"] for x in index], np.int64)
                columns = [pa.array(np.full(len(n), part, np.int32)), pa.array(np.full(len(n), number, np.int32)), pa.array([x["doc_id"] for x in index], pa.int64()), pa.array(np.cumsum(n) - n), pa.array(n), pa.array([zlib.crc32(x) for x in ids], pa.int64())]
                if with_ids:
                    columns.append(pa.array([np.frombuffer(x, "<u4").astype(np.int64) for x in ids], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, names=["part", "shard", "doc_id", "inside", "n_tokens", "ids_crc32", *["ids"] * with_ids])

    docs = shards.select("part", "shard", "dictionary_hash", "payload", "index").mapInArrow(run, "part int, shard int, doc_id long, inside long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
    sums = shards.groupBy("part", "shard").agg(F.sum("n_tokens").alias("n"))
    # One row for each range partition meets in one task, not one for each document or shard.
    parts = sums.groupBy("part").agg(F.sum("n").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = sums.select("part", "shard", (F.sum("n").over(Window.partitionBy("part").orderBy("shard")) - F.col("n")).alias("ahead"))
    starts = inside.join(parts, "part").select("part", "shard", (F.col("before") + F.col("ahead")).alias("base"))
    return docs.join(starts, ["part", "shard"]).select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def read_document(spark: SparkSession, target: str, doc_id: int) -> list[list[int]]:
    """The ids of the documents with this doc_id: one shard's row is read, one slice of it decompressed."""
    dictionary = bytes(spark.read.parquet(f"{target}/dictionary").first()["dictionary"])
    place = F.explode(F.filter("index", lambda x: x["doc_id"] == doc_id)).alias("x")
    found = spark.read.schema(SHARDS).parquet(f"{target}/shards").select("payload", place).select(F.expr("substring(payload, cast(x.at as int) + 1, cast(x.size as int))").alias("frame"))
    return [np.frombuffer(_decompressor(dictionary).decompress(bytes(r["frame"])), "<u4").tolist() for r in found.collect()]


def fresh_target(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
