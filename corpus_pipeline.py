"""From raw documents to packed training sequences, in five stages.

Quality rules drop bad documents; of near copies one document stays; byte
strings that still stand more than once are cut out; secrets are replaced; what
is left is packed into sequences. Each stage works on all that the one before
kept, and reads it from Parquet in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.llm import ngram_join, packing, quality_rules, secret_scan, suffix_dedup
from tracelode.llm.queries import WORD_BPE
from tracelode.llm.store import bounded_batches, written
from tracelode.llm.tokens import tokenizer_path

#: Bytes of a string that is cut out where it repeats: below what 50 words of prose take, while op1's contract fixes 400.
REPEATED_BYTES = 250

#: Columns of ``documents`` that a stage passes on as they are.
PLAIN = ("doc_id", "lang", "source")


def _with_text(docs: DataFrame, text: str) -> DataFrame:
    """The columns of documents, with ``text`` as the text."""
    return docs.select("doc_id", F.col(text).alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the risk-controlled cutoffs keep."""
    bounded_batches(spark)
    return quality_rules.keep_good(docs.select("doc_id", "text", "lang", "source", "n_chars"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8; documents without words stay."""
    bounded_batches(spark)
    return ngram_join.keep_one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the strings of REPEATED_BYTES bytes that stand in them more than once."""
    bounded_batches(spark)
    return _with_text(suffix_dedup.remove_repeats(docs, PLAIN, with_text=True, length=REPEATED_BYTES), "kept")


def replace_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their secrets replaced."""
    bounded_batches(spark)
    return _with_text(secret_scan.scan_documents(docs, secret_scan.fit(docs), PLAIN, with_text=True), "clean")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and place there."""
    bounded_batches(spark)
    return packing.pack_documents(docs, tokenizer_path(WORD_BPE))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", apply_quality_rules),
    ("ngram_jaccard_join", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("secret_scan", replace_secrets),
    ("best_fit_packing", pack_sequences),
]

#: Suffix sorting, the forest and the tokenizer are beyond SQL: the tests hold the rows against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"pipeline-{name}")
    return docs
