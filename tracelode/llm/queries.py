"""The queries opN_<name> over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, embedding_dedup, fill_middle, language_id, ngram_join, packing, quality_classifier, quality_rules, secret_scan, suffix_dedup, token_output, url_filter, whitening
from .oracles import ORACLES
from .store import bounded_batches
from .tokens import tokenizer_path

__all__ = ["ORACLES", "QUERIES"]

WORD_BPE = "word_bpe_49k.json"
#: Allow and block entries of op13, as the contract states them.
URL_RULES = ("allow com/", "block example.com/en/", "allow www.example.com/en/", "block net/es/", "block net/fr/")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest columns of every document, and the text that stays."""
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"), with_text=True).withColumnRenamed("kept", "text")


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.link_vectors(_table(spark, sf_dir, "embeddings"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return secret_scan.scan_documents(documents, secret_scan.fit(documents))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path(WORD_BPE))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_pages(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "documents"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_documents(_table(spark, sf_dir, "documents"))


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = token_output.fresh_target(spark)
    token_output.write_tokens(_table(spark, sf_dir, "documents"), target, tokenizer_path(WORD_BPE), end_id=1)
    return token_output.read_tokens(spark, target, with_ids=False)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_rules.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = byte_bpe.read_ranks(tokenizer_path("byte_bpe_multi_50k.tiktoken"))
    encoded = byte_bpe.encode_documents(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return encoded.select("doc_id", "n_tokens", F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return quality_classifier.score_documents(documents, quality_classifier.fit(documents, _table(spark, sf_dir, "labels")))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.fill_in_middle(_table(spark, sf_dir, "documents"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(fill_middle.restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deviation is null where its exact value does not fit a long."""
    return whitening.whiten(_table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("long"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_pages(_table(spark, sf_dir, "pages"), url_filter.parse_rules(spark, URL_RULES))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_secret_scan": op3_secret_scan,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_language_id": op5_language_id,
    "op6_ngram_join": op6_ngram_join,
    "op7_token_output": op7_token_output,
    "op8_quality_rules": op8_quality_rules,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_url_filter": op13_url_filter,
}
