"""Quality rules whose cutoffs are set by risk control on labelled holdouts.

Every document gets counts of its words, symbols, lines and repeats. Rules are
one-sided cutoffs on ratios of these counts. For each stratum and rule, the
cutoffs of a fixed grid are tested from mild to sharp: the exact
(Clopper-Pearson) upper limit of the rate of falsely rejected good documents
must lie below the rule's share of the tolerated rate, and the first cutoff
that fails ends the rule's sequence (fixed-sequence testing). The level is
shared by all rules and strata (Bonferroni). With all rules together, a good
document of a stratum is then rejected at most at the tolerated rate, with the
stated confidence. A stratum with too few labelled documents gets no cutoff.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import row_count_at_most, written
from .textkernel import BYTE_CODES, Texts, U, mix, pieces, prefix_hashes, span_hashes, window_hashes

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5

#: rule: (numerator, denominator, +1 if high values are bad or -1 if low ones are, grid of cutoffs from sharp to mild).
RULES: dict[str, tuple[str, str, int, list[float]]] = {
    "symbols": ("n_symbols", "n_words", 1, [0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 1.0]),
    "exclamations": ("n_exclamations", "n_words", 1, [0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 1.0]),
    "capitals": ("n_capitals", "word_chars", 1, [0.08, 0.12, 0.2, 0.3, 0.45, 0.6]),
    "duplicate_lines": ("n_dup_lines", "n_lines", 1, [0.1, 0.2, 0.3, 0.4, 0.5, 0.7]),
    "long_words": ("word_chars", "n_words", 1, [6.0, 6.5, 7.0, 7.5, 8.0, 9.0, 10.0, 12.0]),
    "short_words": ("word_chars", "n_words", -1, [4.0, 3.5, 3.0, 2.5, 2.0]),
}
#: Strata whose cutoffs are sent to every task when texts are filtered.
MOST_BROADCAST = 100_000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_exclamations", "n_capitals")

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1


def _per_document(texts: Texts, of_byte: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(of_byte)))
    return total[texts.end] - total[texts.start]


def count_text(column: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS of each document of a text column; a null counts as an empty text."""
    texts = Texts(column)
    data, n = texts.data, texts.n
    start, end, doc = texts.words()
    out = {"n_words": np.bincount(doc, minlength=n)}
    inside = np.zeros(len(data) + 1, np.int8)
    inside[start] += 1
    inside[end] -= 1
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    out["word_chars"] = _per_document(texts, inside & ((data & 0xC0) != 0x80))
    out["n_symbols"] = _per_document(texts, _SYMBOL[data])
    out["n_exclamations"] = _per_document(texts, data == 0x21)
    # Capitals: A-Z, and the two-byte letters from U+00C0 to U+00DE but the sign between them.
    after = np.concatenate(([0], data[:-1]))
    out["n_capitals"] = _per_document(texts, ((data >= 65) & (data <= 90)) | ((after == 0xC3) & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)))

    prefix = prefix_hashes(BYTE_CODES[data])
    line_end = np.flatnonzero(data == 0x0A)
    line_start = np.concatenate(([0], line_end[:-1] + 1)) if len(line_end) else line_end
    words_before = np.searchsorted(start, np.concatenate((line_start, line_end[-1:])))
    full = np.diff(words_before) > 0
    line_start, line_end = line_start[full], line_end[full]
    line_doc = np.searchsorted(texts.end, line_start, side="right")
    out["n_lines"] = np.bincount(line_doc, minlength=n)
    key = mix(span_hashes(prefix, line_start, line_end) ^ mix(line_doc.astype(U)))
    _, first = np.unique(key, return_index=True)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(line_doc[first], minlength=n)

    window = window_hashes(span_hashes(prefix, start, end), WINDOW)
    same = np.flatnonzero(doc[: len(window)] == doc[WINDOW - 1 :]) if len(window) else np.zeros(0, np.int64)
    key = mix(window[same] ^ mix(doc[same].astype(U)))
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    equal = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][equal]] = True
    twice[order[:-1][equal]] = True
    covered = np.zeros(len(start) + 1, np.int64)
    np.add.at(covered, same[twice], 1)
    np.add.at(covered, same[twice] + WINDOW, -1)
    out["n_repeat_words"] = np.bincount(doc[np.cumsum(covered[:-1]) > 0], minlength=n)
    return out


def with_counts(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of each row with the COUNTS of its whole text. Null text: all counts 0."""
    chosen = docs.select(*keep, F.col(text).cast("string").alias("__text"))
    names = chosen.columns[:-1]
    schema = chosen.select(names).schema
    for name in COUNTS:
        schema = schema.add(name, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            for low, high in pieces(column):
                counts = count_text(column.slice(low, high - low))
                part = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], *(pa.array(counts[c].astype(np.int64)) for c in COUNTS)], names=[*names, *COUNTS])

    return chosen.mapInArrow(run, schema)


def binomial_upper(rejected: int, n: int, delta: float) -> float:
    """Exact upper limit of a rate seen ``rejected`` times in ``n``, at confidence ``1 - delta``; 1 where n is 0."""
    if n <= 0 or rejected >= n:
        return 1.0

    def tail(p: float) -> float:  # probability of at most `rejected` hits
        logs = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p) for k in range(rejected + 1)]
        top = max(logs)
        return math.exp(top) * sum(math.exp(x - top) for x in logs)

    low, high = rejected / n, 1.0
    for _ in range(60):
        middle = (low + high) / 2
        if 0 < middle < 1 and tail(middle) > delta:
            low = middle
        else:
            high = middle
    return high


def base_failed() -> F.Column:
    """Too short, or more than a fifth of the words in repeated windows."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _value(rule: str) -> F.Column:
    above, below, _, _ = RULES[rule]
    return F.try_divide(F.col(above).cast("double"), F.col(below).cast("double"))


def _rejects(rule: str, cutoff: float | F.Column) -> F.Column:
    return F.coalesce(_value(rule) > cutoff if RULES[rule][2] > 0 else _value(rule) < cutoff, F.lit(False))


def fit_cutoffs(counted: DataFrame, stratum: str, strata: int, tolerated: float = 0.05, delta: float = 0.05) -> DataFrame:
    """(stratum, a cutoff or null for each rule, evidence): the sharpest cutoffs that the good rows of ``counted`` allow.

    Only base-passing rows count. The cutoffs of a rule are tested in their
    fixed order from mild to sharp and the first one that fails ends the
    sequence, so a rule's tests need no correction among themselves; the level
    is shared by all rules of all ``strata`` (Bonferroni). Counts are summed in
    Spark, and the limits are computed there, a row for each stratum; evidence
    has (rule, cutoff, rejected, good rows, upper limit) of each cutoff taken.
    """
    level, share = delta / max(1, len(RULES) * strata), tolerated / len(RULES)
    tests = [(rule, c) for rule, (_, _, _, grid) in RULES.items() for c in reversed(grid)]
    sums = [F.sum(_rejects(rule, c).cast("long")).alias(f"t{i}") for i, (rule, c) in enumerate(tests)]
    table = counted.where(~base_failed()).groupBy(F.col(stratum).cast("string").alias("stratum")).agg(F.count("*").alias("n"), *sums)
    taken = pa.struct([("rule", pa.string()), ("cutoff", pa.float64()), ("rejected", pa.int64()), ("n", pa.int64()), ("upper", pa.float64())])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                found: dict[str, dict] = {}
                ended = set()
                for i, (rule, cutoff) in enumerate(tests):
                    upper = 1.0 if rule in ended else binomial_upper(row[f"t{i}"], row["n"], level)
                    if upper <= share:
                        found[rule] = {"rule": rule, "cutoff": cutoff, "rejected": row[f"t{i}"], "n": row["n"], "upper": upper}
                    else:
                        ended.add(rule)
                out.append((row["stratum"], *[found[r]["cutoff"] if r in found else None for r in RULES], list(found.values())))
            kinds = [pa.string(), *[pa.float64()] * len(RULES), pa.list_(taken)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names=["stratum", *RULES, "evidence"])

    return table.mapInArrow(fit, f"stratum string, {', '.join(f'{r} double' for r in RULES)}, evidence array<struct<rule:string,cutoff:double,rejected:long,n:long,upper:double>>")


def verdict() -> F.Column:
    """True unless the cutoff of a rule rejects the row; a rule without a cutoff rejects nothing."""
    bad = F.lit(False)
    for rule in RULES:
        bad = bad | F.coalesce(_rejects(rule, F.col(f"cutoff.{rule}")), F.lit(False))
    return ~bad


def labelled_cutoffs(counted: DataFrame, labels: DataFrame, tolerated: float, delta: float) -> DataFrame:
    """``fit_cutoffs`` from the rows of ``counted`` (with stratum and text_key) that ``labels`` marks good, written.

    Labels with null doc_id or quality are ignored; where a document is
    labelled twice, it is good only if no label says otherwise. Exact copies
    are one trial, as trials must be independent.
    """
    good = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")
    trials = counted.join(good, "doc_id", "left_semi").dropDuplicates(["stratum", "text_key"])
    strata = trials.select("stratum").distinct().count()
    return written(fit_cutoffs(trials, "stratum", strata, tolerated, delta), "quality-cutoffs")


def _with_cutoffs(rows: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """``rows`` with the struct ``cutoff`` of their stratum, nulls where it has none: one row for each stratum meets them."""
    table = cutoffs.select(F.col("stratum").alias("__stratum"), F.struct(*RULES).alias("cutoff"))
    # Broadcast while the strata are few, so that no row is shuffled by its stratum.
    table = F.broadcast(table) if row_count_at_most(cutoffs, MOST_BROADCAST) else table
    return rows.join(table, F.col("stratum").eqNullSafe(F.col("__stratum")), "left").drop("__stratum")


def _counted(docs: DataFrame) -> DataFrame:
    named = docs.select("doc_id", F.col("lang").cast("string").alias("stratum"), F.xxhash64("text").alias("text_key"), "text")
    return written(with_counts(named, keep=("doc_id", "stratum", "text_key")), "quality-counts")


def score_documents(docs: DataFrame, labels: DataFrame, tolerated: float = 0.05, delta: float = 0.05) -> DataFrame:
    """Counts, ``base_failed`` and ``kept`` of each row of ``docs``, one row out for one in.

    Strata are the values of ``lang`` (null is a stratum of its own). Rows of
    docs with a null doc_id are never labelled but are scored. Empty and null
    texts have no words and fail the base rules. Without usable labels only
    the base rules decide. Ties with a cutoff are kept. Other columns of docs
    and labels are not read, whatever their names.
    """
    counted = _counted(docs)
    joined = _with_cutoffs(counted, labelled_cutoffs(counted, labels, tolerated, delta))
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict()).drop("cutoff", "text_key")


def keep_good(docs: DataFrame, labels: DataFrame, tolerated: float = 0.05, delta: float = 0.05) -> DataFrame:
    """The rows of ``docs``, all columns, that ``score_documents`` keeps; an empty table stays empty.

    The counts that the cutoffs are fitted on are written without the texts;
    the texts are counted once more where they are filtered, and stay in Spark.
    """
    cutoffs = labelled_cutoffs(_counted(docs), labels, tolerated, delta)

    @F.arrow_udf(T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))
    def counts(column: pa.Array) -> pa.Array:
        parts = [count_text(column.slice(low, high - low)) for low, high in pieces(column)]
        return pa.StructArray.from_arrays([pa.array(np.concatenate([p[c] for p in parts]).astype(np.int64) if parts else [], pa.int64()) for c in COUNTS], names=list(COUNTS))

    own = {f"c{i}": c for i, c in enumerate(docs.columns)}
    named = docs.select(*[F.col(c).alias(k) for k, c in own.items()], F.col("lang").cast("string").alias("stratum"), counts(F.col("text").cast("string")).alias("counts"))
    passed = named.select(*own, "stratum", "counts.*").where(~base_failed())
    return _with_cutoffs(passed, cutoffs).where(verdict()).select(*[F.col(k).alias(c) for k, c in own.items()])
