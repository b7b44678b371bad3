"""Language of web pages by Bayesian fusion of text, markup, address and host.

Text likelihoods are smoothed frequencies of hashed character trigrams, summed
over all labelled documents. The language that a page declares in its markup
has its own likelihoods, and the host a prior that is smoothed step by step:
a host's share of each language leans on its domain's, that on the address
suffix's, that on the whole corpus's. Both come from grouped sums of the
pages' text posteriors, from which a page's own part is taken out again.
"""

from __future__ import annotations

import html as markup
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import written
from .textkernel import LOWER_CODES, Texts, U, mix, pieces

BUCKETS, CHUNK = 1 << 16, 1 << 13
#: Languages whose table is held and sent at once (half a MB each); more are scored group by group.
LANGUAGES_AT_ONCE = 192
#: Trigrams overlap, so their evidence counts a third; and pseudo-counts of the smoothing.
TEMPER, SMOOTH, LEAN, DECLARED = 1 / 3, 0.5, 4.0, 1.0

_OPENING = re.compile(r"<(?:(!--)|(script|style|noscript)\b)?", re.I)
_CLOSING = {"": re.compile(">"), "!--": re.compile("-->"), **{name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "noscript")}}


def _without_markup(page: str) -> str:
    """A space in place of each comment, each script, style and noscript with what it holds, and each other tag.

    The page is walked forward. What is never closed counts as a plain tag, and
    its end is looked for once: from then on it is known that none follows.
    """
    out, at, never = [], 0, set()
    while opening := _OPENING.search(page, at):
        for kind in ((opening[1] or opening[2] or "").lower(), ""):
            if kind in never:
                continue
            closing = _CLOSING[kind].search(page, opening.end() if kind else opening.start() + 1)
            if closing:
                out += [page[at : opening.start()], " "]
                at = closing.end()
                break
            never.add(kind)
        else:
            out.append(page[at : opening.start() + 1])
            at = opening.start() + 1
        if len(never) == len(_CLOSING) or "" in never:
            break
    return "".join([*out, page[at:]])


def visible_text(page: str | None) -> str:
    """What a page shows, roughly: no markup, comments, scripts or styles."""
    return markup.unescape(_without_markup(page or ""))


def _trigrams(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of each byte trigram inside a document, A-Z lower-cased."""
    code = LOWER_CODES[texts.data]
    if len(code) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    bucket = (mix(code[:-2] + code[1:-1] * U(3) + code[2:] * U(7)) & U(BUCKETS - 1)).astype(np.int64)
    doc = np.repeat(np.arange(texts.n), texts.end - texts.start + 1)
    same = np.flatnonzero(doc[: len(bucket)] == np.append(doc[3:], -1)[: len(bucket)])
    return doc[same], bucket[same]


def trigram_counts(docs: DataFrame) -> DataFrame:
    """(lang, at, n): sums over all rows with a language, a row for each bucket that occurs."""

    def rows_of(total: dict[str, np.ndarray]):
        for name, counts in total.items():
            at = np.flatnonzero(counts)
            for low in range(0, len(at), CHUNK):
                part = at[low : low + CHUNK]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(part), pa.string()), pa.array(part, pa.int32()), pa.array(counts[part], pa.int64())], names=["lang", "at", "n"])

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for low, high in pieces(batch.column(1)):
                doc, bucket = _trigrams(Texts(batch.column(1).slice(low, high - low)))
                edge = np.searchsorted(doc, np.arange(high - low + 1))
                own: dict[str, list[np.ndarray]] = {}
                for i, name in enumerate(langs[low:high]):
                    own.setdefault(name, []).append(bucket[edge[i] : edge[i + 1]])
                for name, parts in own.items():
                    if name not in total and len(total) >= LANGUAGES_AT_ONCE:  # sums are added up later, too
                        yield from rows_of(total)
                        total = {}
                    counts = np.bincount(np.concatenate(parts), minlength=BUCKETS)
                    total[name] = total[name] + counts if name in total else counts
        yield from rows_of(total)

    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", F.col("text").cast("string")).mapInArrow(run, "lang string, at int, n long")
    return rows.groupBy("lang", "at").agg(F.sum("n").alias("n"))


class TextModel:
    def __init__(self, languages: list[str], logs: np.ndarray):
        self.languages, self.logs = languages, logs

    def score(self, column: pa.Array) -> np.ndarray:
        """Tempered log likelihoods, a row for each text."""
        texts = Texts(column)
        doc, bucket = _trigrams(texts)
        return TEMPER * np.stack([np.bincount(doc, weights=row[bucket], minlength=texts.n) for row in self.logs], axis=1)


def fit_text(docs: DataFrame) -> Iterator[TextModel]:
    """Likelihoods from all labelled rows of ``docs`` (text, lang), every language in one model of LANGUAGES_AT_ONCE at most; the models follow the alphabet."""
    languages = sorted(r["lang"] for r in docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang").distinct().collect())
    groups = [languages[i : i + LANGUAGES_AT_ONCE] for i in range(0, len(languages), LANGUAGES_AT_ONCE)]
    sums = trigram_counts(docs)
    if len(groups) > 1:
        sums = written(sums, "trigrams")
    for group in groups:
        yield _fit_group(sums, group)


def _fit_group(sums: DataFrame, languages: list[str]) -> TextModel:
    place = {name: i for i, name in enumerate(languages)}
    table = np.full((len(languages), BUCKETS), SMOOTH)
    chunks = sums.where(F.col("lang").between(languages[0], languages[-1])).groupBy("lang", F.floor(F.col("at") / CHUNK).alias("chunk")).agg(F.collect_list("at").alias("at"), F.collect_list("n").alias("n"))
    for row in chunks.toLocalIterator():
        table[place[row["lang"]], row["at"]] += row["n"]
    return TextModel(languages, np.log(table / table.sum(1, keepdims=True)))


def address_parts(url: Column) -> tuple[Column, Column, Column]:
    """(host, domain, suffix) of an address; null where it has none."""
    host = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))
    host = F.when(host != "", host)
    return host, F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1), F.regexp_extract(host, r"([^.]+)$", 1)


def declared_language(html: Column) -> Column:
    """The primary part of the language in the page's html tag, lower-cased; null where there is none."""
    found = F.lower(F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})\b", 1))
    return F.when(found != "", found)


def _with_scores(pages: DataFrame, model: TextModel) -> DataFrame:
    """``pages`` with the model's log likelihoods added to the end of ``text``, which is made if it is not there."""
    wide = pages.sparkSession.sparkContext.broadcast(model)
    names = [c for c in pages.columns if c != "text"]
    place = names.index("html")

    def run(batches):
        for batch in batches:
            texts = pa.array([visible_text(x) for x in batch.column(place).to_pylist()], pa.string())
            scores = [wide.value.score(texts.slice(low, high - low)) for low, high in pieces(texts)]
            scores = list(np.concatenate(scores)) if scores else []
            if batch.num_columns > len(names):
                scores = [np.concatenate(both) for both in zip(batch.column(len(names)).to_pylist(), scores, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(scores, pa.list_(pa.float64()))], names=[*names, "text"])

    return pages.mapInArrow(run, pages.select(*names).schema.add("text", T.ArrayType(T.DoubleType())))


def identify_pages(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """page_id, host, declared, text_language, language and probability of every page.

    Ties go to the alphabetically first language. A null or empty page is
    judged by its host and the corpus, one with a null or hostless address by
    text, markup and corpus. Without any labelled document, language and
    probability are null. Repeated pages are judged each. Other columns of
    either table are not read.
    """
    host, domain, suffix = address_parts(F.col("url"))
    base = pages.select("page_id", host.alias("host"), domain.alias("domain"), suffix.alias("suffix"), declared_language(F.col("html")).alias("declared"), F.col("html").cast("string").alias("html"))
    scored, languages = base, []
    for model in fit_text(docs):
        if languages:  # the scores so far, beside the pages
            scored = written(scored, "page-scores")
        scored = _with_scores(scored, model)
        languages += model.languages
    if not languages:
        return base.select("page_id", "host", "declared", *(F.lit(None).cast(t).alias(c) for c, t in (("text_language", "string"), ("language", "string"), ("probability", "double"))))
    scored = scored.drop("html")
    span = range(len(languages))
    top = F.array_max("text")
    part = F.transform("text", lambda x: F.exp(x - top))
    whole = F.aggregate(part, F.lit(0.0), lambda s, x: s + x)
    scored = written(scored.withColumn("p", F.transform(part, lambda x: x / whole)), "page-text")

    def level(name: str) -> DataFrame:
        """Sums of the posteriors of the pages of each value; partial sums go into the shuffle, so a very common value is no burden.

        Written, so that the join with the pages is of plain exchanges, whose large parts Spark can split.
        """
        return written(scored.where(F.col(name).isNotNull()).groupBy(name).agg(F.array(*[F.sum(F.col("p")[i]) for i in span]).alias(f"n_{name}")), "page-sums")

    total = scored.agg(F.array(*[F.coalesce(F.sum(F.col("p")[i]), F.lit(0.0)) for i in span]).alias("a")).first()["a"]
    joined = scored
    for name in ("suffix", "domain", "host", "declared"):
        joined = joined.join(level(name), name, "left")
    corpus = F.array(*[F.lit(float(x)) for x in total])

    def less(counts: Column) -> Column:
        """Without the page's own part."""
        return F.zip_with(counts, "p", lambda n, p: F.greatest(n - p, F.lit(0.0)))

    def share(counts: Column, lean: Column, strength: float) -> Column:
        all_of = F.aggregate(counts, F.lit(0.0), lambda s, x: s + x)
        return F.zip_with(counts, lean, lambda n, q: (n + strength * q) / (all_of + strength))

    even = F.array(*[F.lit(1.0 / len(span))] * len(span))
    prior = share(less(corpus), even, LEAN)
    joined = joined.withColumn("prior", prior)
    for name in ("suffix", "domain", "host"):
        joined = joined.withColumn("prior", F.when(F.col(f"n_{name}").isNull(), F.col("prior")).otherwise(share(less(F.col(f"n_{name}")), F.col("prior"), LEAN)))
    # The likelihood of what is declared: its soft count with a language over that language's.
    said = F.zip_with(less(F.col("n_declared")), less(corpus), lambda n, c: (n + F.lit(DECLARED / len(span))) / (c + F.lit(DECLARED)))
    evidence = F.zip_with("text", F.transform("prior", lambda x: F.ln(x)), lambda a, b: a + b)
    evidence = F.when(F.col("declared").isNull(), evidence).otherwise(F.zip_with(evidence, F.transform(said, lambda x: F.ln(x)), lambda a, b: a + b))
    names = F.array(*[F.lit(x) for x in languages])
    best = lambda a: F.get(names, F.array_position(a, F.array_max(a)).cast("int") - 1)
    out = joined.select("page_id", "host", "declared", best(F.col("text")).alias("text_language"), evidence.alias("e"))
    return out.select("page_id", "host", "declared", "text_language", best(F.col("e")).alias("language"), F.round(1 / F.aggregate(F.transform("e", lambda x: F.exp(x - F.array_max("e"))), F.lit(0.0), lambda s, x: s + x), 6).alias("probability"))
