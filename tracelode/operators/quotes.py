"""Where a quote stands in its source: exactly, or with the slips that people and models make.

Column expressions settle exact quotes; only what they leave goes through one
Arrow pass that tries the slips in turn.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A short quote must be unique; pieces around an ellipsis; the share of a quote that its tail must be.
SHORT, PIECE, TAIL_LEAST, TAIL_MOST, TAIL_SHARE = 8, 8, 20, 2000, 0.8
SCHEMA = "quote_id long, first_line long, last_line long, mode string, n_hits long"


def _unescaped(text: str) -> str:
    return text.replace("\\n", "\n").replace("\\t", "\t").replace('\\"', '"').replace("\\\\", "\\")


def _spread(source: str, pattern: str) -> tuple[int, int, int]:
    hits = [m.span() for m in re.finditer(pattern, source)]
    return (*hits[0], len(hits)) if hits else (-1, -1, 0)


def resolve(source: str | None, quote: str | None) -> tuple[int, int, str, int]:
    """(start, end, mode, hits) of a quote: exact, escaped, white space, ellipsis, tail; or none, or ambiguous."""
    quote, source = (quote or "").removesuffix("\n"), source or ""
    if not quote:
        return -1, -1, "none", 0
    n = source.count(quote)
    if n:
        start = source.find(quote)
        return (start, start + len(quote), "exact", n) if n == 1 or len(quote) >= SHORT else (-1, -1, "ambiguous", n)
    if len(quote) < SHORT:
        return -1, -1, "none", 0
    words = [re.escape(w) for w in quote.split()]
    pieces = [p.strip() for p in re.split(r"\.\.\.|…", quote)]
    tries = [("escaped", re.escape(_unescaped(quote))), ("white space", r"\s+".join(words))]
    if len(pieces) > 1 and all(len(p) >= PIECE for p in pieces):
        tries.append(("ellipsis", r"[\s\S]{0,4000}?".join(map(re.escape, pieces))))
    for mode, pattern in tries:
        start, end, hits = _spread(source, pattern)
        if hits == 1:
            return start, end, mode, 1
        if hits:
            return -1, -1, "ambiguous", hits
    size = max(TAIL_LEAST, int(TAIL_SHARE * len(quote) + 0.999))
    if TAIL_LEAST <= size <= min(TAIL_MOST, len(quote)) and source.count(quote[-size:]) == 1:
        start = source.find(quote[-size:])
        return start, start + size, "tail", 1
    return -1, -1, "none", 0


def resolve_quotes(citations: DataFrame) -> DataFrame:
    """SCHEMA rows of citations (quote_id, quote, text). Null quotes and texts give mode none and null lines."""
    import pyarrow as pa

    rows = citations.select(F.col("quote_id").cast("long"), F.col("quote").cast("string"), F.col("text").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for quote_id, quote, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                start, end, mode, hits = resolve(text, quote)
                lines = (text.count("\n", 0, start) + 1, text.count("\n", 0, max(start, end - 1)) + 1) if start >= 0 else (None, None)
                out.append((quote_id, *lines, mode, hits))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kinds[i]) for i in range(5)], names=["quote_id", "first_line", "last_line", "mode", "n_hits"])

    return rows.mapInArrow(run, SCHEMA)


def match_grades(resolved: DataFrame) -> DataFrame:
    """(mode, n): how many citations each way settled."""
    return resolved.groupBy("mode").agg(F.count("*").alias("n"))
