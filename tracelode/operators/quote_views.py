"""Where quotes stand in the lines they cite, also through escapes, in diff hunks, repeated close by, or with one slip.

A region is looked through in views: as it stands, with one layer of string
escapes decoded, and with white space collapsed. Each view knows the place in
the region of every character, so a hit always maps back to source lines. All
quotes of a region are found in one pass over a view by an automaton (blocks of
quotes, where a region has very many); for each quote only sums over its hits
are kept, never the hits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters below which a quote must stand once, and of each piece around an ellipsis.
SHORT, PIECE = 8, 8
#: Lines of a diff hunk and of close repeats that are cited as a whole, spans that are kept.
HUNK_LINES, CLOSE_LINES, MOST_SPANS = 20, 3, 5
#: Characters of a quote's head that may stand for it, and its least share in percent.
HEAD_LEAST, HEAD_MOST, HEAD_SHARE = 20, 2000, 80
#: What one layer of escapes stands for.
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", '"': '"', "'": "'", "\\": "\\", "/": "/"}
#: Quotes of one region that are looked for together.
BLOCK = 256
SCHEMA = "quote_id long, mode string, first_line long, last_line long, n_hits long, spans array<struct<s:long,e:long>>"
_ESCAPE = re.compile(r"\\[" + re.escape("".join(ESCAPES)) + "]")
_ELLIPSIS = re.compile(r"\.\.\.|…")
_SPACES, _WIDE = re.compile(r"\s+"), re.compile(r"\s{2,}")


def decoded(text: str) -> tuple[str, np.ndarray]:
    """The text without one layer of escapes, and where each of its characters (and its end) stands in the text."""
    kept = np.ones(len(text) + 1, bool)
    kept[[m.start() + 1 for m in _ESCAPE.finditer(text)]] = False
    return _ESCAPE.sub(lambda m: ESCAPES[m[0][1]], text), np.flatnonzero(kept)


def collapsed(text: str) -> tuple[str, np.ndarray]:
    """The text with each run of white space as one space, and where each character (and the end) stands."""
    kept = np.ones(len(text) + 1, bool)
    for m in _WIDE.finditer(text):
        kept[m.start() + 1 : m.end()] = False
    return _SPACES.sub(" ", text), np.flatnonzero(kept)


@dataclass
class Hits:
    """Sums over the hits of one quote in one view, in lines from 0."""

    n: int = 0
    first: int = 0
    last: int = 0
    same: bool = True
    hunk: bool = True
    bounds: tuple[int, int] = (0, 0)
    spans: list[tuple[int, int]] = field(default_factory=list)


class Region:
    """Lines of a text, and which of them are the body or a head of a diff."""

    def __init__(self, text: str):
        self.text = text

    @cached_property
    def starts(self) -> np.ndarray:
        own = self.text.split("\n")
        sizes = np.fromiter((len(x) + 1 for x in own), np.int64, len(own))
        return np.cumsum(sizes) - sizes

    @cached_property
    def beside(self) -> np.ndarray:
        body = [x[:1] in ("+", "-", " ") and x[:4] not in ("+++ ", "--- ") for x in self.text.split("\n")]
        return np.concatenate(([0], np.cumsum(~np.array(body, bool))))

    @cached_property
    def heads(self) -> np.ndarray:
        head = [x.startswith(("@@", "diff --git ")) for x in self.text.split("\n")]
        return np.concatenate(([0], np.cumsum(np.array(head, bool))))

    def lines_of(self, s: int, e: int) -> tuple[int, int]:
        return int(np.searchsorted(self.starts, s, side="right")) - 1, int(np.searchsorted(self.starts, e - 1, side="right")) - 1

    def find(self, needles: set[str], view: str, places: np.ndarray | None) -> dict[str, Hits]:
        """The hits of all needles in one pass, overlapping ones too; ``places`` maps the view to the region."""
        import ahocorasick

        needles = {x for x in needles if x}
        if not needles:
            return {}
        automaton = ahocorasick.Automaton()
        for needle in needles:
            automaton.add_word(needle, needle)
        automaton.make_automaton()
        out: dict[str, Hits] = {}
        for end, needle in automaton.iter(view):
            s, e = end + 1 - len(needle), end + 1
            if places is not None:
                s, e = int(places[s]), int(places[e])
            bounds = self.lines_of(s, e)
            hits = out.get(needle)
            if hits is None:
                hits = out[needle] = Hits(first=bounds[0], last=bounds[1], bounds=bounds)
            hits.n += 1
            hits.first, hits.last = min(hits.first, bounds[0]), max(hits.last, bounds[1])
            hits.same &= bounds == hits.bounds
            hits.hunk &= bool(self.beside[bounds[1] + 1] == self.beside[bounds[0]])
            if len(hits.spans) <= MOST_SPANS:
                hits.spans.append((s, e))
        return out

    def way(self, hits: Hits, close: bool) -> str | None:
        """How several hits are one: in the same lines, as both sides of a hunk, or close by."""
        if hits.n == 1:
            return "inside"
        if hits.same:
            return "same lines"
        if hits.hunk and hits.last - hits.first < HUNK_LINES and self.heads[hits.last + 1] == self.heads[hits.first]:
            return "diff hunk"
        return "close repeats" if close and hits.last - hits.first < CLOSE_LINES else None

    def ellipsis(self, quote: str) -> list[tuple[int, int]] | None:
        """Spans of the pieces around ellipses, where each stands once and they stand in order."""
        pieces, at, out = [p.strip() for p in _ELLIPSIS.split(quote)], 0, []
        if len(pieces) < 2 or min(map(len, pieces)) < PIECE:
            return None
        for piece in pieces:
            s = self.text.find(piece)
            if s < at or self.text.find(piece, s + 1) >= 0:
                return None
            at = s + len(piece)
            out.append((s, at))
        return out

    def head(self, quote: str) -> tuple[int, int] | None:
        """The longest head of the quote that stands in the region, if it stands once and ends a line there. Where a head stands, shorter ones do: its length is found by bisection."""
        low, high = max(HEAD_LEAST, -(-len(quote) * HEAD_SHARE // 100)), min(len(quote), len(self.text), HEAD_MOST)
        if low > high or self.text.find(quote[:low]) < 0:
            return None
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if self.text.find(quote[:middle]) >= 0 else (low, middle - 1)
        s = self.text.find(quote[:low])
        once = self.text.find(quote[:low], s + 1) < 0
        return (s, s + low) if once and (s + low == len(self.text) or self.text[s + low] == "\n") else None


def resolve(text: str, quotes: list[tuple[str, bool]]) -> list[tuple]:
    """(mode, first line, last line, hits, spans) of quotes (quote, close) in a region; lines count from 1."""
    region = Region(text)
    asked = [q.rstrip("\n") if q.strip() else q for q, _ in quotes]
    plain = {q: _ESCAPE.sub(lambda m: ESCAPES[m[0][1]], q) for q in asked if "\\" in q}
    view, places = decoded(text) if "\\" in text else ("", None)
    whole = region.find({*asked, *plain.values()}, text, None)
    inner = region.find(set(asked), view, places) if view else {}
    views = [[("", whole.get(q)), ("decoded ", inner.get(q)), ("unescaped ", whole.get(plain[q]) if plain.get(q, q) != q else None)] for q in asked]
    # White space is collapsed only where a quote is not settled without it.
    left = [_settled(region, q, close, v) is None for q, (_, close), v in zip(asked, quotes, views, strict=True)]
    narrow = {q: _SPACES.sub(" ", q) for q, x in zip(asked, left, strict=True) if x and q.strip()}
    loose = region.find(set(narrow.values()), *collapsed(text)) if narrow else {}
    return [_one(region, q, close, v, loose.get(narrow.get(q, ""))) for q, (_, close), v in zip(asked, quotes, views, strict=True)]


def _settled(region: Region, quote: str, close: bool, views: list[tuple[str, Hits | None]]) -> tuple | None:
    """What the views say of a quote that is short, or whose hits are one."""
    prefix, hits = next(((name, h) for name, h in views if h), ("", None))
    if len(quote) < SHORT:
        if quote.strip() and hits and hits.n == 1 and not prefix:
            return "short", hits.first + 1, hits.last + 1, 1, hits.spans
        return "refused: short", None, None, hits.n if hits else 0, None
    way = region.way(hits, close) if hits else None
    return (prefix + way, hits.first + 1, hits.last + 1, hits.n, hits.spans if hits.n <= MOST_SPANS else None) if way else None


def _one(region: Region, quote: str, close: bool, views: list[tuple[str, Hits | None]], loose: Hits | None) -> tuple:
    if settled := _settled(region, quote, close, views):
        return settled
    hits = next((h for _, h in views if h), None)
    spans, mode = None, ""
    if loose and loose.n == 1:
        spans, mode = loose.spans, "white space"
    elif pieces := region.ellipsis(quote):
        spans, mode = pieces, "ellipsis"
    elif head := region.head(quote):
        spans, mode = [head], "tail"
    if spans:
        lines = [region.lines_of(*x) for x in spans]
        return mode, min(x[0] for x in lines) + 1, max(x[1] for x in lines) + 1, len(spans), spans if len(spans) <= MOST_SPANS else None
    return ("refused: several" if hits else "refused: not found"), None, None, hits.n if hits else 0, None


def resolve_in_regions(quotes: DataFrame, regions: DataFrame) -> DataFrame:
    """SCHEMA rows of ``quotes`` (quote_id, region_id, quote, close) in ``regions`` (region_id, text).

    ``mode`` is inside, same lines, diff hunk or close repeats (only where
    ``close``), with ``decoded`` before it where the region's escapes hide the
    quote and ``unescaped`` where the quote escapes what the region holds
    plainly; or short, white space, ellipsis, tail; or ``refused:`` and why.
    Spans are places in the region; more than MOST_SPANS are null. Lines end at
    line feeds. A region's quotes are looked for BLOCK at a time, so one that a
    third of all quotes cite is as many tasks as it has blocks. Null and empty
    quotes are refused as short; a region that is not there holds nothing.
    """
    many = quotes.groupBy("region_id").agg(F.ceil(F.count("*") / BLOCK).alias("__blocks")).withColumnRenamed("region_id", "__r")
    placed = quotes.join(many, F.col("region_id").eqNullSafe(F.col("__r"))).withColumn("__block", F.pmod(F.xxhash64("quote_id", "quote"), F.col("__blocks")))
    gathered = placed.groupBy("region_id", "__block").agg(F.collect_list(F.struct(F.col("quote_id").cast("long").alias("id"), F.coalesce(F.col("quote").cast("string"), F.lit("")).alias("quote"), F.coalesce("close", F.lit(False)).alias("close"))).alias("asked"))
    rows = gathered.join(regions.select("region_id", F.col("text").cast("string").alias("text")), "region_id", "left").select("text", "asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, asked in zip(batch.column(0), batch.column(1), strict=True):
                every = asked.as_py()
                found = resolve(text.as_py() or "", [(x["quote"], x["close"]) for x in every])
                yield _as_batch([(x["id"], *f) for x, f in zip(every, found, strict=True)])

    return rows.mapInArrow(run, SCHEMA)


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())])))
    columns = [*zip(*rows, strict=True)]
    columns[5] = [None if x is None else [{"s": s, "e": e} for s, e in x] for x in columns[5]]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["quote_id", "mode", "first_line", "last_line", "n_hits", "spans"])
