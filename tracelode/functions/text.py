"""Functions on lines, quotes and titles, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import let

#: What ends a line, and the limits of blocks, titles and excerpts.
LINE_BREAKS = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x85\u2028\u2029]"
BLOCK_LINES, RESULT_HEAD, RESULT_TAIL = 12, 6, 6
TITLE_CHARS, EXCERPT_LEAST, EXCERPT_AROUND = 72, 400, 120


def lines(text: Column) -> Column:
    """The lines of a text; no line follows a final line break. Null stays null, an empty text has none."""
    parts = F.split(text, LINE_BREAKS)
    return let(parts, lambda p: F.when(text == "", F.array().cast("array<string>")).otherwise(F.slice(p, F.lit(1), F.size(p) - (F.element_at(p, -1) == "").cast("int"))))


def one_line(text: Column, limit: int = TITLE_CHARS) -> Column:
    """White space runs become one space; what is longer than ``limit`` ends with an ellipsis."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, limit - 1)), F.lit("…")))


def safe_text(text: Column, multiline: bool = True) -> Column:
    """Without terminal escapes and without control, format and surrogate characters; line feeds and tabs stay if ``multiline``."""
    plain = F.regexp_replace(text, r"\x1B(?:\[[0-?]*[ -/]*[@-~]|\][^\x07\x1B]*(?:\x07|\x1B\\)|[@-Z\\-_])", "")
    kept = r"[\p{Cc}\p{Cf}\p{Cs}&&[^\n\t]]" if multiline else r"[\p{Cc}\p{Cf}\p{Cs}]"
    return F.regexp_replace(plain, kept, "" if multiline else " ")


def content_id(prefix: str, *parts: Column) -> Column:
    """``prefix`` and 24 hex digits of the SHA-256 of the parts as a JSON array."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.to_json(F.array(*parts)), 256), 1, 24))


def _cut(spans: Column) -> Column:
    """Spans (lo, hi) in pieces of at most BLOCK_LINES lines."""
    return F.flatten(F.transform(spans, lambda s: F.transform(F.sequence(s["lo"], s["hi"], F.lit(BLOCK_LINES)), lambda lo: F.struct(lo.alias("lo"), F.least(lo + BLOCK_LINES - 1, s["hi"]).alias("hi")))))


def paragraphs(text_lines: Column) -> Column:
    """Blocks (lo, hi), counted from 1, of the paragraphs of an array of lines."""

    def spans(at: Column) -> Column:
        first = F.filter(at, lambda x, i: x.isNotNull() & F.get(at, i - 1).isNull())
        last = F.filter(at, lambda x, i: x.isNotNull() & F.get(at, i + 1).isNull())
        return F.zip_with(first, last, lambda a, b: F.struct(a.alias("lo"), b.alias("hi")))

    return _cut(let(F.transform(text_lines, lambda x, i: F.when(x.rlike(r"\S"), i + 1)), spans))


def head_and_tail(text_lines: Column) -> Column:
    """Blocks (lo, hi) of a tool result: its first and last lines."""
    n = F.size(text_lines)
    head = F.struct(F.lit(1).alias("lo"), F.least(n, F.lit(RESULT_HEAD)).alias("hi"))
    tail = F.struct(F.greatest(n - RESULT_TAIL + 1, F.lit(RESULT_HEAD + 1)).alias("lo"), n.alias("hi"))
    return F.when(n == 0, F.array().cast("array<struct<lo:int,hi:int>>")).when(n <= RESULT_HEAD, F.array(head)).otherwise(F.array(head, tail))


def occurrences(text: Column, needle: Column) -> Column:
    """Places, from 0, of all hits of ``needle``, overlapping ones too; an empty needle has none.

    The text is cut before each hit, so the work grows with the text, not with text times hits.
    """
    quoted = F.concat(F.lit(r"(?=\Q"), F.replace(needle, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E)"))
    none = F.array().cast("array<int>")

    def places(parts: Column) -> Column:
        sizes = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), F.length)
        ends = F.aggregate(sizes, F.array(F.lit(0)), lambda done, n: F.concat(done, F.array(F.element_at(done, -1) + n)))
        return F.when(text.startswith(needle), ends).otherwise(F.slice(ends, F.lit(2), F.size(ends)))

    return F.when((F.length(needle) == 0) | (F.instr(text, needle) == 0), none).otherwise(let(F.split(text, quoted), places))


def line_of(text: Column, place: Column) -> Column:
    """The line number, from 1, of a place counted from 0."""
    before = F.substring(text, F.lit(1), place)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def merge_spans(spans: Column) -> Column:
    """Union of half-open spans (s, e); touching ones join."""
    empty = F.array().cast("array<struct<s:bigint,e:bigint>>")

    def add(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"))))
        return F.when((F.size(done) > 0) & (x["s"] <= F.try_element_at(done, F.lit(-1))["e"]), joined).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(F.array_sort(spans), empty, add)


def excerpt(quote: Column, focus: Column) -> Column:
    """The cited parts of a long quote with their surroundings; null where the whole quote is to be shown."""
    n = F.length(quote).cast("bigint")
    good = F.filter(focus, lambda x: (x["s"] >= 0) & (x["s"] < x["e"]) & (x["e"] <= n))
    wide = F.transform(good, lambda x: F.struct(F.greatest(x["s"] - EXCERPT_AROUND, F.lit(0)).alias("s"), F.least(x["e"] + EXCERPT_AROUND, n).alias("e")))
    shown = F.transform(merge_spans(wide), lambda x: F.concat(F.when(x["s"] > 0, "…").otherwise(""), F.substring(quote, (x["s"] + 1).cast("int"), (x["e"] - x["s"]).cast("int")), F.when(x["e"] < n, "…").otherwise("")))
    return F.when((n > EXCERPT_LEAST) & (F.size(good) > 0), F.array_join(shown, "\n"))


def head_lines(text_lines: Column, most_chars: int) -> Column:
    """How many lines from the start fit ``most_chars`` characters, line ends counted; one at least."""
    sums = F.aggregate(text_lines, F.struct(F.lit(0).alias("chars"), F.lit(0).alias("n")), lambda s, x: F.struct((s["chars"] + F.length(x) + 1).alias("chars"), (s["n"] + (s["chars"] + F.length(x) + 1 <= most_chars).cast("int")).alias("n")), lambda s: s["n"])
    return F.least(F.greatest(sums, F.lit(1)), F.size(text_lines))


def fold_case(text: Column) -> Column:
    """Lower case with the German sharp s written out, so that searches find both spellings."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))
