"""Citations of records: accepting them, cutting them by code, collecting and putting them back in place.

A citation is (cite_id, source_id, start_line, end_line, quote); ``provided``
has the line ranges (source_id, lo, hi) that a reader was shown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import let
from ..functions.text import lines, occurrences
from .quotes import SHORT, resolve

#: Lines of a citation cut by code, and characters of a record's opening lines.
CUT_LINES, OPENING_CHARS = 20, 2000


def validated(citations: DataFrame, records: DataFrame, provided: DataFrame) -> DataFrame:
    """(cite_id, first_line, last_line, mode): where each citation stands, or mode ``refused: reason`` with null lines.

    In order: the record must exist, the range must lie in it and in one shown
    range; the quote must be the lines, or stand once in them as whole lines
    (narrowed), or be found in them by the ways of ``quotes.resolve``; a
    quote that only lies elsewhere in the shown lines, in one place, is moved
    there. Without a quote the range is refused. The ranges of a record are
    gathered (they are few), its text is not copied for each of them.
    """
    import pyarrow as pa

    ranges = provided.groupBy("source_id").agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("shown"))
    rows = citations.join(records.select("source_id", F.col("content").cast("string").alias("content"), F.lit(True).alias("there")), "source_id", "left").join(ranges, "source_id", "left")
    chosen = rows.select(F.col("cite_id").cast("long"), F.col("start_line").cast("long"), F.col("end_line").cast("long"), F.col("quote").cast("string"), lines(F.col("content")).alias("lines"), F.col("there"), F.transform("shown", lambda r: F.array(r["lo"].cast("long"), r["hi"].cast("long"))).alias("shown"))

    def inside(own: list[str], start: int, end: int, quote: str) -> tuple[int, int, str] | None:
        region = own[start - 1 : end]
        if "\n".join(region) == quote:
            return start, end, "exact"
        span = quote.count("\n") + 1
        whole = [lo for lo in range(start, end - span + 2) if "\n".join(own[lo - 1 : lo + span - 1]) == quote]
        if len(whole) == 1:
            return whole[0], whole[0] + span - 1, "narrowed"
        text = "\n".join(region)
        low, high, mode, hits = resolve(text, quote)
        if low < 0 or hits > 1 or (len(quote) < SHORT and mode != "exact"):
            return None
        return start + text.count("\n", 0, low), start + text.count("\n", 0, max(low, high - 1)), "inside" if mode == "exact" else mode

    def judge(start, end, quote, own, there, shown) -> tuple[int | None, int | None, str]:
        if not there:
            return None, None, "refused: unknown source"
        if not quote:
            return None, None, "refused: no quote"
        quote, own, shown = quote.rstrip("\n") if quote.strip() else quote, own or [], shown or []
        reason = "outside the source" if start is None or end is None or not 1 <= start <= end <= len(own) else "not shown" if not any(lo <= start and end <= hi for lo, hi in shown) else None
        found = None if reason else inside(own, start, end, quote)
        if found:
            return found
        if len(quote) >= SHORT:
            places = {p[:2] for lo, hi in shown if max(1, lo) <= min(hi, len(own)) and (p := inside(own, max(1, lo), min(hi, len(own)), quote))}
            if len(places) == 1:
                return *places.pop(), "moved"
        return None, None, f"refused: {reason or ('short' if len(quote) < SHORT else 'not found once')}"

    def run(batches):
        for batch in batches:
            out = [(cite, *judge(*rest)) for cite, *rest in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True)]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kinds[i]) for i in range(4)], names=["cite_id", "first_line", "last_line", "mode"])

    return chosen.mapInArrow(run, "cite_id long, first_line long, last_line long, mode string")


def cut_citation(text: Column, lo: Column, hi: Column, start: Column, end: Column) -> Column:
    """(start_line, end_line, quote) cut by code from the shown lines lo to hi: those asked for, else the first ones, CUT_LINES at most; null for blank lines."""

    def cut(own: Column) -> Column:
        last = F.least(hi, F.size(own))
        asked_lo, asked_hi = F.greatest(lo, start), F.least(last, F.coalesce(end, start))
        meets = F.coalesce(asked_lo <= asked_hi, F.lit(False))
        first, to = F.when(meets, asked_lo).otherwise(lo), F.when(meets, asked_hi).otherwise(last)
        to = F.least(to, first + CUT_LINES - 1)
        quote = F.array_join(F.slice(own, first.cast("int"), F.greatest(to - first + 1, F.lit(0)).cast("int")), "\n")
        return F.when((first <= to) & quote.rlike(r"\S"), F.struct(first.cast("bigint").alias("start_line"), to.cast("bigint").alias("end_line"), quote.alias("quote")))

    return let(lines(text), cut)


def opening(text: Column, most: int = OPENING_CHARS) -> Column:
    """(end_line, quote): the opening whole lines of a record within ``most`` characters, one at least."""

    def cut(own: Column) -> Column:
        state = F.struct(F.lit(-1).alias("chars"), F.lit(0).alias("n"), F.lit(True).alias("on"))

        def add(s: Column, x: Column) -> Column:
            chars = s["chars"] + F.length(x) + 1
            on = s["on"] & ((chars <= most) | (s["n"] == 0))
            return F.struct(chars.alias("chars"), (s["n"] + on.cast("int")).alias("n"), on.alias("on"))

        n = F.greatest(F.aggregate(own, state, add, lambda s: s["n"]), F.lit(1))
        return F.struct(n.cast("bigint").alias("end_line"), F.array_join(F.slice(own, F.lit(1), n), "\n").alias("quote"))

    return let(lines(text), cut)


def evidence_ids(rows: DataFrame, key: str, arrays: list[str]) -> DataFrame:
    """(key, evidence_ids): the different ids of several arrays, first seen first."""
    return rows.select(key, F.array_distinct(F.filter(F.flatten(F.array(*[F.coalesce(F.col(a), F.array().cast("array<string>")) for a in arrays])), lambda x: x.isNotNull())).alias("evidence_ids"))


def quote_chars(answers: DataFrame, key: str, sections: dict[str, str]) -> DataFrame:
    """(key, section, chars): characters of the quotes of each section, an array of structs with an array ``evidence`` of structs with ``quote``; sections without any are left out."""
    total = lambda c: F.aggregate(F.flatten(F.transform(F.col(c), lambda item: F.coalesce(item["evidence"]["quote"], F.array().cast("array<string>")))), F.lit(0).cast("bigint"), lambda s, q: s + F.coalesce(F.length(q), F.lit(0)))
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("section"), total(column).alias("chars")) for name, column in sections.items()]))
    return answers.select(key, each.alias("x")).select(key, "x.section", "x.chars").where("chars > 0")


def rehydrated(kept: DataFrame) -> DataFrame:
    """(source_id, n_lines, content): partial records put together again from kept quotes (source_id, start_line, quote); lines between them are empty.

    Overlapping quotes agree by their source; where they do not, the earlier one counts.
    """
    each = kept.select("source_id", "start_line", F.posexplode(lines(F.col("quote"))).alias("at", "line")).select("source_id", (F.col("start_line") + F.col("at")).alias("n"), "start_line", "line")
    placed = each.groupBy("source_id", "n").agg(F.min_by("line", F.struct("start_line", "line")).alias("line"))
    whole = placed.groupBy("source_id").agg(F.map_from_entries(F.collect_list(F.struct("n", "line"))).alias("m"), F.max("n").alias("n_lines"))
    return whole.select("source_id", F.col("n_lines").cast("bigint").alias("n_lines"), F.array_join(F.transform(F.sequence(F.lit(1).cast("bigint"), F.col("n_lines").cast("bigint")), lambda i: F.coalesce(F.try_element_at("m", i.cast(dict(placed.dtypes)["n"])), F.lit(""))), "\n").alias("content"))


def numbered_blocks(blocks: DataFrame, prefix: str) -> DataFrame:
    """``blocks`` (session_id, pos, ...) with label: B1, B2, ... in order within the session."""
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("pos"))
    return blocks.withColumn("label", F.concat(F.lit(prefix), place.cast("string")))


def quote_hits(text: Column, quote: Column) -> Column:
    return F.size(occurrences(text, quote)).cast("bigint")
