"""Long records: segments, quotes and where they stand, duplicates, votes and search."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import let
from ..functions.text import fold_case, line_of
from ..sources.store import written

#: Characters of a segment, and rows whose texts are cut at once, so that a task holds the pieces of few texts.
SEGMENT_CHARS = 32_000
SEGMENT_ROWS = 128
#: Words of a quote that stand for it in the join, and characters of quotes that an automaton holds at most (some 50 bytes each).
ANCHOR_WORDS = 4
AUTOMATON_CHARS = 1 << 20


def segments(records: DataFrame, key: str, text: str, most: int = SEGMENT_CHARS) -> DataFrame:
    """(key, n, n_segments, start, end, content): pieces of at most ``most`` characters, cut after the last line feed in their second half.

    Each cut depends on the one before, so the rows of a task are walked one by
    one over Arrow batches. A null text has no segment, an empty one has one.
    """
    import pyarrow as pa

    chosen = records.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = chosen.schema["key"].dataType.simpleString()

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from (batch.slice(low, SEGMENT_ROWS) for low in range(0, batch.num_rows, SEGMENT_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shares(batches):
            rows = []
            for i, whole in enumerate(batch.column(1).to_pylist()):
                if whole is None:
                    continue
                bounds = [0]
                while bounds[-1] < len(whole):
                    low, high = bounds[-1], min(bounds[-1] + most, len(whole))
                    feed = whole.rfind("\n", low + most // 2, high) if high < len(whole) else -1
                    bounds.append(feed + 1 if feed > low else high)
                bounds = bounds if len(bounds) > 1 else [0, 0]
                rows += [(i, k, len(bounds) - 1, a, b, whole[a:b]) for k, (a, b) in enumerate(zip(bounds, bounds[1:]), 1)]
            numbers = [pa.array([r[c] for r in rows], pa.int64()) for c in range(5)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(numbers[0]), *numbers[1:], pa.array([r[5] for r in rows], pa.string())], names=["key", "n", "n_segments", "start", "end", "content"])

    return chosen.mapInArrow(run, f"key {kind}, n long, n_segments long, start long, end long, content string").withColumnRenamed("key", key)


def joined_segments(pieces: DataFrame, key: str) -> DataFrame:
    """(key, text): the records that ``segments`` cut, whole again."""
    return pieces.groupBy(key).agg(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("n", "content"))), lambda x: x["content"])).alias("text"))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def quote_places(records: DataFrame, quotes: DataFrame) -> DataFrame:
    """(quote_id, record_id, place, line, n_hits): records (record_id, text) that hold a quote (quote_id, quote) verbatim; ``place`` counts from 0.

    While all quotes together are short, every task walks its texts once
    through an automaton of all of them. Beyond that, quotes meet records by
    their first inner words: a shuffle join on word runs, of which the quotes'
    ones are distinct; those under ANCHOR_WORDS + 2 words go through automata,
    in blocks of AUTOMATON_CHARS, a walk for each. Null and empty quotes, null
    texts and null ids of quotes give nothing; equal quotes are found each.
    """
    wanted = quotes.where("quote_id IS NOT NULL AND length(quote) > 0").select("quote_id", F.col("quote").cast("string").alias("quote"))
    texts = records.where("text IS NOT NULL").select("record_id", F.col("text").cast("string").alias("text"))
    size = wanted.agg(F.sum(F.length("quote"))).first()[0] or 0
    if size <= AUTOMATON_CHARS:
        return _walked(texts, wanted)
    few = F.size(_words(F.col("quote"))) < ANCHOR_WORDS + 2
    inner = F.slice(_words(F.col("quote")), 2, ANCHOR_WORDS)
    keyed = wanted.where(~few).withColumn("anchor", F.xxhash64(F.array_join(inner, " ")))
    w = _words(F.col("text"))
    runs = texts.select("record_id", w.alias("w")).select("record_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - ANCHOR_WORDS, F.lit(0))), lambda i: F.xxhash64(F.array_join(F.slice("w", i + 1, ANCHOR_WORDS), " "))))).alias("anchor"))
    pairs = runs.join(keyed, "anchor").select("record_id", "quote_id", "quote").distinct()
    met = texts.join(pairs, "record_id").where(F.col("text").contains(F.col("quote")))
    place = F.instr("text", F.col("quote")) - 1
    hits = (F.length("text") - F.length(F.replace("text", F.col("quote"), F.lit("")))) / F.length("quote")
    found = met.select("quote_id", "record_id", place.cast("bigint").alias("place"), line_of(F.col("text"), place).cast("bigint").alias("line"), hits.cast("bigint").alias("n_hits"))
    short = wanted.where(few)
    blocks = -(-int(short.agg(F.sum(F.length("quote"))).first()[0] or 0) // AUTOMATON_CHARS)
    for k in range(blocks):
        found = found.union(_walked(texts, short.where(F.pmod(F.xxhash64("quote"), F.lit(blocks)) == k)))
    return found


def _walked(texts: DataFrame, quotes: DataFrame) -> DataFrame:
    """``quote_places`` of quotes that are few: they reach every task, whose texts are walked once."""
    import pyarrow as pa

    kinds = dict(quotes.dtypes)["quote_id"], dict(texts.dtypes)["record_id"]
    by_text: dict[str, list] = {}
    for row in quotes.collect():
        by_text.setdefault(row["quote"], []).append(row["quote_id"])
    wide = texts.sparkSession.sparkContext.broadcast(by_text)
    types = quotes.schema["quote_id"].dataType, texts.schema["record_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick
        from pyspark.sql.pandas.types import to_arrow_type

        automaton = ahocorasick.Automaton()
        for quote in wide.value:
            automaton.add_word(quote, quote)
        if wide.value:
            automaton.make_automaton()
        for batch in batches:
            rows = []
            for record, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for quote in dict.fromkeys(q for _, q in automaton.iter(text)) if wide.value else ():
                    place = text.find(quote)
                    rows += [(i, record, place, text.count("\n", 0, place) + 1, text.count(quote)) for i in wide.value[quote]]
            arrow = (*(to_arrow_type(t) for t in types), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(arrow)], names=["quote_id", "record_id", "place", "line", "n_hits"])

    return texts.mapInArrow(run, f"quote_id {kinds[0]}, record_id {kinds[1]}, place long, line long, n_hits long")


def latest_place(places: DataFrame) -> DataFrame:
    """For each quote the record with the highest record_id that holds it, its line, and how many records hold it."""
    return places.groupBy("quote_id").agg(F.max("record_id").alias("record_id"), F.max_by("line", "record_id").alias("line"), F.count("*").alias("n_records"))


def exact_copies(records: DataFrame, key: str, text: str) -> DataFrame:
    """(key, first_key, n_copies) of rows whose text another row has too; the group's name is its smallest key.

    Texts are compared by SHA-256, so groups are summed before the shuffle and
    a text that a third of all rows have is one row from each task.
    """
    hashed = records.where(F.col(text).isNotNull()).select(F.col(key), F.sha2(F.col(text), 256).alias("__h"))
    groups = hashed.groupBy("__h").agg(F.min(key).alias("first_key"), F.count("*").alias("n_copies")).where("n_copies > 1")
    return hashed.join(groups, "__h").select(key, "first_key", "n_copies")


def votes(records: DataFrame, group: str, choice: str, order: str) -> DataFrame:
    """(group, choice, n, n_all): the most frequent choice; of equally frequent ones that seen first."""
    counts = records.where(F.col(choice).isNotNull()).groupBy(group, choice).agg(F.count("*").alias("n"), F.min(order).alias("__first"))
    best = counts.groupBy(group).agg(F.max_by(choice, F.struct("n", -F.col("__first"), choice)).alias(choice), F.max("n").alias("n"), F.sum("n").alias("n_all"))
    return best.select(group, choice, "n", "n_all")


#: Scripts in the order in which equally frequent ones are preferred.
SCRIPTS = {"hangul": r"\p{IsHangul}+", "kana": r"[\p{IsHiragana}\p{IsKatakana}]+", "han": r"\p{IsHan}+", "cyrillic": r"\p{IsCyrillic}+", "latin": r"\p{IsLatin}+"}


def script_of(text: Column) -> Column:
    """The script that most letters of a text have: hangul, kana, han, cyrillic or latin; null without letters.

    Scripts share no letter, so each is counted, run by run, in what the ones
    before it left.
    """

    def counted(rest: Column, names: list[str], counts: list[Column]) -> Column:
        if not names:
            return let(F.array_max(F.array(*counts)), lambda best: F.when(best["n"] > 0, best["name"]))
        name, rank = names[0], F.lit(-list(SCRIPTS).index(names[0]))
        count = lambda left: F.struct((F.length(rest) - F.length(left)).alias("n"), rank.alias("rank"), F.lit(name).alias("name"))
        return let(F.regexp_replace(rest, SCRIPTS[name], ""), lambda left: counted(left, names[1:], [*counts, count(left)]))

    return counted(text, list(SCRIPTS)[::-1], [])


def message_groups(messages: DataFrame, message: str, order: str) -> DataFrame:
    """(pattern, n, example): messages that differ only in numbers and file names, largest groups first in ``place``."""
    pattern = F.regexp_replace(F.regexp_replace(F.col(message), r"[^\s/]*/\S+", "<path>"), r"\d+", "<n>")
    grouped = messages.groupBy(pattern.alias("pattern")).agg(F.count("*").alias("n"), F.min_by(message, order).alias("example"))
    return grouped


def find(events: DataFrame, query: str, text: str = "quotes", limit: int = 20) -> DataFrame:
    """The ``limit`` best events (id, title, at, score): those with all words of the query in title, summary or quotes; score 2 if title and summary have all. Newest first among equals, then by position.

    ``events`` has id, pos, title, summary, at (a string) and ``text``.
    """
    head = fold_case(F.concat_ws("\n", "title", "summary"))
    whole = F.concat_ws("\n", head, fold_case(F.col(text)))
    all_of = lambda c: [c.contains(fold_case(F.lit(w))) for w in query.split()]
    both = lambda conditions: reduce(and_, conditions, F.lit(True))
    found = events.where(both(all_of(whole))).withColumn("score", F.when(both(all_of(head)), 2).otherwise(1))
    return found.orderBy(F.desc("score"), F.desc_nulls_last("at"), "pos").limit(limit).select("id", "title", "at", "score")


def open_items(items: DataFrame, related: DataFrame) -> DataFrame:
    """Open items (item_id, text) with the latest time and number of their related events (item_id, at)."""
    last = related.groupBy("item_id").agg(F.max("at").alias("last_at"), F.count("*").alias("n_events"))
    return items.where("status = 'open'").join(last, "item_id", "left").select("item_id", "last_at", F.coalesce("n_events", F.lit(0)).alias("n_events"))


def same_citations(events: DataFrame) -> DataFrame:
    """(id, twin): pairs of an event and the first other of the same kind that cites exactly the same records (id, kind, source_id: one row for each citation).

    Sets are compared by a hash that no order changes and their size; a hot
    set is summed before the shuffle. The sets and the first of each are
    written, so that both sides of the join are plain exchanges: Spark sends a
    short list of different sets to every task, and splits a hot set of a long one.
    """
    sets = events.select("id", "kind", "source_id").distinct().groupBy("id", "kind").agg(F.sum(F.xxhash64("source_id").cast("decimal(38,0)")).alias("h"), F.count("*").alias("n"))
    sets = written(sets, "citation-sets")
    first = written(sets.groupBy("kind", "h", "n").agg(F.min("id").alias("twin")), "citation-twins")
    return sets.join(first, ["kind", "h", "n"]).where("id <> twin").select("id", "twin")


def nearest_lines(records: DataFrame, quote: str, most: int = 3) -> DataFrame:
    """The ``most`` lines (record_id, line, distance) nearest to ``quote`` by edit distance, of lines that are not much longer or shorter."""
    from ..functions.text import lines

    each = records.select("record_id", F.posexplode(lines(F.col("text"))).alias("line", "content")).where(F.length("content").between(len(quote) // 2, 2 * len(quote)))
    far = F.levenshtein("content", F.lit(quote))
    return each.select("record_id", (F.col("line") + 1).cast("bigint").alias("line"), far.cast("bigint").alias("distance")).orderBy("distance", "record_id", "line").limit(most)


def memory_selection(sections: DataFrame, limits: dict[str, int], most_chars: int = 2000) -> DataFrame:
    """Items (section, rank, text) chosen in rounds over the sections, each up to its limit, while the text stays within ``most_chars``; a section whose item does not fit is closed."""
    order = {name: i for i, name in enumerate(limits)}
    wanted = F.lit(False)
    for name, n in limits.items():
        wanted = wanted | ((F.col("section") == name) & (F.col("rank") <= n))
    few = sections.where(wanted).collect()  # the sum of the limits at most
    chosen, size, closed = [], 0, set()
    for row in sorted(few, key=lambda r: (r["rank"], order[r["section"]])):
        if row["section"] in closed:
            continue
        if size + len(row["text"]) + 1 > most_chars:
            closed.add(row["section"])
            continue
        size += len(row["text"]) + 1
        chosen.append((row["section"], row["rank"], row["text"]))
    return sections.sparkSession.createDataFrame(chosen, "section string, rank int, text string")


def budget_units(records: DataFrame, most_chars: int, most_records: int) -> DataFrame:
    """(session_id, pos, unit): greedy units of at most ``most_records`` rows and ``most_chars`` characters, in order; a longer row is a unit of its own.

    Each unit's end depends on the one before: rows are dealt by session and
    part (as natural cuts make them), sorted, and walked once. Only the lengths
    travel.
    """
    import pyarrow as pa

    chosen = records.select("session_id", "part", "pos", F.col("chars").cast("long"))
    dealt = chosen.repartition("session_id", "part").sortWithinPartitions("session_id", "part", "pos")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share, unit, n, size = None, 0, 0, 0
        for batch in batches:
            units = []
            for session, part, chars in zip(*(batch.column(c).to_pylist() for c in (0, 1, 3)), strict=True):
                if (session, part) != share:
                    share, unit, n, size = (session, part), 0, 0, 0
                if n and (n >= most_records or size + (chars or 0) > most_chars):
                    unit, n, size = unit + 1, 0, 0
                n, size = n + 1, size + (chars or 0)
                units.append(unit)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(units, pa.int64())], names=["session_id", "part", "pos", "unit"])

    kinds = dict(chosen.dtypes)
    return dealt.mapInArrow(fill, f"session_id {kinds['session_id']}, part {kinds['part']}, pos {kinds['pos']}, unit long")
