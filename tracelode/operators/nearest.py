"""The lines of a session that come closest to a quote that stands in none of them.

Quotes meet the lines of their session's latest records only. How many
characters a line shares with the quote, in any order, is a column expression
and never below the share of the matching blocks; the best lines by it are
kept, and only these few are aligned.
"""

from __future__ import annotations

import difflib
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import lines

if TYPE_CHECKING:
    import pandas as pd

#: Latest records of a session, lines that are aligned, lines that are named, and characters shown of each.
LATEST_RECORDS, ALIGNED, NAMED, SHOWN_CHARS = 400, 40, 3, 200


def shared_characters(quote: Column, line: Column) -> Column:
    """How many characters two texts share, each as often as it stands in both."""
    each = F.array_distinct(F.split(quote, ""))
    times = lambda text, sign: F.length(text) - F.length(F.replace(text, sign, F.lit("")))
    return F.aggregate(each, F.lit(0), lambda n, sign: n + F.least(times(quote, sign), times(line, sign)))


def alike_lines(records: DataFrame, quotes: DataFrame, latest: int = LATEST_RECORDS, most: int = ALIGNED) -> DataFrame:
    """(quote_id, quote, source_id, pos, line, content, overlap, place): for each of ``quotes`` (quote_id, session_id, quote) the ``most`` lines that share most characters with it.

    ``records`` has source_id, session_id, pos, content; the ``latest`` of a
    session by pos and source_id count, and of these the lines that are not
    blank. ``overlap`` is twice the shared characters over those of both. Of
    lines equally alike the earlier ones come first. quote_id names a quote
    once. Null and empty quotes, null sessions, and sessions without records
    give no rows. Every limit is kept before the shuffle as well as after it,
    so a session with a third of all records sends ``latest`` rows a task; these
    meet, texts included, in one task.
    """
    asked = quotes.where(F.length("quote") > 0).select("quote_id", "session_id", F.col("quote").cast("string").alias("quote"))
    back = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("pos"), F.desc("source_id")))
    late = records.select("source_id", "session_id", "pos", "content").join(asked.select("session_id").distinct(), "session_id", "left_semi").withColumn("__back", back).where(F.col("__back") <= latest)
    each = late.select("session_id", "source_id", "pos", F.posexplode(lines(F.col("content"))).alias("line", "content")).where(F.col("content").rlike(r"\S"))
    overlap = 2.0 * shared_characters(F.col("quote"), F.col("content")) / (F.length("quote") + F.length("content"))
    met = asked.join(each, "session_id").select("quote_id", "quote", "source_id", "pos", (F.col("line") + 1).cast("long").alias("line"), "content", overlap.alias("overlap"))
    place = F.row_number().over(Window.partitionBy("quote_id").orderBy(F.desc("overlap"), "pos", "source_id", "line"))
    return met.withColumn("place", place.cast("long")).where(F.col("place") <= most)


def closest_lines(records: DataFrame, quotes: DataFrame, most: int = NAMED, latest: int = LATEST_RECORDS) -> DataFrame:
    """(quote_id, place, source_id, line, ratio, shown): the ``most`` lines closest to each quote by the share of their matching blocks.

    Out of ``alike_lines``, in whose order equally close lines come. A line
    whose overlap is below the ratio of ``most`` others is not aligned, as it
    can't reach it. Longer lines are shown around their longest match.
    """
    kinds = dict(records.dtypes) | dict(quotes.dtypes)

    def align(group: pd.DataFrame) -> pd.DataFrame:
        import pandas as pd

        best: list[tuple[float, int]] = []
        ordered = group.sort_values("place").reset_index(drop=True)
        for at, (quote, content, overlap) in enumerate(zip(ordered["quote"], ordered["content"], ordered["overlap"], strict=True)):
            if len(best) == most and overlap <= -best[-1][0]:
                break  # so are all later ones
            best = sorted([*best, (-difflib.SequenceMatcher(None, quote, content, autojunk=False).ratio(), at)])[:most]
        chosen = ordered.iloc[[at for _, at in best]]
        shown = [_around(q, x) for q, x in zip(chosen["quote"], chosen["content"], strict=True)]
        return pd.DataFrame({"quote_id": chosen["quote_id"].to_numpy(), "place": range(1, len(best) + 1), "source_id": chosen["source_id"].to_numpy(), "line": chosen["line"].to_numpy(), "ratio": [-r for r, _ in best], "shown": shown})

    found = alike_lines(records, quotes, latest).groupBy("quote_id").applyInPandas(align, f"quote_id {kinds['quote_id']}, place long, source_id {kinds['source_id']}, line long, ratio double, shown string")
    return found


def _around(quote: str, line: str) -> str:
    if len(line) <= SHOWN_CHARS:
        return line
    middle = difflib.SequenceMatcher(None, quote, line, autojunk=False).find_longest_match().b
    first = min(max(0, middle - SHOWN_CHARS // 2), len(line) - SHOWN_CHARS)
    return line[first : first + SHOWN_CHARS]
