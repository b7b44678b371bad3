"""Sessions cut into bounded units at the best place: after a commit, before a person's message, after a check.

Where a unit that begins at a row ends depends on the rows after it only, as far
as one unit reaches. So every row gets its pointer, the place where a unit that
began here would end, by binary search on prefix sums, in blocks of rows with a
rim of the rows that follow. Which rows units really begin at is a walk along
the pointers: each block says where it is left for each of its entry places,
these functions of neighbouring blocks are joined by pointer doubling, and each
block then walks from its own entry. A session that holds a third of all rows
is as many tasks as it has blocks, in a number of rounds that grows with the
logarithm of its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import written
from . import ordered
from .turns import CUT_GAP, DATE_GAP

#: Hints after whose result a unit may end, and the share of the window that such an end must fill, in percent.
RESULT_HINTS = ("run", "test", "commit", "vcs")
LEAST_FILL = 40
#: What a unit's input takes: half characters for each character of its records, characters for each record, and beside them.
HALVES, EACH, BESIDE = 3, 500, 30_000
KINDS = ("limit", "natural", "end", "commit", "turn", "result", "safe")


@dataclass(frozen=True)
class Limits:
    """Most records and characters of a unit, most characters of its input, and rows of a block."""

    records: int = 200
    chars: int = 60_000
    payload: int = 150_000
    block: int = 4096

    @property
    def rim(self) -> int:
        """Rows after a place that its pointer may depend on."""
        return self.records + 1


def boundaries(records: DataFrame) -> DataFrame:
    """(session_id, pos, i, cost, safe, natural, turn, result, commit) of ``records`` (session_id, pos, role, at, cost, links, prompt, compaction, hint, failed).

    ``i`` counts the rows of a session from 0; the flags say how good a cut
    right before the row is. A cut is safe where no link (a call's or a
    fragment's id) stands on both sides of it; only safe cuts have flags. It
    is natural at a compaction, after three hours, or after one across a date;
    a turn before a prompt; a result after the result of a run, test, commit or
    version control call; a commit after one that did not fail. Null links,
    times, hints and costs stand for none; ``pos`` must tell a session's rows
    apart.
    """
    block = ordered.block_of(F.col("pos"))
    rows = records.select("session_id", "pos", "role", "at", F.coalesce(F.col("cost").cast("long"), F.lit(0)).alias("cost"), "links", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("prompt", "compaction", "failed")], "hint")
    rows = ordered.running_count(rows, ["session_id"], ["pos"], F.lit(True), "__n", block).withColumn("i", F.col("__n") - 1).drop("__n")
    rows = written(rows, "unit-numbered")  # each running value below reads its input twice
    linked = rows.select("session_id", "i", F.explode(F.array_distinct("links")).alias("__link")).where("__link IS NOT NULL")
    spans = linked.groupBy("session_id", "__link").agg(F.min("i").alias("__from"), F.max("i").alias("__to")).where("__from < __to")
    # A link spans the cuts before the rows __from + 1 to __to: opened at the first, closed after the last.
    edges = spans.select("session_id", F.explode(F.array(F.struct((F.col("__from") + 1).alias("i"), F.lit(1).alias("by")), F.struct((F.col("__to") + 1).alias("i"), F.lit(-1).alias("by")))).alias("e")).groupBy("session_id", "e.i").agg(F.sum("e.by").alias("__by"))
    edges = edges.withColumnsRenamed({"session_id": "__s", "i": "__i"})
    rows = rows.join(edges, F.col("session_id").eqNullSafe(F.col("__s")) & (F.col("i") == F.col("__i")), "left").drop("__s", "__i")
    along = ordered.block_of(F.col("i"))
    rows = ordered.running_sum(rows, ["session_id"], ["i"], F.coalesce("__by", F.lit(0)), "__open", along)
    rows = written(rows, "unit-links")
    rows = ordered.previous(rows, ["session_id"], ["i"], ["role", "at", "hint", "failed"], "__before", along)
    safe = (F.col("i") > 0) & (F.col("__open") == 0)
    gap = F.unix_micros(F.col("at").cast("timestamp")) - F.unix_micros(F.col("__before.at").cast("timestamp"))
    natural = F.col("compaction") | (gap >= CUT_GAP * 1_000_000) | ((gap >= DATE_GAP * 1_000_000) & (F.to_date("at") != F.to_date("__before.at")))
    result = (F.col("__before.role") == "tool_result") & F.col("__before.hint").isin(*RESULT_HINTS)
    flags = {"natural": natural, "turn": F.col("prompt"), "result": result, "commit": result & (F.col("__before.hint") == "commit") & ~F.col("__before.failed")}
    return rows.select("session_id", "pos", "i", "cost", safe.alias("safe"), *[(safe & F.coalesce(c, F.lit(False))).alias(name) for name, c in flags.items()])


def pointers(cost: np.ndarray, flags: dict[str, np.ndarray], own: int, limits: Limits) -> tuple[np.ndarray, np.ndarray]:
    """Where a unit that begins at each of the first ``own`` rows ends, and why (a place of KINDS); an end beyond the last row is that of the session."""
    n = len(cost)
    start = np.arange(own)
    total = np.concatenate(([0], np.cumsum(cost)))
    # floor(HALVES / 2 * chars) + EACH * records <= room is the same as HALVES * chars + 2 * EACH * records <= 2 * room + 1.
    load = HALVES * total + 2 * EACH * np.arange(n + 1)
    room = 2 * (limits.payload - BESIDE) + 1
    limit = np.minimum(np.searchsorted(total, total[start] + limits.chars, side="right") - 1, np.searchsorted(load, load[start] + room, side="right") - 1)
    limit = np.maximum(start + 1, np.minimum(limit, np.minimum(start + limits.records, n)))
    window = total[limit] - total[start]

    def last(kind: str) -> np.ndarray:
        """The latest cut of the kind in the window; -1 if there is none after the start."""
        at = np.flatnonzero(flags[kind])
        found = np.concatenate(([-1], at))[np.searchsorted(at, limit, side="right")]
        return np.where(found > start, found, -1)

    end, why = limit.copy(), np.full(own, KINDS.index("limit"))
    safe = last("safe")
    end, why = np.where(safe >= 0, safe, end), np.where(safe >= 0, KINDS.index("safe"), why)
    for kind in ("result", "turn", "commit"):
        cut = last(kind)
        good = (cut >= 0) & (100 * (total[np.maximum(cut, 0)] - total[start]) >= LEAST_FILL * window)
        end, why = np.where(good, cut, end), np.where(good, KINDS.index(kind), why)
    end, why = np.where(limit == n, n, end), np.where(limit == n, KINDS.index("end"), why)
    at = np.append(np.flatnonzero(flags["natural"]), n + 1)
    natural = at[np.searchsorted(at, start, side="right")]
    return np.where(natural <= limit, natural, end), np.where(natural <= limit, KINDS.index("natural"), why)


_FLAGS = ("safe", "natural", "turn", "result", "commit")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole blocks of rows that are sorted by session, block and i: a table, and where each block begins in it and the last one ends.

    Rows of a block follow one another in i, and a session's block 0 begins at
    0, its others at a multiple of the block's length: where i does not go on, or the
    block changes, another begins.
    """
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        rest = (table if rest is None else pa.concat_tables([rest, table])).combine_chunks()
        block, i = rest["block"].to_numpy(), rest["i"].to_numpy()
        begin = np.flatnonzero((np.diff(i) != 1) | (np.diff(block) != 0)) + 1
        if len(begin):
            yield rest.slice(0, begin[-1]), np.concatenate(([0], begin))
            rest = rest.slice(begin[-1])
    if rest is not None and len(rest):
        yield rest, np.array([0, len(rest)])


def _walked(table: pa.Table, begin: np.ndarray, limits: Limits, only_left: bool) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, own rows, pointers, why) of each block of a table; with ``only_left`` of those that others of their session follow."""
    home, cost = table["home"].to_numpy(), table["cost"].to_numpy()
    flags = {k: table[k].to_numpy() for k in _FLAGS}
    for low, high in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
        own = int(np.count_nonzero(home[low:high]))  # the rim follows a block's own rows
        if own < high - low or not only_left:
            yield low, own, *pointers(cost[low:high], {k: v[low:high] for k, v in flags.items()}, own, limits)


def _exits(limits: Limits, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, begin in _groups(batches):
            # The block is the session's last where nothing follows its own rows: it leads nowhere.
            for low, own, end, why in _walked(table, begin, limits, True):
                leave, kind = end.copy(), why.copy()
                for k in range(own - 1, -1, -1):
                    if end[k] < own:
                        leave[k], kind[k] = leave[end[k]], kind[end[k]]
                entries = np.arange(min(own, limits.rim))
                one = table.select(["session_id", "block"]).take(pa.array(np.full(len(entries), low)))
                yield from _batches([one["session_id"], one["block"], pa.array(entries, pa.int32()), pa.array(leave[entries] - own, pa.int32()), pa.array(kind[entries], pa.int32())], names)

    return run


def _starts(limits: Limits, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, begin in _groups(batches):
            begun, reason = np.zeros(len(table), bool), np.full(len(table), -1)
            entry, by = table["entry"].to_numpy(), table["by"].to_numpy()
            for low, own, end, why in _walked(table, begin, limits, False):
                at, kind, end, why = int(entry[low]), int(by[low]), end.tolist(), why.tolist()
                while at < own:
                    begun[low + at], reason[low + at] = True, kind
                    at, kind = end[at], why[at]
            out = pa.table([table["session_id"], table["pos"], table["i"], pa.array(begun), pa.array(reason, pa.int32())], names)
            yield from out.filter(table["home"]).to_batches()

    return run


def _batches(columns: list, names: list[str]) -> list[pa.RecordBatch]:
    return pa.table(columns, names).to_batches()


def _entries(steps: DataFrame, seeds: DataFrame) -> DataFrame:
    """(session_id, block, entry, by) of every block, by pointer doubling over ``steps`` (session_id, block, entry, to_block, to_entry, by): each round doubles how far the pointers lead and how many blocks are known."""
    known, jump = seeds, steps
    place = ["session_id", "block", "entry"]
    while not jump.isEmpty():
        met = known.join(jump, _at(known, jump)).select(known["session_id"], F.col("to_block").alias("block"), F.col("to_entry").alias("entry"), jump["by"])
        known = written(known.unionByName(met), "unit-entries")
        then = jump.select(*[F.col(c).alias(f"then_{c}") for c in ("session_id", "block", "entry", "to_block", "to_entry", "by")])
        onward = jump.join(then, jump["session_id"].eqNullSafe(F.col("then_session_id")) & (F.col("to_block") == F.col("then_block")) & (F.col("to_entry") == F.col("then_entry")))
        jump = written(onward.select(*place, F.col("then_to_block").alias("to_block"), F.col("then_to_entry").alias("to_entry"), F.col("then_by").alias("by")), "unit-jumps")
    return known


def _at(a: DataFrame, b: DataFrame):
    return a["session_id"].eqNullSafe(b["session_id"]) & (a["block"] == b["block"]) & (a["entry"] == b["entry"])


def best_units(cuts: DataFrame, limits: Limits | None = None) -> DataFrame:
    """(session_id, pos, unit, begun, why) of every row of ``cuts`` (what ``boundaries`` gives).

    From where a unit begins, its window takes rows while they stay within the
    limits, one at least. The earliest natural cut in the window ends it, or
    the session's end; else the latest commit that fills LEAST_FILL of the
    window, else so the latest turn, else the latest result, else the latest
    safe cut, else the window's end. ``unit`` counts from 0, ``begun`` marks a
    unit's first row, whose ``why`` names the cut before it: a place of KINDS
    (``limit``: a link was split), empty for a session's first unit, null
    elsewhere. A session with a null id is one. No rows give no rows.
    """
    limits = limits or Limits()
    if limits.block < limits.rim:
        raise ValueError("a block must be longer than a unit")
    home = F.floor(F.col("i") / limits.block).cast("int")
    before = F.when((F.col("i") % limits.block < limits.rim) & (home > 0), home - 1)
    dealt = written(cuts.select("*", F.explode(F.array_compact(F.array(home, before))).alias("block")).withColumn("home", F.col("block") == home), "unit-rows")
    kind, place = dict(cuts.dtypes)["session_id"], dict(cuts.dtypes)["pos"]
    # Sorted partitions are cut into blocks in the tasks: a call for each block would cost more than its walk where sessions are short.
    sort = lambda df: df.repartition("session_id", "block").sortWithinPartitions("session_id", "block", "i")
    exits = sort(dealt).mapInArrow(_exits(limits, ["session_id", "block", "entry", "then", "by"]), f"session_id {kind}, block int, entry int, then int, by int")
    # A block before the session's last may also be left beyond the end: that step leads to no block and is met by none.
    steps = written(exits.select("session_id", "block", "entry", (F.col("block") + 1).alias("to_block"), F.col("then").alias("to_entry"), "by"), "unit-steps")
    seeds = dealt.where("i = 0").select("session_id", F.lit(0).alias("block"), F.lit(0).alias("entry"), F.lit(-1).alias("by"))
    entries = _entries(steps, seeds)
    found = dealt.join(entries.withColumnsRenamed({"session_id": "__s", "block": "__b"}), F.col("session_id").eqNullSafe(F.col("__s")) & (F.col("block") == F.col("__b"))).drop("__s", "__b")
    begun = sort(found).mapInArrow(_starts(limits, ["session_id", "pos", "i", "begun", "why"]), f"session_id {kind}, pos {place}, i long, begun boolean, why int")
    begun = written(begun, "unit-begun")
    numbered = ordered.running_count(begun, ["session_id"], ["i"], F.col("begun"), "__unit", ordered.block_of(F.col("i")))
    name = F.coalesce(F.get(F.array(*map(F.lit, KINDS)), F.col("why")), F.lit(""))
    return numbered.select("session_id", "pos", (F.col("__unit") - 1).alias("unit"), "begun", F.when(F.col("begun"), name).alias("why"))


def plain_units(cost: list[int], flags: dict[str, list[bool]], limits: Limits) -> Iterator[tuple[int, str]]:
    """The same walk, row by row, for one session: (first row, why) of each unit. What the tests hold the blocks against."""
    n, start, why = len(cost), 0, ""
    while start < n:
        yield start, why
        limit, chars = start, 0
        while limit < n and limit - start < limits.records and chars + cost[limit] <= limits.chars and (HALVES * (chars + cost[limit])) // 2 + EACH * (limit - start + 1) + BESIDE <= limits.payload:
            chars += cost[limit]
            limit += 1
        limit = max(limit, start + 1)
        window = sum(cost[start:limit])
        inside = [c for c in range(start + 1, min(limit, n - 1) + 1) if flags["safe"][c]]
        natural = [c for c in inside if flags["natural"][c]]
        if natural:
            start, why = natural[0], "natural"
            continue
        if limit == n:
            return
        end, why = (inside[-1], "safe") if inside else (limit, "limit")
        for kind in ("commit", "turn", "result"):
            filled = [c for c in inside if flags[kind][c] and 100 * sum(cost[start:c]) >= LEAST_FILL * window]
            if filled:
                end, why = filled[-1], kind
                break
        start = end
