"""Tool steps: calls and results, edits and the checks that follow them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ordered

_DAY = 86_400


def _time_block(column: str = "at") -> Column:
    return ordered.block_of(F.unix_micros(F.col(column).cast("timestamp")) / 1e6, _DAY)


def pair_results(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Each call (session_id, call_id, ...) with the last result of its call_id: result_id, result_status; nulls where there is none."""
    last = results.groupBy("session_id", "call_id").agg(F.max_by(F.struct("result_id", "result_status"), F.struct("at", "result_id")).alias("r"))
    return calls.join(last, ["session_id", "call_id"], "left").select(*calls.columns, "r.result_id", "r.result_status")


def next_results(steps: DataFrame, is_call: Column, is_result: Column) -> DataFrame:
    """Calls of ``steps`` (id, session_id, key, at) with result_id: the next result of the same session and key, before the next call of it."""
    seen = steps.withColumn("__call", is_call).withColumn("__result", is_result).where("__call OR __result")
    nearest = ordered.previous(seen, ["session_id", "key"], ["at", "id"], ["id", "__result"], "__next", _time_block(), backwards=True)
    return nearest.where("__call").select(*steps.columns, F.when(F.col("__next.__result"), F.col("__next.id")).alias("result_id"))


def latest_edit(steps: DataFrame, is_edit: Column, is_check: Column) -> DataFrame:
    """Checks of ``steps`` (id, session_id, at) with edit_id: the latest edit of the session before them."""
    found = ordered.last_before(steps.withColumn("__check", is_check), ["session_id"], ["at", "id"], F.when(is_edit, F.col("id")), "edit_id", _time_block(), strict=True)
    return found.where("__check").drop("__check")


def runs_after_edits(steps: DataFrame, is_edit: Column, is_run: Column, most: int = 3) -> DataFrame:
    """(edit_id, run_id, place): the first ``most`` runs after each edit in its session.

    Runs are numbered; an edit that comes after n runs takes those numbered
    n + 1 to n + most, by an equi join on the number.
    """
    numbered = ordered.running_count(steps.withColumn("__edit", is_edit).withColumn("__run", is_run), ["session_id"], ["at", "id"], F.col("__run"), "__n", _time_block())
    runs = numbered.where("__run").select("session_id", F.col("__n").alias("__at"), F.col("id").alias("run_id"))
    edits = numbered.where("__edit").select("session_id", F.col("id").alias("edit_id"), F.col("__n"), F.explode(F.sequence(F.lit(1), F.lit(most))).alias("place"))
    return edits.withColumn("__at", F.col("__n") + F.col("place")).join(runs, ["session_id", "__at"]).select("edit_id", "run_id", F.col("place").cast("bigint"))


def edit_groups(steps: DataFrame, hint: str = "hint") -> DataFrame:
    """Work items (session_id, item, hint, n_steps, first_id, last_id): consecutive edits are one item, every check or commit its own; other steps make no item and do not break one."""
    made = steps.where(F.col(hint).isin("edit", "test", "commit"))
    seen = ordered.previous(made.withColumn("__hint", F.col(hint)), ["session_id"], ["at", "id"], ["__hint"], "__before", _time_block())
    marked = seen.withColumn("__new", (F.col(hint) != "edit") | ~F.col("__before.__hint").eqNullSafe("edit"))
    numbered = ordered.running_count(marked, ["session_id"], ["at", "id"], F.col("__new"), "item", _time_block())
    order = F.struct("at", "id")
    return numbered.groupBy("session_id", "item").agg(F.min_by(hint, order).alias("hint"), F.count("*").alias("n_steps"), F.min_by("id", order).alias("first_id"), F.max_by("id", order).alias("last_id"))


def repeated_checks(items: DataFrame) -> DataFrame:
    """Outcomes (session_id, target, at, id, status) with runs of the same target collapsed: the latest status, the number of records."""
    seen = ordered.previous(items, ["session_id"], ["at", "id"], ["target"], "__before", _time_block())
    new = F.coalesce(F.col("__before.target") != F.col("target"), F.lit(True))
    numbered = ordered.running_count(seen.withColumn("__new", new), ["session_id"], ["at", "id"], F.col("__new"), "run", _time_block())
    return numbered.groupBy("session_id", "run", "target").agg(F.max_by("status", F.struct("at", "id")).alias("status"), F.count("*").alias("n_records"))


def hint_counts(steps: DataFrame, target: str) -> DataFrame:
    """hint, n, n_targets (different ones) and share of all steps."""
    total = steps.agg(F.count("*").alias("__all"))
    counted = steps.groupBy("hint").agg(F.count("*").alias("n"), F.count_distinct(target).alias("n_targets"))
    return counted.crossJoin(F.broadcast(total)).select("hint", "n", "n_targets", F.bround(F.col("n") / F.col("__all"), 3).alias("share"))


def near_in_time(left: DataFrame, right: DataFrame, seconds: int, most: int) -> DataFrame:
    """(id, other_id, apart_s, place): for each row of ``left`` (id, tree, session_id, at) the nearest ``most`` rows of other sessions in the same tree within ``seconds``; of equally near ones those with the smaller id.

    Times are cut in slots; a slot has its own rows of ``left`` and those of
    ``right`` up to ``seconds`` beyond its edges. A row's nearest others are the
    first ones in two orders, later and earlier, where runs of its own session
    are jumped over: no pairs are made. Rows with a null tree, session or time
    meet nothing; ``most`` is the operator's limit, not a cap on its search.
    """
    width, reach = _SLOTS * seconds * 1_000_000, seconds * 1_000_000
    micros = F.unix_micros(F.col("at").cast("timestamp"))
    slot = lambda c: F.floor(c / F.lit(width)).cast("bigint")
    own = left.where("session_id IS NOT NULL").select("tree", F.col("session_id").alias("session"), micros.alias("us"), "id", slot(micros).alias("slot"))
    other = right.where("session_id IS NOT NULL").select("tree", F.col("session_id").alias("session"), micros.alias("us"), F.col("id").alias("other_id"), F.explode(F.sequence(slot(micros - reach), slot(micros + reach))).alias("slot"))
    both = own.withColumn("mine", F.lit(True)).unionByName(other.withColumn("mine", F.lit(False)), allowMissingColumns=True).where("tree IS NOT NULL AND us IS NOT NULL")
    groups = max(1, right.count() // _TOGETHER)
    kinds = dict(own.dtypes) | dict(other.dtypes)
    dealt = both.withColumn("part", F.pmod(F.xxhash64("tree", "slot"), F.lit(groups)))
    return dealt.groupBy("part").applyInArrow(_nearest(width, reach, most), f"id {kinds['id']}, other_id {kinds['other_id']}, apart_s double, place long")


#: Slots are this many times as wide as the search reaches; rows of one group of slots, about.
_SLOTS, _TOGETHER = 4, 50_000


def _nearest(width: int, reach: int, most: int):
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def codes(column) -> np.ndarray:
        return pc.dictionary_encode(column.combine_chunks()).indices.to_numpy(zero_copy_only=False).astype(np.int64)

    def first(session: np.ndarray, order: np.ndarray, start: np.ndarray, own: np.ndarray) -> list[np.ndarray]:
        """From each start on, the places of the first ``most`` rows of other sessions in ``order``; -1 where there are no more."""
        n, session = len(order), session[order]
        runs = np.append(np.flatnonzero(np.diff(session)) + 1, n)
        beyond = runs[np.searchsorted(runs, np.arange(n), side="right")]
        out, at = [], start
        for _ in range(most):
            here = np.minimum(at, n - 1)
            at = np.where((at < n) & (session[here] == own), beyond[here], at)
            out.append(np.where(at < n, order[np.minimum(at, n - 1)], -1))
            at = np.minimum(at + 1, n)
        return out

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        # Slots lie far enough apart on one line that none is within reach of another.
        pair = np.unique(np.stack([codes(table["tree"]), table["slot"].to_numpy()]), axis=1, return_inverse=True)[1].ravel()
        along = table["us"].to_numpy() - table["slot"].to_numpy() * width + pair * (width + 4 * reach)
        session, mine = codes(table["session"]), table["mine"].to_numpy(zero_copy_only=False).astype(bool)
        a, b = np.flatnonzero(mine), np.flatnonzero(~mine)
        empty = np.zeros(0, np.int64)
        row, found, apart = empty, empty, empty
        if len(a) and len(b):
            rank = np.empty(len(b), np.int64)
            rank[pc.sort_indices(table["other_id"].take(pa.array(b)), null_placement="at_start").to_numpy()] = np.arange(len(b))
            us, ses = along[b], session[b]
            later, earlier = np.lexsort((rank, us)), np.lexsort((rank, -us))
            places = first(ses, later, np.searchsorted(us[later], along[a], side="left"), session[a]) + first(ses, earlier, np.searchsorted(-us[earlier], -along[a], side="right"), session[a])
            row, found = np.tile(np.arange(len(a)), len(places)), np.concatenate(places)
            row, found = row[found >= 0], found[found >= 0]
            apart = np.abs(us[found] - along[a][row])
            row, found, apart = (x[apart <= reach] for x in (row, found, apart))
            by = np.lexsort((rank[found], apart, row))
            row, found, apart = row[by], found[by], apart[by]
        place = np.arange(len(row)) - np.searchsorted(row, row) + 1
        keep = place <= most
        ids, others = table["id"].take(pa.array(a[row[keep]])), table["other_id"].take(pa.array(b[found[keep]]))
        return pa.table({"id": ids, "other_id": others, "apart_s": pa.array(apart[keep] / 1e6), "place": pa.array(place[keep])})

    return run


def due_points(items: DataFrame, most: int, seconds: int, commit: Column) -> DataFrame:
    """(session_id, fired_at, n_items): when a reminder falls due: at ``most`` items, ``seconds`` after the first, or at a commit; counting then starts anew.

    A fold over each session's whole sequence, which no window frame expresses.
    A commit sets the state back whatever it was, so a session is cut exactly
    there, into as many shares as it has commits; a task walks the rows of a
    share once, in order, and holds only the count and the first time.
    """
    import pyarrow as pa

    chosen = items.select("session_id", F.col("at"), F.unix_micros(F.col("at").cast("timestamp")).alias("micros"), F.coalesce(commit, F.lit(False)).alias("commit"), "id")
    counted = ordered.running_count(chosen, ["session_id"], ["at", "id"], F.col("commit"), "share", _time_block()).withColumn("share", F.col("share") - F.col("commit").cast("bigint"))
    dealt = counted.repartition("session_id", "share").sortWithinPartitions("session_id", "share", "at", "id")

    def fold(batches):
        share, first, n = None, 0, 0
        for batch in batches:
            fired = []
            for i, (session, part, micros, is_commit) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 5, 2, 3)), strict=True)):
                if (session, part) != share:
                    share, n = (session, part), 0
                if n and micros - first >= seconds * 1_000_000:
                    fired.append((i, n))
                    n = 0
                first, n = (micros if n == 0 else first), n + 1
                if n >= most or is_commit:
                    fired.append((i, n))
                    n = 0
            rows = batch.take(pa.array([i for i, _ in fired], pa.int64()))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array([n for _, n in fired], pa.int64())], names=["session_id", "fired_at", "n_items"])

    kinds = dict(chosen.dtypes)
    return dealt.mapInArrow(fold, f"session_id {kinds['session_id']}, fired_at {kinds['at']}, n_items long")
