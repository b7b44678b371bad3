"""Tables that are kept between runs: upserts, changes between versions, what is pending, and call ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert_actions(before: DataFrame, now: DataFrame, key: str, value_hash: str = "content_hash", full_scan: bool = True) -> DataFrame:
    """(key, action): insert, update, unchanged or missing. A row that is gone is missing, never deleted, and only a full scan says so."""
    old = before.select(F.col(key), F.col(value_hash).alias("__old"), F.lit(True).alias("__was"))
    new = now.select(F.col(key), F.col(value_hash).alias("__new"), F.lit(True).alias("__is"))
    action = F.when(F.col("__was").isNull(), "insert").when(F.col("__is").isNull(), "missing" if full_scan else "unchanged").when(F.col("__old").eqNullSafe(F.col("__new")), "unchanged").otherwise("update")
    return old.join(new, key, "full_outer").select(key, action.alias("action"))


def upserted(before: DataFrame, now: DataFrame, key: str) -> DataFrame:
    """All rows after the upsert, with available: rows of ``now``, and those of ``before`` that it does not have."""
    kept = before.join(now.select(key), key, "left_anti").withColumn("available", F.lit(False))
    return now.withColumn("available", F.lit(True)).unionByName(kept)


def version_changes(old: DataFrame, new: DataFrame, key: str, closed: Column | None = None) -> DataFrame:
    """(key, change): added, updated, invalidated (newly ``closed``) or removed between two versions; equal rows give none."""
    columns = [c for c in new.columns if c != key]
    side = lambda df, name: df.select(key, F.struct(*columns).alias(f"__{name}"), (closed if closed is not None else F.lit(False)).alias(f"__{name}_closed"))
    joined = side(old, "old").join(side(new, "new"), key, "full_outer")
    change = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "removed").when(F.col("__new_closed") & ~F.col("__old_closed"), "invalidated").when(~F.col("__old").eqNullSafe(F.col("__new")), "updated")
    return joined.select(key, change.alias("change")).where("change IS NOT NULL")


def field_changes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(field, n): how many rows of both versions differ in each field."""
    fields = [c for c in new.columns if c != key]
    joined = old.alias("o").join(new.alias("n"), key)
    sums = joined.agg(*[F.count_if(~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))).alias(c) for c in fields])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("n")) for c in fields])).alias("x")).select("x.*")


def pending(records: DataFrame) -> DataFrame:
    """Available records whose processed_hash is not their content_hash, null counting as never processed."""
    return records.where(F.col("available") & ~F.col("processed_hash").eqNullSafe(F.col("content_hash")))


def file_changes(listing: DataFrame, index: DataFrame) -> DataFrame:
    """(path, state, bytes_to_read): new, changed, deleted or same; a file that grew is read from where it was."""
    new = listing.select("path", F.col("bytes").alias("__new"), F.col("mtime").alias("__at"))
    old = index.select("path", F.col("bytes").alias("__old"), F.col("mtime").alias("__before"))
    state = F.when(F.col("__old").isNull(), "new").when(F.col("__new").isNull(), "deleted").when((F.col("__old") != F.col("__new")) | (F.col("__at") != F.col("__before")), "changed").otherwise("same")
    todo = F.when(F.col("__old").isNull(), F.col("__new")).when(F.col("__new") > F.col("__old"), F.col("__new") - F.col("__old")).when((F.col("__new") < F.col("__old")) | (F.col("__at") != F.col("__before")), F.col("__new"))
    return new.join(old, "path", "full_outer").select("path", state.alias("state"), F.coalesce(todo, F.lit(0)).cast("bigint").alias("bytes_to_read"))


def token_totals(calls: DataFrame, n_in: str, n_out: str, cost: str) -> DataFrame:
    """One row: reported (calls with both counts), the sums of these, and the cost, null where no call has one."""
    both = F.col(n_in).isNotNull() & F.col(n_out).isNotNull()
    return calls.agg(F.count_if(both).alias("reported"), F.sum(F.when(both, F.col(n_in))).alias("tokens_in"), F.sum(F.when(both, F.col(n_out))).alias("tokens_out"), F.sum(cost).alias("cost"))


def call_summary(calls: DataFrame, dimensions: list[str], n_in: str, cost: str) -> DataFrame:
    """(dimension, value, n, tokens, cost): the ledger by each dimension on its own, in one pass of grouping sets."""
    sets = [[d] for d in dimensions]
    grouped = calls.groupingSets([[F.col(c) for c in s] for s in sets], *dimensions).agg(F.count("*").alias("n"), F.sum(n_in).alias("tokens"), F.sum(cost).alias("cost"), *[F.grouping(d).alias(f"__{d}") for d in dimensions])
    which = F.coalesce(*[F.when(F.col(f"__{d}") == 0, F.lit(d)) for d in dimensions])
    value = F.coalesce(*[F.when(F.col(f"__{d}") == 0, F.col(d).cast("string")) for d in dimensions])
    return grouped.select(which.alias("dimension"), value.alias("value"), "n", "tokens", "cost")


def plan_figures(units: DataFrame, choices: tuple[int, ...] = (5, 15, 30), fixed: int = 30_000, per_minute: int = 15_000) -> DataFrame:
    """(n, calls, tokens, minutes): running totals over the first n units (pos, calls, chars), for the choices there are."""
    first = units.orderBy("pos").limit(max(choices)).withColumn("n", F.row_number().over(Window.orderBy("pos")))
    so_far = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    totals = first.select("n", F.sum("calls").over(so_far).alias("calls"), F.sum(F.col("calls") * fixed + F.col("chars") / 4).over(so_far).alias("tokens"))
    return totals.where(F.col("n").isin(*choices)).select(F.col("n").cast("bigint").alias("n"), "calls", F.floor("tokens").cast("bigint").alias("tokens"), F.ceil(F.col("tokens") / per_minute).cast("bigint").alias("minutes"))


def calibration(units: DataFrame, calls: DataFrame, least: int = 3) -> DataFrame:
    """One row (units, ratio): actual tokens over estimated ones of the units all of whose calls report usage; null ratio below ``least`` units."""
    used = calls.groupBy("unit_id").agg(F.sum("tokens").alias("actual"), F.bool_and(F.col("tokens").isNotNull()).alias("complete"))
    sums = units.join(used.where("complete"), "unit_id").agg(F.count("*").alias("units"), F.sum("actual").alias("a"), F.sum("estimated").alias("e"))
    return sums.select("units", F.when(F.col("units") >= least, F.bround(F.col("a").cast("double") / F.col("e").cast("double"), 4)).alias("ratio"))


def held_units(units: DataFrame, records: DataFrame) -> DataFrame:
    """unit_id of failed units (unit_id, status, source_id, content_hash: one row for each source) whose input is still the same and available."""
    failed = units.where("status = 'failed'")
    now = records.select("source_id", F.col("content_hash").alias("__now"), F.col("available").alias("__there"))
    same = F.coalesce((F.col("__now") == F.col("content_hash")) & F.col("__there"), F.lit(False))
    return failed.join(now, "source_id", "left").groupBy("unit_id").agg(F.bool_and(same).alias("same")).where("same").select("unit_id")


def expectation_scores(expected: DataFrame, events: DataFrame) -> DataFrame:
    """(result, n): how often an expectation (label, kind, status) is met by exactly one event of its label, by none, by several, or by one that differs."""
    found = events.groupBy("label").agg(F.count("*").alias("n"), F.first("kind").alias("__kind"), F.first("status").alias("__status"))
    joined = expected.join(found, "label", "left")
    result = F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "split").when(F.col("kind").eqNullSafe(F.col("__kind")) & F.col("status").eqNullSafe(F.col("__status")), "met").otherwise("differs")
    return joined.select(result.alias("result")).groupBy("result").agg(F.count("*").alias("n"))


def comparison(results: DataFrame, row: str, column: str, value: str, columns: list[str]) -> DataFrame:
    """A column for each of ``columns``, a row for each ``row``: sums of ``value``."""
    return results.groupBy(row).pivot(column, columns).agg(F.sum(value))


def snapshot_id(records: DataFrame) -> DataFrame:
    """One row (id, n): a digest of all (source_id, content_hash).

    Hashes are combined by a sum that no order and no partitioning changes, so
    no list of all records is gathered.
    """
    word = lambda k: F.conv(F.substring(F.sha2(F.concat_ws("\n", "source_id", "content_hash"), 256), 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")
    sums = records.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(word(k)), F.lit(0)).cast("string").alias(f"w{k}") for k in range(4)])
    return sums.select(F.concat(F.lit("snap_"), F.substring(F.sha2(F.concat_ws(",", "n", "w0", "w1", "w2", "w3"), 256), 1, 24)).alias("id"), "n")
