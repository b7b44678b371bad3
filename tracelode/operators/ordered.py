"""Running values over long sequences without gathering a sequence in one task.

A sequence is cut into blocks along its order. Running values are computed
inside the blocks, in parallel; one small row for each block carries on what
came before it. A session that holds a third of all rows is then as many tasks
as it has blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions, or seconds, that one block spans.
BLOCK = 65_536


def block_of(order: Column, width: int = BLOCK) -> Column:
    """The block of a number or a time (``width`` in units or seconds)."""
    return F.floor(order / width).cast("bigint")


def running_count(rows: DataFrame, keys: list[str], order: list[str], hit: Column, name: str, block: Column) -> DataFrame:
    """``rows`` with ``name``: how many rows up to and with this one fulfil ``hit``.

    ``block`` must not fall along ``order``. A null ``hit`` counts as false;
    rows with null keys form a sequence of their own; ties of ``order`` make
    the result depend on the partitioning, so ``order`` should be total.
    """
    return running_sum(rows, keys, order, F.coalesce(hit, F.lit(False)).cast("bigint"), name, block)


def running_sum(rows: DataFrame, keys: list[str], order: list[str], value: Column, name: str, block: Column) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` up to and with this one, as ``running_count`` counts."""
    marked = rows.withColumn("__block", block).withColumn("__hit", value)
    inside = Window.partitionBy(*keys, "__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = marked.groupBy(*keys, "__block").agg(F.sum("__hit").alias("__sum"))
    ahead = sums.withColumn("__ahead", F.coalesce(F.sum("__sum").over(Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__sum")
    joined = marked.withColumn("__own", F.sum("__hit").over(inside)).join(_renamed(ahead, keys), _same(keys), "left")
    return joined.withColumn(name, F.col("__own") + F.coalesce("__ahead", F.lit(0))).select(*rows.columns, name)


def last_before(rows: DataFrame, keys: list[str], order: list[str], value: Column, name: str, block: Column, strict: bool = False, backwards: bool = False) -> DataFrame:
    """``rows`` with ``name``: the last non-null ``value`` up to this row, without it if ``strict``; with ``backwards`` the first one from this row on. An as-of join on one table."""
    marked = rows.withColumn("__block", -block if backwards else block).withColumn("__value", value)
    inside = Window.partitionBy(*keys, "__block").orderBy(*[F.desc(c) if backwards else F.col(c) for c in order]).rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
    nearest = F.min_by if backwards else F.max_by
    latest = marked.where("__value IS NOT NULL").groupBy(*keys, "__block").agg(nearest("__value", F.struct(*order)).alias("__latest"))
    blocks = marked.select(*keys, "__block").distinct().join(latest.withColumnsRenamed({k: f"__k{i}" for i, k in enumerate(keys)} | {"__block": "__b"}), _same(keys), "left").select(*keys, "__block", "__latest")
    joined = marked.withColumn("__own", F.last("__value", ignorenulls=True).over(inside)).join(_renamed(_carried(blocks, keys), keys), _same(keys), "left")
    return joined.withColumn(name, F.coalesce("__own", "__carried")).select(*rows.columns, name)


def _carried(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, __block, __carried): the last value of the blocks before. Blocks are carried over within groups of BLOCK, then from group to group, so that no task holds all blocks of a very long sequence."""
    before = F.last("__latest", ignorenulls=True)
    grouped = blocks.withColumn("__group", F.floor(F.col("__block") / BLOCK))
    near = grouped.withColumn("__near", before.over(Window.partitionBy(*keys, "__group").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)))
    of_group = grouped.where("__latest IS NOT NULL").groupBy(*keys, "__group").agg(F.max_by("__latest", "__block").alias("__latest"))
    groups = grouped.select(*keys, "__group").distinct().withColumnsRenamed({k: f"__g{i}" for i, k in enumerate(keys)} | {"__group": "__h"})
    joined = groups.join(of_group, _equal({f"__g{i}": k for i, k in enumerate(keys)} | {"__h": "__group"}), "left").select(*[f"__g{i}" for i in range(len(keys))], "__h", "__latest")
    far = joined.withColumn("__far", before.over(Window.partitionBy(*[f"__g{i}" for i in range(len(keys))]).orderBy("__h").rowsBetween(Window.unboundedPreceding, -1))).drop("__latest")
    return near.join(far, _equal({f"__g{i}": k for i, k in enumerate(keys)} | {"__h": "__group"}), "left").select(*keys, "__block", F.coalesce("__near", "__far").alias("__carried"))


def _equal(pairs: dict[str, str]) -> Column:
    on = F.lit(True)
    for a, b in pairs.items():
        on = on & F.col(a).eqNullSafe(F.col(b))
    return on


def previous(rows: DataFrame, keys: list[str], order: list[str], columns: list[str], name: str, block: Column, backwards: bool = False) -> DataFrame:
    """``rows`` with ``name``: a struct of ``columns`` of the row before (``backwards``: after) this one, null where there is none. What lag and lead give, but a long sequence is many tasks."""
    return last_before(rows, keys, order, F.struct(*columns), name, block, strict=True, backwards=backwards)


def as_of(rows: DataFrame, known: DataFrame, key: str, known_key: str, order: str, known_order: str, value: list[str], name: str, block: Column) -> DataFrame:
    """``rows`` with ``name``: the ``value`` columns, as a struct, of the last row of ``known`` with this key and an order up to this row's; ties go by the greater value. One pass over both tables, no pairs.

    ``block`` is written on the column ``__o``.
    """
    left = rows.select(F.col(key).alias("__s"), F.col(order).alias("__o"), F.lit(1).alias("__side"), F.struct(*rows.columns).alias("__row"))
    right = known.select(F.col(known_key).alias("__s"), F.col(known_order).alias("__o"), F.lit(0).alias("__side"), F.struct(*value).alias("__known"))
    both = left.unionByName(right, allowMissingColumns=True)
    return last_before(both, ["__s"], ["__o", "__side", "__known"], F.col("__known"), name, block).where("__side = 1").select("__row.*", name)


def _renamed(small: DataFrame, keys: list[str]) -> DataFrame:
    return small.withColumnsRenamed({k: f"__k{i}" for i, k in enumerate(keys)} | {"__block": "__b"})


def _same(keys: list[str]) -> Column:
    on = F.col("__block").eqNullSafe(F.col("__b"))
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return on
