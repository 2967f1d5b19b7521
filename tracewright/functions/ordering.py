"""Row numbers, running totals and cut-offs for groups of any size.

A window over a group puts the whole group into one task. For groups that may be large, the
group is first divided into *slots*, a value that never decreases along the wanted order. Only
the per-slot totals (after map-side aggregation) are windowed over the group; rows are windowed
inside one slot.

For the many small groups of a log that would only cost a second shuffle, so exact counts decide
beforehand which keys need slots (``hot_keys``). Both ways give the same numbers.

Where no slot is given, rows are dealt into ranges of the order itself: their bounds come from a sample,
but the numbers don't depend on them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle

# A key with more rows than this is divided into slots.
HOT_ROWS = 2_000_000


def hot_keys(df: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """The keys (null too) with more than ``hot_rows`` rows as a written table, None without any."""
    hot = settle(df.groupBy(F.col(key).alias("_hot")).agg(F.count("*").alias("_c")).where(F.col("_c") > hot_rows).select("_hot"))
    return None if hot.isEmpty() else hot


def by_heat(df: DataFrame, key: str, plain, slotted, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``plain(df)``, but ``slotted`` for the rows of hot keys."""
    hot = hot_keys(df, key, hot_rows)
    if hot is None:
        return plain(df)
    same = df[key].eqNullSafe(hot["_hot"])
    return plain(df.join(hot, same, "left_anti")).unionByName(slotted(df.join(hot, same, "left_semi")))


def range_slot(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """``df`` with ``_slot``, which never decreases along the order within a group; written, so that it is fixed."""
    columns = [F.col(c) if isinstance(c, str) else c for c in (*keys, *order)]
    return settle(df.repartitionByRange(*columns).withColumn("_slot", F.spark_partition_id()))


def hash_slot(h: Column) -> Column:
    """65,536 even slots for an order by a hexadecimal hash."""
    return F.substring(h, 1, 4)


def _by(keys):
    return Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))


def running_total(
    df: DataFrame, keys: list[str], slot: Column | None, order: list, weight: Column, name: str = "upto"
) -> DataFrame:
    """Add the sum of ``weight`` over the rows of the group up to and including this one.

    Rows equal in ``order`` are summed one after the other in no fixed order, so aggregate
    equal rows first where that matters.
    """
    keyed = range_slot(df, keys, order) if slot is None else df.withColumn("_slot", slot)
    keyed = keyed.withColumn("_weight", weight)
    totals = keyed.groupBy(*keys, "_slot").agg(F.sum("_weight").alias("_total"))
    earlier = _by(keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_before")
    offsets = totals.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_slot").alias("_ks"), before)
    same = keyed["_slot"].eqNullSafe(offsets["_ks"])
    for i, k in enumerate(keys):
        same = same & keyed[k].eqNullSafe(offsets[f"_k{i}"])
    inside = (
        Window.partitionBy(*keys, "_slot")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    added = keyed.join(offsets, same).withColumn(name, F.col("_before") + F.sum("_weight").over(inside))
    return added.select(*[c for c in df.columns if c != name], name)


def numbered(df: DataFrame, keys: list[str], slot: Column | None, order: list, name: str = "pos") -> DataFrame:
    """Row numbers from 1 within each group (the whole table when ``keys`` is empty)."""
    return running_total(df, keys, slot, order, F.lit(1).cast("bigint"), name)


def slot_edges(totals: DataFrame, keys: list[str], keep) -> DataFrame:
    """From row counts per (group, ``_slot``): the slot holding row ``keep(n)`` and its rank there.

    Also returns ``n``, the group's size. Groups with ``keep(n) < 1`` are left out.
    """
    upto = _by(keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        totals.withColumn("_hi", F.sum("_c").over(upto))
        .withColumn("n", F.sum("_c").over(_by(keys)))
        .withColumn("_k", keep(F.col("n")).cast("bigint"))
        .where((F.col("_hi") - F.col("_c") < F.col("_k")) & (F.col("_k") <= F.col("_hi")))
        .select(*keys, "_slot", "n", (F.col("_k") - F.col("_hi") + F.col("_c")).alias("_r"))
    )


def edge_rows(rows: DataFrame, keys: list[str], h: str) -> DataFrame:
    """From the rows of the edge slots (with ``_r`` and ``n``): the hash of the cut row per group."""
    inside = Window.partitionBy(*keys, "_slot").orderBy(h)
    return (
        rows.withColumn("_rn", F.row_number().over(inside))
        .where(F.col("_rn") == F.col("_r"))
        .select(*keys, F.col(h).alias("cut"), "n")
    )


def hash_cut(df: DataFrame, h: str, keep, keys=()) -> DataFrame:
    """The hash of row number ``keep(n)`` in hash order, n being the number of rows of the group.

    One pass counts rows per slot, a second ranks the rows of the one slot that holds the cut.
    There is no row for a group with ``keep(n) < 1``.
    """
    keyed = df.select(*keys, F.col(h), hash_slot(F.col(h)).alias("_slot"))
    edge = slot_edges(keyed.groupBy(*keys, "_slot").agg(F.count("*").alias("_c")), list(keys), keep)
    return edge_rows(keyed.join(edge, [*keys, "_slot"]), list(keys), h)
