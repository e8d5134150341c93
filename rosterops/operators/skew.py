"""Building blocks that keep one hot key from becoming one hot task.

``attach`` joins rows back to a table with one row per key. A key of more than ``HOT_ROWS`` rows
gets a slot for every ``HOT_ROWS`` of them: its rows are spread over the slots, and the matching
row is copied that often. Every other key takes the plain shuffle join. The list of hot keys
is broadcast; there are at most ``rows / HOT_ROWS`` of them. It only steers the spread, it
never decides a result.

``running_last`` and ``running_sum`` scan an ordered group in two levels: inside fixed
spans of the order column, then over one summary row per span. A group of a billion rows
costs a million summary rows, not one billion-row sort in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT_ROWS = 100_000
SPAN = 4096


def _slots(n: str) -> Column:
    return F.ceil(F.col(n) / HOT_ROWS).cast("int")


def hot_keys(counts: DataFrame, keys: list[str], n: str) -> DataFrame:
    """Keys of more than ``HOT_ROWS`` rows with their number of slots."""
    return counts.filter(F.col(n) > HOT_ROWS).select(*keys, _slots(n).alias("_slots"))


def attach(
    rows: DataFrame, per_key: DataFrame, keys: list[str], n: str, spread: Column,
    how: str = "left", counts: DataFrame | None = None,
) -> DataFrame:
    """Join ``rows`` to ``per_key`` (one row per key).

    ``n`` is the column with the number of rows of a key, in ``counts`` when given, else in
    ``per_key``.
    """
    hot = F.broadcast(hot_keys(per_key if counts is None else counts, keys, n))
    slot = F.pmod(F.xxhash64(spread), F.coalesce("_slots", F.lit(1))).cast("int")
    salted = rows.join(hot, keys, "left").withColumn("_slot", F.when(F.col("_slots").isNull(), 0).otherwise(slot)).drop("_slots")
    if counts is None:
        marked = per_key.withColumn("_slots", F.greatest(_slots(n), F.lit(1)))
    else:
        marked = per_key.join(hot, keys, "left")
    every = F.sequence(F.lit(0), F.coalesce("_slots", F.lit(1)) - 1)
    copied = marked.withColumn("_slot", F.explode(every)).drop("_slots")
    return salted.join(copied, [*keys, "_slot"], how).drop("_slot")


def mark_first(rows: DataFrame, keys: list[str], order: str, flag: str) -> DataFrame:
    """Flag the row with the smallest ``order`` per key; later ones get False."""
    firsts = rows.groupBy(*keys).agg(F.min(order).alias("_first"), F.count(F.lit(1)).alias("_n"))
    return (
        attach(rows, firsts, keys, "_n", F.col(order))
        .withColumn(flag, F.col(order) == F.col("_first"))
        .drop("_first", "_n")
    )


def _span(order: str, span: int) -> Column:
    return F.floor(F.col(order) / span)


def running_last(
    rows: DataFrame, keys: list[str], order: str, value: Column, out: str,
    reverse: bool = False, exclusive: bool = False, span: int = SPAN,
) -> DataFrame:
    """Last non-null ``value`` at or before each row (``reverse``: first at or after)."""
    staged = rows.withColumn("_v", value).withColumn("_s", _span(order, span))
    by = F.col(order).desc() if reverse else F.col(order).asc()
    edge = -1 if exclusive else 0
    inner = Window.partitionBy(*keys, "_s").orderBy(by).rowsBetween(Window.unboundedPreceding, edge)
    local = staged.withColumn("_local", F.last("_v", ignorenulls=True).over(inner))
    pick = F.min_by if reverse else F.max_by
    edge_of = pick("_v", F.when(F.col("_v").isNotNull(), F.col(order)))
    spans = staged.groupBy(*keys, "_s").agg(edge_of.alias("_edge"))
    step = F.col("_s").desc() if reverse else F.col("_s").asc()
    outer = Window.partitionBy(*keys).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.select(*keys, "_s", F.last("_edge", ignorenulls=True).over(outer).alias("_carry"))
    return (
        local.join(carried, [*keys, "_s"], "left")
        .withColumn(out, F.coalesce("_local", "_carry"))
        .drop("_v", "_s", "_local", "_carry")
    )


def running_sum(
    rows: DataFrame, keys: list[str], order: str, value: Column, out: str, span: int = SPAN
) -> DataFrame:
    """Sum of ``value`` up to and including each row."""
    staged = rows.withColumn("_v", value).withColumn("_s", _span(order, span))
    inner = Window.partitionBy(*keys, "_s").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = staged.withColumn("_local", F.sum("_v").over(inner))
    sums = staged.groupBy(*keys, "_s").agg(F.sum("_v").alias("_t"))
    outer = Window.partitionBy(*keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(*keys, "_s", F.coalesce(F.sum("_t").over(outer), F.lit(0)).alias("_carry"))
    return (
        local.join(carried, [*keys, "_s"], "left")
        .withColumn(out, F.col("_local") + F.col("_carry"))
        .drop("_v", "_s", "_local", "_carry")
    )


def dense_order(rows: DataFrame, keys: list[str], outer: str, inner: str, out: str) -> DataFrame:
    """Numbers rows from 1 by ``(outer, inner)`` within ``keys``; both may hold any numbers.

    The rows of one ``outer`` value (a page, a unit) are numbered in one window; the sizes
    before it come from a running sum over one row per ``outer`` value.
    """
    within = Window.partitionBy(*keys, outer).orderBy(inner)
    sizes = rows.groupBy(*keys, outer).agg(F.count(F.lit(1)).alias("_size"))
    before = running_sum(sizes, keys, outer, F.col("_size"), "_upto").select(*keys, outer, (F.col("_upto") - F.col("_size")).alias("_before"))
    placed = rows.withColumn("_place", F.row_number().over(within)).join(before, [*keys, outer])
    return placed.withColumn(out, F.col("_before") + F.col("_place")).drop("_before", "_place")


def with_halo(rows: DataFrame, order: str, ahead: int, span: int = SPAN) -> DataFrame:
    """Copy the first ``ahead`` rows of each span into the one before it.

    A window partitioned by the group and ``_s`` then sees every follower it needs;
    rows with ``_halo`` are only there to be looked at.
    """
    here = _span(order, span)
    near_edge = F.pmod(F.col(order), F.lit(span)) < ahead
    homes = F.when(near_edge, F.array(here, here - 1)).otherwise(F.array(here))
    return rows.withColumn("_s", F.explode(homes)).withColumn("_halo", F.col("_s") != here)


def near_pairs(
    ranges: DataFrame, pieces: DataFrame, key: str, low: Column, high: Column, start: Column, end: Column, cell: int = SPAN
) -> DataFrame:
    """Pairs of one ``key`` where ``[low, high]`` and ``[start, end]`` overlap.

    Both sides are laid on cells of the axis and meet cell by cell, so a key with many
    ranges and many pieces never pairs them all. A pair is kept in the first cell both
    share, hence once.
    """
    def cells(a, b):
        return F.explode(F.sequence(F.floor(a / cell), F.floor(F.greatest(a, b) / cell)))

    left = ranges.withColumns({"_l": low, "_h": high}).withColumn("_cell", cells(F.col("_l"), F.col("_h")))
    right = pieces.withColumns({"_a": start, "_b": end}).withColumn("_cell", cells(F.col("_a"), F.col("_b")))
    met = left.join(right, [key, "_cell"]).filter((F.col("_a") <= F.col("_h")) & (F.col("_b") >= F.col("_l")))
    first = F.floor(F.greatest("_l", "_a") / cell)
    return met.filter(F.col("_cell") == first).drop("_l", "_h", "_a", "_b", "_cell")
