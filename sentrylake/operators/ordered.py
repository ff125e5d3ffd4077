"""Order-dependent building blocks whose work is split by time or value, never by key alone.

A window function partitioned by a user or an address sends everything that key did to one
task. Here each key is first cut into pieces that can be summarised before the shuffle; the
only per-key ordering left is over the summaries, whose number is bounded by the calendar.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.timefn import minutes, time_slot


def gap_groups(
    df: DataFrame,
    keys: Sequence[str],
    start: str,
    end: str,
    gap_minutes: int,
    aggs: Sequence[Column] = (),
) -> DataFrame:
    """Join-free interval grouping: a row belongs to the running group of its key when it
    starts no later than gap_minutes after the latest end seen so far.

    Rows whose starts share a slot of gap_minutes always belong together, so each slot is
    aggregated first (map-side) and only slots are put in order. Returns one row per
    (keys, slot) with group_start, slot_start, slot_end, slot_rows and the extra aggregates.
    """
    slots = (
        df.groupBy(*keys, time_slot(F.col(start), gap_minutes * 60).alias("slot"))
        .agg(
            F.min(start).alias("slot_start"),
            F.max(end).alias("slot_end"),
            F.count(F.lit(1)).alias("slot_rows"),
            *aggs,
        )
    )
    by_key = Window.partitionBy(*keys).orderBy("slot")
    before = by_key.rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max("slot_end").over(before)
    opens = reach.isNull() | (F.col("slot_start") > reach + minutes(gap_minutes))
    return (
        slots.withColumn("opened", F.when(opens, F.col("slot_start")))
        .withColumn(
            "group_start",
            F.max("opened").over(by_key.rowsBetween(Window.unboundedPreceding, 0)),
        )
        .drop("opened")
    )


def with_group_start(
    df: DataFrame, groups: DataFrame, keys: Sequence[str], start: str, gap_minutes: int
) -> DataFrame:
    """Attach group_start to the rows: an equi-join on (keys, slot), so a busy key spreads
    over its slots. Rows that already carry a slot column keep it as it is."""
    left = (
        df
        if "slot" in df.columns
        else df.withColumn("slot", time_slot(F.col(start), gap_minutes * 60))
    )
    right = groups.select(
        *[F.col(k).alias(f"_g_{k}") for k in keys], F.col("slot").alias("_g_slot"), "group_start"
    )
    cond = reduce(
        lambda a, b: a & b,
        [F.col(k).eqNullSafe(F.col(f"_g_{k}")) for k in keys],
        F.col("slot") == F.col("_g_slot"),
    )
    return left.join(right, cond).drop("slot", "_g_slot", *[f"_g_{k}" for k in keys])


def previous_row(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    order: Sequence[str],
    values: Sequence[str],
    slot_seconds: int,
) -> DataFrame:
    """Add prev_<value> columns: the values of the preceding row of the same key.

    Rows are ordered inside (keys, slot); the last row of the preceding slot that has any is
    carried into each slot, inside blocks of a day, and from each day into the next. order must
    start with ts and be unique within a key. With one row per key and instant, a slot of n
    seconds holds at most n million rows, a day 86,400 / n slots and a key as many blocks as days
    passed: no task orders more than that, whatever the key.
    """
    cols = list(dict.fromkeys([*order, *values]))
    slotted = df.withColumn("slot", time_slot(F.col(ts), slot_seconds))
    last = slotted.groupBy(*keys, "slot").agg(
        F.max_by(F.struct(*cols), F.struct(*order)).alias("last_row")
    )
    last = last.withColumn("block", F.floor(F.col("slot") / F.lit(max(1, 86_400 // slot_seconds))))
    in_block = Window.partitionBy(*keys, "block").orderBy("slot")
    within = last.withColumn("last_row", F.lag("last_row").over(in_block)).drop("block")
    # What a day's first slot gets comes from the last day that has any.
    by_key = Window.partitionBy(*keys).orderBy("block")
    across = (
        last.groupBy(*keys, "block")
        .agg(F.min("slot").alias("slot"), F.max_by("last_row", "slot").alias("last_row"))
        .withColumn("last_row", F.lag("last_row").over(by_key))
        .drop("block")
    )
    carried = (
        within.unionByName(across)
        .filter(F.col("last_row").isNotNull())
        .select(*keys, "slot", "last_row.*", F.lit(True).alias("is_carry"))
    )
    rows = slotted.withColumn("is_carry", F.lit(False))
    both = rows.unionByName(
        carried.select(*dict.fromkeys([*keys, "slot", *cols, "is_carry"])),
        allowMissingColumns=True,
    )
    in_slot = Window.partitionBy(*keys, "slot").orderBy(F.desc("is_carry"), *order)
    for v in values:
        both = both.withColumn(f"prev_{v}", F.lag(v).over(in_slot))
    return both.filter(~F.col("is_carry")).drop("is_carry", "slot")


def running_totals(
    df: DataFrame,
    value: str,
    sums: Sequence[str],
    descending: bool = False,
    chunks: int = 128,
    keep_chunk: bool = False,
) -> DataFrame:
    """Running sums over all distinct values in order, without a single-task window.

    df has one row per value. Values are cut into chunks at approximate percentiles; the
    chunk totals (at most chunks + 1 rows) give the offset each chunk starts from. Adds
    run_<s> (the row included) for each s in sums.
    """
    cuts = df.agg(
        F.percentile_approx(value, [i / chunks for i in range(1, chunks)], 10000).alias("cuts")
    )
    cut = df.crossJoin(F.broadcast(cuts)).withColumn(
        "chunk", F.size(F.filter("cuts", lambda c: c < F.col(value)))
    ).drop("cuts")
    order = F.desc if descending else F.asc
    offsets = cut.groupBy("chunk").agg(*[F.sum(s).alias(f"off_{s}") for s in sums])
    before = Window.orderBy(order("chunk")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.select(
        "chunk",
        *[F.coalesce(F.sum(f"off_{s}").over(before), F.lit(0)).alias(f"off_{s}") for s in sums],
    )
    within = (
        Window.partitionBy("chunk")
        .orderBy(order(value))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    out = cut.join(F.broadcast(offsets), "chunk")
    for s in sums:
        out = out.withColumn(f"run_{s}", F.col(f"off_{s}") + F.sum(s).over(within))
    return out.drop(*[f"off_{s}" for s in sums], *([] if keep_chunk else ["chunk"]))
