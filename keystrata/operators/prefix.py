"""Running sums and last values along an order, without one task reading a whole hot group.

Groups of at most ROWS rows are a window each. The rows of a larger group are cut into slots of about ROWS rows, by quantiles
of their order; each slot is a window, a slot's outcome is one row, and those few rows are run through to give every slot what came before it. The
rows are shuffled once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a group that one task sorts.
ROWS = 2_000_000
SLOTS = 4_096


def _slotted(df: DataFrame, by: Sequence[str], order: str, most: int | None) -> tuple[DataFrame, bool]:
    """`df` with _k (the group, nulls being a group) and _slot, and whether any group has more than one slot.

    `order` is a number; it is unique within a group. Groups above `most` rows are at most rows / `most`, so they are broadcast.
    """
    most = most or ROWS
    k = F.struct(*by) if by else F.struct(F.lit(1).alias("all"))
    rows = df.withColumn("_k", k)
    sizes = rows.select("_k", F.col(order).alias("_o")).groupBy("_k").agg(F.count("*").alias("_n")).where(F.col("_n") > most)
    hot = [r["_n"] for r in sizes.select("_n").limit(100_001).collect()]
    if not hot:
        return rows.withColumn("_slot", F.lit(0)), False
    if len(hot) > 100_000:  # so many large groups keep every task busy as they are
        return rows.withColumn("_slot", F.lit(0)), False
    cuts = min(SLOTS, -(-max(hot) // most))
    large = rows.join(F.broadcast(sizes.select("_k")), "_k", "left_semi")
    edges = large.groupBy("_k").agg(F.percentile_approx(F.col(order), [i / cuts for i in range(1, cuts)], 10 * cuts).alias("_edges"))
    slot = F.when(F.col("_edges").isNull(), 0).otherwise(F.size(F.filter("_edges", lambda e: e < F.col(order))))
    return rows.join(F.broadcast(edges), "_k", "left").withColumn("_slot", slot).drop("_edges"), True


def _before(sums: DataFrame) -> Window:
    return Window.partitionBy("_k").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)


def running_sum(df: DataFrame, by: Sequence[str], order: str, value: Column, name: str, *, before: bool = False, most: int | None = None) -> DataFrame:
    """`df` with `name`: the sum of `value` (nulls count as 0) over the group's rows up to this one, or before it."""
    rows, cut = _slotted(df, by, order, most)
    rows = rows.withColumn("_v", F.coalesce(value, F.lit(0)))
    own = Window.partitionBy("_k", "_slot").orderBy(order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    total = F.coalesce(F.sum("_v").over(own), F.lit(0))
    if not cut:
        return rows.withColumn(name, total).drop("_k", "_slot", "_v")
    sums = rows.groupBy("_k", "_slot").agg(F.sum("_v").alias("_s"))
    sums = sums.select("_k", "_slot", F.coalesce(F.sum("_s").over(_before(sums)), F.lit(0)).alias("_s"))
    return rows.withColumn("_t", total).join(sums, ["_k", "_slot"]).withColumn(name, F.col("_s") + F.col("_t")).drop("_k", "_slot", "_v", "_s", "_t")


def running_since(df: DataFrame, by: Sequence[str], order: str, resets: Column, value: Column, name: str, epoch: str, *, most: int | None = None) -> DataFrame:
    """`df` with `epoch`, the resets of the group up to and with this row, and `name`, the sum of `value` (nulls count as 0) over the rows
    since the last reset, which is one of them.
    """
    rows, cut = _slotted(df, by, order, most)
    rows = rows.withColumn("_v", F.coalesce(value, F.lit(0))).withColumn("_r", F.when(resets, F.lit(1)).otherwise(F.lit(0)).cast("long"))
    own = Window.partitionBy("_k", "_slot").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_e", F.sum("_r").over(own))
    rows = rows.withColumn("_t", F.sum("_v").over(Window.partitionBy("_k", "_slot", "_e").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    if not cut:
        return rows.withColumn(epoch, F.col("_e")).withColumn(name, F.col("_t")).drop("_k", "_slot", "_v", "_r", "_e", "_t")
    ends = rows.groupBy("_k", "_slot").agg(F.max_by("_t", order).alias("_end"), F.sum("_r").alias("_n"))
    # slots since the last one with a reset go into what a slot begins with
    ends = ends.withColumn("_runs", F.sum((F.col("_n") > 0).cast("long")).over(Window.partitionBy("_k").orderBy("_slot")))
    up_to = Window.partitionBy("_k", "_runs").orderBy("_slot").rowsBetween(Window.unboundedPreceding, 0)
    ends = ends.withColumn("_upto", F.sum("_end").over(up_to))
    slots = Window.partitionBy("_k").orderBy("_slot")
    ends = ends.select("_k", "_slot", F.coalesce(F.lag("_upto").over(slots), F.lit(0)).alias("_carry"), F.coalesce(F.sum("_n").over(_before(ends)), F.lit(0)).alias("_earlier"))
    out = rows.join(ends, ["_k", "_slot"]).withColumn(epoch, F.col("_e") + F.col("_earlier"))
    out = out.withColumn(name, F.when(F.col("_e") == 0, F.col("_carry") + F.col("_t")).otherwise(F.col("_t")))
    return out.drop("_k", "_slot", "_v", "_r", "_e", "_t", "_carry", "_earlier")


def last_value(df: DataFrame, by: Sequence[str], order: str, value: Column, when: Column, name: str, *, before: bool = True, most: int | None = None) -> DataFrame:
    """`df` with `name`: `value` (which may be null) in the group's last row where `when` holds, before this one or up to it."""
    rows, cut = _slotted(df, by, order, most)
    rows = rows.withColumn("_v", F.when(when, F.struct(F.col(order).alias("o"), value.alias("v"))))
    own = Window.partitionBy("_k", "_slot").orderBy(order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    last = F.last("_v", ignorenulls=True).over(own)
    if not cut:
        return rows.withColumn("_t", last).withColumn(name, F.col("_t")["v"]).drop("_k", "_slot", "_v", "_t")
    lasts = rows.groupBy("_k", "_slot").agg(F.max_by("_v", F.col("_v.o")).alias("_l"))
    lasts = lasts.select("_k", "_slot", F.last("_l", ignorenulls=True).over(_before(lasts)).alias("_l"))
    joined = rows.withColumn("_t", last).join(lasts, ["_k", "_slot"])
    return joined.withColumn(name, F.coalesce("_t", "_l")["v"]).drop("_k", "_slot", "_v", "_l", "_t")
