"""Append logs read at points in time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dovetail.sources import shared


def as_of(log: DataFrame, asks: DataFrame, by: str, at: str) -> DataFrame:
    """``asks`` with ``state``, the last row of ``log`` (a struct of its other columns) of the same ``by`` at or before ``at``; null before the first.

    Both have the columns ``by`` and ``at``. Rows stand in ranges of (by, at), so a subject may span tasks: a row takes the last state before it in
    its own task, or else that of the last task before with one. Of rows of the log at the same time, that with the largest columns counts. A null
    ``by`` has no state.
    """
    other = [c for c in log.columns if c not in (by, at)]
    state = F.struct(*other)
    rows = log.where(F.col(by).isNotNull()).select(by, at, F.lit(0).alias("asks"), state.alias("state"), F.lit(None).alias("ask"))
    both = rows.unionByName(asks.select(by, at, F.lit(1).alias("asks"), F.lit(None).cast(log.select(state.alias("s")).schema["s"].dataType).alias("state"), F.struct(*asks.columns).alias("ask")))
    order = [by, at, "asks", "state"]
    placed = both.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    placed = shared.stash(placed.withColumn("task", F.shiftrightunsigned("place", 33)), "as-of")
    last = placed.where("state is not null").groupBy(by, "task").agg(F.max_by("state", "place").alias("state"))
    tasks = placed.select(by, "task").distinct().join(last, [by, "task"], "left")
    before = Window.partitionBy(by).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    carried = tasks.select(by, "task", F.last("state", ignorenulls=True).over(before).alias("carried"))
    inside = Window.partitionBy(by, "task").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = placed.withColumn("near", F.last("state", ignorenulls=True).over(inside)).where("asks = 1").join(carried, [by, "task"], "left")
    return filled.select("ask.*", F.coalesce("near", "carried").alias("state"))


def first_of(log: DataFrame, by: str, at: str) -> DataFrame:
    """The first row of each ``by``."""
    columns = [c for c in log.columns if c != by]
    return log.groupBy(by).agg(F.min_by(F.struct(*columns), F.col(at)).alias("row")).select(by, "row.*")
