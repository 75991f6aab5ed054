"""Ranks over all tasks: rows are sorted in ranges, and only a row for each range and group is gathered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from rookery.plans.staging import staged

#: Rows up to which offsets are sent to every executor; beyond, rows are shuffled.
BROADCAST_ROWS = 100_000


def ranked(rows: DataFrame, group: list[str], order: list[str], name: str = "ranked", within: tuple[Callable, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``rank`` (from 0 in its group) and ``n`` (rows of the group), and the groups with their ``n``.

    Rows are range-sorted by group and order over all tasks, so a group of any
    size is spread; a row's rank is its place in its partition and the count of
    its group's rows in the partitions before.  Equal rows are split like others.
    The result is a staged table: a task that reads it meets ranks in ascending
    stretches.  ``within`` (a function on Arrow batches and what it returns) sees
    each partition in order before it is written.  Groups must not be null, and
    no column may be called ``rank``, ``n`` or end with an underscore.
    """
    kept = rows.columns
    by = [*group, *order, "tie_"]
    # rows should come from a table: the ranges' sample runs what made them
    laid = rows.withColumn("tie_", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by).select(*kept)
    if within:
        laid = laid.mapInArrow(*within)
    kept = laid.columns
    laid = staged(laid.withColumns({"part_": F.spark_partition_id(), "place_": F.monotonically_increasing_id()}), name)
    spans = staged(laid.groupBy("part_", *group).agg(F.count("*").alias("rows_"), F.min("place_").alias("first_")), f"{name}-spans")
    whole = Window.partitionBy(*(group or [F.lit(0)]))
    before = F.coalesce(F.sum("rows_").over(whole.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = spans.withColumns({"before_": before, "n": F.sum("rows_").over(whole)}).drop("rows_")
    out = laid.join(F.broadcast(offsets) if spans.count() <= BROADCAST_ROWS else offsets, ["part_", *group])
    groups = spans.groupBy(*group).agg(F.sum("rows_").alias("n"))
    return out.select(*kept, (F.col("before_") + F.col("place_") - F.col("first_")).alias("rank"), "n"), groups
