"""Row lists that a reviewer reads: what stands on a sheet about a node.

A filter narrows what is drawn, never these lists: they are made from all edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from rookery.operators import calls as call_ops
from rookery.operators.graph import closure


def crate_focus(links: DataFrame, names: DataFrame, chosen: str, rows: int = 14) -> DataFrame:
    """(side, name, kind, event, place, total): used by and depends on, for all versions of a name; removed links are listed too."""
    n = lambda c: names.select(F.col("node").alias(c), F.col("name").alias(f"{c}_name"))
    l = links.join(n("src"), "src").join(n("dst"), "dst")
    used = l.where(F.col("dst_name") == chosen).select(F.lit("used by").alias("side"), F.col("src_name").alias("name"), "kind", "event")
    uses = l.where(F.col("src_name") == chosen).select(F.lit("depends on").alias("side"), F.col("dst_name").alias("name"), "kind", "event")
    order = Window.partitionBy("side").orderBy("kind", "name", "event")

    def first(side: DataFrame) -> DataFrame:
        """A side's first rows, with how many there are; each task keeps no more than ``rows``."""
        every = side.distinct()
        total = every.agg(F.count("*").alias("total"))
        return every.orderBy("kind", "name", "event").limit(rows).withColumn("place", F.row_number().over(order)).join(F.broadcast(total), F.lit(True))

    return first(used).unionByName(first(uses))


def band(tiers: DataFrame, weights: DataFrame, depth: int, rows: int = 14) -> DataFrame:
    """The first ``rows`` functions at a depth, heaviest first."""
    return tiers.where(F.col("depth") == depth).join(weights, "node", "left").na.fill(0, ["w"]).orderBy(F.desc("w"), "node").limit(rows)


def function_sheet(calls: DataFrame, node: int) -> DataFrame:
    """(list, other, n): who calls it and whom it calls, heaviest first, and who else reaches it."""
    by = calls.where((F.col("dst") == node) & (F.col("src") != node)).groupBy(F.col("src").alias("other")).agg(F.sum("w").cast("long").alias("n"))
    to = calls.where((F.col("src") == node) & (F.col("dst") != node)).groupBy(F.col("dst").alias("other")).agg(F.sum("w").cast("long").alias("n"))
    start = calls.sparkSession.range(node, node + 1).select(F.col("id").alias("node"))
    beyond = call_ops.upstream(calls, start).where("hops > 1").select(F.lit("upstream").alias("list"), F.col("node").alias("other"), F.col("hops").cast("long").alias("n"))
    return by.select(F.lit("called by").alias("list"), "other", "n").unionByName(to.select(F.lit("calls").alias("list"), "other", "n")).unionByName(beyond)


def owner_sheet(calls: DataFrame, parents: DataFrame) -> DataFrame:
    """(container, methods, calls_in, calls_out) over a container's edge."""
    cross = call_ops.container_crossings(calls, parents).groupBy("container").agg(F.sum("calls_in").alias("calls_in"), F.sum("calls_out").alias("calls_out"))
    own = parents.where("parent is not null").groupBy(F.col("parent").alias("container")).agg(F.count("*").alias("methods"))
    return own.join(cross, "container", "left").na.fill(0, ["calls_in", "calls_out"])


def data_sheet(holds: DataFrame, ties: DataFrame, node: int) -> DataFrame:
    """(side, other, words): everything that uses a type and that it uses, one row an end, its words in the order holds, names."""
    held_by = holds.where((F.col("dst") == node) & (F.col("src") != node)).select(F.lit("used by").alias("side"), F.col("src").alias("other"), F.lit(0).alias("ord"), F.col("kind").alias("word"))
    holding = holds.where((F.col("src") == node) & (F.col("dst") != node)).select(F.lit("uses").alias("side"), F.col("dst").alias("other"), F.lit(0).alias("ord"), F.col("kind").alias("word"))
    named = ties.where(F.col("definition") == node).select(F.lit("used by").alias("side"), F.col("holder").alias("other"), F.lit(1).alias("ord"), F.lit("names").alias("word"))
    naming = ties.where(F.col("holder") == node).select(F.lit("uses").alias("side"), F.col("definition").alias("other"), F.lit(1).alias("ord"), F.lit("names").alias("word"))
    every = held_by.unionByName(holding).unionByName(named).unionByName(naming)
    words = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("ord", "word"))), lambda x: x["word"]))
    return every.groupBy("side", "other").agg(F.array_join(words, " · ").alias("words"))


def data_reach(holds: DataFrame, node: int) -> DataFrame:
    """One row: direct holders, and holders beyond them."""
    start = holds.sparkSession.range(node, node + 1).select(F.col("id").alias("node"))
    up = closure(holds.select(F.col("dst").alias("src"), F.col("src").alias("dst")), start, inclusive=False)
    return up.agg(F.count_if(F.col("hops") == 1).alias("direct"), F.count_if(F.col("hops") > 1).alias("beyond"))


def seen_of(visits: DataFrame, affected: DataFrame) -> DataFrame:
    """One row: how many of the affected nodes were visited."""
    v = visits.select(F.col(visits.columns[0]).alias("node")).distinct()
    return affected.join(v.withColumn("was", F.lit(True)), "node", "left").agg(F.count_if("was").alias("seen"), F.count("*").alias("total"))
