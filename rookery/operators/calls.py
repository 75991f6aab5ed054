"""The function altitude: call tiers, reach, contracts, corridors and containers.

Calls are (src, dst, w): ``src`` calls ``dst`` w times.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from rookery.operators.graph import closure, descendants, discovery_tree


def band_sheet(tiers: DataFrame) -> DataFrame:
    """Per depth: how many stand there, and its caption."""
    caption = F.when(F.min("tier") == "ring", "in a call ring").when(F.col("depth") == 0, "called by nothing").otherwise(F.concat(F.col("depth").cast("string"), F.when(F.col("depth") == 1, " call").otherwise(" calls"), F.lit(" deep")))
    return tiers.groupBy("depth").agg(F.count("*").alias("n"), caption.alias("caption"))


def upstream(calls: DataFrame, start: DataFrame) -> DataFrame:
    """(node, hops): who calls the start, directly or not, without the start; ``hops`` 1 is direct."""
    return closure(calls.select(F.col("dst").alias("src"), F.col("src").alias("dst")), start, inclusive=False)


def way_in_reach(calls: DataFrame, drawn: DataFrame) -> DataFrame:
    """(node, runs): how many drawn nodes are first reached through each."""
    return descendants(discovery_tree(calls, drawn))


def corridors(calls: DataFrame, homes: DataFrame) -> DataFrame:
    """Calls between modules: (src_module, dst_module, calls), each call at least once, none inside a module."""
    home = homes.select("node", "module")
    e = calls.join(home.select(F.col("node").alias("src"), F.col("module").alias("src_module")), "src").join(home.select(F.col("node").alias("dst"), F.col("module").alias("dst_module")), "dst")
    return e.where("src_module <> dst_module").groupBy("src_module", "dst_module").agg(F.sum(F.greatest("w", F.lit(1))).cast("long").alias("calls"))


def boundary_bundles(edges: DataFrame, inside: DataFrame, homes: DataFrame) -> DataFrame:
    """Edges with exactly one end inside a box, by the far end's module and direction.

    ``solid`` edges are counted (n), others summed by weight; (far, inbound, solid, n).
    Edges whose far end has no home are no part of a bundle; see ``single_edges``.
    """
    box = inside.select(F.col(inside.columns[0]).alias("node")).distinct()
    mark = lambda c: box.select(F.col("node").alias(c), F.lit(True).alias(f"{c}_in"))
    e = edges.join(mark("src"), "src", "left").join(mark("dst"), "dst", "left")
    cross = e.where(F.col("src_in").isNull() != F.col("dst_in").isNull())
    far = F.when(F.col("src_in").isNull(), F.col("src")).otherwise(F.col("dst"))
    cross = cross.select(far.alias("node"), F.col("src_in").isNull().alias("inbound"), "solid", "w").join(homes.where("module is not null").select("node", F.col("module").alias("far")), "node")
    return cross.groupBy("far", "inbound", "solid").agg(F.when(F.col("solid"), F.count("*")).otherwise(F.sum("w")).cast("long").alias("n"))


def single_edges(edges: DataFrame, inside: DataFrame, homes: DataFrame) -> DataFrame:
    """Edges (src, dst, solid, w) that no bundle takes in: both ends on one side of the box, or a far end without a home."""
    box = inside.select(F.col(inside.columns[0]).alias("node")).distinct()
    mark = lambda c: box.select(F.col("node").alias(c), F.lit(True).alias(f"{c}_in"))
    e = edges.join(mark("src"), "src", "left").join(mark("dst"), "dst", "left")
    far = F.when(F.col("src_in").isNull(), F.col("src")).otherwise(F.col("dst"))
    e = e.withColumn("crosses", F.col("src_in").isNull() != F.col("dst_in").isNull()).withColumn("node", far)
    home = homes.where("module is not null").select("node", F.lit(True).alias("homed")).distinct()
    e = e.join(home, "node", "left")
    return e.where(~F.col("crosses") | F.col("homed").isNull()).select("src", "dst", "solid", "w")


def frame_rollup(homes: DataFrame) -> DataFrame:
    """Marks held by every frame at any depth; a path's frames are all its prefixes (``path`` is an array)."""
    frames = F.transform(F.sequence(F.lit(0), F.size("path")), lambda k: F.array_join(F.slice("path", 1, k), "/"))
    return homes.select(F.explode(frames).alias("frame")).groupBy("frame").agg(F.count("*").alias("held"))


def fold_gather(calls: DataFrame, shown: DataFrame) -> DataFrame:
    """Edges between what stands for their ends: (src, dst, w, n), none with both ends in one.

    ``shown`` is (node, box): the outermost folded box of a node; others stand for themselves.
    """
    at = lambda c: shown.select(F.col("node").alias(c), F.col("box").alias(f"{c}_box"))
    e = calls.join(at("src"), "src", "left").join(at("dst"), "dst", "left")
    e = e.select(F.coalesce("src_box", F.col("src").cast("string")).alias("src"), F.coalesce("dst_box", F.col("dst").cast("string")).alias("dst"), "w")
    return e.where("src <> dst").groupBy("src", "dst").agg(F.sum("w").cast("long").alias("w"), F.count("*").alias("n"))


def container_crossings(calls: DataFrame, parents: DataFrame) -> DataFrame:
    """Per container and far end: calls in and out across the container's edge."""
    p = parents.select("node", "parent")
    e = calls.join(p.select(F.col("node").alias("src"), F.col("parent").alias("src_in")), "src", "left").join(p.select(F.col("node").alias("dst"), F.col("parent").alias("dst_in")), "dst", "left")
    e = e.where(~F.col("src_in").eqNullSafe(F.col("dst_in")))
    inward = e.where("dst_in is not null").select(F.col("dst_in").alias("container"), F.col("src").alias("far"), F.col("w").alias("calls_in"), F.lit(0).alias("calls_out"))
    outward = e.where("src_in is not null").select(F.col("src_in").alias("container"), F.col("dst").alias("far"), F.lit(0).alias("calls_in"), F.col("w").alias("calls_out"))
    return inward.unionByName(outward).groupBy("container", "far").agg(F.sum("calls_in").cast("long").alias("calls_in"), F.sum("calls_out").cast("long").alias("calls_out"))


def touches(signatures: DataFrame, bodies: DataFrame) -> DataFrame:
    """(node, type, how, n, place): types that a function names, signatures first, then by count, type."""
    s = signatures.select("node", "type", F.lit("signature").alias("how"), F.lit(1).cast("long").alias("n")).distinct()
    b = bodies.groupBy("node", "type").agg(F.sum("w").cast("long").alias("n")).join(s.select("node", "type"), ["node", "type"], "left_anti").select("node", "type", F.lit("body").alias("how"), "n")
    order = Window.partitionBy("node").orderBy(F.desc("how"), F.desc("n"), "type")
    return s.unionByName(b).withColumn("place", F.row_number().over(order))
