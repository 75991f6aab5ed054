"""Module frames, folds and boxes: everything that nests by a path of names.

Paths are arrays of names.  A frame is any prefix of a mark's path, so trees are
made by taking prefixes apart, without recursion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ancestors(path: Column) -> Column:
    """All prefixes of a path as joined keys, the empty one (the crate) first."""
    return F.transform(F.sequence(F.lit(0), F.size(path)), lambda k: F.array_join(F.slice(path, 1, k), "/"))


def frame_tree(homes: DataFrame) -> DataFrame:
    """(krate, frame, parent, depth, own, held): every frame with marks somewhere in it."""
    own = homes.groupBy("krate", F.array_join("path", "/").alias("frame")).agg(F.count("*").alias("own"))
    deep = homes.select("krate", F.posexplode(ancestors(F.col("path"))).alias("depth", "frame")).groupBy("krate", "frame", "depth").agg(F.count("*").alias("held"))
    parent = F.when(F.col("depth") > 0, F.regexp_extract("frame", r"^(?:(.*)/)?[^/]*$", 1))
    return deep.join(own, ["krate", "frame"], "left").select("krate", "frame", parent.alias("parent"), "depth", F.coalesce("own", F.lit(0)).alias("own"), "held")


def fold_box(homes: DataFrame, folds: DataFrame) -> DataFrame:
    """(node, box): the outermost folded frame around each node, null outside of folds."""
    key = homes.select("node", "krate", F.posexplode(ancestors(F.col("path"))).alias("depth", "frame"))
    hit = key.join(folds.select("krate", "frame").distinct(), ["krate", "frame"])
    best = hit.groupBy("node").agg(F.min_by("frame", "depth").alias("box"))
    return homes.select("node").join(best, "node", "left")


def reveal_path(homes: DataFrame, folds: DataFrame) -> DataFrame:
    """(node, frames): the folded frames around each node, outermost first."""
    key = homes.select("node", "krate", F.posexplode(ancestors(F.col("path"))).alias("depth", "frame"))
    hit = key.join(folds.select("krate", "frame").distinct(), ["krate", "frame"])
    listed = F.transform(F.array_sort(F.collect_list(F.struct("depth", "frame"))), lambda x: x["frame"])
    return homes.select("node").join(hit.groupBy("node").agg(listed.alias("frames")), "node", "left")


def packed(homes: DataFrame, folds: DataFrame) -> DataFrame:
    """(box, n): what each outermost fold hides."""
    return fold_box(homes, folds).where("box is not null").groupBy("box").agg(F.count("*").alias("n"))


def inside_frame(homes: DataFrame, frame: list[str]) -> DataFrame:
    """Nodes in a frame or below it."""
    n = len(frame)
    return homes.where(F.slice("path", 1, n) == F.array(*[F.lit(x) for x in frame]) if n else F.lit(True)).select("node")


def containers(methods: DataFrame, types: DataFrame) -> DataFrame:
    """(owner, path, methods): one box for each type that declares a method, in the frame of the type's file; methods by path and line.

    ``methods`` has node, owner, file and line; ``types`` node and path.
    """
    home = types.select(F.col("node").alias("owner"), "path")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("file", "line", "node"))), lambda m: m["node"])
    return methods.join(home, "owner").groupBy("owner", "path").agg(listed.alias("methods"))


def homes(marks: DataFrame, boxes: DataFrame) -> DataFrame:
    """Each mark with its box: its owner's container, else its frame."""
    owner = boxes.select("owner", F.lit(True).alias("boxed")).distinct()
    m = marks.join(owner, "owner", "left")
    return m.select("node", F.when(F.col("boxed"), F.concat(F.lit("owner "), F.col("owner").cast("string"))).otherwise(F.concat(F.lit("frame "), F.array_join("path", "/"))).alias("home"))


def lit(start: DataFrame, holds: DataFrame, ties: DataFrame, direction: str) -> DataFrame:
    """(node, light): a selected mark, what holds it (up, any distance), what it holds (down), and its ties in the read direction (near)."""
    from rookery.operators.ownership import hold_upstream

    sel = start.select(F.col(start.columns[0]).alias("node")).distinct()
    up = hold_upstream(holds, sel).select("node", F.lit("up").alias("light"), F.lit(1).alias("rank"))
    down = holds.join(sel.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node"), F.lit("down").alias("light"), F.lit(2).alias("rank"))
    uses = ties.join(sel.select(F.col("node").alias("holder")), "holder").select(F.col("definition").alias("node"))
    used = ties.join(sel.select(F.col("node").alias("definition")), "definition").select(F.col("holder").alias("node"))
    near = {"out": uses, "in": used, "both": uses.unionByName(used)}[direction].select("node", F.lit("near").alias("light"), F.lit(3).alias("rank"))
    every = sel.select("node", F.lit("sel").alias("light"), F.lit(0).alias("rank")).unionByName(up).unionByName(down).unionByName(near)
    return every.groupBy("node").agg(F.min_by("light", "rank").alias("light"))


def ghost_seats(drops: DataFrame) -> DataFrame:
    """(ghost, dropper, seat, turn): a ghost hangs off the first that dropped it, seats of one dropper alternate by 0.22 radians."""
    from pyspark.sql import Window

    first = drops.groupBy("ghost").agg(F.min("dropper").alias("dropper"))
    seat = F.row_number().over(Window.partitionBy("dropper").orderBy("ghost")) - 1
    s = first.withColumn("seat", seat)
    return s.withColumn("turn", F.when(F.col("seat") % 2 == 0, 1).otherwise(-1) * 0.22 * F.floor(F.col("seat") / 2 + 1))
