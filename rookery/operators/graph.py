"""Fixpoints on graphs that live in tables: breadth-first distances, closures, trees.

Edges lie in buckets by their source and found nodes in as many by node, so a round
shuffles only the ends of the newest nodes' edges: all rounds together shuffle an edge
once.  What is new is added to the table of found nodes in the shared folder, and
the plan doesn't grow.  Rounds end when nothing is new; nothing is cut off.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from rookery.plans.staging import bucketed, buckets_for, discard, loose, staged

#: Rounds after which the files of a bucket, one for each round, are put together.
FOLD = 48


def _edges(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").where("src is not null and dst is not null and src <> dst")


def by_source(edges: DataFrame) -> DataFrame:
    """Distinct edges in buckets by ``src``."""
    rows = staged(_edges(edges), "edges")
    n = buckets_for(rows)
    out = bucketed(rows.repartition(n, "src").distinct(), "src", n, "edges")
    discard(rows)
    return out


def in_buckets(nodes: DataFrame, n: int, name: str, key: str = "node") -> DataFrame:
    return bucketed(nodes.repartition(n, key), key, n, name)


def leads_to(frontier: DataFrame, e: DataFrame) -> DataFrame:
    """Edges ``e`` from the nodes of ``frontier``, with its other columns; both have equal buckets, and only the frontier is held in memory."""
    return e.join(frontier.withColumnRenamed("node", "src").hint("shuffle_hash"), "src")


def unknown(met: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of ``met`` whose node is not in ``known``; ``known`` is streamed past them."""
    had = known.select("node", F.lit(True).alias("had"))
    return met.hint("shuffle_hash").join(had, "node", "left").where("had is null").drop("had")


def distances(edges: DataFrame, seeds: DataFrame, start: int = 0) -> DataFrame:
    """(node, hops): the fewest steps along ``src -> dst`` from any seed; seeds have ``start``.

    Null nodes, self edges and repeated edges don't matter; cycles end by
    themselves.  Nodes that no seed reaches are not in the result.
    """
    e = by_source(edges)
    first = seeds.select(F.col(seeds.columns[0]).cast(e.schema["dst"].dataType).alias("node")).where("node is not null").distinct()
    known = spread(e, in_buckets(first.withColumn("hops", F.lit(start)), e.buckets, "hops"), start)
    discard(e)
    return loose(known)


def spread(e: DataFrame, known: DataFrame, start: int) -> DataFrame:
    """Breadth first from the nodes of ``known`` that have ``start`` hops, to nodes not in ``known``, which they are added to."""
    hops = start
    while True:
        frontier = known.where(F.col("hops") == hops).select("node")
        hops += 1
        met = leads_to(frontier, e).select(F.col("dst").alias("node")).repartition(e.buckets, "node").distinct()
        known = bucketed(unknown(met, known).withColumn("hops", F.lit(hops)), "node", e.buckets, "hops", onto=known)
        if not known.added:
            return known
        known = folded(known, hops - start, "hops")


def folded(known: DataFrame, rounds: int, name: str) -> DataFrame:
    if rounds % FOLD:
        return known
    before, known = known, bucketed(known, "node", known.buckets, name)
    discard(before)
    return known


def tiers(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, tier, depth) over all nodes: entry (nothing else leads to it), deep (steps from an entry), ring (no entry leads to it).

    A ring's depth is one below the deepest.  Self edges don't make a node less of an entry.
    """
    e = _edges(edges)
    node = nodes.select(F.col(nodes.columns[0]).alias("node")).where("node is not null").distinct()
    entries = node.join(e.select(F.col("dst").alias("node")).distinct(), "node", "left_anti")
    depth = distances(e, entries)
    deepest = depth.agg(F.coalesce(F.max("hops"), F.lit(0)) + 1).head()[0]
    out = node.join(depth, "node", "left")
    tier = F.when(F.col("hops").isNull(), "ring").when(F.col("hops") == 0, "entry").otherwise("deep")
    return out.select("node", tier.alias("tier"), F.coalesce("hops", F.lit(deepest)).alias("depth"))


def rings(edges: DataFrame, nodes: DataFrame, members: DataFrame, root: DataFrame, cap: int = 4) -> DataFrame:
    """(node, hops, ring): distance from the root, outer ones collapsed into ring ``cap``.

    Members that the root doesn't reach stand beside it, at 1; what they don't
    reach either stands outside all others.  A later seat never lowers a distance.
    """
    e = by_source(edges)
    node = staged(nodes.select(F.col(nodes.columns[0]).alias("node")).distinct(), "nodes")
    known = spread(e, in_buckets(root.select(F.col(root.columns[0]).alias("node")).distinct().withColumn("hops", F.lit(0)), e.buckets, "hops"), 0)
    member = members.select(F.col(members.columns[0]).alias("node")).distinct()
    for seats, fixed in ((member, True), (node, False)):
        at = 1 if fixed else known.agg(F.coalesce(F.max("hops"), F.lit(0)) + 1).head()[0]
        seated = staged(seats.join(node, "node", "left_semi").join(known, "node", "left_anti").withColumn("hops", F.lit(at)), "hops")
        if not seated.isEmpty():
            # what is known keeps its place, so only the seats are walked from
            settled = known.select("node", F.lit(-1).alias("hops")).unionByName(seated)
            found = spread(e, in_buckets(settled, e.buckets, "hops"), at)
            before, known = known, in_buckets(known.unionByName(found.where("hops >= 0")), e.buckets, "hops")
            discard(before, found)
        discard(seated)
    discard(e)
    return loose(known).withColumn("ring", F.least("hops", F.lit(cap)))


def _in_order(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with ``rank``, a number that ascends with ``order``: a range of rows for each task, so no task orders them all."""
    return df.repartitionByRange(*order).sortWithinPartitions(*order).drop("first").withColumn("rank", F.monotonically_increasing_id())


def queue_walk(e: DataFrame, known: DataFrame | None, seats: DataFrame, at: int, nth: str = "dst") -> DataFrame:
    """(node, hops, parent, rank, part) of ``known``, of ``seats`` and of all that a queue discovers from them, in buckets by node.

    The seats stand in the queue by id, at ``at`` hops, but for nodes of ``known``; a node's targets follow
    it by ``nth``, a column of the edges.  So within a level nodes are in the order of who discovered
    them, then of ``nth``, and of several discoverers the first in that order is the parent.  A level has
    ranks of its own, which are all that the next one needs; ``part`` tells the walks apart.
    """
    n, node = e.buckets, e.schema["src"].dataType
    start = seats.select(F.col(seats.columns[0]).cast(node).alias("node")).where("node is not null").distinct()
    if known is not None:
        start = start.join(known.select("node"), "node", "left_anti")
    part = 0 if known is None else 1 + known.agg(F.coalesce(F.max("part"), F.lit(-1))).head()[0]
    level = lambda df, *order: _in_order(df.withColumn("part", F.lit(part)), *order).select("node", "hops", "parent", "rank", "part").repartition(n, "node")
    known = bucketed(level(start.select("node", F.lit(at).alias("hops"), F.lit(None).cast(node).alias("parent")), "node"), "node", n, "walk", onto=known)
    rounds = 0
    while True:
        frontier = known.where((F.col("part") == part) & (F.col("hops") == at)).select("node", "rank")
        at, rounds = at + 1, rounds + 1
        # the first in the walk's order discovers a node
        met = leads_to(frontier, e).select(F.col("dst").alias("node"), F.struct("rank", F.col(nth).alias("nth"), "src").alias("by")).repartition(n, "node")
        new = unknown(met.groupBy("node").agg(F.min("by").alias("by")), known)
        new = new.select("node", F.lit(at).alias("hops"), F.col("by.src").alias("parent"), F.struct("by.rank", "by.nth").alias("first"))
        known = bucketed(level(new, "first"), "node", n, "walk", onto=known)
        if not known.added:
            return known
        known = folded(known, rounds, "walk")


def ring_walk(edges: DataFrame, nodes: DataFrame, members: DataFrame, root: DataFrame, cap: int = 4) -> DataFrame:
    """(node, hops, ring, parent): rings as in ``rings``, and who discovered each node; seats have no parent.

    The walk has three parts, and what one has found keeps its place: from the
    root; from members that the root doesn't reach, seated at 1; from what they
    don't reach either, seated outside all rings.
    """
    e = by_source(edges)
    node = staged(nodes.select(F.col(nodes.columns[0]).alias("node")).distinct(), "nodes")
    only = lambda df: df.select(F.col(df.columns[0]).alias("node")).distinct().join(node, "node", "left_semi")
    known = queue_walk(e, None, only(root), 0)
    for seats, at in ((only(members), 1), (node, None)):
        left = staged(seats.join(known, "node", "left_anti"), "left")
        if not left.isEmpty():
            at = at or known.agg(F.coalesce(F.max("hops"), F.lit(0)) + 1).head()[0]
            known = queue_walk(e, known, left, at)
        discard(left)
    discard(e, node)
    return loose(known).select("node", "hops", "parent").withColumn("ring", F.least("hops", F.lit(cap)))


def cycle_heads(pointers: DataFrame) -> DataFrame:
    """(node): the largest node of each cycle of (node, parent), where a node has one parent at most.

    Paths double in every round, and each knows the largest node on it.  A path
    that ends is dropped; a node that is the largest on its own path closes a
    cycle, and all paths on or into that are dropped with it.
    """
    paths = pointers.where("parent is not null").select("node", F.col("parent").alias("jump"), F.col("parent").alias("most"))
    paths, heads = staged(paths, "paths"), pointers.select("node").limit(0)
    while True:
        n, closed = paths.agg(F.count("*"), F.count_if(F.col("most") == F.col("node"))).head()
        if not n:
            discard(paths)
            return heads
        left = paths
        if closed:
            found = staged(paths.where("most = node").select("node"), "heads")
            heads = heads.unionByName(found)
            left = paths.join(found.withColumnRenamed("node", "most"), "most", "left_anti")
        on = left.select(F.col("node").alias("jump"), F.col("jump").alias("next"), F.col("most").alias("further"))
        before, paths = paths, staged(left.join(on, "jump").select("node", F.col("next").alias("jump"), F.greatest("most", "further").alias("most")), "paths")
        discard(before)


def discovery_tree(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, parent, level): who discovers whom in a breadth-first walk.

    ``edges`` has src, dst and w.  The walk starts from nodes that nothing leads to,
    in order of id, and tries a node's edges heaviest first, then by id; what is
    left is walked from its smallest id, ring after ring.  A level is one round:
    of several discoverers the first in the walk's order wins.  Levels are ordered
    in ranges, so no level has to be numbered in one task.
    """
    on = staged(nodes.select(F.col(nodes.columns[0]).alias("node")).distinct(), "nodes")
    e = edges.where("src <> dst").groupBy("src", "dst").agg(F.sum("w").alias("w"))
    e = staged(e.join(on.select(F.col("node").alias("src")), "src").join(on.select(F.col("node").alias("dst")), "dst"), "calls")
    n = buckets_for(e)
    nth = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("w"), "dst"))
    before, e = e, bucketed(e.repartition(n, "src").select("src", "dst", nth.alias("nth")), "src", n, "calls")
    discard(before)
    ground = on.join(e.select(F.col("dst").alias("node")).distinct(), "node", "left_anti")
    known = queue_walk(e, None, ground, 0, "nth")
    while True:
        left = on.join(known, "node", "left_anti")
        # strongly tied leftovers of different rings don't meet, so each ring's smallest id can start at once
        heads = staged(_ring_heads(e, left), "heads")
        if heads.isEmpty():
            discard(e, heads)
            return loose(known).select("node", "parent", F.col("hops").alias("level"))
        known = queue_walk(e, known, heads, 0, "nth")
        discard(heads)


def _ring_heads(e: DataFrame, left: DataFrame) -> DataFrame:
    """The smallest leftover of each weakly connected part of the leftovers."""
    left = staged(left, "left")
    inside = e.join(left.select(F.col("node").alias("src")), "src").join(left.select(F.col("node").alias("dst")), "dst").select("src", "dst")
    return components(inside, left).select(F.col("label").alias("node")).distinct()


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each weakly connected part; ``nodes`` has both ends of all edges.

    A round takes the smallest label among neighbours, then the label of that
    label, so a label travels ever further.
    """
    inside, left = edges.select("src", "dst"), nodes.select("node")
    both = staged(inside.unionByName(inside.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "left-edges")
    label = staged(left.select("node", F.col("node").alias("label"), F.lit(True).alias("moved")), "labels")
    while True:
        least = label.join(both, F.col("node") == F.col("src")).groupBy("dst").agg(F.min("label").alias("least"))
        hooked = label.join(least, F.col("node") == F.col("dst"), "left").select("node", F.least("label", "least").alias("at"), "label")
        far = label.select(F.col("node").alias("at"), F.col("label").alias("far"))
        new = hooked.join(far, "at").select("node", F.least("at", "far").alias("label"), (F.least("at", "far") < F.col("label")).alias("moved"))
        before, label = label, staged(new, "labels")
        discard(before)
        if label.where("moved").isEmpty():
            discard(both)
            return label.select("node", "label")


def descendants(tree: DataFrame) -> DataFrame:
    """(node, runs): how many nodes stand below each in a forest of (node, parent, level), from the deepest level up."""
    return summed_up(tree.select("node", F.col("level").alias("hops"), "parent"), F.count("n") + F.sum("n"), 0).select("node", F.col("n").alias("runs"))


def summed_up(tree: DataFrame, total: Column, leaf: int) -> DataFrame:
    """A forest (node, hops, parent) with ``n``: ``leaf`` where nothing stands below, else ``total`` of the ``n`` right below; a parent is one hop above."""
    rows = staged(tree.select("node", "hops", "parent"), "tree")
    buckets = buckets_for(rows)
    tree, done = in_buckets(rows, buckets, "tree"), None
    discard(rows)
    deepest = tree.agg(F.max("hops")).head()[0] or 0
    for hops in range(deepest, -1, -1):
        here = tree.where(F.col("hops") == hops)
        if done is None:
            here = here.withColumn("n", F.lit(leaf).cast("long"))
        else:
            below = done.where((F.col("hops") == hops + 1) & F.col("parent").isNotNull()).select(F.col("parent").alias("node"), "n").repartition(buckets, "node")
            here = here.join(below.groupBy("node").agg(total.cast("long").alias("n")).hint("shuffle_hash"), "node", "left").withColumn("n", F.coalesce("n", F.lit(leaf)))
        done = bucketed(here.select("node", "hops", "parent", "n"), "node", buckets, "sums", onto=done)
        done = folded(done, deepest - hops + 1, "sums")
    discard(tree)
    return loose(done)


def closure(edges: DataFrame, start: DataFrame, *, inclusive: bool) -> DataFrame:
    """(node, hops): everything that ``start`` leads to along ``src -> dst``; with or without the start itself, even on a cycle."""
    out = distances(edges, start)
    return out if inclusive else out.where("hops > 0")
