"""The dependency altitude's drawing: which names and edges show, and where the rings' stars stand."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from rookery.operators.dependency import KIND_RANK, longest_prefix, rank_of, routes
from rookery.operators.graph import closure, folded, in_buckets, summed_up
from rookery.plans.numbering import ranked
from rookery.plans.staging import bucketed, buckets_for, discard, loose, staged

#: Externals that are named at rest; rings at rest; places of event labels along an edge.
SHOWN_OUTSIDERS, RINGS_AT_REST, LABEL_PLACES = 20, 4, (0.38, 0.54, 0.68)
#: Space between rings, the most of it, and between stars of a ring.
NEXT_RING, NEXT_RING_MOST, STAR_ROOM = 150.0, 380.0, 24.0


def biggest_externals(nodes: DataFrame, limit: int = SHOWN_OUTSIDERS) -> DataFrame:
    """External nodes with most dependents, then by name and id."""
    return nodes.where("not is_member and not ghost").orderBy(F.desc("dependents"), "name", "id").limit(limit)


def named_at_rest(nodes: DataFrame, hood: DataFrame) -> DataFrame:
    """(id) of nodes whose names show at rest: members, changed, ghosts, affected ones, the neighbourhood, and the biggest externals.

    ``nodes`` is (id, name, is_member, changed_files, ghost, affected, dependents).
    """
    own = nodes.where("is_member or changed_files > 0 or ghost or affected").select("id")
    near = nodes.join(hood.select(F.col(hood.columns[0]).alias("id")).distinct(), "id", "left_semi").select("id")
    return own.unionByName(near).unionByName(biggest_externals(nodes).select("id")).distinct()


def repeated_names(nodes: DataFrame) -> DataFrame:
    """(name, versions) of live names that stand for several nodes."""
    return nodes.where("not ghost").groupBy("name").agg(F.count("*").alias("versions")).where("versions > 1")


def deepest_by_name(rings: DataFrame, nodes: DataFrame) -> DataFrame:
    """(name, hops): the deepest of a name's live versions."""
    return rings.join(nodes.where("not ghost").select(F.col("id").alias("node"), "name"), "node").groupBy("name").agg(F.max("hops").alias("hops"))


def ring_cap(deepest: DataFrame, step: str | None) -> int:
    """Rings that are drawn apart for a step: none, ``ring:3``, or names joined by ``+``, which open the rings down to below them."""
    if step is None:
        return RINGS_AT_REST
    if step.startswith("ring:"):
        return max(int(step[5:]), RINGS_AT_REST)
    hops = deepest.where(F.col("name").isin(*step.split("+"))).agg(F.max("hops")).head()[0]
    return max(RINGS_AT_REST, (hops or 0) + 1)


def around(sorted_names: DataFrame) -> DataFrame:
    """(name, next, previous) in the order of names, with the ends joined."""
    numbered, _ = ranked(sorted_names.select("name").distinct(), [], ["name"], "names")
    numbered = staged(numbered, "around")
    beside = lambda step, to: numbered.select(F.pmod(F.col("rank") - step, F.col("n")).alias("rank"), F.col("name").alias(to))
    return numbered.join(beside(1, "next"), "rank").join(beside(-1, "previous"), "rank").select("name", "next", "previous")


def event_labels(edges: DataFrame) -> DataFrame:
    """Edges with an event, and where along each its label stands: three places in turn, over all such edges in the order of (src, dst)."""
    numbered, _ = ranked(edges.where("event is not null"), [], ["src", "dst"], "labels")
    turn = F.pmod(F.col("rank"), F.lit(len(LABEL_PLACES))).cast("int") + 1
    return numbered.withColumn("at", F.element_at(F.array(*map(F.lit, LABEL_PLACES)), turn)).drop("rank", "n")


def drawn_edges(links: DataFrame, selected: DataFrame, direction: str) -> DataFrame:
    """(src, dst, role, kind, event): one edge for each pair that is drawn around a selection.

    Drawn are, in direction ``deps``, what the selection uses, in ``users`` who uses
    it, in ``root`` every step of a way to it; and all edges with an event.  A
    removed edge is no way.  Of a pair's links the smallest kind counts, the first
    event in the order of kinds, and the strongest role: dep, user, event.
    """
    start = selected.select(F.col(selected.columns[0]).alias("node")).distinct()
    mark = lambda df, c: df.select(F.col("node").alias(c), F.lit(True).alias(f"{c}_in"))
    e = links.join(mark(start, "src"), "src", "left").join(mark(start, "dst"), "dst", "left")
    if direction == "root":
        live = routes(links).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        up = closure(live, start, inclusive=True).select(F.col("node").alias("dst"), F.lit(True).alias("wanted"))
        e = e.join(up, "dst", "left")
    else:
        e = e.withColumn("wanted", F.col("src_in" if direction == "deps" else "dst_in"))
    e = e.where("wanted or event is not null")
    role = F.when(F.col("src_in"), 0).when(F.col("dst_in") | F.col("wanted"), 1).otherwise(2)
    rank = rank_of(F.col("kind"), KIND_RANK)
    pair = e.groupBy("src", "dst").agg(F.min(role).alias("r"), F.min_by("kind", rank).alias("kind"), F.min_by("event", F.when(F.col("event").isNotNull(), rank)).alias("event"))
    return pair.select("src", "dst", F.when(F.col("r") == 0, "dep").when(F.col("r") == 1, "user").otherwise("event").alias("role"), "kind", "event")


def neighbourhood(edges: DataFrame, selected: DataFrame) -> DataFrame:
    """(node): the selection and the far ends of its drawn edges."""
    start = selected.select(F.col(selected.columns[0]).alias("node")).distinct()
    far = lambda here, there: edges.join(start.select(F.col("node").alias(here)), here, "left_semi").select(F.col(there).alias("node"))
    return start.unionByName(far("src", "dst")).unionByName(far("dst", "src")).distinct()


def changed_members(files: DataFrame, members: DataFrame) -> DataFrame:
    """(member, changed_files, manifest_changed) of changed files (path), each counted for the deepest member (member, dir) around it."""
    met = longest_prefix(files, members.select(F.col("dir").alias("owner"))).where("owner is not null")
    met = met.join(members.select("member", F.col("dir").alias("owner")), "owner")
    manifest = F.col("path") == F.when(F.col("owner") == ".", "Cargo.toml").otherwise(F.concat("owner", F.lit("/Cargo.toml")))
    return met.groupBy("member").agg(F.count("*").alias("changed_files"), F.bool_or(manifest).alias("manifest_changed"))


def member_dirs(packages: DataFrame, root: str) -> DataFrame:
    """(member, dir, depth) of workspace packages (name, manifest_path, is_member): the folder below the root, ``.`` for the root itself.

    Deepest first is ``orderBy(desc depth, member)``; the root has depth 0.
    """
    folder = F.regexp_replace(F.substring("manifest_path", F.lit(len(root.rstrip("/")) + 2), F.length("manifest_path")), "/?[^/]*$", "")
    rel = F.when(folder == "", ".").otherwise(folder)
    inside = packages.where(F.col("is_member") & F.startswith("manifest_path", F.lit(root.rstrip("/") + "/")))
    return inside.select(F.col("name").alias("member"), rel.alias("dir"), F.when(rel == ".", 0).otherwise(F.size(F.split(rel, "/"))).alias("depth"))


def leaf_weights(tree: DataFrame) -> DataFrame:
    """(node, hops, parent, weight): how many outermost stars stand below each, a star without any is one; from the outermost ring inwards."""
    return summed_up(tree, F.sum("n"), 1).select("node", "hops", "parent", F.col("n").cast("double").alias("weight"))


def sectors(weights: DataFrame) -> DataFrame:
    """(node, hops, start, width): each star's sector of the circle, from twelve o'clock, by the root of its weight among its siblings.

    Siblings follow one another by id.  Seats without a parent share the circle;
    they are ordered in ranges, so no task orders them all.
    """
    share = weights.withColumn("share", F.sqrt("weight"))
    share = staged(share, "shares")
    n = buckets_for(share)
    before = F.coalesce(F.sum("share").over(Window.partitionBy("group").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    top = staged(share.where("parent is null").repartitionByRange("node").withColumn("group", F.spark_partition_id()), "seats")
    parts = top.groupBy("group").agg(F.sum("share").alias("sum"))
    parts = parts.withColumn("offset", F.sum("sum").over(Window.orderBy("group")) - F.col("sum"))  # a row for each task
    total = max(top.agg(F.sum("share")).head()[0] or 0.0, 1.0)
    level = top.withColumn("before", before).join(F.broadcast(parts), "group")
    level = level.select("node", "hops", (-math.tau / 4 + math.tau * (F.col("offset") + F.col("before")) / total).alias("start"), (math.tau * F.col("share") / total).alias("width"))
    # stars in buckets by parent meet sectors in as many by node
    kin = in_buckets(share.where("parent is not null"), n, "kin", "parent")
    done = in_buckets(level.withColumn("depth", F.lit(0)), n, "sectors")
    every = F.greatest(F.sum("share").over(Window.partitionBy("parent")), F.lit(1.0))
    depth = 0
    while True:
        above = done.where(F.col("depth") == depth).select(F.col("node").alias("parent"), F.col("start").alias("at"), F.col("width").alias("room"))
        depth += 1
        kids = kin.join(above.hint("shuffle_hash"), "parent").withColumn("group", F.col("parent")).withColumn("before", before).withColumn("every", every)
        start = F.col("at") + F.col("room") * F.col("before") / F.col("every")
        kids = kids.select("node", "hops", start.alias("start"), (F.col("room") * F.col("share") / F.col("every")).alias("width"), F.lit(depth).alias("depth"))
        done = bucketed(kids.repartition(n, "node"), "node", n, "sectors", onto=done)
        if not done.added:
            discard(kin)
            return loose(done).drop("depth")
        done = folded(done, depth, "sectors")


def ring_gaps(angles: DataFrame, cap: int) -> DataFrame:
    """(ring, gap): between each star (node, hops, angle) and the next one of its ring, the last one's to the first, round the circle."""
    placed, _ = ranked(angles.select(F.least("hops", F.lit(cap)).alias("ring"), "node", "angle"), ["ring"], ["angle", "node"], "ring-order")
    placed = staged(placed, "ring-places")
    following = placed.select("ring", F.pmod(F.col("rank") - 1, F.col("n")).alias("rank"), F.col("angle").alias("next"))
    turn = F.when(F.col("rank") == F.col("n") - 1, F.lit(math.tau)).otherwise(F.lit(0.0))
    return placed.where("n >= 2").join(following, ["ring", "rank"]).select("ring", (F.col("next") + turn - F.col("angle")).alias("gap"))


def ring_radii(angles: DataFrame, cap: int) -> list[float]:
    """Radius of each ring (node, hops, angle): at least a gap beyond the ring inside it, more where a quarter of its stars stand close.

    Stars of a ring are ordered in ranges over all tasks, and so are its gaps.  Of
    those only the one at the first quarter comes to the driver, so a number a
    ring, of which there are at most ``cap`` and one.
    """
    gaps, _ = ranked(staged(ring_gaps(angles, cap), "gaps"), ["ring"], ["gap"], "gap-order")
    quarter = {r["ring"]: r["gap"] for r in gaps.where("rank = floor(n / 4)").select("ring", "gap").collect()}
    deepest = angles.agg(F.max(F.least("hops", F.lit(cap)))).head()[0] or 0
    radii = [0.0]
    for k in range(1, deepest + 1):
        needed = STAR_ROOM / max(quarter[k], 1e-4) if k in quarter else 0.0
        radii.append(min(max(needed, radii[-1] + NEXT_RING), radii[-1] + NEXT_RING_MOST))
    return radii


def radial_layout(tree: DataFrame, cap: int = RINGS_AT_REST) -> DataFrame:
    """(node, hops, ring, angle, radius, x, y): where every star stands; a star is in the middle of its sector.

    ``tree`` is (node, hops, parent) as ``graph.ring_walk`` gives it; seats of their own have no parent.
    """
    placed = sectors(leaf_weights(tree)).withColumn("angle", F.col("start") + F.col("width") / 2)
    placed = staged(placed.select("node", "hops", "angle"), "angles")
    radii = F.array(*map(F.lit, ring_radii(placed, cap)))
    out = placed.withColumn("ring", F.least("hops", F.lit(cap))).withColumn("radius", F.element_at(radii, F.col("ring") + 1))
    return out.withColumn("x", F.col("radius") * F.cos("angle")).withColumn("y", F.col("radius") * F.sin("angle"))
