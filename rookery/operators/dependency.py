"""The dependency altitude: who depends on whom, what changed, and how far a change reaches.

Links are (src, dst, kind, w[, event]): ``src`` uses ``dst``.  A link whose event is
``removed`` is no route.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from rookery.operators.graph import closure, distances

#: Kinds of dependency in drawing order.
KIND_RANK = {"normal": 0, "build": 1, "dev": 2}


def rank_of(col: Column, ranks: dict[str, int]) -> Column:
    return reduce(lambda c, kv: c.when(col == kv[0], kv[1]), ranks.items(), F.when(F.lit(False), 0))


def routes(links: DataFrame) -> DataFrame:
    """Links that are not removed; a null event is no event."""
    return links.where(~F.col("event").eqNullSafe("removed")) if "event" in links.columns else links


def blast_radius(links: DataFrame, changed: DataFrame) -> DataFrame:
    """(node, hops): every node that a change may affect, by fewest steps from what it uses."""
    return distances(routes(links).select(F.col("dst").alias("src"), F.col("src").alias("dst")), changed)


def rollups(links: DataFrame, nodes: DataFrame, members: DataFrame) -> DataFrame:
    """Per node: dependents, direct_deps, external_deps, over distinct pairs whatever their kind."""
    pair = routes(links).select("src", "dst").distinct()
    inside = members.select(F.col(members.columns[0]).alias("dst"), F.lit(True).alias("inside"))
    used = pair.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("dependents"))
    uses = pair.join(inside, "dst", "left").groupBy(F.col("src").alias("node")).agg(F.count("*").alias("direct_deps"), F.count_if(F.col("inside").isNull()).alias("external_deps"))
    out = nodes.select(F.col(nodes.columns[0]).alias("node")).join(used, "node", "left").join(uses, "node", "left")
    return out.na.fill(0, ["dependents", "direct_deps", "external_deps"])


def change_report(nodes: DataFrame, radius: DataFrame) -> DataFrame:
    """One row: members, externals, changed, affected (beyond the changed), deepest."""
    n = nodes.join(radius, "node", "left")
    return n.agg(
        F.count_if("is_member").alias("members"), F.count_if(~F.col("is_member")).alias("externals"),
        F.count_if(F.col("hops") == 0).alias("changed"), F.count_if(F.col("hops") > 0).alias("affected"), F.coalesce(F.max("hops"), F.lit(0)).alias("deepest"),
    )


def manifest_events(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, event, event_old, event_new): added, removed or bumped requirements; equal ones are left out."""
    a, b = old.select(*keys, F.col("req").alias("event_old")), new.select(*keys, F.col("req").alias("event_new"))
    both = a.withColumn("in_old", F.lit(True)).join(b.withColumn("in_new", F.lit(True)), keys, "full_outer")
    event = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(~F.col("event_old").eqNullSafe(F.col("event_new")), "bumped")
    return both.withColumn("event", event).where("event is not null").select(*keys, "event", "event_old", "event_new")


def events_on_links(events: DataFrame, links: DataFrame) -> DataFrame:
    """Each event (src, kind, name) with the first link, by id of its end, from src of that kind to a node of that name; null if there is none."""
    first = links.groupBy("src", "kind", "name").agg(F.min("dst").alias("dst"))
    return events.join(first, ["src", "kind", "name"], "left")


def ghosts(events: DataFrame, nodes: DataFrame) -> DataFrame:
    """Names that were removed and that no live node has, once each."""
    gone = events.where("event = 'removed'").select("name").distinct()
    return gone.join(nodes.select("name").distinct(), "name", "left_anti")


def linked_events(links: DataFrame, events: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst, kind, event): links with their events, and a link for each removed requirement; ends are ids or ghosts' names, as text.

    ``links`` is (src, dst, kind), ``events`` (src, kind, name, event) by the name that a manifest writes, ``nodes``
    (id, name) what is resolved now.  An added or bumped requirement marks the first link, by id of its end, of that kind to a
    node of that name.  A removed one leads to the first node that still bears the name, else to a ghost.
    """
    named = links.join(nodes.select(F.col("id").alias("dst"), "name"), "dst", "left")
    marked = events_on_links(events.where("event <> 'removed'"), named.where("name is not null")).where("dst is not null").select("src", "kind", "dst", "event")
    live = links.join(marked, ["src", "kind", "dst"], "left").select("src", F.col("dst").cast("string").alias("dst"), "kind", "event")
    bearer = nodes.groupBy("name").agg(F.min("id").cast("string").alias("id"))
    gone = events.where("event = 'removed'").join(bearer, "name", "left").select("src", F.coalesce("id", "name").alias("dst"), "kind", "event")
    return live.unionByName(gone)


def merge_edges(links: DataFrame) -> DataFrame:
    """One edge a pair: the kind of the smallest drawing rank, and the weight of all."""
    ranked = links.withColumn("rank", rank_of(F.col("kind"), KIND_RANK))
    return ranked.groupBy("src", "dst").agg(F.min_by("kind", "rank").alias("kind"), F.sum("w").cast("long").alias("w"), F.count("*").alias("n_links"))


def multi_select(links: DataFrame, selected: DataFrame) -> DataFrame:
    """One row: distinct dependencies and users outside a selection."""
    sel = selected.select(F.col(selected.columns[0]).alias("node")).distinct()
    live = routes(links).select("src", "dst").distinct()
    mark = lambda c: sel.select(F.col("node").alias(c), F.lit(True).alias(f"{c}_in"))
    e = live.join(mark("src"), "src", "left").join(mark("dst"), "dst", "left")
    return e.agg(
        F.countDistinct(F.when(F.col("src_in") & F.col("dst_in").isNull(), F.col("dst"))).alias("deps_outside"),
        F.countDistinct(F.when(F.col("dst_in") & F.col("src_in").isNull(), F.col("src"))).alias("users_outside"),
    )


def prefixes(path: Column, sep: str = "/") -> Column:
    """A path's ancestors and the path itself, longest first, as (prefix, depth)."""
    parts = F.split(path, sep)
    return F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda k: F.struct(F.array_join(F.slice(parts, 1, k), sep).alias("prefix"), k.alias("depth")))


def longest_prefix(paths: DataFrame, owners: DataFrame) -> DataFrame:
    """(path, owner): the deepest owner that is the path or one of its directories; the owner ``.`` has everything, else null.

    Paths are taken apart into their prefixes, so this is an equi join, and
    ``libs/corely`` never matches ``libs/core``.
    """
    p = paths.select("path").distinct()
    tried = p.select("path", F.explode(prefixes(F.col("path"))).alias("x")).select("path", F.col("x.prefix").alias("owner"), F.col("x.depth").alias("depth"))
    dot = p.select("path", F.lit(".").alias("owner"), F.lit(0).alias("depth"))
    found = tried.unionByName(dot).join(owners.select("owner").distinct(), "owner")
    return p.join(found.groupBy("path").agg(F.max_by("owner", "depth").alias("owner")), "path", "left")


def nearest_prefix(gone: DataFrame, live: DataFrame) -> DataFrame:
    """(path, near, shared): the live path that shares most leading segments; of several the last in path order, null if none is shared."""
    seg = lambda df: df.select("path", F.explode(prefixes(F.col("path"))).alias("x")).select("path", F.col("x.prefix").alias("prefix"), F.col("x.depth").alias("depth"))
    # of a prefix's live paths only the last in order can win
    best = seg(live.select("path").distinct()).groupBy("prefix").agg(F.max("path").alias("near"))
    met = seg(gone.select("path").distinct()).join(best, "prefix").groupBy("path").agg(F.max(F.struct("depth", "near")).alias("m"))
    return gone.select("path").distinct().join(met, "path", "left").select("path", F.col("m.near").alias("near"), F.coalesce("m.depth", F.lit(0)).alias("shared"))


def search(items: DataFrame, query: str, *, limit: int, weight: str) -> DataFrame:
    """The first ``limit`` names that hold ``query``, whatever their case: prefixes first, then members, then by weight, name and id.

    Ghosts are never found; ``items`` may leave out ``ghost`` and ``is_member`` where there are none.
    """
    hit = items.where(F.contains(F.lower("name"), F.lit(query.lower())))
    if "ghost" in items.columns:
        hit = hit.where(~F.coalesce("ghost", F.lit(False)))
    member = [F.desc(F.coalesce("is_member", F.lit(False)))] if "is_member" in items.columns else []
    return hit.orderBy(~F.startswith(F.lower("name"), F.lit(query.lower())), *member, F.desc(weight), "name", "id").limit(limit)


def ring_roster(rings: DataFrame, rollup: DataFrame, ring: int, rows: int) -> DataFrame:
    """The first ``rows`` nodes of a ring by dependents, with the ring's whole ``total``."""
    at = rings.where(F.col("ring") == ring).join(rollup, "node")
    total = at.agg(F.count("*").alias("total"))
    return at.orderBy(F.desc("dependents"), "node").limit(rows).join(F.broadcast(total), F.lit(True)).select("node", "hops", "dependents", "total")
