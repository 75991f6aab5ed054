"""From raw positions to declarations: files, parents, reference ends, holders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from rookery.operators.intervals import CELL, cells
from rookery.plans.numbering import ranked


def files_of(modules: DataFrame) -> DataFrame:
    """(path, krate): source files of local crates, of several crates the first; build output and other files go."""
    m = modules.where(F.col("path").endswith(".rs") & ~F.col("path").startswith("target/"))
    return m.groupBy("path").agg(F.min("krate").alias("krate"))


def numbered(items: DataFrame) -> DataFrame:
    """Items with ``id`` from 0 in the order of path, start and end (longest first).

    Items are sorted in ranges over all tasks, so neither a file nor the list of files is
    ordered in one place.
    """
    laid = items.withColumn("back_", -F.col("end"))
    numbered, _ = ranked(laid, [], ["path", "start", "back_"], "items")
    return numbered.withColumn("id", F.col("rank")).drop("back_", "rank", "n")


def parents(items: DataFrame, impls: DataFrame) -> DataFrame:
    """Items with the mark that declares them: an impl block's self type, or the trait itself; never themselves.

    ``items`` has id, path, owner_start; ``impls`` path, start, self_mark; traits are items with a start.
    """
    own = impls.select("path", F.col("start").alias("owner_start"), "self_mark")
    trait = items.where("kind = 'trait'").select("path", F.col("start").alias("owner_start"), F.col("id").alias("trait_mark"))
    out = items.join(own, ["path", "owner_start"], "left").join(trait, ["path", "owner_start"], "left")
    parent = F.coalesce("self_mark", "trait_mark")
    return out.withColumn("parent", F.when(parent != F.col("id"), parent)).drop("self_mark", "trait_mark")


def lifted(refs: DataFrame, impl_self: DataFrame) -> DataFrame:
    """References whose source is an impl block count for its self type; those of a mark with itself go; equal pairs are summed."""
    up = impl_self.select(F.col("impl").alias("src"), "self_mark")
    r = refs.join(up, "src", "left").withColumn("src", F.coalesce("self_mark", "src"))
    return r.where("src is null or src <> dst").groupBy("src", "dst", "same_file").agg(F.sum("w").cast("long").alias("w"))


def pair_counts(refs: DataFrame) -> DataFrame:
    """(src, dst, w) over files; sources without a mark are no pair."""
    return refs.where("src is not null and src <> dst").groupBy("src", "dst").agg(F.sum("w").cast("long").alias("w"))


def fan_in(refs: DataFrame) -> DataFrame:
    """(dst, fan_in): references from other files, those without a mark too."""
    return refs.where("not same_file").groupBy("dst").agg(F.sum("w").cast("long").alias("fan_in"))


def outside(refs: DataFrame, skipped: DataFrame) -> DataFrame:
    """References (file, at) that lie in no skipped range [start, end); by the cells of a grid, not by all pairs of a file."""
    s = skipped.where("start < end").select("file", "start", "end", F.explode(cells(F.col("start"), F.col("end") - 1)).alias("cell"))
    at = refs.select("file", "at").distinct().withColumn("cell", F.floor(F.col("at") / CELL))
    hit = at.join(s, ["file", "cell"]).where("at >= start and at < end").select("file", "at").distinct()
    return refs.join(hit, ["file", "at"], "left_anti")


def container_root(items: DataFrame, most: int = 8) -> DataFrame:
    """(node, root): the topmost parent, climbed at most ``most`` steps; chains are shallow by construction."""
    up = items.select(F.col("id").alias("node"), "parent")
    at = up.select("node", F.coalesce("parent", "node").alias("root"))
    for _ in range(most - 1):
        step = up.where("parent is not null").select(F.col("node").alias("root"), F.col("parent").alias("above"))
        at = at.join(step, "root", "left").select("node", F.coalesce("above", "root").alias("root"))
    return at


def hold_edges(fields: DataFrame) -> DataFrame:
    """Edges (src, dst, kind, via, from_method) with their distinct fields in source order.

    ``fields`` has ord, name, decl and rank: of a field's several holds of one
    target the strongest counts, of equal ones the first.
    """
    order = Window.partitionBy("src", "from_method", "name", "dst").orderBy(F.desc("rank"), "ord")
    best = fields.withColumn("k", F.row_number().over(order)).where("k = 1")
    once = best.groupBy("src", "dst", "kind", "via", "from_method", "name", "decl").agg(F.min("ord").alias("ord"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("ord", "name", "decl"))), lambda f: F.struct(f["name"].alias("name"), f["decl"].alias("decl")))
    return once.groupBy("src", "dst", "kind", "via", "from_method").agg(listed.alias("fields"))


def row_targets(rows: DataFrame, holds: DataFrame, drawn: DataFrame) -> DataFrame:
    """Each row (item, name) with the type of the first hold that names it; linked if that is drawn and not the item itself."""
    f = holds.select(F.col("src").alias("item"), "dst", "ord", F.explode("fields").alias("f")).select("item", F.col("f.name").alias("name"), "dst", "ord")
    first = f.groupBy("item", "name").agg(F.min_by("dst", "ord").alias("held"))
    on = drawn.select(F.col(drawn.columns[0]).alias("held"), F.lit(True).alias("on")).distinct()
    out = rows.join(first, ["item", "name"], "left").join(on, "held", "left")
    return out.withColumn("linked", F.coalesce(F.col("on") & (F.col("held") != F.col("item")), F.lit(False))).drop("on")


def declared(items: DataFrame, keys: DataFrame) -> DataFrame:
    """The first item of each (path, label); null if there is none."""
    return keys.join(items.groupBy("path", "label").agg(F.min("id").alias("id")), ["path", "label"], "left")
