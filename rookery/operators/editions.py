"""The structural diff: two editions of declarations, their rows and their edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from rookery.plans.staging import staged


def match(base: DataFrame, live: DataFrame) -> DataFrame:
    """(path, kind, name, verdict, moved_from) over declarations (path, kind, name, text, place).

    Matched within a path by kind and name: same or changed by text; of a path's
    repeated base declarations the last counts.  Leftovers of equal kind and name
    in other paths are moves, one to one in path order; what is left then was
    added or removed.
    """
    key = ["path", "kind", "name"]
    last = lambda df: df.groupBy(*key).agg(F.max_by("text", "place").alias("text"))
    b, l = last(base), last(live)
    both = l.withColumnRenamed("text", "new").join(b.withColumnRenamed("text", "old"), key)
    met = both.select(*key, F.when(F.col("new").eqNullSafe(F.col("old")), "same").otherwise("changed").alias("verdict"), F.lit(None).cast("string").alias("moved_from"))
    order = Window.partitionBy("kind", "name").orderBy("path")
    gone = b.join(l, key, "left_anti").select(*key, F.row_number().over(order).alias("k"))
    new = l.join(b, key, "left_anti").select(*key, F.row_number().over(order).alias("k"))
    pair = new.join(gone.withColumnRenamed("path", "moved_from"), ["kind", "name", "k"], "left")
    added = pair.select(*key, F.when(F.col("moved_from").isNull(), "added").otherwise("moved").alias("verdict"), "moved_from")
    removed = gone.join(new.select("kind", "name", "k"), ["kind", "name", "k"], "left_anti").select(*key, F.lit("removed").alias("verdict"), F.lit(None).cast("string").alias("moved_from"))
    return met.unionByName(added).unionByName(removed)


def row_diff(base: DataFrame, live: DataFrame) -> DataFrame:
    """Added and removed rows of items: (item, event, seat, name, decl).

    Rows are (item, ord, name, decl).  A live row is added if no base row has its
    name and text; of repeated names the last counts.  A base row that is gone or
    changed is removed, seated before the live row that follows it: the smaller
    of the next surviving row's place and the place after the last surviving one.
    """
    last = lambda df: df.groupBy("item", "name").agg(F.max_by(F.struct("ord", "decl"), "ord").alias("x")).select("item", "name", "x.ord", "x.decl")
    b, l = last(base), last(live)
    added = l.join(b.select("item", "name", F.col("decl").alias("old"), F.lit(True).alias("had")), ["item", "name"], "left")
    added = added.where(F.col("had").isNull() | ~F.col("old").eqNullSafe(F.col("decl"))).select("item", F.lit("added").alias("event"), F.col("ord").cast("long").alias("seat"), "name", "decl")
    alive = l.select("item", "name", F.col("ord").alias("li"), F.col("decl").alias("new"))
    seats = base.join(alive, ["item", "name"], "left").withColumn("kept", F.col("new").eqNullSafe(F.col("decl")) & F.col("li").isNotNull())
    total = live.groupBy("item").agg((F.max("ord") + 1).alias("n_live"))
    order = Window.partitionBy("item").orderBy("ord")
    after = F.first("li", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    before = F.last(F.col("li") + 1, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    seats = seats.join(total, "item", "left").withColumn("next", after).withColumn("prev", before)
    seat = F.coalesce("li", F.least(F.coalesce("next", "n_live", F.lit(0)), F.coalesce("prev", F.lit(0))))
    removed = seats.where(~F.col("kept")).select("item", F.lit("removed").alias("event"), seat.cast("long").alias("seat"), "name", "decl")
    return added.unionByName(removed)


def band_diff(base: DataFrame, live: DataFrame, items: DataFrame) -> DataFrame:
    """``row_diff`` of items' methods, where the base edition was read in the item's own file only: (item, event, seat, name, decl).

    ``live`` is (item, ord, name, decl, file), a row for each method wherever it is
    written; ``items`` (item, file, kind).  A trait's clauses are all its own, another
    item's only those of its file; these alone are compared.  Seats are then
    places in the whole band: of an added row its own, of a removed one that of the own
    row that took its place, or the band's end.
    """
    at = items.select("item", F.col("file").alias("home"), "kind")
    own = live.join(at, "item").where((F.col("kind") == "trait") | (F.col("file") == F.col("home")))
    own = own.withColumn("nth", (F.row_number().over(Window.partitionBy("item").orderBy("ord")) - 1).cast("long"))
    own = staged(own.select("item", "nth", "ord", "name", "decl"), "own")
    diff = row_diff(base, own.select("item", F.col("nth").alias("ord"), "name", "decl"))
    seats = own.select("item", F.col("nth").alias("seat"), F.col("ord").cast("long").alias("whole"))
    full = live.groupBy("item").agg(F.count("*").alias("full"))
    out = diff.join(seats, ["item", "seat"], "left").join(full, "item", "left")
    return out.select("item", "event", F.coalesce("whole", "full", F.lit(0)).cast("long").alias("seat"), "name", "decl")


def impl_events(implements: DataFrame, items: DataFrame, base: DataFrame, read_files: DataFrame) -> DataFrame:
    """(trait, type, event) of promises: what types promise now, and what they promised in the base edition.

    ``implements`` is (trait, type) by ids, ``items`` (id, kind, name, file); ``base`` (path, trait, type)
    has the names that impl blocks of the base edition write, bare, and ``read_files`` (path) the files
    that were read there.  A promise is added if the file of either end was read and no impl
    block there has the two names.  A pair of names that no live promise has is a removed one, if
    a single trait and a single type bear them; ambiguous names are left alone.  What wasn't read has no event.
    """
    bare = F.element_at(F.split("name", "::"), -1)
    named = items.select("id", "kind", bare.alias("bare"), "file").join(read_files.select(F.col("path").alias("file"), F.lit(True).alias("read")).distinct(), "file", "left")
    end = lambda c: named.select(F.col("id").alias(c), F.col("bare").alias(f"{c}_name"), F.coalesce("read", F.lit(False)).alias(f"{c}_read"))
    live = implements.select("trait", "type").distinct().join(end("trait"), "trait").join(end("type"), "type")
    old = base.join(read_files.select("path").distinct(), "path", "left_semi").select(F.col("trait").alias("trait_name"), F.col("type").alias("type_name")).distinct()
    known = live.join(old.withColumn("had", F.lit(True)), ["trait_name", "type_name"], "left")
    new = (F.col("trait_read") | F.col("type_read")) & F.col("had").isNull()
    now = known.select("trait", "type", F.when(new, "added").alias("event"))
    only = lambda kinds, c: items.where(F.col("kind").isin(*kinds)).groupBy(bare.alias(f"{c}_name")).agg(F.count("*").alias("n"), F.min("id").alias(c)).where("n = 1").drop("n")
    gone = old.join(live.select("trait_name", "type_name").distinct(), ["trait_name", "type_name"], "left_anti")
    gone = gone.join(only(("trait",), "trait"), "trait_name").join(only(("struct", "enum", "union"), "type"), "type_name")
    return now.unionByName(gone.select("trait", "type", F.lit("removed").alias("event")))


def edge_events(base: DataFrame, live: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, event) of edges that only one edition has."""
    new = live.select(*keys).distinct().join(base, keys, "left_anti").withColumn("event", F.lit("added"))
    gone = base.select(*keys).distinct().join(live, keys, "left_anti").withColumn("event", F.lit("removed"))
    return new.unionByName(gone)


def unique_targets(tokens: DataFrame, names: DataFrame) -> DataFrame:
    """(row, token, target, ambiguous): the one node of that name; several make no edge but count as ambiguous."""
    known = names.groupBy(F.col("name").alias("token")).agg(F.count("*").alias("n"), F.min("id").alias("id"))
    return tokens.select("row", "token").distinct().join(known, "token").select("row", "token", F.when(F.col("n") == 1, F.col("id")).alias("target"), (F.col("n") > 1).alias("ambiguous"))
