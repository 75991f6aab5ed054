"""What the structural diff says about a declaration, its rows and its edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def changed(base: DataFrame, live: DataFrame) -> DataFrame:
    """(path, kind, name, verdict) of declarations in both editions.

    Functions compare visibility, rows and result; traits visibility and clauses;
    anything else its collapsed text and its methods in the file itself.
    """
    key = ["path", "kind", "name"]
    facts = ["vis", "rows", "result", "text", "methods"]
    both = live.select(*key, *[F.col(c).alias(f"new_{c}") for c in facts]).join(base.select(*key, *[F.col(c).alias(f"old_{c}") for c in facts]), key)
    same = lambda *cols: [F.col(f"new_{c}").eqNullSafe(F.col(f"old_{c}")) for c in cols]
    every = lambda cs: cs[0] if len(cs) == 1 else cs[0] & every(cs[1:])
    equal = F.when(F.col("kind") == "fn", every(same("vis", "rows", "result"))).when(F.col("kind") == "trait", every(same("vis", "rows"))).otherwise(every(same("text", "methods")))
    return both.select(*key, F.when(equal, "same").otherwise("changed").alias("verdict"))


def variant_key(row: Column) -> Column:
    """The name that leads a variant's written form."""
    return F.regexp_extract(row, r"^([\p{L}\p{N}_]+)", 1)


def field_text(vis: Column, ty: Column) -> Column:
    """What two editions of a field compare: the visibility word is part of it."""
    return F.concat_ws(" ", F.nullif(vis, F.lit("")), ty)


def added_holds(holds: DataFrame, deltas: DataFrame, added_rows: DataFrame) -> DataFrame:
    """Holds with ``event``: added if either end is, or if every field that draws one is an added row of a changed holder."""
    d = lambda c: deltas.select(F.col("node").alias(c), F.col("delta").alias(f"{c}_delta"))
    rows = added_rows.groupBy(F.col("item").alias("src")).agg(F.collect_set("name").alias("new_rows"))
    h = holds.join(d("src"), "src", "left").join(d("dst"), "dst", "left").join(rows, "src", "left")
    all_new = F.forall("fields", lambda f: F.array_contains(F.coalesce("new_rows", F.array().cast("array<string>")), f["name"]))
    new = F.col("src_delta").eqNullSafe("added") | F.col("dst_delta").eqNullSafe("added") | (F.col("src_delta").eqNullSafe("changed") & all_new)
    return h.withColumn("event", F.when(new, "added")).drop("src_delta", "dst_delta", "new_rows")


def removed_holds(dropped: DataFrame, live: DataFrame, *also: str) -> DataFrame:
    """Edges that dropped rows drew: without self edges, without pairs that are still held, their fields together, apart by ``also``."""
    gone = dropped.where("src <> dst").join(live.select("src", "dst", "from_method").distinct(), ["src", "dst", "from_method"], "left_anti")
    listed = F.transform(F.array_sort(F.collect_set(F.struct("ord", "name"))), lambda f: f["name"])
    return gone.groupBy("src", "dst", "kind", *also, "from_method").agg(listed.alias("fields")).withColumn("event", F.lit("removed"))


def woven(live: DataFrame, removed: DataFrame) -> DataFrame:
    """Rows of an item as read: removed ones at their seats, before the live row there."""
    l = live.select("item", F.col("ord").alias("seat"), F.lit(1).alias("is_live"), F.lit(0).alias("base_ord"), "name")
    r = removed.select("item", "seat", F.lit(0).alias("is_live"), F.col("ord").alias("base_ord"), "name")
    listed = F.array_sort(F.collect_list(F.struct("seat", "is_live", "base_ord", "name")))
    return l.unionByName(r).groupBy("item").agg(F.transform(listed, lambda x: F.struct(x["name"].alias("name"), (x["is_live"] == 0).alias("removed"))).alias("rows"))


def landing(modules: DataFrame) -> DataFrame:
    """One row: where the diff lands, as ``a, b and c``."""
    m = modules.agg(F.array_sort(F.collect_set("module")).alias("m")).select("m")
    n = F.size("m")
    return m.select(F.when(n <= 1, F.array_join("m", "")).otherwise(F.concat_ws(" and ", F.array_join(F.slice("m", 1, n - 1), ", "), F.element_at("m", -1))).alias("modules"))
