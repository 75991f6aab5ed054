"""Dropped rows read by name: which known types a row's text names, and how strongly it holds them.

There is no compiler for an edition that is gone, so a row is read as words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rookery.operators.ownership import HOLD_RANK
from rookery.operators.verdicts import removed_holds
from rookery.plans.staging import staged

#: Kinds that a name can stand for; words that make a hold a shared one.
NAMED_KINDS = ("struct", "enum", "union", "trait")
SHARING_WORDS = ("Arc", "Rc", "Weak", "Signal", "GlobalSignal", "ReadSignal", "Memo", "Resource")
#: What a word is made of.
WORD = r"[\p{IsAlphabetic}\p{N}_]+"


def last_segment(name: Column) -> Column:
    """``c`` of ``a::b::c``."""
    return F.element_at(F.split(name, "::"), -1)


def known_names(live: DataFrame, ghosts: DataFrame) -> DataFrame:
    """(name, id, several) of what live and removed declarations (id, kind, name) can be called; of several one has no id."""
    both = live.select("id", "kind", "name").unionByName(ghosts.select("id", "kind", "name")).where(F.col("kind").isin(*NAMED_KINDS))
    called = both.groupBy(last_segment(F.col("name")).alias("name")).agg(F.count("*").alias("n"), F.min("id").alias("id"))
    return called.select("name", F.when(F.col("n") == 1, F.col("id")).alias("id"), (F.col("n") > 1).alias("several"))


def words(rows: DataFrame) -> DataFrame:
    """(row, at, word): a row's words in order; with ``skip_leading`` the first, a variant's own name, is none."""
    every = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0))
    skip = F.coalesce("skip_leading", F.lit(False)).cast("int")
    return rows.select("row", skip.alias("skip"), F.posexplode(every).alias("at", "word")).where("at >= skip").drop("skip")


def name_walk(rows: DataFrame, names: DataFrame) -> DataFrame:
    """(row, kind, via, targets, ambiguous) of every row (row, text, skip_leading).

    ``targets`` are the declarations that a word names, in the order of their first
    places; ``ambiguous`` counts words that name several.  A row borrows if there is a
    ``&`` in it, else it owns; ``dyn`` and the sharing words make it stronger, unless a
    declaration bears that name, and ``via`` is the first word of the strongest kind (or
    ``&``, or nothing).  Rows are told apart by ``row``; null texts name nothing.

    Only words that are known meet the table of names, so no common word is a hot key
    but a common name, whose row on the other side is one.
    """
    return _walked(rows.select("row", "text", "skip_leading"), names).select("row", "kind", "via", "targets", "ambiguous")


def _walked(rows: DataFrame, names: DataFrame) -> DataFrame:
    """``rows`` with kind, via, targets and ambiguous.  A text is read once, however many rows have it, and its words go by its number."""
    rows = staged(rows.withColumns({"text": F.coalesce("text", F.lit("")), "skip_leading": F.coalesce("skip_leading", F.lit(False))}), "rows")
    texts = staged(rows.select("text", "skip_leading").distinct().withColumn("row", F.monotonically_increasing_id()), "texts")
    return rows.join(_read(texts, names).drop("row"), ["text", "skip_leading"])


def _read(texts: DataFrame, names: DataFrame) -> DataFrame:
    """``texts`` with what they name and how they hold it; how is told by a text's own words, without a shuffle."""
    hit = words(texts).join(names.withColumnRenamed("name", "word"), "word")
    found = hit.groupBy("row").agg(F.array_sort(F.collect_set(F.when(~F.col("several"), F.struct("at", "id")))).alias("places"), F.count_if("several").alias("ambiguous"))
    # a declaration of several places is a target once, at its first
    ids = F.transform("places", lambda p: p["id"])
    found = found.select("row", F.array_distinct(ids).alias("targets"), "ambiguous")
    own = names.where(F.col("name").isin("dyn", *SHARING_WORDS)).agg(F.collect_set("name").alias("own"))  # one row, nine names at most
    strong = F.array_except(F.array(*map(F.lit, ("dyn", *SHARING_WORDS))), "own")
    every = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    every = F.slice(every, F.col("skip_leading").cast("int") + 1, F.size(every))
    held = F.filter(every, lambda w: F.array_contains(F.col("strong"), w))
    out = texts.join(F.broadcast(own), F.lit(True)).withColumn("strong", strong).withColumn("held", held)
    shared = F.get(F.filter("held", lambda w: w != "dyn"), F.lit(0))  # the stronger kind
    out = out.withColumn("word", F.coalesce(shared, F.get("held", F.lit(0))))
    plain = F.when(F.contains("text", F.lit("&")), HOLD_RANK["borrows"]).otherwise(HOLD_RANK["owns"])
    rank = F.when(F.col("word").isNull(), plain).when(F.col("word") == "dyn", HOLD_RANK["dyn"]).otherwise(HOLD_RANK["shares"])
    kinds = F.array(*map(F.lit, HOLD_RANK))
    return out.join(found, "row", "left").select(
        *texts.columns, F.element_at(kinds, rank + 1).alias("kind"),
        F.when(F.col("word").isNotNull(), F.col("word")).when(plain == HOLD_RANK["borrows"], "&").otherwise("").alias("via"),
        F.coalesce("targets", F.array().cast(f"array<{names.schema['id'].dataType.simpleString()}>")).alias("targets"), F.coalesce("ambiguous", F.lit(0)).cast("long").alias("ambiguous"),
    )


def dropped_holds(rows: DataFrame, names: DataFrame, live: DataFrame) -> DataFrame:
    """(src, dst, kind, via, from_method, fields, event): edges that dropped rows drew, read from their texts.

    ``rows`` is (row, src, ord, name, text, skip_leading, from_method); ``live`` the holds (src, dst,
    from_method) that stand without an event.  A pair that still stands draws nothing, nor does a
    declaration that names itself.
    """
    drawn = _walked(rows, names).select("row", "src", "ord", "name", "from_method", "kind", "via", F.explode("targets").alias("dst"))
    return removed_holds(drawn, live, "via")
