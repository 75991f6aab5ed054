r"""Mixing sources to target weights by balanced sampling (the cube method).

Every source gets a target number of words; a document of it is to be taken
target / source size times on average, at most ``MOST`` times.  The whole part of
that is certain; the rest is an inclusion probability, the same for all documents of
a source.  The cube method turns probabilities into yes or no:

* **Flight.**  Documents much larger than most are settled first, one by one, while
  all others give way a little.  Then three documents whose probabilities are still
  fractions move along the one direction that changes neither their expected words
  nor their expected number (the constraints' null-space), one way or the other at
  random so that expectations stay, until one of them is settled.
* Flights run in groups of at most ``GROUP`` documents of one source; what is left
  of each (two documents) meets in the next round, ``MERGED`` groups at a time.
* **Landing.**  The last ``LANDED`` documents of a source at most are settled at
  once, by the best of all choices: near the target in words, then in documents.

So a source's words differ from its target by what the landing leaves.  Groups come
from ranks in a hashed order, so a source of any size is spread, and random numbers
from source, round and group: reruns agree.
"""

from __future__ import annotations

import random
from collections.abc import Callable
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rookery.llm.common import discard, join_heavy, ranked, staged

WORDS = r"[^\x20\x09-\x0D]+"
#: Weights of sources in their order, repeating.
WEIGHTS = (5, 2, 1)
#: What is taken in all, in hundredths of all sizes; how often a document is taken at most.
PERCENT, MOST = 150, 2
#: Documents that fly together; groups whose rests meet; documents that land together.
GROUP, MERGED, LANDED = 2048, 512, 12
#: A document this many times the mean of those that are fractions is settled first.
LARGE = 4
#: Share of a source's target within which the landing prefers the right number of documents.
NEAR_WORDS = 0.0005
NEAR = 1e-9


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, most: int = MOST) -> DataFrame:
    """``sources`` (key, source_size, docs) with ``target``.

    Sources share ``percent`` hundredths of all sizes by weight.  A target stops at
    ``most`` times its source's size; the excess is shared anew by weight until
    none is above.  The share of a unit of weight only grows on the way, so a round
    is one aggregate of sums, which are exact.
    """
    ordered, _ = ranked(sources, [], ["key"], "mix-sources")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")
    ordered = staged(ordered.select(*sources.columns, weight.alias("weight")), "mix-weights")
    exact = lambda c: F.col(c).cast("decimal(38,0)")
    everything, heft = ordered.agg(F.sum(exact("source_size")), F.sum("weight")).head()
    if not everything:  # no sources, or no words
        return ordered.withColumn("target", F.lit(0.0))
    full = percent * int(everything)
    share, over = full, heft * 100
    while True:
        stopped_now = exact("weight") * F.lit(Decimal(share)) > exact("source_size") * F.lit(Decimal(most * over))
        size, left = ordered.agg(F.sum(F.when(stopped_now, exact("source_size"))), F.sum(F.when(~stopped_now, F.col("weight")))).head()
        if (full - 100 * most * int(size or 0), 100 * (left or 0)) == (share, over) or not left:
            return ordered.withColumn("target", F.when(stopped_now, F.col("source_size") * float(most)).otherwise((exact("weight") * F.lit(Decimal(share))).cast("double") / float(over)))
        share, over = full - 100 * most * int(size or 0), 100 * left


def settle_large(p: np.ndarray, x: np.ndarray, draw: random.Random, keep: int) -> None:
    """Settle documents much larger than most, largest first, while all others give way a little.

    The direction is the document's own, projected on the constraints' null-space.
    """
    inside = (p > 0) & (p < 1)
    for k in np.argsort(-x, kind="stable"):
        if not inside.any() or x[k] <= LARGE * x[inside].mean():
            return
        while inside[k] and inside.sum() > max(keep, 2):
            which = np.flatnonzero(inside)
            a = np.stack([np.ones(len(which)), x[which] / x[k]])
            own = which == k
            way = own - a.T @ np.linalg.lstsq(a @ a.T, a[:, own][:, 0], rcond=None)[0]
            room = np.where(way > 0, 1 - p[which], p[which]), np.where(way > 0, p[which], 1 - p[which])
            size = np.where(np.abs(way) > NEAR, np.abs(way), np.nan)
            if np.isnan(size).all():
                return
            forth, back = np.nanmin(room[0] / size), np.nanmin(room[1] / size)
            p[which] += (forth if draw.random() * (forth + back) < back else -back) * way
            p[p < NEAR], p[p > 1 - NEAR] = 0, 1
            inside = (p > 0) & (p < 1)


def fly(p: np.ndarray, x: np.ndarray, draw: random.Random, keep: int) -> list[float]:
    """``p``, moved until no three documents of sizes ``x``, or no more than ``keep``, are fractions."""
    settle_large(p, x, draw, keep)
    p, x = p.tolist(), x.tolist()
    waiting = [k for k in range(len(p)) if 0 < p[k] < 1]
    waiting.reverse()
    three: list[int] = []
    while len(waiting) + len(three) > keep:
        while len(three) < 3 and waiting:
            three.append(waiting.pop())
        if len(three) < 3:
            break
        a, b, c = three
        way = (x[b] - x[c], x[c] - x[a], x[a] - x[b])
        if not any(way):
            way = (1.0, -1.0, 0.0)
        moved = [(k, w) for k, w in zip(three, way, strict=True) if w]
        forth = min((1 - p[k]) / w if w > 0 else p[k] / -w for k, w in moved)
        back = min(p[k] / w if w > 0 else (1 - p[k]) / -w for k, w in moved)
        step = forth if draw.random() * (forth + back) < back else -back
        for k, w in moved:
            p[k] += step * w
            if p[k] < NEAR or p[k] > 1 - NEAR:
                p[k] = float(round(p[k]))
        three = [k for k in three if 0 < p[k] < 1]
    return p


def land(p: list[float], x: np.ndarray, near: float) -> None:
    """Settle all fractions: words as near as can be, or within ``near`` with documents in all as near as can be."""
    rest = [k for k in range(len(p)) if 0 < p[k] < 1]
    if not rest:
        return
    chance, size = np.array([p[k] for k in rest]), x[rest]
    choice = np.arange(1 << len(rest))[:, None] >> np.arange(len(rest)) & 1
    number = np.floor(np.abs(choice.sum(1) - chance.sum()))
    words = np.abs(choice @ size - chance @ size)
    # the first of equal choices
    best = np.lexsort((words, np.where(words <= near, number, np.inf)))[0] if (words <= near).any() else int(np.argmin(words))
    for k, yes in zip(rest, choice[best], strict=True):
        p[k] = float(yes)


def _flight(round_: int) -> Callable[[tuple, pa.Table], pa.Table]:
    def of_group(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("rank")
        x = rows.column("size").to_numpy().astype(float)
        last = rows.column("groups")[0].as_py() == 1
        p = fly(rows.column("p").to_numpy().copy(), x, random.Random(f"{round_}/{key[1].as_py()}/{key[0].as_py()}"), LANDED if last else 2)
        if last:
            land(p, x, NEAR_WORDS * rows.column("target")[0].as_py())
        return rows.set_column(rows.schema.get_field_index("p"), "p", pa.array(p, pa.float64()))

    return of_group


def mix(docs: DataFrame, size: Column, id_col: str = "doc_id", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, most: int = MOST) -> DataFrame:
    """(``id_col``, size, source_size, target, copies): how often the mix takes each document.

    ``size`` is a column over ``docs`` (a long, 0 or more; null counts as 0).
    Sources are ordered by code point, null last, for their weights.  ``copies`` is 0
    to ``most``.  Equal rows are documents each; ids may be null.  Without
    documents there are no rows; a source without words has target 0 and copies 0.
    Other columns of ``docs`` are ignored, whatever their names.
    """
    # "=" sorts before ">", so names come before null
    key = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(">"))
    rows = staged(docs.select(F.col(id_col).alias("id"), key.alias("key"), F.coalesce(size.cast("long"), F.lit(0).cast("long")).alias("size")), "mix-sizes")
    sources = staged(source_targets(rows.groupBy("key").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs")), weights, percent, most), "mix-targets")
    n_sources, largest, total = sources.agg(F.count("*"), F.max("docs"), F.sum("docs")).head()
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    known = sources.select("key", "source_size", "target", F.floor(each).cast("int").alias("base"), (each - F.floor(each)).alias("p"), F.col("docs").alias("n_source"))
    known = known.withColumn("p", F.when(F.col("p") < NEAR, 0.0).when(F.col("p") > 1 - NEAR, 1.0).otherwise(F.col("p")))
    place = F.xxhash64(F.lit(17), "id", "size")
    laid, _ = ranked(rows.withColumn("place", place), ["key"], ["place", "id", "size"], "mix-ranked")
    laid = join_heavy(laid.drop("n", "place"), known, "key", "n_source", total or 0, n_sources)
    groups = lambda n: F.ceil(F.col("n_source") / n).cast("long")
    now = laid.withColumns({"group": F.floor(F.col("rank") / GROUP).cast("long"), "groups": groups(GROUP)}).drop("n_source")
    open_ = "p > 0 and p < 1"
    settled, count, round_ = now.where(f"not ({open_})"), -(-(largest or 0) // GROUP), 0
    now = now.where(open_)
    while count:
        flown = staged(now.groupBy("key", "group").applyInArrow(_flight(round_), now.schema), "mix-flight")
        settled = settled.unionByName(flown.where(f"not ({open_})"))
        now = flown.where(open_).withColumns({"group": F.floor(F.col("group") / MERGED).cast("long"), "groups": F.ceil(F.col("groups") / MERGED).cast("long")})
        count, round_ = 0 if count == 1 else -(-count // MERGED), round_ + 1
    discard(rows)
    return settled.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("base") + F.col("p").cast("int")).alias("copies"))


def mixed_words(docs: DataFrame) -> DataFrame:
    """The mix of documents by their words: doc_id, size, source_size, target, taken."""
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORDS)), F.lit(0)).cast("long")
    return mix(docs, size).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
