"""Connected components of links that live in a table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rookery.llm.common import discard, join_heavy, staged

#: Rounds after which something must be wrong; each halves distances.
MOST_ROUNDS = 60
#: Links that a task contracts at once.
CONTRACTED = 1_000_000


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components with fewest links: every node with the smallest one that it reaches."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label != (up := label[label])).any():
            label = up
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    rows = 0

    def flush() -> pa.RecordBatch:
        ends = [np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in held]) for k in (0, 1)]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in stars(*ends)], names=["u", "v"])

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= CONTRACTED:
            yield flush()
            rows = 0
    if rows:
        yield flush()


def _labels(edges: DataFrame) -> DataFrame:
    """(node, label) of stars."""
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b: long): label is the smallest node of its component.

    Every task first contracts the links that it holds.  If fewer than
    ``CONTRACTED`` are left, one task contracts them.  Else rounds of two steps
    (large star and small star) until all that is left are stars: every node
    tells its larger, then its smaller neighbours of the smallest one it knows.
    The rows of a hub are not gathered.  Each round is written to the shared
    folder, and the one before removed.  Null ends and links of a node with
    itself are left out; without links there are no rows.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a is not null and b is not null and a <> b")
    edges = staged(edges.mapInArrow(_contract, "u long, v long"), "stars")
    if edges.count() < CONTRACTED:
        before, edges = edges, staged(edges.coalesce(1).mapInArrow(_contract, "u long, v long"), "stars")
        discard(before)
        return _labels(edges)
    for _ in range(MOST_ROUNDS):
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("under")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("under")))
        known = ends.groupBy("node").agg(F.sum("under").alias("under"), F.count("*").alias("n"))
        open_, n = known.agg(F.max((F.col("under") > 1) | ((F.col("under") > 0) & (F.col("n") > 1))), F.sum("n")).head()
        if not open_:
            return _labels(edges)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n"))
        large = join_heavy(both, least, "u", "n", n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        pair = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        fewer = join_heavy(large, root, "u", "n", n).select(F.explode(pair).alias("e")).select("e.*").where("u <> v").distinct()
        before, edges = edges, staged(fewer.mapInArrow(_contract, "u long, v long"), "stars")
        discard(before)
    raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
