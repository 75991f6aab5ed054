"""Rounds of a walk shuffle what they find, not the edges nor the nodes that are known."""

from __future__ import annotations

from pyspark.sql import functions as F

from rookery.operators import graph, landmarks
from rookery.plans.staging import discard


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_round_shuffles_no_edges_and_no_known_nodes(spark):
    e = graph.by_source(spark.range(500).select(F.col("id").alias("src"), (F.col("id") * 7 % 501).alias("dst")))
    known = graph.in_buckets(spark.range(50).select(F.col("id").alias("node"), F.lit(0).alias("hops")), e.buckets, "hops")
    met = graph.leads_to(known.select("node"), e)
    assert "Exchange" not in _plan(met)
    new = graph.unknown(met.select(F.col("dst").alias("node")).repartition(e.buckets, "node"), known)
    assert _plan(new).count("Exchange") == 1  # only the ends that were met
    discard(e, known)


def test_folded_rounds_keep_all_nodes_and_leave_no_tables(spark, monkeypatch):
    monkeypatch.setattr(graph, "FOLD", 2)
    before = {t.name for t in spark.catalog.listTables()}
    chain = spark.createDataFrame([(k, k + 1) for k in range(7)] + [(7, 0), (3, 3)], "src long, dst long")
    got = {r.node: r.hops for r in graph.distances(chain, spark.createDataFrame([(0,)], "node long")).collect()}
    assert got == {k: k for k in range(8)}
    tree = spark.createDataFrame([(0, 0, None), (1, 1, 0), (2, 1, 0), (3, 2, 2), (4, 3, 3), (5, 3, 3)], "node long, hops int, parent long")
    assert {r.node: r.weight for r in landmarks.leaf_weights(tree).collect()} == {0: 3, 1: 1, 2: 2, 3: 2, 4: 1, 5: 1}
    levels = tree.withColumnRenamed("hops", "level")
    assert {r.node: r.runs for r in graph.descendants(levels).collect()} == {0: 5, 1: 0, 2: 3, 3: 2, 4: 0, 5: 0}
    assert graph.distances(chain, spark.createDataFrame([], "node long")).count() == 0
    assert {t.name for t in spark.catalog.listTables()} == before
