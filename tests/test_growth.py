"""Work that must not grow faster than its input."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from rookery.functions import lexing
from rookery.functions import text as T
from rookery.operators import ownership
from rookery.queries import QUERIES
import rookery.more_queries  # noqa: F401  registers its queries


def test_indents_are_read_from_the_places_own_line(spark):
    df = spark.createDataFrame([("   \nfn a {\n}", 4, 12)], "text string, start int, end int").selectExpr("*", "cast(null as int) owner_start", "cast(null as int) owner_end")
    assert [b.text for b in lexing.item_source(df).head().blocks] == ["fn a {\n}"]
    assert lexing.quoted(df).head().quote == "fn a {\n}"


def test_items_behind_long_lines_and_of_many_lines(spark):
    body = F.concat(F.lit("fn a() {\n"), F.repeat(F.lit("        x;\n"), F.lit(20_000)), F.lit("    }"))
    lead = F.concat(F.repeat(F.lit("x"), F.lit(400_000) + F.col("id").cast("int")), F.lit("\n    "))
    df = spark.range(1).select(F.concat(lead, body).alias("text"), F.length(lead).alias("start"), (F.length(lead) + F.length(body)).alias("end"))
    df = df.selectExpr("*", "cast(null as int) owner_start", "cast(null as int) owner_end")
    began = time.time()
    assert lexing.item_source(df).head().blocks[0].text == "fn a() {\n" + "    x;\n" * 20_000 + "}"
    assert df.select(T.dedent(F.substring("text", F.col("start") - 3, F.length("text"))).alias("t")).head().t == "fn a() {\n" + "    x;\n" * 20_000 + "}"
    assert time.time() - began < 30


def test_rows_of_the_band_are_aggregated_before_they_are_read(spark, data):
    """The plan of what is read back has no aggregate of lineitem in it."""
    assert "lineitem.parquet" not in QUERIES["q_band_diff"](spark, data)._jdf.queryExecution().executedPlan().toString()


def test_ties_are_dealt_by_ends_and_roots_only(spark):
    """Whether ends are drawn needs no join with the ties, and the last step has as many tasks as asked for."""
    refs = spark.createDataFrame([(1, 2, 3), (2, 1, 1), (1, 3, 2), (3, 4, 1)], "src long, dst long, w long")
    roots = spark.createDataFrame([(k, k) for k in (1, 2, 3, 4)], "node long, root long")
    out = ownership.ties(refs, roots, spark.createDataFrame([(1,), (2,)], "node long"), 7)
    assert sorted(map(tuple, out.collect())) == [(1, 2, 1, "both"), (2, 1, 3, "both"), (3, 1, 2, "unseen_out"), (4, 3, 1, "neither")]
    assert "hashpartitioning(definition" in (plan := out._jdf.queryExecution().executedPlan().toString()) and ", 7), REPARTITION_BY_NUM" in plan


def test_what_is_lit_reads_links_that_are_made_once(spark, data):
    assert "lineitem.parquet" not in QUERIES["q_lit"](spark, data)._jdf.queryExecution().executedPlan().toString()
