"""The step that counts links keeps its tasks' size as tables grow."""

from rookery import row_queries
from rookery.plans import fixtures


def test_links_are_counted_in_one_shuffle_and_more_tasks_as_they_grow(spark, monkeypatch):
    found = row_queries.q_pair_counts(spark, "/root/testdata/sf0.01")
    # by supplier, then by ends; no third one to turn links, none to add up kinds
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    monkeypatch.setattr(fixtures, "TASK_ROWS", 1_000)
    assert fixtures.relation(spark, "/root/testdata/sf0.01", "fx_edge").rdd.getNumPartitions() == 61
