"""The nesting forest: without rings in the engine only, with rings as the greedy walk in plain Python."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest

from rookery.operators import dependency, ownership


def _greedy(holds, frame):
    """Nodes in order of id take the heaviest owner of their frame that closes no ring."""
    weight, held = defaultdict(int), defaultdict(set)
    for a, b, w in holds:
        if a != b:
            weight[b, a] += w
            held[b].add(a)
    vocab = {n for n, by in held.items() if len(by) > ownership.HELD_CAP}
    nest, out = {}, {}
    for n in sorted(frame):
        mine = sorted((-w, a) for (b, a), w in weight.items() if b == n and frame[a] == frame[n] and not vocab & {a, n})
        for _, a in mine:
            at = a
            while at is not None and at != n:
                at = nest.get(at)
            if at is None:
                nest[n] = a
                break
        if mine:
            out[n] = (nest.get(n), n not in nest)
    return out


def _forest(spark, holds, frame):
    h = spark.createDataFrame([(a, b, "owns", w) for a, b, w in holds], "src long, dst long, kind string, fields long")
    return ownership.nesting_forest(h, spark.createDataFrame([(n, "struct", f) for n, f in frame.items()], "id long, kind string, frame string"))


def test_no_frame_is_gathered_where_no_ring_can_be(spark):
    holds, frame = [(k // 2, k, 1) for k in range(2, 200)], dict.fromkeys(range(1, 200), "m")
    df = _forest(spark, holds, frame)
    assert "FlatMapGroupsIn" not in df._jdf.queryExecution().toString()
    assert {r.node: (r.parent, r.ringed) for r in df.collect()} == _greedy(holds, frame)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_rings_are_the_greedy_walk(spark, seed):
    r = random.Random(seed)
    frame = {n: r.choice("ab") for n in range(120)} | dict.fromkeys(range(200, 206), "a")
    holds = [(r.randrange(120), r.randrange(120), r.randrange(1, 4)) for _ in range(200)]
    holds += [(200, 201, 1), (201, 200, 1), (202, 203, 2), (203, 204, 1), (204, 202, 1), (203, 205, 1)]
    want = _greedy(holds, frame)
    assert any(ringed for _, ringed in want.values())
    assert {x.node: (x.parent, x.ringed) for x in _forest(spark, holds, frame).collect()} == want


def test_items_held_only_off_the_reading_are_narrower(spark):
    holds = lambda *of: spark.createDataFrame([(a, b, k, 1) for a, b, k in of], "src long, dst long, kind string, fields long")
    items = spark.createDataFrame([(n, "static" if n == 5 else "struct", "m") for n in range(1, 6)], "id long, kind string, frame string")
    off = holds((9, 1, "owns"), (9, 2, "owns"), (9, 3, "borrows"), (9, 4, "shares"), (9, 5, "owns"))
    got = ownership.data_tiers(holds((1, 2, "owns")), items, off)
    assert {r.node: r.tier for r in got.collect()} == {1: "narrower", 2: "nested", 3: "root", 4: "narrower", 5: "root"}


def test_search_leaves_out_ghosts_and_puts_members_first(spark):
    of = [(1, "alpha", 5, False, False), (2, "alto", 1, True, False), (3, "alum", 9, True, True), (4, "royal", 99, True, False), (5, "zeta", 7, True, False)]
    items = spark.createDataFrame(of, "id long, name string, fan_in long, is_member boolean, ghost boolean")
    assert [r.id for r in dependency.search(items, "AL", limit=9, weight="fan_in").collect()] == [2, 1, 4]
    assert [r.id for r in dependency.search(items.drop("ghost", "is_member"), "al", limit=2, weight="fan_in").collect()] == [3, 1]
