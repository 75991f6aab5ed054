"""The altitudes' operators on hand-built cases, and the ring layout against plain Python."""

from __future__ import annotations

import math
import random
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from rookery.functions import predicates as P
from rookery.operators import calls, functions, graph, intervals, landmarks, ownership, paper


def test_contracts_take_the_first_other_clause_of_their_own_trait(spark):
    df = spark.createDataFrame
    traits = df([(1, "Show"), (2, "Show")], "id long, name string")
    clauses = df([(1, 0, "go", 10), (1, 1, "go", 11), (2, 0, "go", 20), (1, 2, "at", 12)], "trait long, ord int, name string, mark long")
    methods = df([(5, "go", 10, "Show"), (5, "at", 30, "Show"), (6, "go", 40, "Show"), (6, "at", 41, "Other")], "ty long, name string, mark long, promise string")
    implements = df([(1, 5), (2, 6)], "trait long, ty long")
    got = {tuple(r) for r in functions.contracts(implements, traits, clauses, methods).collect()}
    assert got == {(11, 10), (12, 30), (20, 40)}  # 10 is its own clause, so the next one; trait 2 has none of trait 1's


def test_edges_to_what_has_no_home_stay_single(spark):
    edges = spark.createDataFrame([(1, 2, True, 4), (1, 9, True, 5), (1, 3, False, 6), (2, 9, True, 7)], "src long, dst long, solid boolean, w long")
    inside = spark.createDataFrame([(1,)], "node long")
    homes = spark.createDataFrame([(2, "m"), (3, "m"), (1, "n"), (9, None)], "node long, module string")
    assert {tuple(r) for r in calls.boundary_bundles(edges, inside, homes).collect()} == {("m", False, True, 1), ("m", False, False, 6)}
    assert {tuple(r) for r in calls.single_edges(edges, inside, homes).collect()} == {(1, 9, True, 5), (2, 9, True, 7)}


def test_resting_wires(spark):
    rows = [(b, l, a, p, d, n, c) for b in (0, 1) for l in (0, 1) for a in (0, 1) for p in (0, 1) for d in (0, 1) for n in (0, 1) for c in (0, 1)]
    df = spark.createDataFrame([tuple(map(bool, r)) for r in rows], ", ".join(f"{x} boolean" for x in "blapdnc"))
    for r in df.withColumn("on", P.resting_drawn(*(F.col(x) for x in "blapdnc"))).collect():
        b, l, a, p, d, n, c = r[:7]
        assert r.on == ((not p) if b else True if l or a else False if p else n if d else not c)
    seen = df.select(P.wire_visible(F.col("b"), F.col("l"), F.col("a")).alias("v"), "b", "l", "a").collect()
    assert all(r.v == (r.b or r.l or r.a) for r in seen)


def test_a_removed_edge_is_an_event_but_no_way(spark):
    links = spark.createDataFrame([(2, 1, "normal", None), (3, 2, "normal", "removed"), (4, 3, "dev", None), (3, 2, "dev", None), (7, 8, "normal", "added"), (1, 6, "build", None)], "src long, dst long, kind string, event string")
    start = spark.createDataFrame([(1,)], "node long")
    got = {tuple(r) for r in landmarks.drawn_edges(links.where("not (src = 3 and kind = 'dev')"), start, "root").collect()}
    assert got == {(2, 1, "user", "normal", None), (3, 2, "user", "normal", "removed"), (7, 8, "event", "normal", "added")}
    whole = {tuple(r) for r in landmarks.drawn_edges(links, start, "root").collect()}
    assert (4, 3, "user", "dev", None) in whole and (3, 2, "user", "normal", "removed") in whole


def test_held_only_from_off_the_paper_is_narrower(spark):
    items = spark.createDataFrame([(1, "struct", "m"), (2, "struct", "m")], "id long, kind string, frame string")
    holds = spark.createDataFrame([(2, 2, "owns", 1)], "src long, dst long, kind string, fields long")
    off = spark.createDataFrame([(9, 1, "owns")], "src long, dst long, kind string")
    assert {r.node: r.tier for r in ownership.data_tiers(holds, items, off).collect()} == {1: "narrower", 2: "root"}


def test_fingerprints_count_repeated_rows_and_tell_nulls(spark):
    of = lambda rows: intervals.fingerprint(spark.createDataFrame(rows, "k string, v string"), "k", "v").head().fingerprint
    assert of([("a", "x"), ("a", "x")]) != of([]) and of([("a", None)]) != of([("a", "")])
    assert of([("a", "x"), ("b", "y")]) == of([("b", "y"), ("a", "x")])


def test_ties_rest_by_direction_only_if_something_changed(spark):
    ties = spark.createDataFrame([(1, 2, 5), (2, 3, 6)], "definition long, holder long, n long")
    flared, none = spark.createDataFrame([(2,)], "node long"), spark.createDataFrame([], "node long")
    rests = lambda f, to: {(r.definition, r.holder) for r in paper.resting_ties(ties, f, to).where("rests").collect()}
    assert (rests(flared, "in"), rests(flared, "out"), len(rests(flared, "both")), len(rests(none, "in"))) == ({(2, 3)}, {(1, 2)}, 2, 2)


def test_ring_caps(spark):
    deepest = spark.createDataFrame([("a", 2), ("b", 7)], "name string, hops int")
    assert [landmarks.ring_cap(deepest, x) for x in (None, "ring:2", "ring:9", "a", "a+b", "z")] == [4, 4, 9, 4, 8, 4]


def walked(edges, nodes, root, members):
    """A queue: from the root, then from members it didn't reach, then from the rest."""
    out, hops, parent, queue = defaultdict(list), {}, {}, deque(root)
    for a, b in sorted(set(edges)):
        if a != b:
            out[a].append(b)
    hops.update(dict.fromkeys(root, 0))
    while True:
        while queue:
            a = queue.popleft()
            for b in out[a]:
                if b not in hops:
                    hops[b], parent[b] = hops[a] + 1, a
                    queue.append(b)
        seats, at = sorted(n for n in members if n not in hops), 1
        if not seats:
            seats, at = sorted(n for n in nodes if n not in hops), max(hops.values(), default=0) + 1
        if not seats:
            return hops, parent
        hops.update(dict.fromkeys(seats, at))
        queue.extend(seats)


def ring_walk(spark, edges, nodes, root, members):
    of = lambda ids: spark.createDataFrame([(n,) for n in ids], "node long")
    got = graph.ring_walk(spark.createDataFrame(edges, "src long, dst long"), of(nodes), of(members), of(root))
    return {x.node: (x.hops, x.parent) for x in got.collect()}


def test_of_several_discoverers_the_first_in_the_queue_is_the_parent(spark):
    edges = [(0, 1), (0, 5), (1, 9), (5, 3), (9, 20), (3, 20)]
    assert ring_walk(spark, edges, [0, 1, 3, 5, 9, 20], [0], [])[20] == (3, 9)
    # what the root has found keeps its parent and its distance when a later seat leads to it too
    assert ring_walk(spark, [(0, 1), (1, 2), (7, 2), (7, 8)], [0, 1, 2, 7, 8, 9], [0], [7]) == {0: (0, None), 1: (1, 0), 2: (2, 1), 7: (1, None), 8: (2, 7), 9: (3, None)}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_ring_walk_is_a_queue(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(90), r.randrange(90)) for _ in range(120)] + [(k, k + 1) for k in range(100, 130)]
    hops, parent = walked(edges, range(140), [5], range(40, 105))
    assert ring_walk(spark, edges, range(140), [5], range(40, 105)) == {n: (hops[n], parent.get(n)) for n in range(140)}


def test_event_labels_take_turns_over_all_edges(spark):
    rows = [(a, b, "added" if (a + b) % 3 else None) for a in range(9) for b in range(7)]
    want = {(a, b): landmarks.LABEL_PLACES[k % 3] for k, (a, b, _) in enumerate(sorted(r for r in rows if r[2]))}
    got = landmarks.event_labels(spark.createDataFrame(rows, "src long, dst long, event string").repartition(5)).collect()
    assert {(x.src, x.dst): x["at"] for x in got} == want


def test_heads_of_cycles(spark):
    r = random.Random(3)
    for n in (1, 40, 200):
        up = {k: r.choice([None, r.randrange(n), r.randrange(n)]) for k in range(n)} | {1000 + k: 1000 + (k + 1) % 37 for k in range(37)}
        up = {k: v for k, v in up.items() if v != k}
        want = set()
        for k in up:
            at, seen = up[k], []
            while at is not None and at not in seen and at != k:
                seen.append(at)
                at = up.get(at)
            if at == k:
                want.add(max([*seen, k]))
        got = graph.cycle_heads(spark.createDataFrame(list(up.items()), "node long, parent long")).collect()
        assert sorted(x.node for x in got) == sorted(want)


def test_components_are_those_of_a_union(spark):
    r = random.Random(4)
    edges = [(r.randrange(150), r.randrange(150)) for _ in range(90)] + [(200 + k, 201 + k) for k in range(40)]
    label = {n: n for n in range(260)}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = graph.components(spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(n,) for n in label], "node long"))
    assert {x.node: x.label for x in got.collect()} == label


def test_layout_is_that_of_a_plain_walk(spark):

    r = random.Random(2)
    edges = sorted({(a, b) for a, b in ((r.randrange(80), r.randrange(80)) for _ in range(130)) if a != b})
    hops, parent = walked(edges, range(103), [0], range(60, 102))
    kids = {n: sorted(k for k in hops if parent.get(k) == n) for n in hops}
    weight = {}
    for n in sorted(hops, key=lambda n: -hops[n]):
        weight[n] = max(sum(weight[k] for k in kids[n]), 1.0)
    angle = {}

    def place(group, start, width):
        total = max(sum(math.sqrt(weight[g]) for g in group), 1.0)
        for g in group:
            w = width * math.sqrt(weight[g]) / total
            angle[g] = start + w / 2
            place(kids[g], start, w)
            start += w

    place(sorted(n for n in hops if n not in parent), -math.tau / 4, math.tau)
    radii = [0.0]
    for ring in range(1, 5):
        at = sorted(angle[n] for n in hops if min(hops[n], 4) == ring)
        gaps = sorted([b - a for a, b in zip(at, at[1:], strict=False)] + [at[0] + math.tau - at[-1]])
        needed = landmarks.STAR_ROOM / max(gaps[len(gaps) // 4], 1e-4) if len(at) > 1 else 0.0
        radii.append(min(max(needed, radii[-1] + 150), radii[-1] + 380))
    tree = spark.createDataFrame([(n, hops[n], parent.get(n)) for n in hops], "node long, hops int, parent long")
    got = {x.node: x for x in landmarks.radial_layout(tree).collect()}
    assert set(got) == set(hops)
    for n, x in got.items():
        assert math.isclose(x.angle, angle[n], abs_tol=1e-9) and math.isclose(x.radius, radii[min(hops[n], 4)], rel_tol=1e-9)
        assert math.isclose(x.x, x.radius * math.cos(x.angle), abs_tol=1e-6)
