"""Structural operators on small hand-built graphs, and against plain Python models on random ones."""

from __future__ import annotations

import random
from collections import deque

import pandas as pd
import pytest
from pyspark.sql import functions as F

from rookery.functions import text as T
from rookery.operators import calls, dependency, editions, graph, intervals, ownership
from rookery.sources import packages
from rookery.streaming import session


def rows(df, *cols):
    return sorted(map(tuple, (df.select(*cols) if cols else df).collect()), key=repr)


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "node long")


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, k, 1, e) for a, b, k, e in pairs], "src long, dst long, kind string, w long, event string")


def plain(spark, pairs):
    return spark.createDataFrame([(a, b, w) for a, b, w in pairs], "src long, dst long, w long")


def test_diamond_has_fewest_steps(spark):
    e = plain(spark, [(0, 1, 1), (0, 3, 1), (1, 2, 1), (2, 3, 1)])
    assert rows(graph.rings(e, ids(spark, 0, 1, 2, 3), ids(spark, 0), ids(spark, 0)), "node", "hops") == [(0, 0), (1, 1), (2, 2), (3, 1)]


def test_unreached_members_stand_beside_the_root_and_islands_outside(spark):
    e = plain(spark, [(0, 1, 1), (1, 2, 1), (2, 3, 1), (10, 11, 1), (20, 21, 1)])
    got = rows(graph.rings(e, ids(spark, 0, 1, 2, 3, 10, 11, 20, 21), ids(spark, 0, 10), ids(spark, 0), 2), "node", "hops", "ring")
    assert got == sorted([(0, 0, 0), (1, 1, 1), (2, 2, 2), (3, 3, 2), (10, 1, 1), (11, 2, 2), (20, 4, 2), (21, 4, 2)], key=repr)


def test_virtual_workspace_has_no_root(spark):
    got = rows(graph.rings(plain(spark, [(1, 3, 1)]), ids(spark, 1, 2, 3), ids(spark, 1, 2), ids(spark).limit(0)), "node", "hops")
    assert got == [(1, 1), (2, 1), (3, 2)]


def test_call_tiers(spark):
    e = plain(spark, [(0, 1, 2), (1, 2, 5), (2, 2, 4), (7, 8, 1), (8, 7, 1)])
    got = rows(graph.tiers(e, ids(spark, 0, 1, 2, 7, 8)), "node", "tier", "depth")
    assert got == [(0, "entry", 0), (1, "deep", 1), (2, "deep", 2), (7, "ring", 3), (8, "ring", 3)]
    assert rows(calls.way_in_reach(e, ids(spark, 0, 1, 2)), "node", "runs") == [(0, 2), (1, 1), (2, 0)]


def _reach(pairs, nodes):
    """The walk in plain Python: a queue, heaviest edges first."""
    weight: dict = {}
    for a, b, w in pairs:
        if a != b and a in nodes and b in nodes:
            weight[a, b] = weight.get((a, b), 0) + w
    out = {n: sorted((b for a, b in weight if a == n), key=lambda b: (-weight[n, b], b)) for n in nodes}
    called = {b for _, b in weight}
    kids, seen, order = {n: [] for n in nodes}, set(), []
    for start in [sorted(n for n in nodes if n not in called)] + [[n] for n in sorted(nodes)]:
        queue = deque(n for n in start if n not in seen)
        seen |= set(queue)
        order += queue
        while queue:
            at = queue.popleft()
            for b in out[at]:
                if b not in seen:
                    seen.add(b)
                    kids[at].append(b)
                    order.append(b)
                    queue.append(b)
    runs: dict = {}
    for n in reversed(order):
        runs[n] = sum(1 + runs[k] for k in kids[n])
    return runs


@pytest.mark.parametrize("seed", [1, 2])
def test_way_in_reach_is_the_queue_walk(spark, seed):
    r = random.Random(seed)
    nodes = set(range(25))
    pairs = [(r.randrange(25), r.randrange(25), r.randrange(1, 4)) for _ in range(35)] + [(30, 31, 1)]
    got = dict(rows(calls.way_in_reach(plain(spark, pairs), ids(spark, *nodes)), "node", "runs"))
    assert got == _reach(pairs, nodes)


def _holds(spark, triples):
    return spark.createDataFrame([(a, b, k, 1) for a, b, k in triples], "src long, dst long, kind string, fields long")


def _items(spark, items):
    return spark.createDataFrame(items, "id long, kind string, frame string")


@pytest.mark.parametrize(
    ("holds", "items", "want"),
    [
        ([(1, 2, "owns")], [(1, "struct", "m"), (2, "struct", "m")], {1: "root", 2: "nested"}),
        ([(1, 2, "shares")], [(1, "struct", "m"), (2, "struct", "m")], {1: "root", 2: "shared"}),
        ([(1, 2, "owns")], [(1, "struct", "m"), (2, "struct", "n")], {1: "root", 2: "afar"}),
        ([(1, 2, "borrows")], [(1, "struct", "m"), (2, "struct", "m")], {1: "root", 2: "root"}),
        ([(1, 2, "owns"), (2, 1, "owns")], [(1, "struct", "m"), (2, "struct", "m")], {1: "nested", 2: "ring"}),
        ([(k, 9, "owns") for k in range(1, 6)], [(k, "struct", "m") for k in (1, 2, 3, 4, 5, 9)], {1: "root", 2: "root", 3: "root", 4: "root", 5: "root", 9: "vocab"}),
        ([(1, 2, "owns")], [(1, "static", "m"), (2, "struct", "m")], {1: "root", 2: "nested"}),
    ],
)
def test_data_tiers(spark, holds, items, want):
    assert dict(rows(ownership.data_tiers(_holds(spark, holds), _items(spark, items)), "node", "tier")) == want


def test_rows_that_go_keep_a_seat_between_their_neighbours(spark):
    schema = "item long, ord int, name string, decl string"
    base = spark.createDataFrame([(7, k, n, "i8") for k, n in enumerate("abcd")] + [(8, 0, "p", "i8"), (8, 1, "q", "i8")], schema)
    live = spark.createDataFrame([(7, k, n, "i8") for k, n in enumerate("acx")] + [(8, 0, "p", "i16"), (8, 1, "q", "i8")], schema)
    want = [(7, "removed", 1, "b"), (7, "removed", 2, "d"), (7, "added", 2, "x"), (8, "added", 0, "p"), (8, "removed", 0, "p")]
    assert rows(editions.row_diff(base, live), "item", "event", "seat", "name") == sorted(want, key=repr)


def test_longest_prefix_is_by_segment(spark):
    p = spark.createDataFrame([("libs/corely/a.rs",), ("libs/core/in/a.rs",), ("libs/core/x.rs",)], "path string")
    o = spark.createDataFrame([("libs/core",), ("libs/core/in",)], "owner string")
    assert rows(dependency.longest_prefix(p, o)) == [("libs/core/in/a.rs", "libs/core/in"), ("libs/core/x.rs", "libs/core"), ("libs/corely/a.rs", None)]
    assert rows(dependency.longest_prefix(p, o.unionByName(spark.createDataFrame([(".",)], "owner string"))))[-1] == ("libs/corely/a.rs", ".")


def test_module_paths_and_headers(spark):
    paths = {"src/main.rs": [], "src/bird.rs": ["bird"], "nest/src/egg/shell.rs": ["egg", "shell"], "nest/tests/egg/mod.rs": ["egg"]}
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert dict(rows(df.select("p", T.module_path(F.col("p"))))) == paths
    headers = {"impl Fly for Rook": ("Fly", "Rook", "Fly"), "impl Into<Box<dyn air::Wing>> for Rook": ("Into<Box<dyn air::Wing>>", "Rook", "Into"), "impl air::Fly for Rook<T>": ("air::Fly", "Rook<T>", "air"), "impl Rook": (None, None, None)}
    h = spark.createDataFrame([(x,) for x in headers], "h string")
    got = h.select("h", *T.header_promise(F.col("h")), T.promises(F.col("h"))).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == headers
    assert h.limit(1).select(T.bare_trait(F.lit("air::Fly<T>"))).head()[0] == "Fly"


def test_text_helpers(spark):
    df = spark.createDataFrame([("    a\n      b\n\n    c",)], "t string")
    assert df.select(T.dedent(F.col("t"))).head()[0] == "a\n  b\n\nc"
    assert spark.range(1).select(T.line_number(F.lit("é\nb\nc"), F.lit(4)), T.plural(F.lit(2), "box")).head() == (2, "2 boxes")
    short = spark.range(1).select(T.compact(F.lit("é " * 40))).head()[0]
    assert short.endswith("…") and len(short[:-1].encode()) <= 48


def test_intervals(spark):
    spans = spark.createDataFrame([("f", 0, 5000, 1), ("f", 10, 20, 2), ("f", 15, 18, 3)], "file string, start long, end long, id long")
    points = spark.createDataFrame([("f", 16), ("f", 20), ("f", 21), ("f", 5001), ("g", 1)], "file string, at long")
    assert rows(intervals.innermost(points, spans)) == sorted([("f", 16, 3), ("f", 20, 2), ("f", 21, 1), ("f", 5001, None), ("g", 1, None)], key=repr)
    over = spark.createDataFrame([("f", 0, 5), ("f", 3, 8), ("f", 5, 9), ("f", 5, 9)], "file string, start long, end long")
    assert rows(intervals.without_overlaps(over)) == [("f", 0, 5), ("f", 5, 9)]


def test_ranges_of_a_file_against_all_pairs(spark):
    from rookery.operators import attribution

    r = random.Random(5)
    points = [(r.choice("fg"), r.randrange(9000)) for _ in range(200)] + [("f", 100), ("f", 100), ("none", 5)]
    ranges = [(f, a, a + r.choice([0, 1, 40, 3000])) for f, a in ((r.choice("fgh"), r.randrange(9000)) for _ in range(12))] + [("f", 100, 101), ("g", 50, 10)]
    p = spark.createDataFrame(points, "file string, at long")
    s = spark.createDataFrame(ranges, "file string, start long, end long")
    want = [x for x in points if not any(f == x[0] and a <= x[1] < b for f, a, b in ranges)]
    assert rows(attribution.outside(p, s)) == sorted(want, key=repr)
    kept: dict = {}
    for f, a, b in sorted(set(ranges)):
        if f not in kept or a >= kept[f][-1][1]:
            kept.setdefault(f, []).append((a, b))
    assert rows(intervals.without_overlaps(s)) == sorted(((f, a, b) for f, x in kept.items() for a, b in x), key=repr)
    some = s.unionByName(spark.createDataFrame([("k", None, 4), ("k", 5, None), (None, 1, 2)], "file string, start long, end long"))
    assert [x for x in rows(intervals.without_overlaps(some)) if x[0] in ("k", None)] == [(None, 1, 2)]


def test_links_of_a_file_against_all_pairs(spark):
    from rookery.functions import lexing

    r = random.Random(6)
    run = [("f", k, a, a + r.choice([4, 30, 2500]), r.randrange(4)) for k, a in enumerate(r.randrange(8000) for _ in range(60))]
    span = [("f", a, a + 3, r.randrange(4)) for a in (r.randrange(8000) for _ in range(60))]
    got = lexing.linked(spark.createDataFrame(run, "file string, run int, start int, end int, item int"), spark.createDataFrame(span, "file string, start int, end int, target int"))
    want = [(k, t) for _, k, a, b, item in run for _, s, e, t in span if a <= s and e <= b and t != item]
    assert rows(got, "run", "target") == sorted(want, key=repr)


def test_fingerprint_ignores_order(spark):
    df = spark.createDataFrame([("a", "1"), ("b", "2")], "k string, c string")
    one = intervals.fingerprint(df, "k", "c").head()
    assert one == intervals.fingerprint(df.orderBy(F.desc("k")), "k", "c").head()
    assert one != intervals.fingerprint(df.withColumn("c", F.lit("x")), "k", "c").head()


def test_manifests(spark):
    text = '[dependencies]\na = "1"\nb = { path = "../b" }\nc = { workspace = true }\nd = {}\n[target."x".dependencies]\na = "2"\n[dev-dependencies]\ne = { git = "u" }'
    files = spark.createDataFrame([("m", text), ("bad", "["), ("null", None)], "path string, text string")
    assert rows(packages.manifests(files), "path", "kind", "name", "req") == [("m", "dev", "e", "u"), ("m", "normal", "a", "2"), ("m", "normal", "b", "../b"), ("m", "normal", "c", "workspace"), ("m", "normal", "d", "*")]


def test_metadata(spark, tmp_path):
    doc = """{"packages":[{"id":"p a","name":"a","version":"1"},{"id":"p b","name":"b","version":"2"}],"workspace_members":["p a"],
    "resolve":{"nodes":[{"id":"p a","deps":[{"name":"b","pkg":"p b","dep_kinds":[{"kind":null},{"kind":null},{"kind":"dev"},{"kind":null}]}]},{"id":"p b","deps":[]}],"root":"p a"}}"""
    (tmp_path / "m.json").write_text(doc)
    meta = packages.read_metadata(spark, f"file://{tmp_path}/m.json")
    assert rows(packages.crates(meta), "id", "is_member") == [("a@1", True), ("b@2", False)]
    assert rows(packages.links(meta)) == [("a@1", "b@2", "dev"), ("a@1", "b@2", "normal"), ("a@1", "b@2", "normal")]


def test_trails_in_batch_and_stream(spark, tmp_path):
    steps, at = [], 0
    for s in ["x", "y", "x", "y", "y", "z", "y", "w"]:
        steps, at = session.note(steps, at, s)
    assert (steps, at) == (["x", "y", "w"], 2)
    r = random.Random(3)
    events = [(k, k % 3, r.choice("vabc")) for k in range(60)]
    pd.DataFrame(events, columns=["id", "who", "what"]).to_parquet(tmp_path / "e.parquet")
    df = spark.read.parquet(f"file://{tmp_path}/e.parquet")
    batch = {r.session: (r.at, r.n_steps) for r in session.trails(df, session="who", step="what", order=["id"], overview="v").collect()}
    want = {}
    for who in range(3):
        s, a = [], 0
        for _, w, what in events:
            if w == who:
                s, a = session.note(s, a, what)
        want[str(who)] = (a, len(s))
    assert batch == want
    stream = spark.readStream.schema(df.schema).parquet(f"file://{tmp_path}")
    q = session.stream_trails(stream, session="who", step="what", order=["id"]).writeStream.outputMode("update").format("memory").queryName("trails").start()
    q.processAllAvailable()
    q.stop()
    assert {r.session: (r.at, r.n_steps) for r in spark.table("trails").collect()} == want


def test_settled(spark):
    e = spark.createDataFrame([(1, 0.0, 1.0), (1, 0.5, 1.0), (1, 5.0, 1.0)], "who long, at double, wait double")
    assert rows(session.settled(e, session="who", at="at", order=[], wait="wait"), "at") == [(0.5,), (5.0,)]


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "src long, dst long, w long")
    assert rows(graph.distances(none, ids(spark, 1))) == [(1, 0)]
    assert rows(graph.tiers(none, ids(spark, 1)), "node", "tier") == [(1, "entry")]
    assert graph.tiers(none, ids(spark, 1).limit(0)).isEmpty()
    assert calls.way_in_reach(none, ids(spark, 1).limit(0)).isEmpty()


def test_lexer_classes(spark):
    from rookery.functions import lexing

    text = '/// Doc\n#[inline]\npub fn note() -> Wire { rsx!("x") }'
    files = spark.createDataFrame([("f", text), ("g", None), ("h", "")], "file string, text string")
    got = {(r.line, r.text): r["class"] for r in lexing.runs(files).collect() if r.file == "f"}
    assert (got[0, "/// Doc"], got[1, "#[inline]"], got[2, "pub"], got[2, "note"], got[2, "Wire"], got[2, "rsx"], got[2, '"x"']) == ("doc", "attr", "kw", "fn", "type", "macro", "str")
    whole = files.where("file = 'f'").select(F.array_join(F.transform(lexing.tokens(F.col("text")), lambda t: t["text"]), "")).head()[0]
    assert whole == text


def test_lexer_strings(spark):
    from rookery.functions import lexing

    strings = [r'"a\"b"', r'"\\"', '""', '"two\nlines"', 'r"c:\\"', 'r#"say "hi" // no"#', 'br##"x"#y"##', 'b"z"', r'"\\\""']
    df = spark.createDataFrame([(f"f({x});",) for x in strings] + [(None,), ("",), ('let a = "open',)], "t string")
    got = [r.t for r in df.select(lexing.tokens(F.col("t")).alias("t")).collect()]
    assert [[(t["text"], t["class"]) for t in x][2:-2] for x in got[: len(strings)]] == [[(x, "str")] for x in strings]
    assert got[-3] is None and got[-2] == [] and "".join(t["text"] for t in got[-1]) == 'let a = "open'


def test_lexer_on_a_long_file(spark):
    from rookery.functions import lexing

    line = 'pub fn note(at: &str) -> Wire { wire("x", at) } // done\n'
    n = 10_000
    files = spark.createDataFrame([("f", 'let all = "' + "long " * 50_000 + '";\n' + line * n)], "file string, text string")
    last = lexing.runs(files).where("text = '// done'").agg(F.count("*"), F.max("line")).head()
    assert tuple(last) == (n, n)


def test_quotes_and_links(spark):
    from rookery.functions import lexing

    items = spark.createDataFrame([("impl X {\n    fn a() {\n        b\n    }\n}", 13, 37)], "text string, start int, end int")
    assert lexing.quoted(items).head().quote == "fn a() {\n    b\n}"
    r = spark.createDataFrame([("f", 0, 0, 5, 1), ("f", 1, 6, 9, 1)], "file string, run int, start int, end int, item int")
    s = spark.createDataFrame([("f", 6, 8, 9), ("f", 0, 2, 1), ("f", 1, 3, 7)], "file string, start int, end int, target int")
    assert rows(lexing.linked(r, s), "run", "target", "link") == [(0, 7, 1), (1, 9, 2)]


def test_predicates(spark):
    from rookery.functions import predicates as P

    one = spark.range(1)
    row = one.select(*P.peek(F.lit("a/b@c.rs@X::y")), *[c.alias(f"n{k}") for k, c in enumerate(P.peek(F.lit("@x")))], P.ring_of(F.lit("/dep/ring/3")), P.selection(F.lit("/dep/crate/a+b")), P.test_only(F.lit("#[cfg( test )]")), P.test_only(F.lit("#[tested]"))).head()
    assert tuple(row) == ("a/b@c.rs", "X::y", None, None, 3, ["a", "b"], True, False)


def test_woven_rows(spark):
    from rookery.operators import verdicts

    live = spark.createDataFrame([(1, 0, "id"), (1, 1, "status")], "item long, ord long, name string")
    gone = spark.createDataFrame([(1, 1, 1, "changed"), (1, 1, 2, "stale")], "item long, seat long, ord long, name string")
    assert [tuple(r) for r in verdicts.woven(live, gone).head().rows] == [("id", False), ("changed", True), ("stale", True), ("status", False)]
