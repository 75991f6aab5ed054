"""Dropped rows read by name, promises and seats of two editions, on hand-built cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from rookery.operators import editions, names

ROWS = "row long, src long, ord int, name string, text string, skip_leading boolean, from_method boolean"


def known(spark):
    live = [(1, "struct", "m::Wire"), (2, "enum", "Kind"), (3, "trait", "Held"), (4, "fn", "Wire"), (5, "struct", "Twin"), (6, "union", "Memo")]
    ghosts = [(7, "struct", "Gone"), (8, "struct", "a::Twin")]
    df = lambda x: spark.createDataFrame(x, "id long, kind string, name string")
    return names.known_names(df(live), df(ghosts))


def test_known_names_are_bare_and_a_name_of_several_has_no_id(spark):
    got = {r.name: (r.id, r.several) for r in known(spark).collect()}
    assert got == {"Wire": (1, False), "Kind": (2, False), "Held": (3, False), "Twin": (None, True), "Memo": (6, False), "Gone": (7, False)}


def test_name_walk(spark):
    texts = ["Vec<Wire>", "&'a Wire", "&mut dyn Held", "Arc<Rc<Kind>>", "Memo<Kind>", "Wire { of: Kind, to: Kind }", "(Twin, Twin, Gone)", "Wired, _Wire, Wire2", "", None, "Weak<&Wire>"]
    rows = spark.createDataFrame([(k, 9, k, f"f{k}", t, k == 5, False) for k, t in enumerate(texts)], ROWS)
    got = [tuple(r)[1:] for r in names.name_walk(rows, known(spark)).orderBy("row").collect()]
    assert got == [
        ("owns", "", [1], 0), ("borrows", "&", [1], 0), ("dyn", "dyn", [3], 0), ("shares", "Arc", [2], 0),
        ("owns", "", [6, 2], 0),  # a declaration bears that word
        ("owns", "", [2], 0),  # the variant's own name is none
        ("owns", "", [7], 2), ("owns", "", [], 0), ("owns", "", [], 0), ("owns", "", [], 0), ("shares", "Weak", [1], 0),
    ]
    assert names.name_walk(rows.limit(0), known(spark)).isEmpty()


def test_dropped_holds_leave_out_what_still_stands(spark):
    rows = spark.createDataFrame([(0, 2, 0, "a", "Wire", False, False), (1, 2, 1, "b", "Wire", False, False), (2, 2, 2, "c", "Kind", False, False), (3, 2, 3, "d", "Held", False, True), (4, 2, 4, "e", "Held", False, False)], ROWS)
    live = spark.createDataFrame([(2, 3, True)], "src long, dst long, from_method boolean")
    got = sorted((r.src, r.dst, r.kind, r.via, r.from_method, r.fields, r.event) for r in names.dropped_holds(rows, known(spark), live).collect())
    assert got == [(2, 1, "owns", "", False, ["a", "b"], "removed"), (2, 3, "owns", "", False, ["e"], "removed")]


def test_promises_of_two_editions(spark):
    items = spark.createDataFrame([(1, "trait", "Show", "a.rs"), (2, "struct", "m::One", "b.rs"), (3, "struct", "Two", "c.rs"), (4, "struct", "x::Twin", "b.rs"), (5, "enum", "Twin", "b.rs")], "id long, kind string, name string, file string")
    live = spark.createDataFrame([(1, 2), (1, 3)], "trait long, type long")
    base = spark.createDataFrame([("b.rs", "Show", "Twin"), ("b.rs", "Show", "Two"), ("z.rs", "Show", "One")], "path string, trait string, type string")
    run = lambda *paths: sorted(map(str, ((r.trait, r.type, r.event) for r in editions.impl_events(live, items, base, spark.createDataFrame([(p,) for p in paths], "path string")).collect())))
    assert run("b.rs") == sorted(map(str, [(1, 2, "added"), (1, 3, None)]))  # Twin is ambiguous, One's block in z.rs wasn't read
    assert run() == sorted(map(str, [(1, 2, None), (1, 3, None)]))
    again = editions.impl_events(live.where("type = 2"), items, base, spark.createDataFrame([("b.rs",)], "path string"))
    assert sorted(map(str, ((r.trait, r.type, r.event) for r in again.collect()))) == sorted(map(str, [(1, 2, "added"), (1, 3, "removed")]))


def test_seats_are_those_of_the_whole_band(spark):
    items = spark.createDataFrame([(1, "a", "struct"), (2, "a", "trait")], "item long, file string, kind string")
    live = [(1, 0, "far", "f", "b"), (1, 1, "own", "o", "a"), (1, 2, "new", "n", "a"), (1, 3, "last", "l", "b"), (2, 0, "clause", "c2", "b")]
    base = [(1, 0, "gone", "g"), (1, 1, "own", "o"), (1, 2, "end", "e"), (2, 0, "clause", "c")]
    got = editions.band_diff(spark.createDataFrame(base, "item long, ord long, name string, decl string"), spark.createDataFrame(live, "item long, ord long, name string, decl string, file string"), items)
    assert sorted((r.item, r.event, r.seat, r.name) for r in got.collect()) == [(1, "added", 2, "new"), (1, "removed", 1, "gone"), (1, "removed", 2, "end"), (2, "added", 0, "clause"), (2, "removed", 0, "clause")]


def test_texts_without_words_have_none(spark):
    rows = spark.createDataFrame([(1, None, True), (2, "  ", True), (3, "x", True)], "row long, text string, skip_leading boolean")
    assert names.words(rows).select(F.count("*")).head()[0] == 0


def test_a_text_is_read_once_however_many_rows_have_it(spark, monkeypatch):
    seen, words = [], names.words
    monkeypatch.setattr(names, "words", lambda texts: seen.append(texts.count()) or words(texts))
    rows = spark.range(40).select(F.col("id").alias("row"), F.when(F.col("id") % 2 == 0, "Arc<Wire>").otherwise("&Kind").alias("text"), F.lit(False).alias("skip_leading"))
    got = {(r.row % 2, r.kind, r.via, *r.targets) for r in names.name_walk(rows, known(spark)).collect()}
    assert seen == [2] and got == {(0, "shares", "Arc", 1), (1, "borrows", "&", 2)}
