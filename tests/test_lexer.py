"""Files lexed in blocks against one pass over the whole text."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from rookery.functions.lexing import KEYWORDS
from rookery.operators import lexer


def plain(text):
    """(line, text, class) of every run, from one pass."""
    tokens = lexer.lex(text, lexer.CODE)[0]
    assert "".join(t for _, t in tokens) == text
    solid = [k for k, (c, _) in enumerate(tokens) if c not in lexer.TRIVIA]
    line, out = 0, []
    for k, (c, t) in enumerate(tokens):
        if c == "word":
            before = max((x for x in solid if x < k), default=None)
            after = min((x for x in solid if x > k), default=None)
            if t in KEYWORDS:
                c = "kw"
            elif after is not None and tokens[after][1] == "!":
                c = "macro"
            elif before is not None and tokens[before][1] == "fn":
                c = "fn"
            else:
                c = "type" if t[0].isupper() else "ident"
        for j, part in enumerate(t.split("\n")):
            if part.rstrip("\r"):
                out.append((line + j, part.rstrip("\r"), c))
        line += t.count("\n")
    return out


PARTS = ["fn", " ", "\n", "name", "!", "(", "Type", "/*", "*/", "/**", "//", '"', "\\", "\\\"", 'r#"', '"#', 'r"', "#[", "[", "]", "'a", "'x'", "b'\\n'", "1.5", "é", "\r\n", "let x = 1;\n", "// note\n", "/* a /* b */ c */"]


@pytest.mark.parametrize("size", [1, 12])
def test_blocks_are_one_pass(spark, size):
    r = random.Random(size)
    texts = {k: "".join(r.choice(PARTS) for _ in range(r.choice([0, 5, 60, 120]))) for k in range(60)}
    texts |= {90: "/*" * 9 + "\n" * 9 + "x\n" + "*/\n" * 9 + "fn\n\n/* c */\nname\n\n!\n", 91: "#[[[[[\n\n]]]\n\"]\"\n]]]\nfn a", 92: 'r####"\n"###\n"####\nx', 93: "#[doc = \"\n]\n\"]\nfn f() {}", 94: "/** d\n/* e */\n f */ g", 95: '"a\\\n" b\\"\n"'}
    files = spark.createDataFrame([*texts.items(), (99, None)], "file long, text string").withColumn("block", F.lit("clash"))
    got = {}
    for x in lexer.file_runs(files, size).orderBy("file", "block", "run").collect():
        got.setdefault(x.file, []).append((x.line, x.text, x["class"]))
    assert got == {k: p for k, t in texts.items() if (p := plain(t))}
    assert lexer.file_runs(files.limit(0), size).isEmpty()


def test_classes(spark):
    text = '/// Doc\n#[inline]\npub fn note<\'a>() -> Wire { rsx!("x", 1) } /* a /* b */ c */ end'
    got = {(x.line, x.text): x["class"] for x in lexer.file_runs(spark.createDataFrame([("f", text)], "file string, text string")).collect()}
    assert [got[k] for k in [(0, "/// Doc"), (1, "#["), (1, "inline"), (1, "]"), (2, "pub"), (2, "note"), (2, "'a"), (2, "Wire"), (2, "rsx"), (2, '"x"'), (2, "1"), (2, "/* a /* b */ c */"), (2, "end")]] == [
        "doc", "attr", "attr", "attr", "kw", "fn", "lifetime", "type", "macro", "str", "num", "comment", "ident",
    ]


def test_a_file_of_20_mb_is_lexed_in_many_tasks(spark):
    line = 'pub fn note(at: &str) -> Wire { wire("x") } /* done */\n'
    df = spark.range(1).select(F.lit("f").alias("file"), F.concat(F.lit("/*\n"), F.repeat(F.concat(F.lit(line), F.substring(F.col("id").cast("string"), 5, 1)), 180_000), F.lit("*/\n"), F.repeat(F.lit(line), 190_000)).alias("text"))
    runs = lexer.file_runs(df, 1 << 19)
    # comments nest, so the first one holds the first part's lines and theirs
    got = {x["class"]: x.n for x in runs.groupBy("class").agg(F.count("*").alias("n")).collect()}
    n = 190_000
    assert runs.select("block").distinct().count() > 30
    assert got["str"] == n and got["fn"] == n and got["kw"] == 2 * n and got["comment"] == 180_000 + 190_000 + 2


def test_without_comments(spark):
    rows = [("V {\n  /// doc\n  a:   u8, // x\n  b: &'static str /* c /* d */ e */ }", "V { a: u8, b: &'static str }"), ('= "a  b"  + 1', '= "a  b" + 1'), ("", ""), (None, None), ("a/* open", "a")]
    df = spark.createDataFrame(rows, "t string, want string")
    assert all(r.got == r.want for r in df.select("want", lexer.without_comments(F.col("t")).alias("got")).collect())


def test_states_are_found_without_tokens():
    rng = random.Random(7)
    bits = ["a", "br", "r#\"", "\"#", "\"", "'", "'a'", "b'", "#[", "#![", "[", "]", "//", "/*", "*/", "1.5", "é", "\\", "\n", " ", "fn", "!", "c\""]
    for _ in range(3_000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 25)))
        for state in [*lexer.common_states(), "2:code:0", "1:string:0"]:
            assert lexer.lex(text, state, tokens=False)[1] == lexer.lex(text, state)[1]


def test_many_blocks_come_in_few_batches(spark):
    files = spark.createDataFrame([(1, "x\n" * 5_000), (2, "fn f\n")], "file long, text string").coalesce(1)
    cut = lexer.blocks(files, 2)
    assert cut.count() == 5_001
    sizes = cut.mapInArrow(lambda batches: (b.select(["block"]).slice(0, 1) for b in batches if b.num_rows), "block long")
    assert sizes.count() < 10


def test_first_and_last_tokens_are_found_without_the_others():
    rng = random.Random(11)
    bits = ["a", "br", "r#\"", "\"#", "\"", "'", "'a'", "#[", "[", "]", "//", "/*", "*/", "1.5", "\\", "\n", " ", "fn", "!", "fn", "!"]
    for _ in range(3_000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 25)))
        for state, got in lexer.transfers(text, [*lexer.common_states(), "2:code:0"]).items():
            tokens, after = lexer.lex(text, state)
            signs = [t if t in lexer.TELLING else "" for c, t in tokens if c not in lexer.TRIVIA] or [None]
            assert got == (after, signs[0], signs[-1])


def test_short_files_are_lexed_where_they_are_read(spark, monkeypatch):
    """They are not written, neither as blocks nor as tokens, and have the runs of files that are dealt over tasks (F1)."""
    r = random.Random(5)
    files = spark.createDataFrame([(k, "".join(r.choice(PARTS) for _ in range(r.choice([5, 60, 120])))) for k in range(12)], "file long, text string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    dealt = rows(lexer.file_runs(files, 40, whole=0))
    written = []
    monkeypatch.setattr(lexer, "staged", lambda df, name="stage", put=lexer.staged: written.append((name, (out := put(df, name)).count())) or out)
    assert rows(lexer.file_runs(files, 40)) == dealt and written == [("blocks", 0)]
    some = files.withColumn("at_most", F.length("text") + 3)
    assert len({n > 60 for n in (len(x.text) for x in files.collect())}) == 2 and rows(lexer.file_runs(some, 40, whole=60)) == dealt
