"""Tokens of source text as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from rookery.functions.text import common_indent, dedent
from rookery.operators.intervals import CELL, cells

# Rust's words.
KEYWORDS = (
    "as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return "
    "self Self static struct super trait true type unsafe use where while"
).split()
def _comment(depth: int) -> str:
    """A block comment that holds others, as deep as this; one that doesn't end goes on to the last character."""
    inner = ""
    for _ in range(depth):
        inner = r"/\*(?:[^*/]++|\*(?!/)|/(?!\*)" + (f"|{inner}" if inner else "") + r")*+\*/"
    return inner + r"|/\*(?s:.*)"


#: What a token looks like; the first that fits counts.
TOKEN = "|".join([
    r"//[^\n]*", _comment(4), r"#!?\[[^\]]*\]", r"b?r(#*)\"(?s:.*?)\"\1", r"b?\"(?s:.*?)(?<!\\)(?:\\\\)*+\"", r"b?'(?:\\.[^']*|[^'\\\n])'", r"'[\p{L}_][\p{L}\p{N}_]*",
    r"[0-9][0-9A-Za-z_]*(?:\.[0-9][0-9A-Za-z_]*)?", r"(?U:[\p{L}_][\p{L}\p{N}_]*)", r"(?U:\s+)", r"(?s:.)",
])


def tokens(text: Column) -> Column:
    """array<struct<text, class>>: the whole text, token after token; null text gives null.

    Classes: doc, comment, attr (a whole attribute), str, lifetime, num, kw, macro
    (a name before ``!``), fn (a name after ``fn``), type (a name with a capital), ident, punct, space.
    The text is cut once; every token then looks at its neighbours in the list.
    """
    raw = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    blank = lambda x: x.rlike(r"^(?U)\s+$")

    def classify(every: Column, x: Column, k: Column) -> Column:
        after, before = F.get(every, k + 1), F.get(every, k - 1)
        after = F.when(blank(after), F.get(every, k + 2)).otherwise(after)
        before = F.when(blank(before), F.get(every, k - 2)).otherwise(before)
        name = (
            F.when(x.isin(*KEYWORDS), "kw").when(after.eqNullSafe("!"), "macro").when(before.eqNullSafe("fn"), "fn")
            .when(x.rlike(r"^\p{Lu}"), "type").otherwise("ident")
        )
        kind = (
            F.when(blank(x), "space").when(x.rlike(r"^(///|//!|/\*\*|/\*!)"), "doc").when(x.rlike(r"^(//|/\*)"), "comment").when(x.rlike(r"^#!?\["), "attr")
            .when(x.rlike(r"^b?(?:r#*)?\"|^b?'(?:\\.[^']*|[^'\\\n])'$"), "str").when(x.startswith("'"), "lifetime").when(x.rlike("^[0-9]"), "num").when(x.rlike(r"^[\p{L}_]"), name).otherwise("punct")
        )
        return F.struct(x.alias("text"), kind.alias("class"))

    # bound as a lambda's variable: a lambda computes any other expression again for each token
    return F.get(F.transform(F.array(raw), lambda every: F.transform(every, lambda x, k: classify(every, x, k))), F.lit(0))


def runs(files: DataFrame) -> DataFrame:
    """(file, line, run, text, class): tokens of (file, text), cut at line ends; lines and runs count from 0.

    A file is one row.  Lines before a token are a running sum over its file's tokens.
    """
    t = files.select("file", F.posexplode(tokens(F.col("text"))).alias("run", "t")).select("file", "run", "t.text", "t.class")
    ends = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    before = F.sum(ends).over(Window.partitionBy("file").orderBy("run").rowsBetween(Window.unboundedPreceding, -1))
    part = t.withColumn("before", F.coalesce(before, F.lit(0)).cast("int")).select("file", "run", "class", "before", F.posexplode(F.split("text", "\n", -1)).alias("n", "part"))
    part = part.select("file", (F.col("before") + F.col("n")).alias("line"), "run", F.regexp_replace("part", "\r+$", "").alias("text"), "class")
    return part.where("text <> ''")


def quoted(items: DataFrame) -> DataFrame:
    """Each item's own text (file text, start, end in characters) with its first line's indent, and without the indent that all lines share."""
    head = F.substring_index(F.left("text", F.col("start")), "\n", -1)
    indent = F.when(F.trim(head) == "", head).otherwise("")
    own = F.concat(indent, F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")))
    return items.withColumn("quote", dedent(own))


def item_source(items: DataFrame) -> DataFrame:
    """Items with ``blocks``, what is quoted of them: (part, start, end, text) of the header, the item and the closing brace.

    ``items`` has file text, start and end, and owner_start and owner_end of the block that
    the item is written in (null without one); all in characters.  The header goes from
    the owner's start to its first brace, if that stands before the item; the closing
    brace is the owner's last sign, if it is one and stands behind the item.  Lines lose the header's
    indent, or without a header what all of the item's own lines share.  A range that isn't
    in the text gives no blocks.
    """
    text, n = F.col("text"), F.length("text")
    piece = lambda a, b: F.substring(text, a + 1, b - a)

    def indent(at: Column) -> Column:
        """The blanks before a place, if nothing else stands there on its line."""
        before = F.substring_index(F.left(text, at), "\n", -1)
        return F.when(F.trim(before) == "", before).otherwise("")

    a, b, first, last = (F.col(c) for c in ("start", "end", "owner_start", "owner_end"))
    brace = first + F.instr(piece(first, last), "{")
    head = F.coalesce((last <= n) & (brace > first) & (brace <= a), F.lit(False))
    foot = F.coalesce((last > b) & (last <= n) & (F.substring(text, last, F.lit(1)) == "}"), F.lit(False))
    own = F.concat(indent(a), piece(a, b))
    strip = F.when(head, F.length(indent(first))).otherwise(common_indent(own))
    # bound as a lambda's variable: a lambda computes any other expression again for each line
    cut = lambda t: F.get(F.transform(F.array(strip), lambda by: F.array_join(F.transform(F.split(t, "\n"), lambda x: F.substring(x, by + 1, F.length(x))), "\n")), F.lit(0))
    block = lambda part, x, y: F.struct(F.lit(part).alias("part"), x.cast("long").alias("start"), y.cast("long").alias("end"), cut(F.concat(indent(x), piece(x, y))).alias("text"))
    blocks = F.array_compact(F.array(F.when(head, block("header", first, brace)), block("item", a, b), F.when(foot, block("closing", last - 1, last))))
    inside = (a >= 0) & (a <= b) & (b <= n)
    return items.withColumn("blocks", F.when(inside, blocks).otherwise(F.array().cast("array<struct<part:string,start:bigint,end:bigint,text:string>>")))


def linked(run_spans: DataFrame, spans: DataFrame) -> DataFrame:
    """Runs (file, run, start, end, item) with the target of the span inside them, links to the item itself left out; links count from 1 by first place.

    A span meets the runs in the grid's cell that it starts in.
    """
    met = spans.select("file", F.col("start").alias("s"), F.col("end").alias("e"), "target", F.floor(F.col("start") / CELL).alias("cell"))
    run = run_spans.where("start <= end").withColumn("cell", F.explode(cells(F.col("start"), F.col("end"))))
    hit = run.join(met, ["file", "cell"]).where("start <= s and end >= e and target <> item")
    first = hit.groupBy("file", "item", "target").agg(F.min("s").alias("first"))
    number = first.withColumn("link", F.row_number().over(Window.partitionBy("file", "item").orderBy("first", "target"))).drop("first")
    return hit.join(number, ["file", "item", "target"]).select("file", "item", "run", "target", "link")
