"""Source text as runs of tokens, file after file of any length.

A file is cut at line ends into blocks.  A short file's blocks are lexed one after the other
where the file is read, and nothing is written.  A long one's are dealt over all tasks.  What a
block's text means depends on the state in which it begins: in code, in a comment of some depth,
in a string, in a raw string of some hashes, in an attribute of some brackets.  So a block is a
function from states to states:

1. Each block, apart from all others, is lexed from the states in which it may begin; that
   gives a small table from states to states (``transfers``), with the first and last token
   that may tell what a word of another block is.
2. The tables of a file's blocks are applied one after the other, as a sorted stream; the
   result is each block's one state, and the tokens beside it.  If a block begins in a state that its table lacks
   (deep brackets, mostly), that entry is made and the stream is run again.
3. Each block is lexed from its state, apart from all others.

A name's class depends on the tokens beside it, which may stand in another block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from unicodedata import category

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rookery.functions.lexing import KEYWORDS
from rookery.plans.staging import discard, staged

#: Characters after which a block ends with its line.
BLOCK = 65_536
#: Nested comments and attributes up to this depth, and hashes of raw strings, are in every table.
COMMON = 3
CODE = "0:code:0"

_CODE = re.compile(r"(?P<line>//[^\n]*)|(?P<comment>/\*)|(?P<attr>#!?\[)|(?P<raw>(?:br|cr|r)(?P<hashes>#*)\")|(?P<string>[bc]?\")|(?P<char>b?'(?:\\[^\n][^'\n]*|[^'\\\n])')|(?P<lifetime>'[^\W\d]\w*)|(?P<num>\d\w*(?:\.\d\w*)?)|(?P<word>\w+)|(?P<space>\s+)|(?P<other>.)", re.S)
#: Runs of tokens in code that leave the state as it is; what may not stops it, and is left to ``_CODE``.
_INERT = re.compile(r"(?:[^\Wbcr]\w*+|\s++|(?!(?:br|cr|r)#*\"|[bc]\"|b')[bcr]\w*+|//[^\n]*+|/(?![/*])|#(?!!?\[)|[^\w\s/#\"'\[\]])++")
#: Blanks and line comments before a token.
_BLANK = re.compile(r"(?:\s++|//[^\n]*+)*+")
#: Characters of a batch of blocks, and of a file that is lexed where it is read.
HELD = 1 << 20
#: Tokens of a batch of runs.
RUNS = 16_384
#: Tokens that tell what a word beside them is.
TELLING = ("fn", "!")
#: Columns of runs.
RUN = ["file", "line", "block", "run", "text", "class"]
_KEYWORDS = frozenset(KEYWORDS)
#: Tokens in code, beside attributes, that leave the state as it is, and their classes.
_PLAIN = {"word": "word", "space": "space", "other": "punct", "num": "num", "lifetime": "lifetime", "char": "str"}
#: What stands between tokens that matter to one another.
TRIVIA = ("space", "comment", "doc")
_COMMENT = re.compile(r"/\*|\*/")
_STRING = re.compile(r"\\.|\"", re.S)


def lex(text: str, state: str, tokens: bool = True) -> tuple[list[tuple[str, str]], str]:
    """The tokens (class, text) of a block that begins in ``state``, and the state after it; without ``tokens`` those that leave the state as it is are one ``inert`` token.

    A state is ``attr:mode:n``: brackets of an attribute that are open, what the text
    is in (code, comment, string, raw), and its depth (below 0 for a doc comment) or
    hashes.  A token that runs on from the block before, or into the next one, has its
    part here.
    """
    brackets, mode, depth = state.split(":")
    attr, n, doc = int(brackets), abs(int(depth)), int(depth) < 0
    out: list[tuple[str, str]] = []
    at = 0

    def put(kind: str, to: int) -> int:
        if to > at:
            out.append(("attr" if attr and kind not in TRIVIA else kind, text[at:to]))
        return to

    begun = 0  # where the token in ``mode`` began, before ``at``
    while at < len(text):
        if mode == "code":
            if not tokens and (inert := _INERT.match(text, at)):
                if _BLANK.match(text, at).end() < inert.end():
                    out.append(("inert", inert[0]))
                at = inert.end()
                continue
            if tokens and not attr:
                for m in _CODE.finditer(text, at):
                    if not (kind := _PLAIN.get(m.lastgroup)):
                        at = m.start()
                        break
                    out.append((kind, m[0]))
                else:
                    break
            else:
                m = _CODE.match(text, at)
            kind = m.lastgroup if m.lastgroup != "hashes" else "raw"
            begun = m.end()
            if kind == "comment":
                mode, n, doc = "comment", 1, text.startswith(("/**", "/*!"), at)
            elif kind == "raw":
                mode, n = "raw", len(m["hashes"])
            elif kind == "string":
                mode = "string"
            elif kind == "attr":
                attr += 1
                at = put("attr", m.end())
            elif attr and m[0] in "[]":
                end = m.end()
                out.append(("attr", m[0]))
                attr, at = attr + (1 if m[0] == "[" else -1), end
            else:
                if kind == "line":
                    kind = "doc" if m[0].startswith(("///", "//!")) else "comment"
                at = put({"char": "str", "other": "punct"}.get(kind, kind), m.end())
            continue
        end = None
        look = max(begun, at)
        if mode == "comment":
            for m in _COMMENT.finditer(text, look):
                n += 1 if m[0] == "/*" else -1
                if not n:
                    end = m.end()
                    break
        elif mode == "string":
            end = next((m.end() for m in _STRING.finditer(text, look) if m[0] == '"'), None)
        else:
            end = text.find('"' + "#" * n, look)
            end = end + 1 + n if end >= 0 else None
        at = put(("doc" if doc else "comment") if mode == "comment" else "str", len(text) if end is None else end)
        begun = at
        if end is not None:
            mode, n, doc = "code", 0, False
    return out, f"{attr}:{mode}:{-n if doc else n}"


def _cut(text: str, size: int) -> Iterator[str]:
    """A text's blocks, each cut after the line in which it comes to ``size``."""
    at = 0
    while at < len(text):
        end = text.find("\n", at + size - 1)
        end = len(text) if end < 0 else end + 1
        yield text[at:end]
        at = end


def blocks(files: DataFrame, size: int = BLOCK) -> DataFrame:
    """(file, block, line, text): files (file, text) cut after lines, a block once it has ``size`` characters; ``line`` counts from 0.

    A file is one cell, and is cut in one pass; its blocks are then dealt over tasks.
    """
    kind = files.schema["file"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            types = [batch.schema.field("file").type, pa.int64(), pa.int64(), pa.string()]
            rows, held = [], 0

            def made() -> pa.RecordBatch:
                columns = zip(*rows, strict=True) if rows else [()] * 4  # noqa: B023
                return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["file", "block", "line", "text"])  # noqa: B023

            for file, text in zip(batch.column("file"), batch.column("text"), strict=True):
                file, text = file.as_py(), text.as_py()
                if file is None or text is None:
                    continue
                line = 0
                for k, part in enumerate(_cut(text, size)):
                    rows.append((file, k, line, part))
                    line, held = line + part.count("\n"), held + len(part)
                    if held >= HELD:
                        yield made()
                        rows, held = [], 0
            yield made()

    return files.select("file", "text").mapInArrow(run, f"file {kind}, block long, line long, text string")


def _sign(token: str) -> str:
    return token if token in TELLING else ""


def _end(kind: str, text: str, k: int) -> str:
    """The first (0) or last (-1) token beside trivia in an inert run; any other token itself."""
    for line in text.split("\n")[:: 1 if k == 0 else -1] if kind == "inert" else ():
        if solid := [m[0] for m in _CODE.finditer(line) if m.lastgroup not in ("space", "line")]:
            return solid[k]
    return text


def transfers(text: str, states: list[str]) -> dict[str, tuple[str, str | None, str | None]]:
    """The block's table: from each state to that after it, with the signs of the first and last token beside trivia."""
    out = {}
    for s in states:
        tokens, after = lex(text, s, tokens=False)
        solid = [x for x in tokens if x[0] not in TRIVIA]
        out[s] = (after, _sign(_end(*solid[0], 0)), _sign(_end(*solid[-1], -1))) if solid else (after, None, None)
    return out


def common_states() -> list[str]:
    """States that every table has."""
    depths = range(1, COMMON + 1)
    return [CODE, "0:string:0", *[f"0:comment:{n}" for n in depths], "0:comment:-1", *[f"0:raw:{n}" for n in range(COMMON)], "1:code:0"]


def _tables(pairs: DataFrame, kind: str) -> DataFrame:
    """(file, block, before, after, first, last) of pairs (file, block, text, states)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [(f, b, s, *t) for f, b, text, states in zip(pdf["file"], pdf["block"], pdf["text"], pdf["states"], strict=True) for s, t in transfers(text, list(states)).items()]
            yield pd.DataFrame(made, columns=["file", "block", "before", "after", "first", "last"])

    return pairs.select("file", "block", "text", "states").mapInPandas(run, f"file {kind}, block long, before string, after string, first string, last string")


def entry_states(cut: DataFrame, rounds: int = 1_000_000) -> DataFrame:
    """(file, block, state, last_before, first_after): the state in which each block begins, and the signs of the tokens beside it."""
    kind = cut.schema["file"].dataType.simpleString()
    known = staged(_tables(cut.withColumn("states", F.array(*map(F.lit, common_states()))), kind), "transfers")
    names = ["file", "block", "state", "last_before", "first_after"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # rows of a block follow one another; of a file only its state is held, and the last block with tokens until the next one
        now, block, state, following, last = None, None, CODE, None, None
        row = held = None
        for pdf in batches:
            out = []
            for f, b, before, after, first, end in zip(*(pdf[c] for c in ("file", "block", "before", "after", "first", "last")), strict=True):
                if f != now or b != block:
                    out += [row] if row else []
                    if f != now:
                        out += [held] if held else []
                        held = last = None
                    state = CODE if f != now else following
                    now, block, following = f, b, None
                    row = None if state is None else [f, b, state, last, None]
                if before == state:
                    following = after
                    if isinstance(first, str):
                        if held:
                            held[-1] = first
                            out.append(held)
                        held, row, last = row, None, end
            yield pd.DataFrame(out, columns=names)
        yield pd.DataFrame([x for x in (row, held) if x], columns=names)

    for _ in range(rounds):
        ordered = known.repartition("file").sortWithinPartitions("file", "block").select("file", "block", "before", "after", "first", "last")
        states = staged(ordered.mapInPandas(run, f"file {kind}, block long, state string, last_before string, first_after string"), "states")
        # the last block that was reached may have lacked its entry
        lacking = states.select("file", "block", "state").join(known.select("file", "block", F.col("before").alias("state")), ["file", "block", "state"], "left_anti")
        if lacking.isEmpty():
            discard(known)
            return states
        more = _tables(cut.join(lacking, ["file", "block"]).withColumn("states", F.array("state")), kind)
        before, known = known, staged(known.unionByName(more), "transfers")
        discard(before, states)
    raise RuntimeError(f"states did not settle in {rounds} rounds")


def _named(word: str, before: str | None) -> str:
    """The class of a word, by the token before it; one before ``!`` is a macro unless it is a keyword."""
    if word in _KEYWORDS:
        return "kw"
    if before == "fn":
        return "fn"
    return "type" if "A" <= word[0] <= "Z" or (word[0] > "\x7f" and category(word[0]) == "Lu") else "ident"


def file_runs(files: DataFrame, size: int = BLOCK, whole: int = HELD) -> DataFrame:
    """(file, line, block, run, text, class): tokens of files (file, text), cut at line ends; lines and blocks count from 0, runs within their block.

    Classes: doc, comment, attr (all of an attribute), str, lifetime, num, kw, macro (a name before
    ``!``), fn (a name after ``fn``), type (a name with a capital), ident, punct, space.
    Empty and null texts have no runs; rows with one ``file`` are files that must differ in it.
    Files of up to ``whole`` characters are lexed by one task each, longer ones by many.  A column ``at_most``
    (no fewer characters than the text) spares making a text only to see that it is short.
    """
    kind = files.schema["file"].dataType.simpleString()
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    long = F.length("text") > whole
    if "at_most" in files.columns:
        long = F.when(F.col("at_most") > whole, long).otherwise(False)  # a branch is made only where it is taken
    cut = staged(blocks(files.where(long), size).repartition(tasks, "file", "block"), "blocks")
    beside = ["state", "last_before", "first_after"]
    lexed = files.select("file", F.when(~long, F.col("text")).alias("text")).repartition(tasks, "file")  # not a filter, which would make the text once more
    lexed = lexed.select("file", F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("line"), "text", F.lit(CODE).alias("state"), *(F.lit(None).cast("string").alias(c) for c in beside[1:]))
    if cut.isEmpty():
        discard(cut)
    else:
        lexed = lexed.unionByName(cut.join(entry_states(cut), ["file", "block"]).select(*lexed.columns))
    return lexed.mapInArrow(_runs(size), f"file {kind}, line long, block long, run long, text string, class string")


def _runs(size: int):
    """From rows (file, block, line, text, state, last_before, first_after) of one or more blocks to runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            types = [batch.schema.field("file").type, *[pa.int64()] * 3, *[pa.string()] * 2]
            out: list[list] = [[] for _ in RUN]

            def made() -> pa.RecordBatch:
                return pa.record_batch([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=RUN)  # noqa: B023

            for row in zip(*(batch.column(c) for c in ("file", "block", "line", "text", "state", "last_before", "first_after")), strict=True):
                f, b, line, text, state, before, following = (x.as_py() for x in row)
                if f is None or text is None:
                    continue
                open_ = None  # the last word, until the token after it is known
                for part in _cut(text, size):
                    if len(out[0]) >= RUNS and open_ is None:
                        yield made()
                        out = [[] for _ in RUN]
                    _, lines, _, _, texts, classes = out
                    begun = len(texts)
                    tokens, state = lex(part, state)
                    for cls, t in tokens:
                        if cls == "word":
                            cls, before = _named(t, before), t
                            open_ = None if cls == "kw" else len(texts)
                            lines.append(line)
                            texts.append(t)
                            classes.append(cls)
                            continue
                        if cls not in TRIVIA:
                            if t == "!" and open_ is not None:
                                classes[open_] = "macro"
                            before, open_ = t, None
                        if "\n" in t or "\r" in t:
                            for piece in t.split("\n"):
                                if piece := piece.rstrip("\r"):
                                    lines.append(line)
                                    texts.append(piece)
                                    classes.append(cls)
                                line += 1
                            line -= 1
                        else:
                            lines.append(line)
                            texts.append(t)
                            classes.append(cls)
                    n = len(texts) - begun
                    out[0].extend([f] * n)
                    out[2].extend([b] * n)
                    out[3].extend(range(n))
                    b += 1
                if open_ is not None and following == "!":
                    classes[open_] = "macro"
            yield made()

    return run


def without_comments(text: Column) -> Column:
    """A declaration's own text on one line: comments out, blanks collapsed; strings as they are (S28)."""
    from rookery.functions.lexing import tokens

    own = F.transform(F.filter(tokens(text), lambda t: ~t["class"].isin("comment", "doc")), lambda t: F.when(t["class"] == "space", " ").otherwise(t["text"]))
    # bound as a lambda's variable, so that it is computed once
    kept = F.get(F.transform(F.array(own), lambda every: F.filter(every, lambda t, k: (t != " ") | ~F.get(every, k - 1).eqNullSafe(" "))), F.lit(0))
    return F.trim(F.array_join(kept, ""))
