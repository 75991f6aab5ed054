"""What sheets and drawings say in words, and the widths they draw with, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of kinds, holds, tiers and events.
KIND_WORDS = {"struct": "struct", "enum": "enum", "union": "union", "static": "static", "trait": "trait", "fn": "fn", "macro": "macro", "const": "const", "alias": "type"}
HOLD_WORDS = {"owns": "owns", "shares": "shares", "borrows": "borrows", "dyn": "dyn", "implements": "implements"}
DEP_WORDS = {"dev": "(dev)", "build": "(build)"}
BRACKETS = {"struct": ("{", "}"), "union": ("{", "}"), "enum": ("{", "}"), "static": (":", ""), "const": (":", ""), "alias": ("=", "")}
#: Fixed value: width of a sign of the data face for each pixel of its size.
ADVANCE = 0.6


def _word(col: Column, words: dict[str, str], otherwise: Column | None = None) -> Column:
    out = F.lit(None).cast("string") if otherwise is None else otherwise
    for key, word in words.items():
        out = F.when(col == key, F.lit(word)).otherwise(out)
    return out


def section_type(section: Column) -> Column:
    """The self type of a section's header: what follows the last `` for ``, else what follows ``impl`` or ``trait``."""
    after = F.regexp_extract(section, r"(?s)^.* for (.*)$", 1)
    named = F.when(section.rlike(r"(?s)^.* for "), after).otherwise(section)
    return F.regexp_replace(named, "^(impl |trait )", "")


def label(section: Column, name: Column) -> Column:
    """``Type::name`` for what stands in a section, else the name."""
    return F.when(section == "", name).otherwise(F.concat(section_type(section), F.lit("::"), name))


def impl_header(trait: Column, self_type: Column) -> Column:
    """``impl Trait for Type``, or ``impl Type`` without a trait."""
    ty = F.coalesce(self_type, F.lit(""))
    return F.when(trait.isNull(), F.concat(F.lit("impl "), ty)).otherwise(F.concat(F.lit("impl "), trait, F.lit(" for "), ty))


def keyword(vis: Column) -> Column:
    """A visibility as it is written; null for private."""
    return F.nullif(vis, F.lit(""))


def decl_words(kind: Column, vis: Column) -> Column:
    """``pub fn``: visibility and kind."""
    return F.concat_ws(" ", keyword(vis), _word(kind, KIND_WORDS, kind))


def written(vis: Column, name: Column, decl: Column) -> Column:
    """A row as its block draws it: ``pub name: Type``; a row without a name is its type."""
    body = F.when(name == "", decl).otherwise(F.concat(name, F.lit(": "), decl))
    return F.concat_ws(" ", keyword(vis), body)


def signature_row(name: Column, ty: Column) -> Column:
    """A parameter as it is written; a receiver has no type of its own."""
    return F.when(ty == "", name).otherwise(F.concat(name, F.lit(": "), ty))


def brackets(kind: Column, rows: Column) -> tuple[Column, Column]:
    """What opens and closes a block of so many rows; nothing without rows."""
    side = lambda k: F.when(rows == 0, "").otherwise(_word(kind, {x: b[k] for x, b in BRACKETS.items()}, F.lit("")))
    return side(0), side(1)


def state_words(ghost: Column, changed_files: Column, hops: Column) -> Column:
    """removed, so many files changed, or so many hops downstream; null for what nothing happened to."""
    files = F.when(changed_files == 1, "1 file changed").otherwise(F.concat(changed_files.cast("string"), F.lit(" files changed")))
    away = F.when(hops == 1, "1 hop downstream").otherwise(F.concat(hops.cast("string"), F.lit(" hops downstream")))
    return F.when(ghost, "removed").when(changed_files > 0, files).when(hops > 0, away)


def locator(path: Column, line: Column, base: Column) -> Column:
    """``src/a.rs:12``; a line of the base edition says so."""
    return F.concat(path, F.lit(":"), line.cast("string"), F.when(base, " (base)").otherwise(""))


def file_line(path: Column, line: Column) -> Column:
    """``a.rs:12``."""
    return F.concat(F.element_at(F.split(path, "/"), -1), F.lit(":"), line.cast("string"))


def out_links(name: Column, version: Column, registry: Column, repository: Column, documentation: Column, homepage: Column) -> Column:
    """Links of a package (word, url): repository, registry, documentation and, if it is none of these, its home; only http counts."""
    web = lambda c: F.when(F.startswith(c, F.lit("http")), c)
    link = lambda word, url: F.when(url.isNotNull(), F.struct(F.lit(word).alias("word"), url.alias("url")))
    crates = F.when(registry, F.concat(F.lit("https://crates.io/crates/"), name))
    derived = F.when(registry & web(documentation).isNull(), F.concat(F.lit("https://docs.rs/"), name, F.lit("/"), version))
    first = F.array_compact(F.array(link("repo", web(repository)), link("crates.io", crates), link("docs", web(documentation)), link("docs.rs", derived)))
    home = F.when(~F.exists(first, lambda x: x["url"] == web(homepage)), link("homepage", web(homepage)))
    return F.array_compact(F.concat(first, F.array(home)))


def _ink(count: Column, base: float, per_log: float, most: float) -> Column:
    return F.least(F.lit(base) + F.ln(F.greatest(count, F.lit(1)).cast("double")) * per_log, F.lit(most))


def tie_width(count: Column) -> Column:
    return _ink(count, 0.9, 0.35, 2.4)


def wire_width(answers: Column, count: Column) -> Column:
    """A contract is a hairline."""
    return F.when(answers, F.lit(1.0)).otherwise(_ink(count, 1.0, 0.32, 2.4))


def corridor_width(count: Column) -> Column:
    return _ink(count, 1.2, 0.34, 3.0)


def text_width(text: Column, px: float) -> Column:
    return F.length(text) * (ADVANCE * px)


def call_words(count: Column) -> Column:
    return F.when(count == 1, "1 call").otherwise(F.concat(count.cast("string"), F.lit(" calls")))


def call_word(count: Column, answers: Column) -> Column:
    return F.when(answers, "answers").otherwise(call_words(count))


def packed_words(held: Column) -> Column:
    return F.concat(F.lit("+ "), held.cast("string"), F.lit(" inside"))


def hold_word(kind: Column, via: Column) -> Column:
    """What a hold goes through, if anything, else its kind."""
    return F.when(via != "", via).otherwise(_word(kind, HOLD_WORDS, kind))


def dep_word(kind: Column) -> Column:
    """The table a dependency comes from; the default one has no word."""
    return _word(kind, DEP_WORDS)


def event_word(event: Column, old: Column, new: Column) -> Column:
    return F.when(event == "bumped", F.concat(old, F.lit(" → "), new)).otherwise(event)


def tier_words(tier: Column, kind: Column) -> Column:
    """A type's tier in a few words."""
    words = {"nested": "inside its holder", "vocab": "held by many", "shared": "shared through a handle", "afar": "held from another module", "ring": "in a ring of owners", "narrower": "held off the paper"}
    return F.when((tier == "root") & (kind == "static"), "a root, state").when(tier == "root", "a root").otherwise(_word(tier, words, tier))
