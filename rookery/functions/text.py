"""Scalar text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def collapse(text: Column) -> Column:
    """Runs of white space, of any script, to one space; none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def bare_name(text: Column) -> Column:
    """The last ``::`` part of what stands before ``<``, ``(`` or a space."""
    return F.element_at(F.split(F.regexp_extract(text, r"^([^<( ]*)", 1), "::"), -1)


def bare_trait(text: Column) -> Column:
    """The last ``::`` part of what stands before ``<``."""
    return F.element_at(F.split(F.regexp_extract(text, r"^([^<]*)", 1), "::"), -1)


def header_promise(header: Column) -> tuple[Column, Column]:
    """(trait, type) of ``impl TRAIT for TYPE``, split at the last `` for ``; null without one."""
    some = lambda k: F.nullif(F.regexp_extract(header, r"(?s)^impl (.*) for (.*)$", k), F.lit(""))
    return some(1), some(2)


def promises(header: Column) -> Column:
    """The leading name, up to ``<``, ``:`` or a space, of the trait that a header promises; null without one."""
    return F.nullif(F.regexp_extract(header_promise(header)[0], r"^([^<: ]*)", 1), F.lit(""))


def module_path(path: Column) -> Column:
    """Modules of a source file: what lies below its last src, tests, benches or examples; main, lib, mod and build name none."""
    parts = F.split(path, "/")
    place = F.transform(parts, lambda p, k: F.when(p.isin("src", "tests", "benches", "examples"), k + 1).otherwise(0))
    below = F.slice(parts, F.array_max(place) + 1, F.size(parts))
    stem = F.regexp_replace(F.element_at(below, -1), r"\.rs$", "")
    dirs = F.slice(below, 1, F.greatest(F.size(below) - 1, F.lit(0)))
    return F.when(stem.isin("main", "lib", "mod", "build"), dirs).otherwise(F.concat(dirs, F.array(stem)))


def line_number(text: Column, offset: Column) -> Column:
    """Line (from 1) of a byte offset in UTF-8 text."""
    before = F.decode(F.substring(F.encode(text, "UTF-8"), F.lit(1), offset.cast("int")), "ISO-8859-1")  # a byte is a character
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def lines_before(text: Column, chars: Column) -> Column:
    """Line (from 1) of a character offset."""
    before = F.substring(text, F.lit(1), chars.cast("int"))
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def common_indent(text: Column) -> Column:
    """The fewest leading spaces of lines that aren't blank; 0 if all are."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    return F.coalesce(F.array_min(F.transform(lines, lambda x: F.length(x) - F.length(F.ltrim(x)))), F.lit(0))


def dedent(text: Column) -> Column:
    """Every line without the common indent."""
    cut = lambda by: F.array_join(F.transform(F.split(text, "\n"), lambda x: F.substring(x, F.least(by, F.length(x)) + 1, F.length(x))), "\n")
    return F.get(F.transform(F.array(common_indent(text)), cut), F.lit(0))  # bound, else it is computed again for each line


def plural(n: Column, word: str) -> Column:
    """``1 crate``, ``2 crates``, ``2 boxes``."""
    many = word + ("es" if word.endswith(("s", "x", "ch", "sh")) else "s")
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, word).otherwise(many))


def compact(text: Column, most: int = 48) -> Column:
    """Collapsed text of at most ``most`` UTF-8 bytes, cut between characters, with an ellipsis if cut."""
    whole = collapse(text)
    sizes = F.transform(F.sequence(F.lit(0), F.least(F.length(whole), F.lit(most))), lambda k: F.when(F.octet_length(F.substring(whole, F.lit(1), k)) <= most, k).otherwise(0))
    return F.when(F.octet_length(whole) <= most, whole).otherwise(F.concat(F.substring(whole, F.lit(1), F.array_max(sizes)), F.lit("…")))


def star_radius(deps: Column) -> Column:
    return F.least(F.sqrt(deps) * 1.3 + 4, F.lit(11.0))


def halo_opacity(hops: Column) -> Column:
    return F.greatest(F.lit(0.85) - (hops - 1) * 0.22, F.lit(0.3))
