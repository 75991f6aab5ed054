"""Predicates and small classifications on nodes and edges, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kinds of declarations.
DATA_KINDS = ("struct", "enum", "union", "static")
CALLABLE_KINDS = ("fn", "macro")
#: A visibility's rank, from the widest; the floors a reading can have.
VISIBILITY = {"pub": 0, "pub(crate)": 1, "pub(super)": 2, "pub(in)": 2, "": 3}
FLOORS = {"pub": 0, "crate": 1, "super": 2, "all": 3}


def is_data(kind: Column) -> Column:
    return kind.isin(*DATA_KINDS)


def is_callable(kind: Column) -> Column:
    return kind.isin(*CALLABLE_KINDS)


def visibility_rank(vis: Column) -> Column:
    """0 for everybody to 3 for private; unknown words count as private."""
    rank = F.lit(3)
    for word, r in VISIBILITY.items():
        rank = F.when(vis == word, r).otherwise(rank)
    return rank


def admits(vis: Column, floor: str) -> Column:
    return visibility_rank(vis) <= FLOORS[floor]


def showing(vis: Column) -> Column:
    """The smallest floor that admits a visibility."""
    return F.element_at(F.array(*[F.lit(f) for f in FLOORS]), visibility_rank(vis) + 1)


def node_class(is_member: Column, changed_files: Column, ghost: Column, hops: Column) -> Column:
    """ghost, changed, member, downstream or external, in this order."""
    return F.when(ghost, "ghost").when(changed_files > 0, "changed").when(is_member, "member").when(hops > 0, "downstream").otherwise("external")


def test_only(attributes: Column) -> Column:
    """Whether collapsed attribute text marks a declaration that only tests have."""
    bare = F.regexp_replace(attributes, r"\s+", "")
    return bare.rlike(r"#\[(test\]|[^\]]*::test\]|cfg\(test|cfg\(all\(test)")


def not_removed(event: Column) -> Column:
    """True for no event too."""
    return ~event.eqNullSafe("removed")


def draws(direction: str, at: Column, definition: Column, user: Column) -> Column:
    """Whether an edge is drawn for the node ``at`` when reading out (what it uses), in (what uses it) or both."""
    return {"out": user == at, "in": definition == at, "both": (user == at) | (definition == at)}[direction]


def structural(from_method: Column, holder_kind: Column) -> Column:
    """A hold is structure iff a data type holds it outside of its methods; else it only names."""
    return ~from_method & is_data(holder_kind)


def charted(kind: Column, parent: Column) -> Column:
    """Declarations that a diff charts: data, traits and, without a parent, functions, constants and aliases."""
    return is_data(kind) | (kind == "trait") | (kind.isin("fn", "const", "alias") & parent.isNull())


def diff_anchored(direction: str, def_dirty: Column, user_dirty: Column) -> Column:
    """Whether an edge starts at a changed declaration in the direction that is read."""
    return {"out": user_dirty, "in": def_dirty, "both": def_dirty | user_dirty}[direction]


def rests(event: Column, vocabulary: Column) -> Column:
    """A hold is drawn at rest if it has an event or its held end is no vocabulary."""
    return event.isNotNull() | ~vocabulary


def resting_drawn(bundle: Column, lit: Column, answers: Column, picked: Column, dirty: Column, anchored: Column, cross: Column) -> Column:
    """Whether a wire is drawn at rest.

    A bundle shows iff nothing is picked; what is lit and contracts always; with a
    pick nothing else; without one, what the diff anchors if there is a diff, else
    what doesn't cross modules.
    """
    return F.when(bundle, ~picked).when(lit | answers, True).when(picked, False).when(dirty, anchored).otherwise(~cross)


def hovered(bundle: Column, reference: Column, direction: str, at: Column, definition: Column, user: Column) -> Column:
    """Whether hovering at a node lights a line: a reference by the direction that is read, structure from either end, a bundle never."""
    return F.when(bundle, False).when(reference, draws(direction, at, definition, user)).otherwise(draws("both", at, definition, user))


def wire_visible(rests: Column, holding_kin: Column, near: Column) -> Column:
    """Whether a wire shows: it rests, a selection's holding leads along it, or it is near in the read direction."""
    return rests | holding_kin | near


def fact_sheet(*facts: Column) -> Column:
    """Whether any fact is there."""
    return F.coalesce(*facts).isNotNull()


def letter(delta: Column) -> Column:
    return F.when(delta == "added", "A").when(delta == "changed", "M").when(delta == "removed", "D")


def role(from_selected: Column, to_selected: Column, wanted: Column) -> Column:
    return F.when(from_selected, "dep").when(to_selected | wanted, "user").otherwise("event")


def selection(path: Column) -> Column:
    """Names in a route such as ``/dep/crate/a+b``."""
    return F.split(F.regexp_extract(path, r"^/dep/crate/(.+)$", 1), r"\+")


def ring_of(path: Column) -> Column:
    """Number in a route such as ``/dep/ring/3``; else null."""
    return F.nullif(F.regexp_extract(path, r"^/dep/ring/([0-9]+)$", 1), F.lit("")).cast("int")


def peek(key: Column) -> tuple[Column, Column]:
    """(path, label) of ``path@label``; both null if either is missing."""
    path, label = F.regexp_extract(key, r"(?s)^(.+)@([^@]+)$", 1), F.regexp_extract(key, r"(?s)^(.+)@([^@]+)$", 2)
    return F.nullif(path, F.lit("")), F.nullif(label, F.lit(""))
