"""The data altitude: who holds whom, what nests in what, and which types stand alone.

Holds are (src, dst, kind, fields): ``src`` holds ``dst`` in that many fields, and
kind is owns, shares or borrows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from rookery.functions.predicates import VISIBILITY, visibility_rank
from rookery.operators.graph import closure, cycle_heads
from rookery.plans.staging import dealt, discard, staged

#: Fixed value: more holders than this make a type vocabulary.
HELD_CAP = 3
#: wrappers' strength, by kind of hold.
HOLD_RANK = {"owns": 0, "borrows": 1, "dyn": 2, "shares": 3}


def holders(holds: DataFrame) -> DataFrame:
    """(node, held_by, shared): distinct holders that own or share, and whether any shares."""
    h = holds.where(F.col("kind").isin("owns", "shares") & (F.col("src") != F.col("dst")))
    return h.groupBy(F.col("dst").alias("node")).agg(F.countDistinct("src").alias("held_by"), F.bool_or(F.col("kind") == "shares").alias("shared"))


def nesting_forest(holds: DataFrame, items: DataFrame) -> DataFrame:
    """(node, parent, ringed) for items that some item of their frame plainly owns.

    Items choose in the order of their ids: each takes the heaviest of its owners
    (the smallest of equals) from which no ring is closed; one without such an owner
    is ringed.  Statics and vocabulary neither nest; vocabulary doesn't contain.

    At first every item has its heaviest owner.  If choices form a ring, its largest
    item is the one that would have closed it: the others chose before, and nothing
    that happens elsewhere makes them choose anew.  So in each round the largest
    item of every ring moves on to its next owner, until there are no rings.
    """
    it = items.select(F.col("id").alias("node"), "kind", "frame")
    vocab = holders(holds).where(F.col("held_by") > HELD_CAP).select("node")
    may = it.join(vocab, "node", "left_anti")
    owns = holds.where("kind = 'owns' and src <> dst").groupBy("src", "dst").agg(F.sum("fields").alias("weight"))
    child = may.where("kind <> 'static'").select(F.col("node").alias("dst"), "frame")
    parent = may.where(F.col("kind").isin("struct", "enum", "union", "static")).select(F.col("node").alias("src"), F.col("frame").alias("parent_frame"))
    pairs = owns.join(child, "dst").join(parent, "src").where("frame = parent_frame")
    # an item has ``HELD_CAP`` owners at most
    order = Window.partitionBy("dst").orderBy(F.desc("weight"), "src")
    options = staged(pairs.select(F.col("dst").cast("long").alias("node"), F.row_number().over(order).alias("nth"), F.col("src").cast("long").alias("parent")), "nest")
    choice = options.where("nth = 1")
    while True:
        heads = cycle_heads(choice.select("node", "parent"))
        if heads.isEmpty():
            return choice.select("node", "parent", F.col("parent").isNull().alias("ringed"))
        on = choice.join(heads, "node", "left_semi").select("node", (F.col("nth") + 1).alias("nth"))
        moved = on.join(options, ["node", "nth"], "left")
        before, choice = choice, staged(choice.join(heads, "node", "left_anti").unionByName(moved), "nested")
        discard(before)


def data_tiers(holds: DataFrame, items: DataFrame, holders_off: DataFrame | None = None) -> DataFrame:
    """(node, tier, parent): root, nested, or standing as vocabulary, shared, ring, afar or narrower.

    ``holders_off`` has the holds (src, dst, kind) by declarations that the reading leaves
    off; an item with no other owning or sharing holder is narrower, not a root.
    """
    out = items.select(F.col("id").alias("node"), "kind").join(nesting_forest(holds, items), "node", "left").join(holders(holds), "node", "left")
    held, off = F.coalesce("held_by", F.lit(0)), F.lit(False)
    if holders_off is not None:
        out = out.join(holders(holders_off).select("node", F.lit(True).alias("off")), "node", "left")
        off = F.coalesce("off", F.lit(False))
    tier = (
        F.when(F.col("kind") == "static", "root").when(F.col("parent").isNotNull(), "nested").when((held == 0) & off, "narrower").when(held == 0, "root")
        .when(held > HELD_CAP, "vocab").when(F.col("shared"), "shared").when(F.col("ringed"), "ring").otherwise("afar")
    )
    return out.select("node", tier.alias("tier"), "parent")


def hold_upstream(holds: DataFrame, start: DataFrame) -> DataFrame:
    """(node, hops): everything that holds the start, directly or not, without the start."""
    return closure(holds.select(F.col("dst").alias("src"), F.col("src").alias("dst")), start, inclusive=False)


def ties(refs: DataFrame, roots: DataFrame, drawn: DataFrame, tasks: int | None = None) -> DataFrame:
    """References lifted to what contains their ends: (definition, holder, n, seen), by whether both ends are drawn.

    ``refs`` is (src, dst, w) with ``src`` the user; ``roots`` (node, root); none stays inside one root.
    ``seen`` is both, unseen_in (only the definition is drawn), unseen_out or neither.
    Whether a root is drawn is told with it, so references are dealt by their ends and their roots
    only; into ``tasks``, if given, which should grow with them.
    """
    on = drawn.select(F.col(drawn.columns[0]).alias("root"), F.lit(True).alias("on")).distinct()
    marked = roots.select("node", "root").join(on, "root", "left")
    at = lambda c, to: marked.select(F.col("node").alias(c), F.col("root").alias(to), F.coalesce("on", F.lit(False)).alias(f"{to}_on"))
    e = dealt(refs.select("src", "dst", "w"), tasks, "src").join(at("src", "holder"), "src")
    e = dealt(e.drop("src"), tasks, "dst").join(at("dst", "definition"), "dst").where("holder <> definition")
    e = dealt(e, tasks, "definition", "holder").groupBy("definition", "holder", "definition_on", "holder_on").agg(F.sum("w").cast("long").alias("n"))
    seen = F.when(F.col("definition_on") & F.col("holder_on"), "both").when(F.col("definition_on"), "unseen_in").when(F.col("holder_on"), "unseen_out").otherwise("neither")
    return e.select("definition", "holder", "n", seen.alias("seen"))


def label_bar(counts: DataFrame, nth: int = 13, least: int = 2) -> DataFrame:
    """One row ``bar``: the nth largest count, at least ``least``; fewer counts than nth give ``least``."""
    top = counts.select("n").orderBy(F.desc("n")).limit(nth)
    return top.agg(F.greatest(F.lit(least), F.when(F.count("*") >= nth, F.min("n")).otherwise(least)).cast("long").alias("bar"))


def visible(vis: str, floor: str):
    """Whether a visibility is admitted by a floor."""
    return visibility_rank(F.col(vis)) <= VISIBILITY[floor]


def census(items: DataFrame, floor: str) -> DataFrame:
    """Per kind: all, admitted and off the paper."""
    on = visible("vis", floor)
    return items.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(on).alias("admitted"), F.count_if(~on).alias("off_paper"))


def type_walk(terms: DataFrame, depth: int = 16) -> DataFrame:
    """Edges from type terms, walked from the outside in: (row, target, kind).

    ``terms`` is (row, node, parent, ctor, name): the tree of a field's type, whose
    inner nodes are ref, shared (a known wrapper), dyn, local (a type of the
    workspace) or plain.  The strongest wrapper so far counts, a local type is a
    target and its arguments are walked on, below ``dyn`` nothing is.  Of several
    edges of a row to one target the strongest, then the outermost counts.
    Terms are trees, so a level is a join; levels are staged, and the walk ends with
    the deepest term or at ``depth``.
    """
    effect = F.when(F.col("ctor") == "ref", 1).when(F.col("ctor") == "dyn", 2).when(F.col("ctor") == "shared", 3).otherwise(0)
    t = staged(terms.withColumn("effect", effect), "terms")
    level = t.where("parent is null").select("row", "node", "ctor", "name", F.col("effect").alias("rank"), F.lit(0).alias("level"))
    found = level
    for k in range(1, depth + 1):
        up = level.where("ctor <> 'dyn'").select("row", F.col("node").alias("parent"), F.col("rank").alias("above"))
        level = t.join(up, ["row", "parent"]).select("row", "node", "ctor", "name", F.greatest("above", "effect").alias("rank"), F.lit(k).alias("level"))
        level = staged(level, "level")
        if level.isEmpty():
            break
        found = found.unionByName(level)
    hit = found.where(F.col("ctor").isin("local", "dyn"))
    best = hit.groupBy("row", F.col("name").alias("target")).agg(F.min_by("rank", F.struct(-F.col("rank"), "level", "node")).alias("rank"))
    names = F.array(*[F.lit(k) for k in HOLD_RANK])
    return best.select("row", "target", F.element_at(names, F.col("rank") + 1).alias("kind"))
