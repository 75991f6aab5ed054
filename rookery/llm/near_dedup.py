"""Near-duplicate documents by minhash with tensored banding.

Two small collections of minhash bundles are computed for a document.  A table of
the index is a pair of bundles, one of each collection, so 2 * BUNDLES bundles
make BUNDLES ** 2 tables.  Documents that meet in a table are candidates; their
full shingle sets decide.

Equal sets are one class from the start, so copies cost nothing later.  Only
bundles that two classes share can meet in a table, so the others are dropped
before keys are paired.  A table key that classes share is a bucket.  Then:

1. Every class is compared with the smallest class of each of its buckets.  A
   bucket of n classes makes n - 1 comparisons.  Links give first components.
2. In a bucket, classes outside the component of its smallest one are compared
   with the bucket's others of another component.  This is done in blocks of
   bounded size, inside tasks: an estimate from all minhashes rejects most pairs,
   a pair that shares several buckets counts in the first only, and full sets are
   brought only where a pair is left.  Only links that join two components leave
   a task.

No bucket is gathered in one task, nothing is capped, and what is broadcast is
checked for its size.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rookery.llm.common import discard, join_heavy, slices, small, staged, utf8
from rookery.llm.components import components
from rookery.llm.shingles import BUNDLES, ROWS, Words64, bundles, common, minhashes, name_of, shingles

#: Linked if 100 * intersection >= SIMILAR * union, unless another share is asked for.
SIMILAR = 85
#: Classes, and shingles of their sets, in a block or compared with a bucket's smallest class in one task.
BLOCK, BLOCK_SHINGLES = 256, 1 << 20
#: Blocks of classes apart that meet all others of their bucket.
FEW = 4
#: Shingles of large buckets' members that count as frequent.
FREQUENT = 50_000
#: In place of a table's number, for buckets of classes that share a rare shingle.
RARE = -1
#: Pairs just similar enough that the estimate from minhashes may reject.
MISSED = 1e-6


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = Words64()
    for batch in slices(batches):
        sets = [shingles(t, hashes) for t in utf8(batch.column(1))]
        keys = [bundles(s).view(np.int64) if len(s) else [] for s in sets]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([name_of(s) if len(s) else None for s in sets], pa.binary()), pa.array(keys, pa.list_(pa.int64())),
            ],
            names=["id", "n", "cls", "keys"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = Words64()
    for batch in slices(batches):
        sets = [shingles(t, hashes) for t in utf8(batch.column(1))]
        same = [len(s) > 0 and name_of(s) == c for s, c in zip(sets, batch.column(2).to_pylist(), strict=True)]
        sketches = [(minhashes(s) >> np.uint64(32)).astype(np.uint32).tobytes() if ok else b"" for s, ok in zip(sets, same, strict=True)]
        out = pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(sketches, pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())],
            names=["node", "cls", "n", "sketch", "shingles"],
        )
        yield out.filter(pa.array(same, pa.bool_()))


def similar(a: np.ndarray, b: np.ndarray, percent: int = SIMILAR) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = common(a, b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def fewest_equal(percent: int) -> int:
    """Equal minhashes from which full sets are compared: of pairs at the link's similarity, at most ``MISSED`` have fewer."""
    n, p, below = 2 * BUNDLES * ROWS, percent / 100, 0.0
    for k in range(n):
        below += math.comb(n, k) * p**k * (1 - p) ** (n - k)
        if below > MISSED:
            return k
    return n


def _star(percent: int) -> Callable[[pa.Table], pa.Table]:
    return lambda group: star_links(group, percent)


def _blocks(percent: int) -> Callable[[pa.Table], pa.Table]:
    fewest = fewest_equal(percent)
    return lambda group: block_links(group, percent, fewest)


def star_links(group: pa.Table, percent: int) -> pa.Table:
    """Links of a bucket's smallest class (side 0) with its members (side 1)."""
    sides, nodes, shingle_sets = (group.column(c).to_pylist() for c in ("side", "node", "shingles"))
    sets = [np.frombuffer(s, np.uint64) for s in shingle_sets]
    heads = [k for k, s in enumerate(sides) if s == 0]
    links = {(nodes[h], nodes[k]) for k, s in enumerate(sides) if s == 1 for h in heads if similar(sets[h], sets[k], percent)}
    return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})


def first_shared(a: np.ndarray, b: np.ndarray) -> int:
    """The first table in which two sketches meet, or -1."""
    same = (a == b).reshape(2, BUNDLES, ROWS).all(axis=2)
    return int(same[0].argmax() * BUNDLES + same[1].argmax()) if same.any(axis=1).all() else -1


def candidates(group: pa.Table, percent: int, fewest: int) -> Iterator[tuple[int, list[int]]]:
    """Rows of two blocks, or of one, with the later ones that may be linked to them over components and meet them in this table first.

    Classes that meet by a rare shingle (``RARE``) may meet by several.
    """
    sketch = np.stack([np.frombuffer(s, np.uint32) for s in group.column("sketch").to_pylist()])
    sizes, label, block = (group.column(c).to_numpy() for c in ("n", "label", "block"))
    table, two = group.column("t")[0].as_py(), block.max() > block.min()
    for k in range(len(label)):
        others = np.arange(k + 1, len(label))
        may = (label[others] != label[k]) & (100 * np.minimum(sizes[others], sizes[k]) >= percent * np.maximum(sizes[others], sizes[k]))
        if two:
            may &= block[others] != block[k]
        others = others[may]
        others = others[(sketch[others] == sketch[k]).sum(axis=1) >= fewest]
        if len(others):
            yield k, [j for j in others.tolist() if table == RARE or first_shared(sketch[k], sketch[j]) == table]


def _with_candidates(percent: int) -> Callable[[pa.Table], pa.Table]:
    """The rows of a group that may be linked to another, with their sketches; full sets are needed for no others."""
    fewest = fewest_equal(percent)

    def run(group: pa.Table) -> pa.Table:
        keep = np.zeros(len(group), bool)
        for k, others in candidates(group, percent, fewest):
            keep[others] = True
            keep[k] |= bool(others)
        return group.filter(pa.array(keep))

    return run


def block_links(group: pa.Table, percent: int, fewest: int) -> pa.Table:
    """Pairs of components that are linked by classes of two blocks, or of one with itself, as many as join them."""
    labels = group.column("label").to_pylist()
    sets = [np.frombuffer(s, np.uint64) for s in group.column("shingles").to_pylist()]
    parent = {x: x for x in set(labels)}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for k, others in candidates(group, percent, fewest):
        for j in others:
            a, b = root(labels[k]), root(labels[j])
            if a != b and similar(sets[k], sets[j], percent):
                parent[max(a, b)] = min(a, b)
                out.append((labels[k], labels[j]))
    return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})


def _parts(which=None):
    """Blocks for the rows that are ``which``, by number and by shingles; a power of two."""
    one, n = (F.count("*"), F.sum("n")) if which is None else (F.count_if(which), F.sum(F.when(which, F.col("n"))))
    weight = F.greatest(one / BLOCK, F.coalesce(n, F.lit(0)) / BLOCK_SHINGLES, F.lit(1.0))
    return F.pow(F.lit(2), F.ceil(F.log2(weight))).cast("int")


def _buckets(classes: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Of classes (node, n, keys), the members of buckets (table_key, t, node, n, head, size, parts), buckets, and how many members.

    ``t`` is the number of the table, ``head`` the bucket's smallest class, and
    ``parts`` in how many tasks the members are compared with the head.
    """
    single = classes.select("node", "n", F.posexplode("keys").alias("k", "key"))
    met = single.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    live = join_heavy(single, met, "key", "size", 2 * BUNDLES * classes.count())
    live = live.groupBy("node").agg(F.max("n").alias("n"), F.collect_set(F.struct("k", "key")).alias("keys"))
    one, two = F.filter("keys", lambda x: x["k"] < BUNDLES), F.filter("keys", lambda x: x["k"] >= BUNDLES)
    pair = lambda x, y: F.struct((x["k"] * BUNDLES + y["k"] - BUNDLES).alias("t"), F.xxhash64(x["key"], y["key"]).alias("table_key"))
    tables = F.flatten(F.transform(one, lambda x: F.transform(two, lambda y: pair(x, y))))
    keyed = staged(live.select("node", "n", F.explode(tables).alias("e")).select("e.table_key", "e.t", "node", "n"), "keys")
    heads = keyed.groupBy("table_key").agg(F.min("node").alias("head"), F.count("*").alias("size"), _parts().alias("parts"))
    heads = staged(heads.where("size > 1"), "heads")
    members = heads.agg(F.coalesce(F.sum("size"), F.lit(0))).head()[0]
    buckets = staged(join_heavy(keyed, heads, "table_key", "size", members), "buckets")
    discard(keyed)
    return buckets, heads, members


def _with_heads(buckets: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """1: links of the buckets' members with the smallest of the bucket."""
    pairs = buckets.where("node <> head").groupBy("head", "node").agg(F.max("parts").alias("parts"))
    members = pairs.select("head", "parts", F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part"), F.lit(1).alias("side"), "node")
    first = pairs.select("head", "parts").distinct()
    first = first.select("head", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("side"), F.col("head").alias("node"))
    sets = members.unionByName(first).join(full.select("node", "shingles"), "node")
    return sets.groupBy("head", "parts", "part").applyInArrow(_star(percent), "a long, b long")


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingles of full sets."""
    for batch in slices(batches, 0):
        for packed in batch.column(0).to_pylist():
            own = np.frombuffer(packed, np.int64)
            for at in range(0, len(own), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(own[at : at + (1 << 16)])], names=["shingle"])


def rarest(own: np.ndarray, frequent: np.ndarray, place: np.ndarray, most: int) -> np.ndarray:
    """The first ``most`` of a sorted set, shingles that aren't ``frequent`` (sorted) first, then those by their ``place``."""
    at = np.searchsorted(frequent, own)
    at[at == len(frequent)] = 0
    rank = np.where(frequent[at] == own, place[at], -1) if len(frequent) else np.full(len(own), -1)
    return own[np.argsort(rank, kind="stable")[:most]]


def _prefixes(held, percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, place = held.value
        for batch in slices(batches):
            nodes, firsts = batch.column(0).to_pylist(), []
            for packed in batch.column(1).to_pylist():
                own = np.frombuffer(packed, np.uint64).view(np.int64)
                own = np.sort(own)
                firsts.append(rarest(own, frequent, place, len(own) - -(-len(own) * percent // 100) + 1))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(nodes, np.int64), list(map(len, firsts)))), pa.array(np.concatenate(firsts))], names=["node", "table_key"])

    return run


def _rare(members: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Buckets (table_key, t, node, n, label) of ``members`` (node, n, label) that share a rare shingle.

    In whatever order all shingles stand, two sets that are linked share one among the first
    n - ceil(n * percent / 100) + 1 of either (prefix filter).  Here the ``FREQUENT`` most frequent ones stand
    last, so classes that only share what many share don't meet, and no link is lost.  Only those go over
    the driver, a fixed number of them.
    """
    sets = staged(members.select("node").join(full.select("node", "shingles"), "node"), "rare-sets")
    often = sets.select("shingles").mapInArrow(_shingle_rows, "shingle long").groupBy("shingle").agg(F.count("*").alias("often")).where("often > 1")
    top = often.orderBy(F.desc("often"), "shingle").limit(FREQUENT).collect()
    order = np.array(sorted(r["shingle"] for r in top), np.int64)
    place = {r["shingle"]: len(top) - k for k, r in enumerate(top)}
    held = members.sparkSession.sparkContext.broadcast((order, np.array([place[x] for x in order.tolist()], np.int64)))
    first = staged(sets.select("node", "shingles").mapInArrow(_prefixes(held, percent), "node long, table_key long"), "prefixes")
    met = first.groupBy("table_key").agg(F.count("*").alias("size")).where("size > 1")
    met = join_heavy(first, met, "table_key", "size", first.count()).select("node", "table_key")
    out = staged(met.join(members, "node").select("table_key", F.lit(RARE).alias("t"), "node", "n", "label"), "rare")
    discard(sets, first)
    return out


def _open(own: DataFrame, members: int) -> DataFrame:
    """Of buckets (table_key, t, node, n, label) those of several components: with ``apart``, who isn't of their smallest one's, and blocks."""
    seen = own.groupBy("table_key").agg(F.count("*").alias("size"), F.min_by("label", "node").alias("head_label"), (F.min("label") != F.max("label")).alias("open"))
    seen = staged(seen.where("open").select("table_key", "size", "head_label"), "open")
    n = seen.count()
    own = join_heavy(own, seen, "table_key", "size", members, n)
    own = labelled = staged(own.select("table_key", "t", "node", "n", "label", (F.col("label") != F.col("head_label")).alias("apart")), "labelled")
    sizes = own.groupBy("table_key").agg(F.count("*").alias("size"), _parts().alias("all"), _parts(F.col("apart")).alias("a"), _parts(~F.col("apart")).alias("b"))
    out = staged(join_heavy(own, sizes, "table_key", "size", own.count(), n), "blocks")
    discard(seen, labelled)
    return out


def _with_others(buckets: DataFrame, members: int, labels: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """2: links between components, of classes that are apart from the bucket's smallest one, with any other.

    A bucket that fits a block is compared as it is.  In a larger one the classes apart (``a`` blocks) meet
    one another and those of the smallest one's component (``b`` blocks); these, being of one
    component, don't meet one another.  That writes at most ``FEW`` + 1 rows a member; where
    more blocks are apart, the members are dealt anew, by rare shingles, and meet in those buckets only.
    """
    label = F.coalesce("label", "node")
    own = buckets.join(small(labels, labels.count()), "node", "left").select("table_key", "t", "node", "n", label.alias("label"))
    first = own = _open(own, members)
    large = staged(own.where(F.col("a") > FEW).select("node", "n", "label").distinct(), "large")
    rare = None
    if not large.isEmpty():
        found = _rare(large, full, percent)
        rare = _open(found, found.count())
        own = own.where(F.col("a") <= FEW).unionByName(rare)
        discard(found)
    dealt = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    block = F.when(F.col("all") == 1, F.lit(0)).when(F.col("apart"), dealt("a")).otherwise(F.col("a") + dealt("b"))
    own = own.withColumn("block", block)
    with_a = F.transform(F.sequence(F.lit(0), F.col("a") - 1), lambda i: F.struct(F.least(i, "block").alias("low"), F.greatest(i, "block").alias("high")))
    with_b = F.transform(F.sequence(F.lit(0), F.col("b") - 1), lambda i: F.struct(F.col("block").alias("low"), (F.col("a") + i).alias("high")))
    alone = F.array(F.struct(F.lit(0).alias("low"), F.lit(0).alias("high")))
    met = F.when(F.col("all") == 1, alone).when(F.col("apart"), F.concat(with_a, with_b)).otherwise(with_a)
    group = ["table_key", "t", "low", "high"]
    spread = own.select("table_key", "t", "node", "label", "block", F.explode(met).alias("e")).select("table_key", "e.low", "e.high", "t", "node", "label", "block")
    kinds = "table_key long, t int, low int, high int, node long, n long, label long, block int, sketch binary"
    some = spread.join(full.select("node", "n", "sketch"), "node").select(*group, "node", "n", "label", "block", "sketch")
    some = some.groupBy(*group).applyInArrow(_with_candidates(percent), kinds)
    found = some.join(full.select("node", "sketch", "shingles"), ["node", "sketch"]).groupBy(*group).applyInArrow(_blocks(percent), "a long, b long")
    found = staged(found, "joined")
    discard(first, large, *([rare] if rare else []))
    return found


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = SIMILAR) -> DataFrame:
    """Per row: id, n_shingles, component_id, kept (whether the id is its component's smallest).

    Texts are linked whose sets have ``percent`` hundredths of their union in common.

    A text's set is its distinct five-word shingles; of fewer words, all of them
    as one; null or without words, it is empty and linked with nothing.  Rows
    that share an id count as one document with several texts.  A row with a null
    id takes no part: its component is null and it is kept.  Texts may be of any
    length; an empty table gives no rows; other columns take no part.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = staged(rows.mapInArrow(_signatures, "id long, n long, cls binary, keys array<long>"), "signatures")
    named = F.coalesce((F.col("n") > 0) & F.col("id").isNotNull(), F.lit(False))
    n_named, ids, distinct = signed.agg(F.count_if(named), F.count("id"), F.count_distinct("id")).head()
    classes = staged(signed.where(named).groupBy("cls").agg(F.min("id").alias("node"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.count("*").alias("copies")), "classes")
    buckets, heads, members = _buckets(classes)

    # full sets of the classes that met
    met = staged(buckets.select("node").distinct().join(classes.select("node", "cls"), "node"), "met")
    wanted = rows.join(small(met.withColumnRenamed("node", "id"), met.count()), "id").select("id", "text", "cls")
    wanted = wanted.distinct() if ids > distinct else wanted  # an id's other texts have other sets, which are left out
    full = staged(wanted.mapInArrow(_sets, "node long, cls binary, n long, sketch binary, shingles binary"), "sets")

    links = staged(_with_heads(buckets, full, percent), "links")
    every = links
    if ids > distinct:  # an id's texts belong together
        texts = signed.where(named).select("id", "cls").distinct().join(classes.select("cls", "node"), "cls")
        several = texts.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")
        every = links.unionByName(texts.join(several, "id").select(F.col("id").alias("a"), F.col("node").alias("b")))
    labels = components(every)
    compared = _with_others(buckets, members, labels, full, percent)
    joined = components(compared)
    labels = labels.unionByName(joined.select("node", F.col("node").alias("label"))).distinct()
    last = joined.select(F.col("node").alias("label"), F.col("label").alias("last"))
    labels = labels.join(small(last, last.count()), "label", "left").select("node", F.coalesce("last", "label").alias("label"))
    of_class = classes.select("cls", "node", "copies").join(labels, "node", "left").select("cls", "copies", F.coalesce("label", "node").alias("component"))
    of_class = staged(of_class, "components")
    discard(buckets, heads, met, full, links)

    some = join_heavy(signed.where(named).select("id", "n", "cls"), of_class, "cls", "copies", n_named).select("id", "n", "component")
    out = some.unionByName(signed.where(~named).select("id", "n", F.col("id").alias("component")))
    out = out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def remove_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = SIMILAR) -> DataFrame:
    """``docs`` with one row of each component, all columns kept as they are.

    Of rows that share the kept id, the one with the smallest text stays, and of
    equal texts the one whose other columns come first as JSON.  Rows with a null
    id all stay, and so do texts without words, unless their id is repeated.
    """
    judged = staged(near_duplicates(docs, id_col=id_col, text_col=text_col, percent=percent).select(id_col, "kept"), "judged")
    n_gone, ids, distinct = judged.agg(F.count_if(~F.col("kept")), F.count(id_col), F.count_distinct(id_col)).head()
    gone = judged.where(~F.col("kept")).select(id_col).distinct()
    out = docs.join(small(gone, n_gone), id_col, "left_anti").select(*docs.columns)
    if ids > distinct:
        row = F.struct(*[out[c] for c in out.columns])
        one = out.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min_by(row, F.struct(F.col(text_col), F.to_json(row))).alias("row_"))
        out = one.select("row_.*").unionByName(out.where(F.col(id_col).isNull()))
    return out
