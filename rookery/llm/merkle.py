r"""A dataset manifest: a Merkle tree over rows, its roots, and a proof for each row.

A row is a leaf: H of its fields, each ``-`` if null, else its UTF-8 byte count, a
colon and the value.  H is the lowercase hex SHA-256 of its inputs one after the
other; digests enter as hex text.  In each group, leaves ascend by id; every
``FAN`` neighbours become a node, level by level, until one node is left: the
subroot.  Subroots, ordered by group, become the root in the same way.

How it is built:

1. Leaves are range-sorted by group and id over all tasks; a leaf's rank comes from
   the counts of its group in the partitions before (``ranked``).
2. Each task turns its stretches of neighbouring ranks into complete aligned
   subtrees of at most ``FAN ** LOCAL`` leaves.  Nodes at a stretch's ragged ends
   stay as they are.
3. All these nodes are shuffled by coordinate (group, level, index), and the upper
   levels are finished one by one, at most ``FAN`` nodes meeting in a group.
4. Proofs come down the levels the same way to blocks of ``FAN ** LOCAL`` leaves;
   each block meets its own one in a task, where the lowest levels are added.

No task holds more than a block.  Ids may be null (first) and repeat (then leaves
ascend by digest); an empty table has no rows; a group may be null (first).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rookery.llm.common import crc32_of_id, discard, ranked, staged

#: Nodes that become one: a fixed value, as a power of two.
SHIFT = 3
FAN = 1 << SHIFT
#: Levels that a task builds; a block is what stands below a node of that level.
LOCAL = 3
PROOF = "array<struct<before string, after string>>"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf(fields: list[Column]) -> Column:
    """The leaf of a row, as 32 bytes."""
    # a text is hashed as it is, its length in front; nothing is copied but into the digest's input
    shown = [f.cast("string") for f in fields]
    whole = F.concat(*[F.coalesce(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f), F.lit("-")) for f in shown])
    return F.unhex(F.sha2(whole, 256))


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def above(count: int) -> int:
    """Nodes of the level above ``count`` nodes."""
    return (count + FAN - 1) >> SHIFT


def subtrees(nodes: list[str], start: int, count: int, most: int) -> Iterator[tuple[int, int, str]]:
    """(level, index, digest) of the largest complete subtrees over neighbouring leaves ``start``... of a group of ``count``."""
    level = 0
    while level < most and count > 1:
        end = start + len(nodes)
        first, last = above(start), above(end) if end == count else end >> SHIFT
        if last <= first:
            break
        head, tail = (first << SHIFT) - start, min(last << SHIFT, end) - start
        yield from ((level, start + k, nodes[k]) for k in [*range(head), *range(tail, len(nodes))])
        nodes = [digest(nodes[k : min(k + FAN, tail)]) for k in range(head, tail, FAN)]
        start, count, level = first, above(count), level + 1
    yield from ((level, start + k, x) for k, x in enumerate(nodes))


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of neighbouring ranks, cut where blocks begin, as their subtrees."""
    held: list[str] = []
    at = done = None  # key, n and first rank of what is held; rows that are made

    def close():
        if held:
            key, n, start = at
            for level, index, x in subtrees(held, start, n, LOCAL):
                for column, value in zip(done, (key, n, level, index, x), strict=True):
                    column.append(value)
            held.clear()

    for batch in batches:
        done = [[], [], [], [], []]
        for key, n, rank, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not held or key != at[0] or rank != at[2] + len(held) or not rank & (FAN**LOCAL - 1):
                close()
                at = key, n, rank
            held.append(x.hex())
        yield _nodes(done)
    if held:
        done = [[], [], [], [], []]
        close()
        yield _nodes(done)


def _nodes(columns: list[list]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["key", "n", "level", "index", "digest"])


def joined(nodes: DataFrame) -> DataFrame:
    """The nodes above ``nodes`` (of one level): with ``children``, their digests in order."""
    runs = nodes.groupBy("key", "n", F.shiftright("index", SHIFT).alias("index")).agg(F.sort_array(F.collect_list(F.struct("index", "digest"))).alias("c"))
    runs = runs.withColumn("children", F.transform("c", lambda c: c["digest"]))
    return runs.select("key", "n", "index", "children", F.sha2(F.array_join("children", ""), 256).alias("digest"))


def climb(nodes: DataFrame, most: int, kept_from: int) -> tuple[DataFrame, dict[int, DataFrame]]:
    """Roots (key, n, height, digest) of groups of up to ``most`` leaves, and by level the children of the level above.

    ``nodes`` (key, n, level, index, digest) are complete subtrees that cover each
    group once.  Levels from ``kept_from`` are staged, as proofs need them.
    """
    height = 0
    while FAN**height < most:
        height += 1
    levels: dict[int, DataFrame] = {}
    here = nodes.where("level = 0").drop("level")
    roots = here.where("n = 1").withColumn("height", F.lit(0))
    for level in range(height):
        up = joined(here.where(F.col("n") > FAN**level))
        if level >= kept_from:
            up = staged(up, "merkle-level")
            levels[level] = up.drop("digest")
        made = up.drop("children")
        here = made.unionByName(nodes.where(F.col("level") == level + 1).drop("level"))
        roots = roots.unionByName(here.where((F.col("n") <= FAN ** (level + 1)) & (F.col("n") > FAN**level)).withColumn("height", F.lit(level + 1)))
    return roots.drop("index"), levels


def descend(roots: DataFrame, levels: dict[int, DataFrame], lowest: int) -> DataFrame:
    """Proofs of the nodes of level ``lowest``, from those of the roots (key, height, proof and what else goes along).

    A group that is not as high has one row, index 0.  A node and its children
    meet by coordinate, so no key is hot.
    """
    along = [c for c in roots.columns if c not in ("height", "proof")]
    at = F.greatest("height", F.lit(lowest))
    start = lambda level: roots.where(at == level).select(*along, F.lit(0).cast("long").alias("index"), "proof")
    here = None
    for level in sorted((k for k in levels if k >= lowest), reverse=True):
        there = start(level + 1) if here is None else here.unionByName(start(level + 1))
        down = there.join(levels[level].select("key", "index", "children"), ["key", "index"])
        down = down.select(*along, "index", "proof", "children", F.posexplode("children").alias("k", "own"))
        sides = F.struct(
            F.array_join(F.slice("children", F.lit(1), F.col("k")), "").alias("before"),
            F.array_join(F.slice("children", F.col("k") + 2, F.lit(FAN)), "").alias("after"),
        )
        here = down.select(*along, (F.shiftleft("index", SHIFT) + F.col("k")).alias("index"), F.concat(F.array(sides), "proof").alias("proof"))
    return start(lowest) if here is None else here.unionByName(start(lowest))


def _with_proofs(leaves: pa.Table, block: pa.Table) -> pa.Table:
    """A block's leaves with their proofs: the lowest levels are made here, the others came with the block."""
    leaves = leaves.sort_by("rank")
    n, upper = leaves.column("n")[0].as_py(), block.column("proof")[0].as_py()
    nodes, count, start = [x.hex() for x in leaves.column("leaf").to_pylist()], n, leaves.column("rank")[0].as_py()
    before, after, which = [], [], []
    at = np.arange(len(nodes))
    for _ in range(LOCAL):
        if count == 1:
            break
        which.append(len(before) + at)
        runs = [nodes[k : k + FAN] for k in range(0, len(nodes), FAN)]
        before += ["".join(run[:k]) for run in runs for k in range(len(run))]
        after += ["".join(run[k + 1 :]) for run in runs for k in range(len(run))]
        nodes, count, start, at = [digest(run) for run in runs], above(count), start >> SHIFT, at >> SHIFT
    which += [np.full(len(at), len(before) + k) for k in range(len(upper))]
    before, after = before + [x["before"] for x in upper], after + [x["after"] for x in upper]
    flat = pa.array(np.stack(which, 1).ravel() if which else np.zeros(0, np.int64))
    sides = pa.StructArray.from_arrays([pa.array(x, pa.string()).take(flat) for x in (before, after)], ["before", "after"])
    proof = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * len(which), pa.int32()), sides)
    same = lambda name: pa.array([block.column(name)[0].as_py()] * len(at), pa.string())
    out = leaves.drop_columns(["key", "n", "rank", "block"])
    return out.append_column("subroot", same("subroot")).append_column("root", same("root")).append_column("proof", proof)


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", fields: tuple[str, ...] = FIELDS, carry: dict[str, Column] | None = None) -> DataFrame:
    """Every row's ``id_col``, ``leaf``, ``subroot``, ``root`` and ``proof``.

    ``proof`` goes from the leaf to the root: at each level the digests before and
    after the row's own in its run of siblings (``folded`` uses it).  ``carry``
    are further columns, made of ``docs``, that go with their rows.  Other
    columns of ``docs`` are ignored, whatever their names.
    """
    carry = carry or {}
    # null groups come first; the sign in front keeps them apart from empty names
    key = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))
    own = docs.select(F.col(id_col).alias("id"), key.alias("key"), leaf([F.col(f) for f in fields]).alias("leaf"), *[c.alias(f"carried_{k}") for k, c in carry.items()])
    hashed = staged(own, "merkle-leaves")
    leaves, groups = ranked(hashed, ["key"], ["id", "leaf"], "merkle-ranked")
    nodes = staged(leaves.select("key", "n", "rank", "leaf").mapInArrow(_local, "key string, n long, level int, index long, digest string"), "merkle-nodes")
    subroots, levels = climb(nodes, groups.agg(F.max("n")).head()[0] or 0, LOCAL)
    subroots = staged(subroots, "merkle-subroots")

    ordered, _ = ranked(subroots.select("key", F.col("digest").alias("subroot"), F.col("height").alias("own_height"), F.col("n").alias("own_n")), [], ["key"], "merkle-groups")
    ordered = staged(ordered, "merkle-order")
    top = ordered.select(F.lit("").alias("key"), "n", F.lit(0).alias("level"), F.col("rank").alias("index"), F.col("subroot").alias("digest"))
    root, top_levels = climb(top, ordered.agg(F.max("n")).head()[0] or 0, 0)
    no_proof = F.array().cast(PROOF)
    from_root = descend(root.select("key", "height", F.col("digest").alias("root"), no_proof.alias("proof")), top_levels, 0)
    from_root = ordered.join(from_root.select(F.col("index").alias("rank"), "root", "proof"), "rank")
    starts = staged(from_root.select("key", F.col("own_height").alias("height"), "subroot", "root", "proof"), "merkle-tops")

    blocks = descend(starts, levels, LOCAL).withColumnRenamed("index", "block")
    rows = leaves.withColumn("block", F.shiftright("rank", SHIFT * LOCAL))
    kind = lambda f: f"`{f.name}` {f.dataType.simpleString()}"
    out = ", ".join([*[kind(f) for f in hashed.schema if f.name != "key"], "subroot string", "root string", f"proof {PROOF}"])
    proved = rows.groupBy("key", "block").cogroup(blocks.groupBy("key", "block")).applyInArrow(_with_proofs, out)
    discard(nodes)
    return proved.select(F.col("id").alias(id_col), F.lower(F.hex("leaf")).alias("leaf"), "subroot", "root", "proof", *[F.col(f"carried_{k}").alias(k) for k in carry])


def folded(leaf_hex: Column, proof: Column) -> Column:
    """The root that a leaf and a proof lead to."""
    return F.aggregate(proof, leaf_hex, lambda own, side: F.sha2(F.concat(side["before"], own, side["after"]), 256))


def siblings(proof: Column) -> Column:
    """All digests of a proof, from the leaf's siblings to the subroots, in one text."""
    return F.array_join(F.transform(proof, lambda side: F.concat(side["before"], side["after"])), "")


def audit(docs: DataFrame) -> DataFrame:
    """Every document's proof, and whether it still holds where the document was tampered with.

    Where three divides the id's crc32, the text's A-Z are lower-cased (nulls
    stay, as do rows without an id); the leaf is made anew from that.
    """
    touched = crc32_of_id(F.col("doc_id")) % 3 == 0
    text = F.translate(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(touched, leaf([text if f == "text" else F.col(f) for f in FIELDS]))
    proved = manifest(docs, carry={"tampered": tampered})
    out = proved.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("proof")), 256).alias("proof_sha256"), folded(F.coalesce(F.lower(F.hex("tampered")), "leaf"), F.col("proof")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def oracle_sql(levels: int = 6) -> str:
    """The query in DuckDB's SQL, for groups of up to ``FAN ** levels`` rows."""
    lower = "replace(" * 26 + "text" + "".join(f", '{chr(65 + k)}', '{chr(97 + k)}')" for k in range(26))
    field = lambda f: f"coalesce(octet_length(encode(cast({f} as varchar))) || ':' || cast({f} as varchar), '-')"
    leaf_of = lambda text: f"sha256({' || '.join(field(text if f == 'text' else f) for f in FIELDS)})"
    sql = [
        "with steps as (select list_transform(range(0, 256), lambda i: list_reduce(range(0, 8), lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i)) t)",
        "d as (select *, cast(doc_id as varchar) s from documents)",
        "c as (select d.*, xor(list_reduce(range(0, length(s)), lambda c, i: xor(t[cast(xor(c & 255, unicode(s[cast(i + 1 as integer)])) as integer) + 1], c >> 8), 4294967295), 4294967295) crc from d, steps)",
        f"l as (select doc_id, lang, {leaf_of('text')} leaf, case when crc % 3 = 0 then {leaf_of(lower)} else {leaf_of('text')} end changed from c)",
        "l0 as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 i, count(*) over (partition by lang) c, leaf d, '' proof, changed f from l)",
    ]

    def levels_of(name: str, group: str, n: int) -> None:
        run = f"partition by {group}, i // 8" if group else "partition by i // 8"
        for k in range(n):
            # nodes of one level, each with the proof up to it: rows of leaves carry their node
            sql.append(f"{name}n{k} as (select distinct {group + ', ' if group else ''}i, c, d from {name}{k})")
            sql.append(
                f"{name}s{k} as (select *, coalesce(string_agg(d, '') over ({run} order by i rows between unbounded preceding and 1 preceding), '') b,"
                f" coalesce(string_agg(d, '') over ({run} order by i rows between 1 following and unbounded following), '') a from {name}n{k})"
            )
            match = f"x.{group} is not distinct from s.{group} and " if group else ""
            kept = "doc_id, x.lang, leaf, changed" if group else "x.lang"
            sql.append(
                f"{name}{k + 1} as (select {kept}, case when x.c = 1 then x.i else x.i // 8 end i, (x.c + 7) // 8 c, case when x.c = 1 then x.d else sha256(b || x.d || a) end d,"
                f" case when x.c = 1 then proof else proof || b || a end proof{', case when x.c = 1 then f else sha256(b || f || a) end f' if group else ', case when x.c = 1 then before else list_append(before, b) end before, case when x.c = 1 then after else list_append(after, a) end after'}"
                f" from {name}{k} x join {name}s{k} s on {match}x.i = s.i)"
            )

    levels_of("l", "lang", levels)
    sql.append(f"t0 as (select lang, row_number() over (order by lang nulls first) - 1 i, count(*) over () c, d, '' proof, []::varchar[] before, []::varchar[] after from (select distinct lang, d from l{levels}))")
    levels_of("t", "", 3)
    fold = "f.f"
    for k in (1, 2, 3):
        fold = f"case when len(before) >= {k} then sha256(before[{k}] || {fold} || after[{k}]) else {fold} end"
    sql.append(f"z as (select doc_id, leaf, f.d subroot, t.d root, sha256(f.proof || t.proof) proof_sha256, {fold} folded_root from l{levels} f join t3 t on f.lang is not distinct from t.lang)")
    return ",\n".join(sql) + "\nselect *, folded_root = root verified from z"
