r"""A prefix trie of conversations, from sorted turn arrays.

A turn is a token of ``TOKEN`` bytes: 16 of the SHA-256 of its role and text, and
8 with the number of words in its text.  A conversation is the bytes of its tokens
one after the other, so bytewise order is the order of turn arrays.

1. Arrays are range-sorted over all tasks (array, then id), and each row is given
   the number of turns that it shares with the row before and the row after
   (adjacent LCPs); at the edges of partitions the neighbours meet in a join of one
   row a partition.
2. Each task sweeps its stretch of rows with a stack of open nodes.  A row opens the
   nodes deeper than its LCP and closes those deeper than the next one.  A node that
   opens and closes in a stretch is complete.
3. Nodes open at either end of a stretch are emitted with what the stretch adds to
   them, keyed by a digest of their turns; all their figures are sums or minima, so
   the stacks of neighbouring partitions are stitched by an aggregate.
4. A node's parent is named by the parent's smallest member, which is known only
   then: a join by the parent's digest, for nodes whose parent has several members.

Nothing holds a node's members but its open stack's counts; ids of equal arrays are
hashed as a sorted stream.  A conversation's array (24 bytes a turn) is one cell.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rookery.llm.common import crc32_of_id, discard, join_heavy, ranked, slices, staged

WORDS = r"[^\x20\x09-\x0D]+"
DIGEST, TOKEN = 16, 24
#: Turns that one piece of a conversation holds, before its pieces are put together.
PIECE = 32_768
#: Ids that a node keeps before they are sent away as a chunk.
IDS = 65_536
EMPTY = hashlib.sha256().hexdigest()
ROOT = bytes(DIGEST)


def token(role: Column, text: Column) -> Column:
    """A turn's bytes; null role and text are empty."""
    role, text = (F.coalesce(c.cast("string"), F.lit("")) for c in (role, text))
    words = F.lpad(F.hex(F.regexp_count(text, F.lit(WORDS)).cast("long")), 16, "0")
    whole = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    return F.unhex(F.concat(F.substring(whole, 1, 2 * DIGEST), words))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring turns of one conversation as one piece, with the place of its first turn."""
    now, held, done = None, [], ([], [], [])

    def close():
        if held:
            for column, value in zip(done, (*now, b"".join(held)), strict=True):
                column.append(value)
            held.clear()

    def out():
        made = pa.RecordBatch.from_arrays([pa.array(done[0], pa.int64()), pa.array(done[1], pa.int64()), pa.array(done[2], pa.binary())], names=["conv_id", "place", "seq"])
        for column in done:
            column.clear()
        return made

    for batch in batches:
        for conv, place, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not held or conv != now[0] or len(held) == PIECE:
                close()
                now = conv, place
            held.append(x)
        yield out()
    close()
    yield out()


def turn_arrays(conversations: DataFrame) -> DataFrame:
    """(conv_id, seq): each conversation's turns in order, as the bytes of their tokens.

    Turns ascend (null first); turns of one number follow one another by token, and
    repeated rows are turns each.  Rows without a conversation are left out.  Turns
    are sorted in ranges and packed before a conversation's pieces meet.
    """
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", token(F.col("role"), F.col("text")).alias("token"))
    turns = staged(turns, "trie-turns")
    by = ["conv_id", "turn", "token", "tie"]
    rows = turns.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by)
    pieces = rows.select("conv_id", F.monotonically_increasing_id().alias("place"), "token").mapInArrow(_pieces, "conv_id long, place long, seq binary")
    whole = F.array_sort(F.collect_list(F.struct("place", "seq")))
    return pieces.groupBy("conv_id").agg(F.aggregate(whole, F.lit(b""), lambda a, x: F.concat(a, x["seq"])).alias("seq"))


def rebuilt(arrays: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Conversations that begin as their base does: c takes the first h turns of conversation c - c % ``every``.

    ``h`` is crc32(c) % ``most``; all turns of the base if it has fewer, none if it
    is absent.  Then come c's own turns after its first h, if any.
    """
    c = F.col("conv_id")
    base = arrays.where(c % every == 0).select(c.alias("base"), F.substring("seq", 1, TOKEN * (most - 1)).alias("head"))
    taken = (crc32_of_id(c) % most * TOKEN).cast("int")
    own = arrays.select("conv_id", (c - c % every).alias("base"), taken.alias("taken"), "seq").join(base, "base", "left")
    head = F.coalesce(F.substring("head", F.lit(1), F.col("taken")), F.lit(b""))
    return own.select("conv_id", F.concat(head, F.substring("seq", F.col("taken") + 1, F.length("seq"))).alias("seq"))


def shared(a: bytes, b: bytes) -> int:
    """Tokens that two arrays share from their start."""
    most = min(len(a), len(b)) // TOKEN
    if a[: most * TOKEN] == b[: most * TOKEN]:
        return most
    low, step = 0, 1  # the first ``low`` are equal; steps double, then halve
    while low + step <= most and a[low * TOKEN : (low + step) * TOKEN] == b[low * TOKEN : (low + step) * TOKEN]:
        low += step
        step *= 2
    while step > 1:
        step //= 2
        if low + step <= most and a[low * TOKEN : (low + step) * TOKEN] == b[low * TOKEN : (low + step) * TOKEN]:
            low += step
    return low


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row with the LCPs of the rows before and after; null at a partition's edges."""
    held = None  # the last row, whose next one hasn't come yet

    def out(rows):
        kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["conv_id", "seq", "lcp", "next"])

    for batch in slices(batches, 1, 4096):
        rows = []
        for conv, seq in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            lcp = None
            if held:
                lcp = held[3] = shared(held[1], seq)
                rows.append(held)
            held = [conv, seq, lcp, None]
        if rows:
            yield out(rows)
    if held:
        yield out([held])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rank, a, b = (c.to_pylist() for c in batch.columns)
        yield pa.RecordBatch.from_arrays([pa.array(rank, pa.int64()), pa.array(list(map(shared, a, b)), pa.int64())], names=["rank", "met"])


def in_order(arrays: DataFrame) -> DataFrame:
    """(rank, conv_id, seq, lcp, next): arrays range-sorted, with the turns shared with either neighbour; -1 where there is none."""
    rows, _ = ranked(staged(arrays, "trie-arrays"), [], ["seq", "conv_id"], "trie-ranked", (_neighbours, "conv_id long, seq binary, lcp long, next long"))
    # one row a partition
    first = rows.where("lcp is null").select("rank", F.col("seq").alias("b"))
    last = rows.where("next is null").select((F.col("rank") + 1).alias("rank"), F.col("seq").alias("a"))
    met = staged(first.join(last, "rank").select("rank", "a", "b").mapInArrow(_meet, "rank long, met long"), "trie-edges")
    before = met.select("rank", F.col("met").alias("met_before"))
    after = met.select((F.col("rank") - 1).alias("rank"), F.col("met").alias("met_after"))
    both = rows.join(F.broadcast(before), "rank", "left").join(F.broadcast(after), "rank", "left")
    none = F.lit(-1).cast("long")
    return both.select("rank", "conv_id", "seq", F.coalesce("lcp", "met_before", none).alias("lcp"), F.coalesce("next", "met_after", none).alias("next"))


class _Open:
    """A node that more than one row may have."""

    __slots__ = ("depth", "key", "here", "words", "n", "least", "children", "leaves", "saved", "ids", "sent")

    def __init__(self, depth: int, key: bytes, here: bool, words: int) -> None:
        self.depth, self.key, self.here, self.words = depth, key, here, words
        self.n = self.children = self.leaves = self.saved = 0
        self.least = None
        self.ids: list[int] = []
        self.sent = False


NODE, PART, ENDS = 0, 1, 2
_KINDS = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
_SWEPT = "kind int, depth long, key binary, parent binary, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string"
_NAMES = [x.split()[0] for x in _SWEPT.split(", ")]


class _Sweep:
    """Rows of a stretch go in, nodes come out (``done``)."""

    def __init__(self) -> None:
        self.done: list[tuple] = []
        self.stack: list[_Open] = []
        self.rank = None

    def add(self, rank: int, conv: int, seq: bytes, lcp: int, after: int) -> None:
        stack = self.stack
        length, deep = len(seq) // TOKEN, max(lcp, after)
        if rank != self.rank:
            self.end()
            self._push(seq, 0, lcp, False)
        self.rank = rank + 1
        # nodes down to ``deep`` may have other members; below, this row is alone
        opened = min(deep, length)
        if lcp < opened:
            if stack:
                stack[-1].children += 1
            self._push(seq, lcp + 1, opened, True)
            for node in stack[lcp + 1 : -1]:
                node.children += 1
        digest = hashlib.sha256(b"%d" % conv).hexdigest()
        for depth in range(deep + 1, length + 1):
            last = depth == length
            above = stack[-1].key if depth == deep + 1 and stack else None
            self.done.append((NODE, depth, None, above, conv, 1, int(not last), 1, 0, digest if last else EMPTY))
        top = stack[-1] if stack else None
        if top:
            top.n += 1
            top.least = conv if top.least is None else min(top.least, conv)
            if length > deep:
                top.children += 1
                top.leaves += 1
            else:
                top.leaves += after < length
                top.ids.append(conv)
                if len(top.ids) == IDS:
                    self._send(top)
        while stack and stack[-1].depth > after:
            self._close(stack[-1].here)

    def end(self) -> None:
        """The rest of the stack goes to the next stretch."""
        while self.stack:
            self._close(False)

    def _push(self, seq: bytes, first: int, last: int, here: bool) -> None:
        for depth in range(first, last + 1):
            own = seq[(depth - 1) * TOKEN : depth * TOKEN] if depth else b""
            key = hashlib.sha256(self.stack[-1].key + own).digest()[:DIGEST] if depth else ROOT
            self.stack.append(_Open(depth, key, here, int.from_bytes(own[DIGEST:], "big")))

    def _send(self, node: _Open) -> None:
        self.done.append((ENDS, node.depth, node.key, None, node.ids[0], None, None, None, None, ",".join(map(str, node.ids))))
        node.ids, node.sent = [], True

    def _close(self, whole: bool) -> None:
        node = self.stack.pop()
        above = self.stack[-1] if self.stack else None
        # a node's own words count once for each member but the first
        node.saved += node.words * (node.n - node.here)
        whole = whole and not node.sent
        if not whole and node.ids:
            self._send(node)
        ends = hashlib.sha256(",".join(map(str, node.ids)).encode()).hexdigest() if whole else None
        self.done.append((NODE if whole else PART, node.depth, node.key, above and above.key, node.least, node.n, node.children, node.leaves, node.saved, ends))
        if above:
            above.n += node.n
            above.least = node.least if above.least is None else min(above.least, node.least)
            above.leaves += node.leaves
            above.saved += node.saved


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sweep = _Sweep()

    def out():
        made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*sweep.done, strict=True), _KINDS, strict=True)], names=_NAMES)
        sweep.done.clear()
        return made

    for batch in slices(batches, 2, 4096):
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            sweep.add(*row)
            if len(sweep.done) >= 20_000:
                yield out()
        if sweep.done:
            yield out()
    sweep.end()
    if sweep.done:
        yield out()


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of ids, sorted by node and place, as one digest a node."""
    now, digest, done = None, None, []
    out = lambda: pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], names=["key", "ends_sha256"])
    for batch in slices(batches):
        for key, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key == now:
                digest.update(b",")
            else:
                if digest:
                    done.append((now, digest.hexdigest()))
                now, digest = key, hashlib.sha256()
            digest.update(ids.encode())
        yield out()
        done.clear()
    if digest:
        done.append((now, digest.hexdigest()))
        yield out()


def trie(arrays: DataFrame) -> DataFrame:
    """The nodes of the trie over ``arrays`` (conv_id, seq); ids must be distinct, arrays may be empty.

    Per node: its smallest member ``conv_id``, ``depth``, ``parent_conv_id``,
    ``n_convs`` members, ``n_children``, ``n_leaves`` and ``saved_tokens`` of its
    subtree, ``ends_sha256`` over members that end in it.  The root (depth 0) has
    no parent.  Without arrays there are no nodes.
    """
    swept = staged(in_order(arrays).mapInArrow(_sweep, _SWEPT), "trie-swept")
    chunks = swept.where(F.col("kind") == ENDS).select("key", "conv_id", F.col("ends").alias("ids"))
    hashed = chunks.repartition("key").sortWithinPartitions("key", "conv_id").select("key", "ids").mapInArrow(_hash_ends, "key binary, ends_sha256 string")
    figures = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
    parts = swept.where(F.col("kind") == PART).groupBy("depth", "key").agg(F.first("parent").alias("parent"), F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in figures])
    columns = ["conv_id", "depth", "key", "parent", *figures, "ends_sha256"]
    stitched = parts.join(hashed, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY))).select(*columns)
    nodes = staged(swept.where(F.col("kind") == NODE).withColumnRenamed("ends", "ends_sha256").select(*columns).unionByName(stitched), "trie-nodes")
    discard(swept)

    names = nodes.where("key is not null and n_children > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("n_rows"))
    total = names.agg(F.coalesce(F.sum("n_rows"), F.lit(0))).head()[0]
    results = ["conv_id", "depth", "parent_conv_id", *figures, "ends_sha256"]
    below = join_heavy(nodes.where("parent is not null"), names, "parent", "n_rows", total)
    alone = nodes.where("parent is null").withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.col("conv_id")))
    return alone.select(*results).unionByName(below.select(*results))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations that begin as their base does (``rebuilt``)."""
    return trie(rebuilt(turn_arrays(conversations)))


#: crc32 is spelt out, as DuckDB has none.
ORACLE_SQL = r"""
with steps as (select list_transform(range(0, 256), lambda i: list_reduce(range(0, 8), lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i)) t),
a as (select conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} order by turn nulls first, substr(sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32)) s
 from conversations where conv_id is not null group by conv_id),
h as (select *, cast(xor(list_reduce(range(0, length(cast(conv_id as varchar))), lambda c, i: xor(t[cast(xor(c & 255, unicode(cast(conv_id as varchar)[cast(i + 1 as integer)])) as integer) + 1], c >> 8), 4294967295), 4294967295) % 4 as integer) h from a, steps),
b as (select h.conv_id, list_concat(coalesce(x.s[1:h.h], []), h.s[h.h + 1:]) s from h left join a x on x.conv_id = h.conv_id - h.conv_id % 20),
m as (select conv_id, len(s) n, d, s[1:d] p from b, unnest(range(0, len(s) + 1)) u(d)),
v as (select p, d, min(conv_id) conv_id, count(*) n_convs, sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (where n = d), '')) ends_sha256,
 case when d = 0 then 0 else len(regexp_extract_all(p[d].t, '[^\x20\x09-\x0D]+')) end w from m group by p, d),
k as (select p[1:d - 1] p, count(*) n from v where d > 0 group by 1),
s as (select v.*, coalesce(k.n, 0) n_children from v left join k on k.p = v.p),
u as (select s.p[1:x] p, sum((n_convs - 1) * w) saved, count(*) filter (where n_children = 0) n_leaves from s, unnest(range(0, d + 1)) q(x) group by 1)
select s.conv_id, s.d depth, o.conv_id parent_conv_id, s.n_convs, s.n_children, u.n_leaves, cast(u.saved as bigint) saved_tokens, s.ends_sha256
from s join u on u.p = s.p left join v o on s.d > 0 and o.p = s.p[1:s.d - 1]
"""
