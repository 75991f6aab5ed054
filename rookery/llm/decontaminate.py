"""Benchmark decontamination with suffix arrays over shards of the training text.

Each shard is a bounded run of documents.  Its words become numbers of the
benchmark's vocabulary (0: not a benchmark word, or the end of a document), its
suffixes are sorted into a suffix array, and every benchmark suffix is found in
it by binary search.  A suffix that starts with no benchmark word sequence can't
match, so the array is sparse: it holds only suffixes whose first words also
start a benchmark window.  Nothing is shuffled; a lost executor's shards are
simply read again.

The benchmark is the only side that is sent to executors.  It is cut into blocks
of at most ``BLOCK_BYTES`` of text, each block is one narrow pass over the
documents, and what the passes find is appended to a column.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rookery.llm.common import remember, slices, utf8

#: Window length in words.
WINDOW = 13
#: Text bytes of the benchmark that one pass holds on an executor.
BLOCK_BYTES = 4_000_000
#: Words of one shard, at which its suffix array is built.
SHARD_WORDS = 2_000_000
#: Bits of a word's number in a packed key of three words.
WORD_BITS = 21
#: A document is contaminated if at least one word in this many is hit.
HIT_SHARE = 20

#: Bytes to themselves if part of a word (0-9, a-z, all beyond ASCII), A-Z to a-z, others to a space.
WORDS_ONLY = bytes(
    c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256)
)

SPAN = "array<struct<doc_start:int,n_words:int,item_id:string,item_start:int>>"
FOUND = f"n_words int, hits array<int>, items array<string>, spans {SPAN}"
SPAN_TYPE = pa.list_(
    pa.struct([("doc_start", pa.int32()), ("n_words", pa.int32()), ("item_id", pa.string()), ("item_start", pa.int32())])
)


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words of UTF-8 text: runs of digits, a-z and characters beyond ASCII."""
    return text.translate(WORDS_ONLY).split()


class Patterns:
    """A block of the benchmark: its vocabulary and its distinct windows, packed for search."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int) -> None:
        self.window = window
        self.vocab: dict[bytes, int] = {}
        number = self.vocab.setdefault
        found: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        self.items: list[str | None] = []
        for item_id, text in items:
            ids = [number(w, len(self.vocab) + 1) for w in words_of(text)]
            n = min(window, len(ids))
            for start in range(len(ids) - n + 1 if n else 0):
                found.setdefault(tuple(ids[start : start + n]), []).append((len(self.items), start))
            self.items.append(item_id)
        if len(self.vocab) >= (1 << WORD_BITS) - 1:  # only an item that is a block of its own can have so many
            raise ValueError(f"an item has {len(self.vocab):,} different words; {(1 << WORD_BITS) - 2:,} are possible")
        #: The distinct items of each window, as they are named in results.
        self.items_of = [frozenset(self.items[k] for k, _ in places if self.items[k] is not None) for places in found.values()]
        #: Every place of a window in the benchmark, by item and start.
        which = np.repeat(np.arange(len(found)), [len(p) for p in found.values()])
        place = np.array([x for p in found.values() for x in p], np.int64).reshape(-1, 2)
        order = np.lexsort((place[:, 1], place[:, 0]))
        self.place_window, self.place_item, self.place_start = which[order], place[order, 0], place[order, 1]
        self.lengths = np.array([len(w) for w in found], np.int64)
        self.keys = -(-window // 3)
        padded = np.zeros((len(found), 3 * self.keys), np.int64)
        for row, w in zip(padded, found, strict=True):
            row[: len(w)] = w
        self.low = pack(padded)
        top = (1 << WORD_BITS) - 1
        for row, n in zip(padded, self.lengths, strict=True):
            row[n:] = top
        self.high = pack(padded)
        self.least = int(self.lengths.min(initial=window))
        self.lead = min(3, self.least)
        self.starts = np.zeros(1 << 20, bool)
        if len(found):
            self.starts[lead_hash([padded[:, j] for j in range(self.lead)])] = True


def pack(rows: np.ndarray) -> np.ndarray:
    """Three numbers of ``WORD_BITS`` bits to one int64; shape (n, 3k) to (k, n)."""
    threes = rows.reshape(len(rows), rows.shape[1] // 3, 3)
    return np.ascontiguousarray(((threes[..., 0] << 2 * WORD_BITS) | (threes[..., 1] << WORD_BITS) | threes[..., 2]).T)


def lead_hash(columns: list[np.ndarray]) -> np.ndarray:
    h = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        h = (h ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(44)).astype(np.int64)


class SuffixArray:
    """The suffixes of a shard that can match, in the order of their first words."""

    def __init__(self, ids: np.ndarray, patterns: Patterns) -> None:
        n = len(ids)
        ends = np.append(np.flatnonzero(ids == 0), n)
        run = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)  # words up to the next break
        at = np.flatnonzero(run >= patterns.least)
        at = at[patterns.starts[lead_hash([ids[at + j] for j in range(patterns.lead)])]] if len(at) else at
        width = 3 * patterns.keys
        rows = np.zeros((len(at), width), np.int64)
        for j in range(width):
            inside = run[at] > j
            rows[inside, j] = ids[at[inside] + j]
        keys = pack(rows)
        order = np.lexsort(keys[::-1]) if len(at) else np.zeros(0, np.int64)
        self.at, self.keys = at[order], keys[:, order]

    def bound(self, column: int, lo: np.ndarray, hi: np.ndarray, value: np.ndarray, right: bool) -> np.ndarray:
        """Binary search for ``value`` in a key column between lo and hi, for many ranges at once."""
        key, lo, hi = self.keys[column], lo.copy(), hi.copy()
        while (open_ := lo < hi).any():
            mid = (lo + hi) >> 1
            probe = key[np.minimum(mid, len(key) - 1)]
            up = open_ & ((probe <= value) if right else (probe < value))
            lo = np.where(up, mid + 1, lo)
            hi = np.where(open_ & ~up, mid, hi)
        return lo

    def search(self, patterns: Patterns) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For every window that occurs: its number, and its first and last place in the array."""
        which = np.arange(len(patterns.lengths))
        if not len(self.at) or not len(which):
            return which[:0], which[:0], which[:0]
        lo = np.searchsorted(self.keys[0], patterns.low[0], "left")
        hi = np.searchsorted(self.keys[0], patterns.high[0], "right")
        for column in range(1, len(self.keys)):
            there = lo < hi
            which, lo, hi = which[there], lo[there], hi[there]
            below = self.bound(column, lo, hi, patterns.low[column][which], False)
            hi = self.bound(column, lo, hi, patterns.high[column][which], True)
            lo = below
        there = lo < hi
        return which[there], lo[there], hi[there]


def suffix_ranks(values: np.ndarray, longest: int) -> list[np.ndarray]:
    """Ranks of the suffixes of ``values`` by their first 1, 2, 4 ... values, up to ``longest``; 0 is beyond the end."""
    ranks = [np.unique(values, return_inverse=True)[1].astype(np.int64) + 1]
    while 1 << (len(ranks) - 1) < longest:
        r, step = ranks[-1], 1 << (len(ranks) - 1)
        after = np.append(r[step:], np.zeros(min(step, len(r)), np.int64))
        ranks.append(np.unique(r * (len(r) + 1) + after, return_inverse=True)[1] + 1)
    return ranks


def common_prefix(ranks: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many values the suffixes at ``a`` and ``b`` share, for many pairs at once."""
    n, a, b = len(ranks[0]), a.copy(), b.copy()
    out = np.zeros(len(a), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        for _ in range(2 if k == len(ranks) - 1 else 1):
            inside = (a < n) & (b < n)
            same = inside & (ranks[k][np.minimum(a, n - 1)] == ranks[k][np.minimum(b, n - 1)])
            out[same] += 1 << k
            a[same] += 1 << k
            b[same] += 1 << k
    return out


def longest(starts: np.ndarray, windows: np.ndarray, patterns: Patterns) -> tuple[np.ndarray, np.ndarray]:
    """For sorted places of occurring windows of full length: the longest verbatim match from there on, in words, and a place in the benchmark where it is.

    Windows that follow one another, in the shard and in the items, are two
    sequences.  Their suffixes are sorted together; the benchmark's suffix that
    shares most with a shard's is the nearest one before or after it.
    """
    there = np.isin(patterns.place_window, windows)
    at = np.flatnonzero(there)
    breaks = (np.diff(patterns.place_item[at]) != 0) | (np.diff(patterns.place_start[at]) != 1)
    gaps = np.diff(starts) != 1
    n_bench = len(at) + int(breaks.sum()) + 1  # with a separator of its own after each run
    bench_at = np.arange(len(at)) + np.append(0, np.cumsum(breaks))
    shard_at = n_bench + np.arange(len(starts)) + np.append(0, np.cumsum(gaps))
    values = -1 - np.arange(shard_at[-1] + 1)
    values[bench_at], values[shard_at] = patterns.place_window[at], windows
    runs = np.diff(np.flatnonzero(np.append(np.append(-1, values) < 0, True)))
    ranks = suffix_ranks(values, int(runs.max()))
    order = np.lexsort((np.arange(len(values)), ranks[-1]))
    of_bench = np.full(len(values), -1)
    of_bench[bench_at] = np.arange(len(at))
    sorted_bench, where = of_bench[order], np.empty(len(values), np.int64)
    where[order] = np.arange(len(values))
    known = sorted_bench >= 0
    before = np.maximum.accumulate(np.where(known, np.arange(len(values)), -1))[where[shard_at]]
    after = np.minimum.accumulate(np.where(known, np.arange(len(values)), len(values))[::-1])[::-1][where[shard_at]]
    length, place = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    for near, ok in ((before, before >= 0), (after, after < len(values))):
        other = sorted_bench[np.where(ok, near, 0)]
        share = np.where(ok, common_prefix(ranks, shard_at, bench_at[np.maximum(other, 0)]), 0)
        better = share > length
        length[better], place[better] = share[better], other[better]
    return length + patterns.window - 1, at[place]


def spans_of(starts: np.ndarray, windows: np.ndarray, patterns: Patterns) -> list[tuple[int, int, str | None, int]]:
    """Verbatim matches (start, words, item, start in item) of sorted places that lie within no match that starts before.

    Of several places of a match in the benchmark, one is named.
    """
    out: list[tuple[int, int, str | None, int]] = []
    full = patterns.lengths[windows] == patterns.window
    if full.any():
        at, (length, place) = starts[full], longest(starts[full], windows[full], patterns)
        end = at + length
        new = np.append(True, end[1:] > np.maximum.accumulate(end)[:-1])
        for p, n, q in zip(at[new].tolist(), length[new].tolist(), place[new].tolist(), strict=True):
            out.append((p, n, patterns.items[patterns.place_item[q]], int(patterns.place_start[q])))
    first = dict(zip(patterns.place_window[::-1].tolist(), range(len(patterns.place_window) - 1, -1, -1), strict=True)) if not full.all() else {}
    for p, w in zip(starts[~full].tolist(), windows[~full].tolist(), strict=True):  # short items are windows of their own
        out.append((p, int(patterns.lengths[w]), patterns.items[patterns.place_item[first[w]]], 0))
    return sorted(out, key=lambda s: s[:2])


def match_shard(docs: list[np.ndarray], patterns: Patterns, spans: bool) -> list[tuple[np.ndarray, set, list]]:
    """For each document of a shard: places of hit words, items and, if asked for, its matches."""
    begins = np.cumsum([0] + [len(d) + 1 for d in docs])
    ids = np.zeros(begins[-1], np.int64)
    for b, d in zip(begins, docs, strict=False):
        ids[b : b + len(d)] = d
    array = SuffixArray(ids, patterns)
    which, lo, hi = array.search(patterns)
    out = [(np.zeros(0, np.int32), set(), [])] * len(docs)
    if not len(which):
        return out
    windows = np.repeat(which, hi - lo)
    places = array.at[np.arange(len(windows)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)]
    edge = np.zeros(len(ids) + 1, np.int32)
    np.add.at(edge, places, 1)
    np.add.at(edge, places + patterns.lengths[windows], -1)
    hit = np.cumsum(edge[:-1]) > 0
    order = np.lexsort((windows, places))
    windows, places = windows[order], places[order]
    of = np.searchsorted(begins, places, "right") - 1
    cuts = np.flatnonzero(np.diff(of)) + 1
    found = spans_of(places, windows, patterns) if spans else []
    span_of = np.searchsorted(begins, [x[0] for x in found], "right") - 1 if found else []
    for d, w in zip(of[np.append(0, cuts)].tolist(), np.split(windows, cuts), strict=True):
        items = set().union(*(patterns.items_of[k] for k in np.unique(w).tolist()))
        out[d] = (np.flatnonzero(hit[begins[d] : begins[d + 1]]).astype(np.int32), items, [])
    for d, (p, n, item, at) in zip(span_of, found, strict=True):
        out[d][2].append((p - int(begins[d]), n, item, at))
    return out


def found_in(texts: list[bytes], patterns: Patterns, spans: bool) -> list[tuple[int, np.ndarray, set, list]]:
    """``match_shard`` over a batch, in shards of at most ``SHARD_WORDS`` words (or one document)."""
    out: list[tuple[int, np.ndarray, set, list]] = []
    shard: list[np.ndarray] = []

    def close() -> None:
        out.extend((len(d), *m) for d, m in zip(shard, match_shard(shard, patterns, spans), strict=True))
        shard.clear()

    size, number = 0, patterns.vocab.get
    for text in texts:
        words = words_of(text)
        if shard and size + len(words) > SHARD_WORDS:
            close()
            size = 0
        shard.append(np.fromiter((number(w, 0) for w in words), np.int32, len(words)))
        size += len(words)
    close()
    return out


def benchmark_blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[str | None, bytes]]]:
    """The benchmark in blocks of at most ``BLOCK_BYTES`` of text (or one item), read as a stream."""
    block: list[tuple[str | None, bytes]] = []
    size = 0
    rows = benchmark.select(F.col(item_col).cast("string"), F.col(text_col).cast("binary")).orderBy(1, 2)
    for item_id, text in rows.toLocalIterator():
        if block and size + len(text or b"") > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((item_id, bytes(text or b"")))
        size += len(text or b"")
    yield block


def matches(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
) -> DataFrame:
    """Where benchmark windows occur in documents.

    A window is ``window`` consecutive words of an item; an item of fewer words,
    but not none, is one window.  Returns one row per row of ``docs`` (repeated
    rows stay): the id, ``n_words``, ``hits`` (places of hit words), ``items``
    (those with occurring windows) and ``spans`` (verbatim matches that lie
    within no match that starts before: where, how many words, an item and where
    in it).  A null or empty text has no words and no hits; an item with a null
    id hits but is not listed; with an empty benchmark nothing is hit.  Texts may
    be of any length, and may repeat one word: the work is n log n.
    """
    # positions, not names: docs may hold columns named like the ones made here
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    for k, block in enumerate(benchmark_blocks(benchmark, item_col, item_text_col)):
        held = out.sparkSession.sparkContext.broadcast(block)
        out = out.mapInArrow(_pass(held, window, bool(k)), f"id {docs.schema[id_col].dataType.simpleString()}, text string, {FOUND}")
    return out.drop("text").withColumnRenamed("id", id_col)


_built: dict[tuple[int, int], tuple[list, Patterns]] = {}  # with the block, so that its number stays its own


def built(held, window: int) -> Patterns:
    """A block's patterns, made once in a worker; only the last block's are kept."""
    key = (id(held.value), window)
    if key not in _built:
        _built.clear()
        _built[key] = held.value, Patterns(held.value, window)
    remember("benchmark", _built.clear)
    return _built[key][1]


def _pass(held, window: int, more: bool, spans: bool = True):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = built(held, window)
        for batch in slices(batches, owner="benchmark"):
            found = found_in(utf8(batch.column(1)), patterns, spans)
            hits = [h for _, h, _, _ in found]
            items = [sorted(i) for _, _, i, _ in found]
            matched = [s for _, _, _, s in found]
            if more:
                hits = [np.union1d(h, o).astype(np.int32) for h, o in zip(hits, batch.column(3).to_pylist(), strict=True)]
                items = [sorted({*i, *o}) for i, o in zip(items, batch.column(4).to_pylist(), strict=True)]
                matched = [o + s for s, o in zip(matched, batch.column(5).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array([n for n, *_ in found], pa.int32()),
                    pa.array(hits, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string())),
                    pa.array([[x if isinstance(x, dict) else dict(zip(("doc_start", "n_words", "item_id", "item_start"), x, strict=True)) for x in s] for s in matched], SPAN_TYPE),
                ],
                names=["id", "text", "n_words", "hits", "items", "spans"],
            )

    return run


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and a digest of the items, from ``matches``; contaminated if a twentieth of the words is hit.

    ``longest_match`` is in words (0 if there is none), ``longest_start`` where the first of that length starts, in words from 0.
    """
    n_hit = F.size("hits").cast("long")
    best = F.array_max(F.transform("spans", lambda s: F.struct(s["n_words"].alias("n_words"), (-s["doc_start"]).alias("back"), s["doc_start"].alias("start"))))
    return found.select(
        id_col,
        F.col("n_words").cast("long").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")).cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (HIT_SHARE * n_hit >= F.col("n_words"))).alias("contaminated"),
        F.coalesce(best["n_words"], F.lit(0)).cast("long").alias("longest_match"),
        best["start"].cast("long").alias("longest_start"),
    )


def remove_contaminated(
    docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", window: int = WINDOW,
) -> DataFrame:
    """``docs`` without its contaminated rows, all columns kept as they are.

    With a benchmark of one block the rows are judged in one pass.  With more,
    the words hit by each block have to be put together first: the row rides
    along as a struct while the passes add to its hits.
    """
    blocks = list(_broadcasts(docs, benchmark, item_col, item_text_col))
    if len(blocks) == 1:
        return docs.mapInArrow(_keep(blocks[0], docs.columns.index(text_col), window), docs.schema)
    row = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = row.schema["id"].dataType.simpleString()
    for k, held in enumerate(blocks):
        row = row.mapInArrow(_pass(held, window, bool(k), False), f"id {kind}, text string, {FOUND}")
    n_hit = F.size("hits")
    return row.where(~((n_hit > 0) & (HIT_SHARE * n_hit >= F.col("n_words")))).select("id.*")


def _broadcasts(docs: DataFrame, benchmark: DataFrame, item_col: str, text_col: str):
    for block in benchmark_blocks(benchmark, item_col, text_col):
        yield docs.sparkSession.sparkContext.broadcast(block)


def _keep(held, at: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = built(held, window)
        for batch in slices(batches, at, owner="benchmark"):
            found = found_in(utf8(batch.column(at)), patterns, False)
            yield batch.filter(pa.array([not (len(h) and HIT_SHARE * len(h) >= n) for n, h, _, _ in found], pa.bool_()))

    return run


#: The digest in SQL; a match is a run of windows on one diagonal of a document and an item.
ORACLE_SQL = r"""
with b as (select row_number() over () k, item_id, regexp_extract_all(translate(text,'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
bw as (select k, item_id, i j, least(13,len(w)) n, array_to_string(list_slice(w, i, i+least(13,len(w))-1), ' ') g
 from b, unnest(range(1, greatest(len(w)-12, 1)+1)) t(i) where len(w) > 0),
d as (select doc_id, coalesce(regexp_extract_all(translate(text,'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) w from documents),
dw as (select doc_id, n, i, array_to_string(list_slice(w, i, i+n-1), ' ') g from d, (select distinct n from bw) k, unnest(range(1, len(w)-n+2)) t(i)),
m as (select dw.doc_id, dw.i, dw.n, bw.item_id, bw.k, bw.j from dw join bw on dw.g = bw.g and dw.n = bw.n),
h as (select doc_id, count(distinct p) n_hit from (select distinct doc_id, i, n from m), unnest(range(i, i+n)) t(p) group by doc_id),
s as (select doc_id, count(*) n_items, string_agg(cast(item_id as varchar), ',' order by cast(item_id as varchar)) ids from (select distinct doc_id, item_id from m) group by doc_id),
runs as (select doc_id, min(i) i, count(*) - 1 + min(n) n_words from
 (select doc_id, k, n, i, i - row_number() over (partition by doc_id, k, n, i - j order by i) r, i - j g from m) group by doc_id, k, n, g, r),
l as (select doc_id, max(n_words) longest_match, arg_min(i, (-n_words, i)) - 1 longest_start from runs group by doc_id)
select d.doc_id, cast(len(w) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(ids, '')) items_sha256,
 coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated, cast(coalesce(longest_match, 0) as bigint) longest_match, cast(longest_start as bigint) longest_start
from d left join h using (doc_id) left join s using (doc_id) left join l using (doc_id)
"""
