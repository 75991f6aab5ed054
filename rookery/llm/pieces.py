"""SentencePiece encoding and decoding, with giant documents cut into chunks.

The vocabulary is one of byte-pair merges.  Its encoding of a text is the one path
of pieces in which any two neighbours are what the merges make of the two alone
("fit"); so it is a shortest-path problem with weights 0 (fits) and minus infinity,
and every prefix of the text has exactly one best path.

A giant document is cut into chunks.  The state at a cut is the piece that ends
there or runs over it.  Each chunk yields the max-plus matrix from states at its
left cut to states at its right cut, chunks' matrices are multiplied (the product
is associative), which leaves one state at each cut, and then each chunk traces its
own pieces back, apart from all others.  A matrix holds only its entries of weight
0, a few dozen.

No piece has a space mark after another sign.  So before such a mark every path
has a cut, and what lies between two of them, mostly a word, is encoded once and
remembered.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rookery.llm.common import SLICE_BYTES, discard, remember, slices, staged

SPACE = "▁"
#: Characters of a chunk; longer documents are cut.
CHUNK = 16_384
#: Words of a generation that a worker remembers; of pairs of pieces it remembers half as many again, of words' first signs half as many.
REMEMBERED = 500_000
#: Chunks whose matrices one task multiplies before the products are put in order.
TOGETHER = 64
MODEL = "/opt/tokenizers/piece_bpe_32k.model"

#: Characters by which pieces are looked up.
HEAD = 4
#: Numbers of signs that are no piece, and of what stands before the first one; both beyond any id.
OTHER, NONE = 1 << 21, (1 << 22) - 1

State = tuple[int, str]  # where the piece ends, and the piece
START: State = (0, "")


class Vocabulary:
    """Pieces, scores and bytes of a model file."""

    def __init__(self, model_file: str = MODEL, remembered: int = REMEMBERED) -> None:
        import sentencepiece

        self.remembered = remembered

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = model.vocab_size()
        pieces = [model.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.score = {pieces[i]: model.get_score(i) for i in plain}
        self.number = {pieces[i]: i for i in plain}
        self.byte = {int(pieces[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.unknown = model.unk_id()
        self.longest = max(map(len, self.score), default=1)
        #: How long pieces of more than ``HEAD`` characters that start so are, the longest first.
        self.sizes: dict[str, tuple[int, ...]] = {}
        for piece in sorted(self.score, key=len, reverse=True):
            if len(piece) > HEAD and len(piece) not in (known := self.sizes.get(piece[:HEAD], ())):
                self.sizes[piece[:HEAD]] = (*known, len(piece))
        self.heads: dict[str, list[tuple[int, int]]] = {}
        self.cuts = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.score)
        self.bytes = [pieces[i].replace(SPACE, " ").encode() for i in range(size)]
        for value, i in self.byte.items():
            self.bytes[i] = bytes([value])
        #: ``bytes`` as an array, made when something is decoded.
        self.by_id: pa.Array | None = None
        self.fitting: dict[tuple[str, str], bool] = {}
        self.fitting_ids: dict[int, bool] = {}
        #: Ids of words as they stand, and of words without the mark before them.
        self.words, self.plain = _Words(self), _Words(self, SPACE)

    def merged(self, text: str) -> list[str]:
        """A short text's pieces by merging: the best-scored neighbours first, the leftmost of equals."""
        out = list(text)
        while True:
            best, at = None, -1
            for k in range(len(out) - 1):
                s = self.score.get(out[k] + out[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                return out
            out[at : at + 2] = [out[at] + out[at + 1]]

    def fits(self, left: str, right: str) -> bool:
        """Whether merging the two pieces' text alone gives the two pieces."""
        known = self.fitting.get((left, right))
        if known is None:
            if len(self.fitting) > self.remembered * 3 // 2:
                self.fitting.clear()
            known = self.fitting[left, right] = self.merged(left + right) == ([left, right] if left else [right])
        return known

    def ends(self, text: str, begin: int, end: int, first: str = "") -> list[str | None]:
        """For each place from ``begin`` to ``end``, the last piece of the best path that comes from ``first``."""
        last: list[str | None] = [None] * (end - begin + 1)
        last[0] = first
        score, fits, longest = self.score, self.fits, self.longest
        for i in range(begin + 1, end + 1):
            for k in range(min(longest, i - begin), 0, -1):
                before = last[i - begin - k]
                if before is not None:
                    piece = text[i - k : i]
                    if (k == 1 or piece in score) and fits(before, piece):
                        last[i - begin] = piece
                        break
        return last

    @staticmethod
    def trace(last: list[str | None]) -> list[str]:
        """Pieces of the path to the last place."""
        out: list[str] = []
        i = len(last) - 1
        while i > 0:
            out.append(last[i])
            i -= len(last[i])
        return out[::-1]

    def path(self, text: str) -> list[int]:
        """The whole text's path, found depth first: the longest piece that fits, else a shorter one, else a step back.

        A place is reached by one path only, so a place that led nowhere is dead
        for good.  Pieces are their ids, signs without one ``OTHER`` and their code.
        This gives what ``trace(ends(...))`` gives, sooner.
        """
        number, fitting, heads, n = self.number.get, self.fitting_ids, self.heads, len(text)
        out: list[int] = []
        lengths: list[int] = []
        dead: set[int] = set()
        before, at, below = NONE, 0, n + 1
        while at < n:
            head = text[at : at + HEAD]
            for k, i in heads.get(head) or self.starting(head):
                if k >= below or (dead and at + k in dead):
                    continue
                if not i:
                    i = number(text[at : at + k], 0) if at + k <= n else 0
                    if not i:
                        continue
                known = fitting.get(before << 22 | i)
                if known is None:
                    if len(fitting) > self.remembered * 3 // 2:
                        fitting.clear()
                    left, piece = text[at - lengths[-1] : at] if lengths else "", text[at : at + k]
                    known = fitting[before << 22 | i] = self.merged(left + piece) == ([left, piece] if left else [piece])
                if known:
                    out.append(i)
                    lengths.append(k)
                    before, below = i, n + 1
                    at += k
                    break
            else:
                dead.add(at)
                out.pop()
                below = lengths.pop()
                at -= below
                before = out[-1] if out else NONE
        return out

    def starting(self, head: str) -> list[tuple[int, int]]:
        """How long pieces that start with ``head`` may be, with ids (0: to be looked up), the longest first; always one sign."""
        if len(self.heads) > self.remembered // 2:
            self.heads.clear()
        longer = [(k, 0) for k in self.sizes.get(head, ())]
        whole = [(k, self.number[head[:k]]) for k in range(len(head), 0, -1) if head[:k] in self.number]
        own = [] if head[0] in self.number else [(1, OTHER + ord(head[0]))]
        self.heads[head] = longer + whole + own
        return self.heads[head]

    def packed_path(self, text: str) -> bytes:
        """Ids of a text's path, as int32."""
        ids = self.path(text)
        if max(ids, default=0) >= OTHER:
            return array("i", [j for i in ids for j in ([i] if i < OTHER else [self.byte.get(b, self.unknown) for b in chr(i - OTHER).encode("utf-8", "surrogatepass")])]).tobytes()
        return array("i", ids).tobytes()

    def numbers(self, pieces: list[str]) -> list[int]:
        """Ids; a sign that is no piece becomes its bytes."""
        try:
            return [self.number[p] for p in pieces]
        except KeyError:
            pass
        out: list[int] = []
        for p in pieces:
            n = self.number.get(p)
            if n is not None:
                out.append(n)
            else:
                out += [self.byte.get(b, self.unknown) for b in p.encode("utf-8", "surrogatepass")]
        return out

    def packed_pieces(self, pieces: list[str]) -> bytes:
        """Ids of some pieces, as int32."""
        return array("i", self.numbers(pieces)).tobytes()

    def packed(self, text: str) -> bytes:
        """Ids of a marked text, as int32."""
        if not self.cuts:
            return self.words[text]
        if text[:1] == SPACE and SPACE + SPACE not in text:
            self.plain.room()
            return b"".join(map(self.plain.__getitem__, text[1:].split(SPACE)))
        self.words.room()
        return b"".join(map(self.words.__getitem__, _WORD.findall(text)))

    def packed_text(self, text: str) -> bytes:
        """Ids of a whole text, as int32."""
        if not self.cuts or SPACE in text or "  " in text or text[:1] == " ":
            return self.packed(marked(text))
        self.plain.room()
        return b"".join(map(self.plain.__getitem__, text.split(" "))) if text else b""

    def give_back(self, parts: list[bytes], texts: list[str]) -> list[bool]:
        """Whether ids decode to their texts: all are decoded, and compared byte by byte."""
        return [got == text.encode("utf-8", "surrogatepass") for got, text in zip(self.decoded(parts), texts, strict=True)]

    def decoded(self, parts: list[bytes]) -> list[memoryview]:
        """UTF-8 of each part's ids (int32), with the leading space that encoding adds."""
        if self.by_id is None:
            self.by_id = pa.array(self.bytes, pa.large_binary())
        if not any(parts):
            return [memoryview(b"")] * len(parts)
        flat = self.by_id.take(pa.array(np.frombuffer(b"".join(parts), np.int32)))
        _, offsets, data = flat.buffers()
        at = np.frombuffer(offsets, np.int64)[np.cumsum([0, *(len(p) // 4 for p in parts)])].tolist()
        view = memoryview(data).cast("B") if data else memoryview(b"")
        return [view[a:b] for a, b in zip(at, at[1:], strict=False)]


_WORD = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


class _Words(dict):
    """Ids of words, of two generations: a full one becomes the old one, from which words in use come back."""

    def __init__(self, vocabulary: Vocabulary, lead: str = "") -> None:
        super().__init__()
        self.vocabulary, self.lead = vocabulary, lead
        self.old: dict[str, bytes] = {}

    def room(self) -> None:
        if len(self) > self.vocabulary.remembered:
            self.old = dict(self)
            self.clear()

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            v = self.vocabulary
            ids = v.packed_path(self.lead + word)
        if len(word) <= 64:
            self[word] = ids
        return ids


def marked(text: str) -> str:
    """What is encoded: a leading space is added, spaces become marks."""
    return SPACE + text.replace(" ", SPACE) if text else ""


class Chunk:
    """Text [begin, end) of a marked text of ``total`` characters; ``text`` also has what lies around it, from ``origin``."""

    def __init__(self, v: Vocabulary, text: str, origin: int, begin: int, end: int, total: int) -> None:
        self.v, self.text, self.origin, self.begin, self.end, self.total = v, text, origin, begin, end, total
        reach = v.longest
        self.first = self.last = None
        if v.cuts:  # places where every path has a cut
            a, b = begin + reach - origin, end - origin
            at = [m.start() + 1 for m in re.finditer(f"[^{SPACE}]{SPACE}", text[max(a - 1, 0) : b])]
            if at:
                self.first, self.last = (x + max(a - 1, 0) + origin for x in (at[0], at[-1]))

    def left_states(self) -> list[State]:
        if self.begin == 0:
            return [START]
        t, o, out = self.text, self.origin, []
        for e in range(self.begin, min(self.begin + self.v.longest, self.total + 1)):
            for k in range(e - self.begin + 1, min(self.v.longest, e - o) + 1):
                piece = t[e - k - o : e - o]
                if k == 1 or piece in self.v.score:
                    out.append((e, piece))
        return out

    def ends(self, at: int, to: int, first: str) -> list[str | None]:
        return self.v.ends(self.text, at - self.origin, to - self.origin, first)

    def right_states(self, at: int, first: str) -> list[State]:
        if self.end == self.total:
            if at == self.total:
                return [(at, first)]
            last = self.ends(at, self.total, first)[-1]
            return [] if last is None else [(self.total, last)]
        to = min(self.end + self.v.longest - 1, self.total)
        last = self.ends(at, to, first)
        out = [(e, p) for e in range(self.end, to + 1) if (p := last[e - at]) is not None and e - len(p) < self.end]
        return out

    def matrix(self) -> list[tuple[State, State]]:
        """The entries of weight 0: (left state, right state)."""
        if self.first is None:
            return [(s, r) for s in self.left_states() for r in self.right_states(*s)]
        right = self.right_states(self.last, "")
        return [(s, r) for s in self.left_states() if self.ends(s[0], self.first, s[1])[-1] is not None for r in right]

    def pieces(self, left: State, right: State) -> bytes:
        """Ids of the pieces after ``left``, up to and with ``right``."""
        number = lambda last: self.v.packed_pieces(self.v.trace(last))
        if left[0] == right[0]:
            return b""
        if self.first is None:
            return number(self.ends(left[0], right[0], left[1]))
        middle = self.text[self.first - self.origin : self.last - self.origin]
        return number(self.ends(left[0], self.first, left[1])) + (self.v.packed(middle) if middle else b"") + number(self.ends(self.last, right[0], ""))


Matrix = dict[State, set[State]]


def times(a: Matrix, b: Matrix) -> Matrix:
    """The max-plus product of two matrices that hold only entries of weight 0."""
    out = {s: set().union(*(b.get(m, set()) for m in mids)) for s, mids in a.items()}
    return {s: r for s, r in out.items() if r}


def states_at_cuts(matrices: list[Matrix], left: State = START, right: State | None = None) -> list[State]:
    """The one state at each cut, from the products over a binary tree: down it, halves agree on their middle.

    The state at the left end is given, and that at the right end unless it is the only one.
    """
    products: dict[tuple[int, int], Matrix] = {}

    def product(i: int, j: int) -> Matrix:
        if j - i == 1:
            return matrices[i]
        if (i, j) not in products:
            m = (i + j) // 2
            products[i, j] = times(product(i, m), product(m, j))
        return products[i, j]

    out = [left] * (len(matrices) + 1)
    if right is None:
        (right,) = product(0, len(matrices))[left]
    out[-1] = right
    spans = [(0, len(matrices))]
    while spans:
        i, j = spans.pop()
        if j - i > 1:
            m = (i + j) // 2
            (out[m],) = {s for s in product(i, m)[out[i]] if out[j] in product(m, j).get(s, ())}
            spans += [(i, m), (m, j)]
    return out


_models: dict[tuple[str, int], Vocabulary] = {}


def vocabulary(model_file: str, remembered: int = REMEMBERED) -> Vocabulary:
    """The model, read once in a process."""
    key = model_file, remembered
    if key not in _models:
        _models.clear()
        _models[key] = Vocabulary(model_file, remembered)
    remember("pieces", _models.clear)
    return _models[key]


def longest_piece(model_file: str) -> int:
    """Characters of the model's longest piece; keeps nothing of the model on the driver."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    plain = (i for i in range(model.vocab_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)))
    return max((len(model.id_to_piece(i)) for i in plain), default=1)


def _lists(parts: list[bytes]) -> pa.Array:
    sizes = np.array([len(p) // 4 for p in parts], np.int32)
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(np.frombuffer(b"".join(parts), np.int32)))


def _encode_whole(model_file: str, remembered: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model_file, remembered)
        for batch in slices(batches, owner="pieces"):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids = list(map(v.packed_text, texts))
            same = v.give_back(ids, [f" {t}" if t else "" for t in texts])
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(ids), pa.array(same, pa.bool_())], names=["id", "ids", "round_trip"])

    return run


def _cut(chunk: int, reach: int):
    """Rows (row, id, raw) in one pass to chunks, each with what ``reach`` can see around it; only slices go out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2, 1, "pieces"):
            raw = batch.column(2).to_pylist()[0]
            total, most = len(raw), max(SLICE_BYTES // (4 * chunk), 1)
            for first in range(0, total, chunk * most):
                begins = np.arange(first, min(first + chunk * most, total), chunk)
                ends, origins = np.minimum(begins + chunk, total), np.maximum(begins - reach, 0)
                same = pa.array(np.zeros(len(begins), np.int32))
                parts = [raw[o : e + reach] for o, e in zip(origins.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(same), batch.column(1).take(same), pa.array(np.full(len(begins), total)), pa.array((begins // chunk).astype(np.int32)),
                        pa.array(begins), pa.array(ends), pa.array(origins), pa.array(parts, pa.string()),
                    ],
                    names=["row", "id", "total", "k", "begin", "end", "origin", "raw"],
                )

    return run


def _chunks_of(batch: pa.RecordBatch, v: Vocabulary) -> Iterator[tuple[int, Chunk]]:
    for k, (text, origin, begin, end, total) in enumerate(zip(*(batch.column(n).to_pylist() for n in ("raw", "origin", "begin", "end", "total")), strict=True)):
        yield k, Chunk(v, text.replace(" ", SPACE), origin, begin, end, total)


_ENTRY = [("le", pa.int64()), ("lp", pa.string()), ("re", pa.int64()), ("rp", pa.string())]
ENTRIES = "array<struct<le:long,lp:string,re:long,rp:string>>"


def _entries(matrices: list[list[tuple]]) -> pa.Array:
    return pa.array([[dict(zip(("le", "lp", "re", "rp"), x, strict=True)) for x in m] for m in matrices], pa.list_(pa.struct(_ENTRY)))


def _matrix(entries: list[dict]) -> Matrix:
    m: Matrix = {}
    for x in entries:
        m.setdefault((x["le"], x["lp"]), set()).add((x["re"], x["rp"]))
    return m


def _matrices(model_file: str, remembered: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model_file, remembered)
        for batch in slices(batches, "raw", owner="pieces"):
            entries = [[(*s, *r) for s, r in c.matrix()] for _, c in _chunks_of(batch, v)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("k"), batch.column("chunks"), _entries(entries)], names=["row", "k", "chunks", "entries"])

    return run


def _runs(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[tuple[tuple, list[dict]]]:
    """Rows that follow one another and are equal in their first ``key`` columns, as dicts."""
    now, held = None, []
    for batch in slices(batches, None, owner="pieces"):
        for row in batch.to_pylist():
            mark = tuple(row[c] for c in batch.schema.names[:key])
            if mark != now and held:
                yield now, held
                held = []
            now = mark
            held.append(row)
    if held:
        yield now, held


def _rows(rows: Iterator[tuple], kinds: tuple, names: list[str]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def out() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array([r[j] for r in held], kind) for j, kind in enumerate(kinds)], names=names)
        held.clear()
        return batch

    for row in rows:
        held.append(row)
        if len(held) >= 4096:
            yield out()
    yield out()


_LINKS = "row long, k int, le long, lp string, re long, rp string"


def _links(found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    return _rows(found, (pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string()), ["row", "k", "le", "lp", "re", "rp"])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """States at the cuts of documents, whose matrices (row, k, entries) come one after the other in their order."""

    def found() -> Iterator[tuple]:
        for (row,), held in _runs(batches, 1):
            at = states_at_cuts([_matrix(r["entries"]) for r in held])
            yield from ((row, r["k"], *left, *right) for r, left, right in zip(held, at, at[1:], strict=False))

    return _links(found())


def _inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """States at the cuts within groups (row, g, k, entries), whose outer ones (le, lp, re, rp) are known."""

    def found() -> Iterator[tuple]:
        for (row, _), held in _runs(batches, 2):
            one = held[0]
            at = states_at_cuts([_matrix(r["entries"]) for r in held], (one["le"], one["lp"]), (one["re"], one["rp"]))
            yield from ((row, r["k"], *left, *right) for r, left, right in zip(held, at, at[1:], strict=False))

    return _links(found())


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Products of the matrices of groups (row, g, k, entries)."""
    for (row, g), held in _runs(batches, 2):
        product = _matrix(held[0]["entries"])
        for r in held[1:]:
            product = times(product, _matrix(r["entries"]))
        entries = [(*left, *right) for left, rights in product.items() for right in rights]
        yield pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), pa.array([g], pa.int32()), _entries([entries])], names=["row", "k", "entries"])


def states(matrices: DataFrame, together: int = TOGETHER) -> DataFrame:
    """The states at both ends of every chunk, from matrices (row, k, entries) of documents of so many ``chunks``.

    A parallel scan: products of ``together`` neighbours, then the products of a
    document in order, then within each group of neighbours, whose outer states
    are known by then.  Documents of one such group need only the last step.
    """
    tasks = int(matrices.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # so many, though the rows are small: they are not cheap
    in_order = lambda df, *keys: df.repartition(tasks, *keys).sortWithinPartitions(*keys, "k")
    few = in_order(matrices.where(F.col("chunks") <= together), "row").select("row", "k", "entries").mapInArrow(_scan, _LINKS)
    groups = matrices.where(F.col("chunks") > together).withColumn("g", F.floor(F.col("k") / together).cast("int"))
    products = in_order(groups, "row", "g").select("row", "g", "k", "entries").mapInArrow(_products, f"row long, k int, entries {ENTRIES}")
    outer = in_order(products, "row").mapInArrow(_scan, _LINKS).withColumnRenamed("k", "g")
    inner = in_order(groups.join(outer, ["row", "g"]), "row", "g").select("row", "g", "k", "entries", "le", "lp", "re", "rp").mapInArrow(_inside, _LINKS)
    return few.unionByName(inner)


def _backtrace(model_file: str, remembered: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model_file, remembered)
        for batch in slices(batches, "raw", owner="pieces"):
            ends = list(zip(*(batch.column(n).to_pylist() for n in ("le", "lp", "re", "rp")), strict=True))
            raws = batch.column("raw").to_pylist()
            ids, own = [], []
            for k, c in _chunks_of(batch, v):
                le, lp, re_, rp = ends[k]
                ids.append(c.pieces((le, lp), (re_, rp)))
                own.append(raws[k][le - c.origin : re_ - c.origin])
            same = v.give_back(ids, own)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("k"), _lists(ids), pa.array(same, pa.bool_())], names=["row", "k", "ids", "same"])

    return run


def encode(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model_file: str = MODEL, chunk: int = CHUNK, remembered: int = REMEMBERED) -> DataFrame:
    """Ids of every row's whole text: id, n_tokens, ids, round_trip (whether decoding gives the text back).

    Null and empty texts have no ids.  Decoding writes the mark U+2581 as a space,
    so ``round_trip`` is false for a text that holds that sign itself.  Repeated
    rows are encoded each; an empty table gives no rows.

    Documents of up to ``chunk`` characters are encoded where they are read.
    Longer ones, of any length that a cell holds, are cut; their chunks, not the
    documents, are dealt over tasks.  A worker remembers the ids of up to twice
    ``remembered`` words; fewer cost time, not results.
    """
    reach = longest_piece(model_file)
    chunk = max(chunk, 4 * reach)
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    long = F.coalesce(F.length("text") > chunk, F.lit(False))
    short = rows.where(~long).mapInArrow(_encode_whole(model_file, remembered), f"id {kind}, ids array<int>, round_trip boolean")

    giant = rows.where(long).select(F.monotonically_increasing_id().alias("row"), "id", F.concat(F.lit(" "), "text").alias("raw"))
    cut = giant.mapInArrow(_cut(chunk, reach), f"row long, id {kind}, total long, k int, begin long, end long, origin long, raw string")
    cut = staged(cut, "chunks")  # fixes the row numbers
    matrices = staged(cut.withColumn("chunks", F.ceil(F.col("total") / chunk)).mapInArrow(_matrices(model_file, remembered), f"row long, k int, chunks long, entries {ENTRIES}"), "matrices")
    ends = staged(states(matrices), "states")
    discard(matrices)
    # dealt anew at every size, because a chunk is a lot of work
    traced = cut.join(ends.hint("merge"), ["row", "k"]).mapInArrow(_backtrace(model_file, remembered), "row long, k int, ids array<int>, same boolean")
    whole = traced.groupBy("row").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "ids"))), lambda c: c["ids"])).alias("ids"), F.bool_and("same").alias("round_trip"))
    long_ones = cut.where("k = 0").select("row", "id").join(whole, "row").select("id", "ids", "round_trip")
    both = short.unionByName(long_ones)
    return both.select(F.col("id").alias(id_col), F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


def decode(encoded: DataFrame, *, id_col: str = "doc_id", ids_col: str = "ids", model_file: str = MODEL) -> DataFrame:
    """Texts of ids: id, text.  Bytes that are no UTF-8 become U+FFFD; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model_file)
        for batch in slices(batches, None, 128, "pieces"):
            parts = [np.array(i or [], np.int32).tobytes() for i in batch.column(1).to_pylist()]
            texts = [bytes(x[1:]).decode("utf-8", "replace") for x in v.decoded(parts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)
