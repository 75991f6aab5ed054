"""Exact top-k inner products of a stated query set against all vectors.

Vectors are quantised to integers.  The longest ones give every query a first
threshold.  Everything is rotated, once, into the basis of the singular vectors,
where the first coordinates hold most of the length; after some coordinates,
partial sum + |rest of query| * |rest of vector| (Cauchy-Schwarz) bounds the score, and
pairs whose bound is below the query's threshold are dropped.  What is left is
scored with whole numbers, exactly.

Blocks of queries meet parts of the vectors in tasks.  A part is gone through by
descending length, until no query of the block can gain from shorter vectors.  A
task yields at most k rows a query.  Queries and vectors never pass the driver,
but for a matrix of fixed size and a fixed number of the longest vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from rookery.llm.common import slices, staged

SCALE = 256
K = 5
#: Queries of a block, and vectors of a part.
QUERY_BLOCK, PART = 8192, 32_768
#: Longest vectors from which first thresholds come.
SEEDS = 4096
#: Queries, and vectors, that are bounded at once.
QUERIES, CHUNK = 2048, 1024
#: Shares of the coordinates after which bounds are taken.
CUTS = (0.25, 0.5)
#: Room for rounding in bounds, which are floating; scores are exact.
SLACK = 1e-9
#: Whole numbers below are exact as doubles.
EXACT = 2.0**53


def quantised(embeddings: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, v (array<double> of whole numbers), norm2; without vectors that are null or hold null or non-finite components."""
    v = F.col(vector_col)
    good = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    scaled = lambda x: x.cast("double") * SCALE
    whole = F.transform(v, lambda x: F.when(F.abs(scaled(x)) < EXACT, F.floor(scaled(x)).cast("double")).otherwise(scaled(x)))  # beyond, all doubles are whole
    rows = embeddings.where(good).select(F.col(id_col).cast("long").alias("id"), whole.alias("v")).where("id is not null")
    return rows.withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A list column as an array of doubles; shorter vectors end in zeros."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if len(flat) == n * dims:
        return flat.reshape(n, dims)
    lengths = np.array([len(x) for x in column.to_pylist()], np.int64)
    out = np.zeros((n, dims))
    out[np.arange(dims)[None] < lengths[:, None]] = flat
    return out


def gram_matrix(vectors: DataFrame, dims: int) -> np.ndarray:
    """The sum of v vT; partial sums are added up in eight tasks before the driver sees them."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = np.zeros((dims, dims))
        for b in batches:
            x = matrix(b.column(0), dims)
            g += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([g.tobytes()], pa.binary())], names=["g"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = np.zeros(dims * dims)
        for b in batches:
            for x in b.column(0).to_pylist():
                g += np.frombuffer(x)
        yield pa.RecordBatch.from_arrays([pa.array([g.tobytes()], pa.binary())], names=["g"])

    sums = vectors.select("v").mapInArrow(partial, "g binary").repartition(8).mapInArrow(add, "g binary").collect()
    return reduce(np.add, (np.frombuffer(r[0]) for r in sums), np.zeros(dims * dims)).reshape(dims, dims)


def packed(vectors: DataFrame, basis: np.ndarray) -> DataFrame:
    """id, norm2, v and r as bytes of doubles: the vector, filled up with zeros, and the rotated one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, None, 4096):
            x = matrix(b.column(2), len(basis))
            parts = [pa.array([row.tobytes() for row in m], pa.binary()) for m in (x, x @ basis)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *parts], names=["id", "norm2", "v", "r"])

    return vectors.select("id", "norm2", "v").mapInArrow(run, "id long, norm2 double, v binary, r binary")


def unpacked(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist())).reshape(len(column), dims)


def first_thresholds(queries: DataFrame, seeds: tuple[np.ndarray, np.ndarray], dims: int, k: int) -> DataFrame:
    """``queries`` with ``least``: the k-th best score among the seeds, below which no answer lies; minus infinity if there are too few."""
    held = queries.sparkSession.sparkContext.broadcast(seeds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = held.value
        for b in slices(batches, None, QUERIES):
            least = np.full(b.num_rows, -np.inf)
            if len(ids) > k:
                scores = unpacked(b.column("v"), dims) @ vectors.T
                scores[b.column("id").to_numpy()[:, None] == ids[None]] = -np.inf
                least = np.partition(scores, -k, axis=1)[:, -k]
                least -= SLACK * (1 + np.abs(least))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(least)], names=[*b.schema.names, "least"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in queries.schema)
    return queries.mapInArrow(run, f"{kinds}, least double")


class QueryBlock:
    """Some queries, their rotated coordinates, rests and thresholds."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, rotated: np.ndarray, least: np.ndarray, k: int, large: bool) -> None:
        self.ids, self.vectors, self.rotated, self.k, self.large = ids, vectors, rotated, k, large
        dims = vectors.shape[1]
        self.cuts = sorted({max(1, int(dims * c)) for c in CUTS}) if dims else []
        self.rests = [np.sqrt((rotated[:, c:] ** 2).sum(axis=1)) for c in self.cuts]
        self.norms = np.sqrt((vectors**2).sum(axis=1))
        self.least = least.copy()

    def search(self, ids: np.ndarray, norms: np.ndarray, x: np.ndarray, rotated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query's place, vector's id, score) of the best k, ties to the smaller id; vectors come by descending length."""
        best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for at in range(0, len(ids), CHUNK):
            longest = norms[at]
            slack = SLACK * (1 + self.norms * longest)
            rows = np.flatnonzero(self.norms * longest + slack >= self.least)
            if not len(rows):
                break  # no query can gain from this vector, nor from shorter ones
            part = slice(at, at + CHUNK)
            found = self.scores(rows, slack, ids[part], x[part], rotated[part])
            if not len(found[0]):
                continue
            q, v, s = (np.concatenate(p) for p in zip(best, found, strict=True))
            order = np.lexsort((v, -s, q))
            q, v, s = q[order], v[order], s[order]
            rank = np.arange(len(q)) - np.searchsorted(q, q, "left")
            keep, full = rank < self.k, rank == self.k - 1
            threshold = s[full].astype(np.float64)
            self.least[q[full]] = np.maximum(self.least[q[full]], threshold - self.large * SLACK * np.abs(threshold))
            best = q[keep], v[keep], s[keep]
        return best

    def scores(self, rows: np.ndarray, slack: np.ndarray, ids: np.ndarray, x: np.ndarray, rotated: np.ndarray):
        """Pairs of a chunk that may be among the best, with exact scores."""
        columns = np.arange(len(ids))
        for cut, rest in zip(self.cuts, self.rests, strict=True):
            if not (len(rows) and len(columns)):
                break
            r = rotated[columns]
            bound = self.rotated[rows, :cut] @ r[:, :cut].T
            bound += rest[rows, None] * np.sqrt((r[:, cut:] ** 2).sum(axis=1))[None]
            may = bound + slack[rows, None] >= self.least[rows, None]
            columns, rows = columns[may.any(axis=0)], rows[may.any(axis=1)]
        exact = self.vectors[rows] @ x[columns].T
        may = (exact + self.large * slack[rows, None] >= self.least[rows, None]) & (self.ids[rows, None] != ids[columns][None])
        a, b = np.nonzero(may)
        if self.large:  # products of such numbers are not exact as doubles
            exact = np.array([int(p @ q) for p, q in zip(self.vectors[rows[a]].astype(np.int64), x[columns[b]].astype(np.int64), strict=True)], np.int64)
            return rows[a], ids[columns[b]], exact
        return rows[a], ids[columns[b]], np.rint(exact[a, b]).astype(np.int64)


def _meet(dims: int, k: int, large: bool):
    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        out = []
        if len(vectors) and len(queries):
            vectors = vectors.sort_by([("norm2", "descending"), ("id", "ascending")])
            ids, norms = vectors["id"].to_numpy(), np.sqrt(vectors["norm2"].to_numpy())
            x, rotated = unpacked(vectors["v"], dims), unpacked(vectors["r"], dims)
            for at in range(0, len(queries), QUERIES):
                some = queries.slice(at, QUERIES)
                block = QueryBlock(some["id"].to_numpy(), unpacked(some["v"], dims), unpacked(some["r"], dims), some["least"].to_numpy(), k, large)
                q, v, s = block.search(ids, norms, x, rotated)
                out.append((some["q"].to_numpy()[q], block.ids[q], v, s))
        columns = [np.concatenate([o[j] for o in out]) if out else np.zeros(0, np.int64) for j in range(4)]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["q", "query_id", "vec_id", "score"])

    return run


def top_k(
    embeddings: DataFrame, queries: DataFrame | None = None, *, id_col: str = "vec_id", vector_col: str = "embedding",
    every: int = 50, k: int = K,
) -> DataFrame:
    """Each query's ``k`` largest integer inner products: query_id, rank (from 1), vec_id, score.

    Components become floor(256 * x).  ``queries`` is a table like ``embeddings``;
    without it, rows whose id is divisible by ``every`` are queries.  Rows with a
    query's own id are no candidates for it; ties go to the smaller id; a query
    with fewer candidates gets all.  Vectors that are null or hold null or
    non-finite components take no part, nor do rows with a null id; a shorter
    vector counts as ended by zeros.  Repeated rows are candidates each, and of a
    repeated query each row is one query, though they share their ``query_id``.
    Scores are exact.  If the longest vectors are so long that a score might not
    fit in a long, ``ValueError`` is raised.  Empty tables give no rows.
    """
    spark = embeddings.sparkSession
    vectors = quantised(embeddings, id_col, vector_col)
    asked = vectors.where(F.col("id") % every == 0) if queries is None else quantised(queries, id_col, vector_col)
    about = lambda df: df.agg(F.coalesce(F.max(F.size("v")), F.lit(0)), F.coalesce(F.max("norm2"), F.lit(0.0)), F.count("*")).head()
    (dims, norm2, n), (asked_dims, asked_norm2, n_asked) = about(vectors), about(asked)
    dims, most = max(dims, asked_dims), float(norm2) ** 0.5 * float(asked_norm2) ** 0.5 * (1 + SLACK)
    if not most < 2.0**63:
        raise ValueError("scores of these vectors may not fit in a long")
    basis = np.linalg.eigh(gram_matrix(vectors, dims))[1][:, ::-1].copy() if dims else np.zeros((0, 0))

    parts = max(-(-n // PART), min(spark.sparkContext.defaultParallelism, n), 1)
    blocks = max(-(-n_asked // QUERY_BLOCK), 1)
    number = F.monotonically_increasing_id()
    vectors = staged(packed(vectors, basis).withColumn("part", (number % parts).cast("int")), "vectors")
    longest = vectors.select("id", "norm2", "v").orderBy(F.desc("norm2"), "id").limit(SEEDS).toArrow()
    seeds = np.array(longest["id"].to_pylist(), np.int64), unpacked(longest["v"], dims)
    asked = vectors.where(F.col("id") % every == 0).select("id", "norm2", "v", "r") if queries is None else packed(asked, basis)
    asked = staged(first_thresholds(asked, seeds, dims, k).withColumn("q", number).withColumn("block", (F.col("q") % blocks).cast("int")), "queries")

    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = vectors.withColumn("block", each(blocks)).groupBy("part", "block")
    right = asked.select("q", "id", "v", "r", "least", "block").withColumn("part", each(parts)).groupBy("part", "block")
    found = left.cogroup(right).applyInArrow(_meet(dims, k, most >= EXACT), "q long, query_id long, vec_id long, score long")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) e from embeddings
 where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id query_id, v.vec_id, cast(list_dot_product(q.e, v.e) as bigint) score
 from v q join v on q.vec_id % 50 = 0 and q.vec_id <> v.vec_id),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) rank from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""
