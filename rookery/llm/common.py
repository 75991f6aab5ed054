"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery.plans.numbering import ranked
from rookery.plans.staging import discard, shared_folder, staged

__all__ = ["shared_folder", "staged", "discard", "table", "slices", "utf8", "crc32_of_id", "small", "join_heavy", "ranked", "remember"]

#: Rows, and bytes of text, that a Python function takes at once (or one row).  Spark bounds what it sends by bytes.
SLICE_ROWS, SLICE_BYTES = 512, 8_000_000
#: Rows up to which ids are sent to every executor; beyond, rows are shuffled.
BROADCAST_ROWS = 100_000
#: A key is heavy if it has more than one row in this many; so there are fewer heavy keys than this.
SHARE = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What a Python worker remembers from one task to the next, by operator, as functions that forget it.
_remembered: dict[str, Callable[[], None]] = {}


def remember(owner: str, forget: Callable[[], None]) -> None:
    """An operator's tables stay in the worker until another operator's task comes."""
    _remembered[owner] = forget


def slices(batches: Iterator[pa.RecordBatch], text: int | str | None = 1, rows: int = SLICE_ROWS, owner: str = "") -> Iterator[pa.RecordBatch]:
    """Arrow batches cut into slices of at most ``rows`` rows and ``SLICE_BYTES`` bytes of column ``text``, or one row.

    Of what the worker remembers, only what is ``owner``'s stays.
    """
    for other in [k for k in _remembered if k != owner]:
        _remembered.pop(other)()
    for batch in batches:
        size = np.zeros(batch.num_rows, np.int64)
        if text is not None and batch.num_rows:
            size = pc.fill_null(pc.cast(pc.binary_length(batch.column(text)), pa.int64()), 0).to_numpy(zero_copy_only=False)
        total, at = np.cumsum(size), 0
        while at < batch.num_rows:
            most = (total[at - 1] if at else 0) + SLICE_BYTES
            end = min(max(int(np.searchsorted(total, most, "right")), at + 1), at + rows, batch.num_rows)
            yield batch.slice(at, end - at)
            at = end
    pa.default_memory_pool().release_unused()


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """A string column's UTF-8 bytes; null gives ``b""``."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def crc32_of_id(spark_column: Column) -> Column:
    """``crc32`` of an id's decimal text, as an unsigned long."""
    return F.crc32(spark_column.cast("string").cast("binary"))


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df``, to be sent to every executor if it has few enough rows."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def join_heavy(rows: DataFrame, by_key: DataFrame, key: str, size: str, total: int, keys: int | None = None) -> DataFrame:
    """``rows`` joined with ``by_key``, which has a row a key and how many rows have it (``size``, in all ``total``).

    The rows of a heavy key stay where they are: fewer than ``SHARE`` keys can be
    heavy, and those are sent to every executor.  The others are shuffled, unless
    there are known to be few ``keys``.
    """
    if keys is not None and keys <= BROADCAST_ROWS:
        return rows.join(F.broadcast(by_key), key)
    values = [c for c in by_key.columns if c != key]
    heavy = by_key.where(F.col(size) * SHARE > total).select(key, F.struct(*values).alias("heavy_"))
    marked = rows.join(F.broadcast(heavy), key, "left")
    there = marked.where("heavy_ is not null").select(*rows.columns, *[F.col("heavy_")[v].alias(v) for v in values])
    other = marked.where("heavy_ is null").select(*rows.columns).join(by_key.where(F.col(size) * SHARE <= total), key)
    return there.unionByName(other.select(*rows.columns, *values))
