"""Spans and offsets within files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Width of a grid's cell, about that of a long span.
CELL = 1024


def cells(first: Column, last: Column) -> Column:
    """The grid's cells from one offset to another, which must not be smaller."""
    return F.sequence(F.floor(first / CELL), F.floor(last / CELL))


def innermost(points: DataFrame, spans: DataFrame) -> DataFrame:
    """Each point (file, at) with the id of the span (file, start, end, id) around it that starts last; both ends count, null if none.

    A range join would compare all pairs of a file.  Here spans are cut into the
    cells of a grid, so that the join is an equi join on file and cell.
    """
    p = points.select("file", "at").distinct()
    s = spans.select("file", "start", "end", "id", F.explode(cells(F.col("start"), F.col("end"))).alias("cell"))
    met = p.withColumn("cell", F.floor(F.col("at") / CELL)).join(s, ["file", "cell"]).where("start <= at and end >= at")
    best = met.groupBy("file", "at").agg(F.max_by("id", F.struct(F.col("start"), -F.col("end"), -F.col("id"))).alias("id"))
    return p.join(best, ["file", "at"], "left")


def _greedy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of spans sorted by file, start and end, those that start at or after the end of the last kept one of their file."""
    at, last = object(), None
    for batch in batches:
        keep = []
        for file, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if file != at:
                at, last = file, None
            keep.append(last is None or start >= last)
            if keep[-1]:
                last = end
        yield batch.filter(pa.array(keep, pa.bool_()))


def without_overlaps(spans: DataFrame) -> DataFrame:
    """Spans (file, start, end) kept greedily: in order of start and end, one stays if it starts at or after the last kept one's end.

    Distinct spans are dealt by file, sorted on disk if need be, and streamed; only
    the last kept end is held.  Spans without a start or an end are left out.
    """
    s = spans.select("file", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")).dropna(subset=["start", "end"]).distinct()
    return s.repartition("file").sortWithinPartitions("file", "start", "end").mapInArrow(_greedy, s.schema)


def fingerprint(files: DataFrame, key: str, content: str) -> DataFrame:
    """One row: number of files, and a sum of hashes of their keys and contents that no order changes.

    Repeated rows count each; a null is told from an empty text.
    """
    tagged = lambda c: F.concat(F.when(F.col(c).isNull(), "0").otherwise("1"), F.coalesce(F.col(c), F.lit("")))
    h = F.conv(F.substring(F.md5(F.concat(F.md5(tagged(key)), F.md5(tagged(content)))), 1, 15), 16, 10).cast("decimal(38,0)")
    return files.agg(F.count("*").alias("n_files"), F.coalesce(F.sum(h), F.lit(0)).cast("string").alias("fingerprint"))
