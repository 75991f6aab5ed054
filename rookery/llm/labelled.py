"""A bounded sample of labelled texts, and words as hashed numbers."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rookery.llm.common import crc32_of_id

#: Labelled rows from which a classifier learns, at most.
SAMPLE_ROWS = 12_000


def held_out(id_col: str, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id's decimal text leaves ``remainder``; false for a null id."""
    return F.coalesce(crc32_of_id(F.col(id_col)) % modulus == remainder, F.lit(False))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label_col: str, *, modulus: int, remainder: int,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = None, rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """Whole texts of at most ``rows`` labelled ids outside the held-out part: (id, text, lang, y).

    The ids with the smallest hashes are taken, so the sample doesn't depend on
    the order of rows.  Of an id's several labels the largest counts, of its
    several texts the smallest.  Only ids, at most ``rows`` of them, are sent to
    every executor.  ``lang`` is null if ``lang_col`` is not given.
    """
    ids = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
        .where(F.col("y").isNotNull() & F.col("id").isNotNull())
        .where(~held_out("id", modulus, remainder))
        .groupBy("id").agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("id"), "id").limit(rows)
    )
    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), lang.alias("lang"))
    return (
        texts.join(F.broadcast(ids), "id")
        .groupBy("id", "y").agg(F.min(F.struct("text", "lang")).alias("row"))
        .select("id", "row.text", "row.lang", "y")
    )


class WordHashes(dict):
    """crc32 of words, remembered; forgets all when it holds ``most`` words."""

    def __init__(self, most: int = 100_000) -> None:
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        h = zlib.crc32(word)
        self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint32, len(words))
