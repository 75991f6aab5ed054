"""A training corpus from documents: five stages, each written and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rookery.llm import decontaminate, near_dedup, pieces, secrets, toxicity
from rookery.llm.common import discard, staged, table

#: Hundredths of their shingles that near copies share; the operator's own query is fixed at 85.
NEAR = 80
#: Words that a worker remembers when it encodes: other stages' workers may still be there.
REMEMBERED = 60_000


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents above their language's threshold go.

    Null and empty texts are scored like others (a text without words is no sign of
    toxicity); repeated rows are scored alike; texts count whole, however long.
    """
    return toxicity.remove_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: texts are linked from a similarity of 0.8.

    Texts without words and rows without an id all stay; of rows that share an id,
    one stays.
    """
    return near_dedup.remove_near_duplicates(docs, percent=NEAR)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go of whose words a twentieth or more occur in benchmark windows; null and empty texts stay."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Confirmed secrets are replaced in the texts; all documents stay, and null and empty texts as they are."""
    return secrets.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become ids, of which null and empty texts have none."""
    return pieces.encode(docs, remembered=REMEMBERED)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("sentencepiece", encode),
]

#: Two stages are learned models, which SQL can't express; tests compare with the stages' own brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, over all documents: doc_id, n_tokens, ids and round_trip of those that stay.

    Each stage's result is a table in the shared folder, and goes when the next one
    is written.  An empty table of documents gives no rows; further columns of
    ``documents`` go along up to the last stage, whatever their names.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(before)
    return docs
