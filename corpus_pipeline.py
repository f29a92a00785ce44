"""Five filtering and encoding stages over documents; each takes (spark, docs, sf_dir).

All stages take rows with nulls in any column, empty and very long texts,
repeated rows, empty tables and further columns of any name; what they do with
nulls and repeats is said with each.  All but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfield.llm import decontamination, pieces, quality_rules, secrets, simhash
from tarnfield.llm.common import durable, forget, own_columns, read


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality rules reject. Null and empty texts go; repeated rows share their fate."""
    return quality_rules.keep_good(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that of the smallest id. Null texts count as empty, null ids as largest; of repeated rows one stays."""
    return simhash.keep_one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that leak a benchmark item. Null and empty texts stay; repeated rows share their fate."""
    return decontamination.remove_leaks(docs, read(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the texts by a mark; n_chars follows where docs has it. Every row stays, null texts as null."""
    clean = secrets.redact(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return clean.select(*own_columns(docs))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode what is left with merge dropout, decode it and compare: doc_id, ids, n_pieces, ids_hash and lossless of every row; null texts have no ids."""
    return pieces.round_trip(docs)


STAGES = [
    ("quality rules", quality),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("secret scans", without_secrets),
    ("SentencePiece encoding and decoding", encoded),
]

#: The n-gram hashes, fingerprints and merges of the stages cannot be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; what a stage kept is written, and deleted when the next one is done with it."""
    docs, stored = read(spark, sf_dir, "documents"), False
    for _, stage in STAGES[:-1]:
        after = durable(stage(spark, docs, sf_dir))
        if stored:
            forget(docs)
        docs, stored = after, True
    return STAGES[-1][1](spark, docs, sf_dir)
