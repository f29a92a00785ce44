"""Evaluation cases and result files."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfield.sources.lines import numbered, stored_with_spots

RAW = "id string, query string, question string, relevant array<string>, gold_files array<string>"


def load_cases(spark: SparkSession, path: str, lines: bool | None = None) -> DataFrame:
    """Raw cases of JSON lines (told by the name .jsonl where lines is not given) or of a JSON array."""
    by_line = path.endswith(".jsonl") if lines is None else lines
    return spark.read.schema(RAW).option("multiLine", str(not by_line).lower()).json(path)


def query_of() -> Column:
    """query, or question where it is missing or empty."""
    return F.coalesce(F.nullif(F.col("query"), F.lit("")), F.nullif(F.col("question"), F.lit("")))


def gold_of() -> Column:
    """relevant, or gold_files where it is missing or empty."""
    some = lambda c: F.when(F.size(c) > 0, F.col(c))
    return F.coalesce(some("relevant"), some("gold_files"))


def normalize_cases(raw: DataFrame, strict: bool = True) -> DataFrame:
    """cases(query_id, query, relevant): empty counts as missing, question and gold_files stand in, ids default to case-<number>.

    raw comes from load_cases() or another source whose rows keep their places.
    Strict fails on a case without query or gold; otherwise such rows are in bad_cases().
    """
    rows = numbered(stored_with_spots(raw.select("id", query_of().alias("asked"), gold_of().alias("gold"))), "no")
    own_id = F.coalesce(F.nullif(F.col("id"), F.lit("")), F.format_string("case-%d", "no"))
    rows = rows.select(own_id.alias("query_id"), F.col("asked").alias("query"), F.col("gold").alias("relevant"))
    if not strict:
        return rows.filter("query is not null and relevant is not null")
    fail = F.raise_error(F.concat(F.lit("case without query or gold files: "), F.col("query_id")))
    return rows.withColumn("query", F.when(F.col("query").isNull() | F.col("relevant").isNull(), fail).otherwise(F.col("query")))


def bad_cases(raw: DataFrame) -> DataFrame:
    """Raw cases without query or gold files."""
    return raw.filter(query_of().isNull() | gold_of().isNull())


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object for each row, UTF-8."""
    df.write.mode("overwrite").json(path)


def sibling_paths(trace_path: str) -> tuple[str, str]:
    """Paths of the stage files and the stage summary beside a trace file."""
    p = PurePosixPath(trace_path)
    return str(p.with_name(f"{p.stem}_stage_files{p.suffix}")), str(p.with_name(f"{p.stem}_stage_summary.json"))
