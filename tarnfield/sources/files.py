"""Source files as a table."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Folders that are skipped anywhere, and at the top only.
IGNORED = (".git", ".venv", "venv", "__pycache__", ".mypy_cache", ".pytest_cache")
IGNORED_AT_TOP = ("legacy",)


@F.pandas_udf(StringType())
def _decoded(content: pd.Series) -> pd.Series:
    return content.map(lambda b: bytes(b).decode("utf-8", "ignore"))


def is_loaded(path: Column) -> Column:
    """Whether a path relative to the root is read: no part of it is an ignored folder."""
    parts = F.split(path, "/")
    inside = F.arrays_overlap(parts, F.array(*map(F.lit, IGNORED)))
    return ~inside & ~F.get(parts, 0).isin(*IGNORED_AT_TOP)


def load_files(spark: SparkSession, root: str, corpus_id: str, pattern: str = "*.py") -> DataFrame:
    """files(corpus_id, file_path, text) below root, paths relative to it, bytes that are not UTF-8 dropped.

    A root that does not exist fails when it is read.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    base = root.rstrip("/").split("://")[-1].lstrip("/") + "/"
    inside = F.element_at(F.split("path", f"(?<=/)\\Q{base}\\E", 2), -1)
    rows = raw.select(F.lit(corpus_id).alias("corpus_id"), inside.alias("file_path"), "content")
    return rows.filter(is_loaded(F.col("file_path"))).select("corpus_id", "file_path", _decoded("content").alias("text"))


#: Files that a task writes, about.
FILES_PER_TASK = 1000


def write_files(rows: DataFrame, root: str, key: str) -> None:
    """Each of stored rows(key, value) as a text file in a folder `key=...` of its own below root.

    A file costs the same however short it is, so tasks are dealt by files; by bytes, few tasks would write all short ones.
    """
    n = max(rows.sparkSession.sparkContext.defaultParallelism, rows.count() // FILES_PER_TASK)
    rows.repartition(n, key).write.partitionBy(key).mode("append").text(root)


def in_file_order(files: DataFrame, more: Sequence[str] = ()) -> DataFrame:
    """files sorted by the parts of their paths."""
    return files.orderBy("corpus_id", F.split("file_path", "/"), *more)
