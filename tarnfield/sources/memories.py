"""The append-only memory store."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfield.operators.memory import SCHEMA
from tarnfield.sources.lines import numbered, stored_with_spots


def _parsed(spark: SparkSession, path: str) -> DataFrame:
    """The lines of the store with the record m and whether it is none, stored with their places; blank lines count as lines."""
    record = F.from_json("value", f"{SCHEMA}, broken string", {"columnNameOfCorruptRecord": "broken"})
    filled = F.trim("value") != ""
    lines = spark.read.text(path, recursiveFileLookup=True).withColumn("m", F.when(filled, record))
    lines = lines.withColumn("is_broken", filled & (F.col("m").isNull() | F.col("m.broken").isNotNull()))
    return stored_with_spots(lines.withColumn("value", F.when(F.col("is_broken"), F.col("value"))))


def _broken(parsed: DataFrame) -> DataFrame:
    name = F.element_at(F.split("file", "/"), -1).alias("file")
    return numbered(parsed, "line_no", each_file=True).filter("is_broken").select(name, "line_no", "value")


def broken_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value) of the lines that are no memory record."""
    return _broken(_parsed(spark, path))


def read_memories(spark: SparkSession, path: str) -> DataFrame:
    """All stored memories, from one read; none where the store does not exist yet; a broken record fails the read with its file and line number."""
    try:
        rows = _parsed(spark, path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMA)
    if not rows.filter("is_broken").isEmpty():
        first = _broken(rows).orderBy("file", "line_no").first()
        raise ValueError(f"broken memory record in {first['file']}, line {first['line_no']}")
    return rows.filter("m is not null").select("m.*").drop("broken")


def append_memories(memories: DataFrame, path: str) -> None:
    memories.select("id", "created_at", "task", "status", "summary", "files", "decisions").write.mode("append").json(path)
