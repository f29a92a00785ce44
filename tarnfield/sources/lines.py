"""Numbers of rows that were read from files, counted where they were read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnfield.sources.scratch import durable, sized_broadcast

#: A part of a file as one task read it.
SPOT = ["file", "block", "task"]


def stored_with_spots(rows: DataFrame) -> DataFrame:
    """rows of files, stored, with where each came from (SPOT) and its place in the task (at): so they are read and parsed once, whatever is counted later."""
    spots = {"file": F.input_file_name(), "block": F.input_file_block_start(), "task": F.spark_partition_id(), "at": F.monotonically_increasing_id()}
    return durable(rows.withColumns(spots))


def _before(over: Window) -> Column:
    return F.coalesce(F.sum("n").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def numbered(stored: DataFrame, name: str, each_file: bool = False) -> DataFrame:
    """Rows of stored_with_spots() with their number, from 1, in the order of files and places; each_file begins anew in every file.

    No rows are moved: a row for each part of a file holds what lies before it.
    Parts are added up file by file, and only the files' totals together.
    """
    parts = durable(stored.groupBy(*SPOT).agg(F.count("*").alias("n"), F.min("at").alias("first")))
    offsets = parts.withColumn("offset", _before(Window.partitionBy("file").orderBy("block", "task")) - F.col("first") + 1)
    if not each_file:
        files = parts.groupBy("file").agg(F.sum("n").alias("n")).select("file", _before(Window.orderBy("file")).alias("earlier"))
        offsets = offsets.join(sized_broadcast(durable(files)), "file").withColumn("offset", F.col("offset") + F.col("earlier"))
    offsets = durable(offsets.select(*SPOT, "offset"))
    return stored.join(sized_broadcast(offsets), SPOT).withColumn(name, F.col("at") + F.col("offset"))
