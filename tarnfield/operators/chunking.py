"""Overlapping line chunks of files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfield.functions.paths import file_key
from tarnfield.functions.text import lines_of


def split_files(files: DataFrame, chunk_size: int | Column = 40, overlap: int | Column = 5, keep: Sequence[str] = ()) -> DataFrame:
    """chunks(corpus_id, file_path, file_key, chunk_no, start_line, end_line, text, and the columns in keep) of files(corpus_id, file_path, text, ...).

    Each chunk starts chunk_size - overlap lines after the one before; the last one is the first that reaches
    the end. Files without lines have no chunk. Row by row, without a shuffle.
    Size and overlap may be columns of files in keep, so that rows have their own.
    """
    if not isinstance(chunk_size, Column) and not isinstance(overlap, Column) and not 0 <= overlap < chunk_size:
        raise ValueError("need chunk_size > 0 and 0 <= overlap < chunk_size")
    chunk_size, overlap = (c if isinstance(c, Column) else F.lit(c) for c in (chunk_size, overlap))
    step = chunk_size - overlap
    rows = files.select("corpus_id", "file_path", *keep, lines_of(F.col("text")).alias("lines"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("lines") - overlap - 1, F.lit(0)), step)

    def chunk(at: Column) -> Column:
        text = F.array_join(F.slice("lines", at + 1, chunk_size), "\n")
        return F.struct((at + 1).alias("start_line"), F.least(at + chunk_size, F.size("lines")).alias("end_line"), text.alias("text"))

    # texts are cut before they are rows, so that no chunk's row brings all lines of its file
    chunks = rows.filter(F.size("lines") > 0).select("corpus_id", "file_path", *keep, F.posexplode(F.transform(starts, chunk)).alias("chunk_no", "c"))
    return chunks.select("corpus_id", "file_path", file_key(F.col("file_path")).alias("file_key"), "chunk_no", "c.*", *keep)


def rebuild_source(chunks: DataFrame) -> DataFrame:
    """(corpus_id, file_key, text) from chunks: of each line the earliest chunk's copy, gaps as empty lines.

    The lines of a file are sorted once by their number; each brings the breaks between it and the line before.
    """
    lines = chunks.select("corpus_id", "file_key", "start_line", F.posexplode(lines_of(F.col("text"))).alias("i", "line"))
    numbered = lines.withColumn("no", F.col("start_line") + F.col("i"))
    first = numbered.groupBy("corpus_id", "file_key", "no").agg(F.min_by("line", "start_line").alias("line"))
    whole = first.groupBy("corpus_id", "file_key").agg(F.sort_array(F.collect_list(F.struct("no", "line"))).alias("all"))
    breaks = lambda x, i: F.repeat(F.lit("\n"), x["no"] - F.when(i > 0, F.get("all", i - 1)["no"]).otherwise(1))
    return whole.select("corpus_id", "file_key", F.array_join(F.transform("all", lambda x, i: F.concat(breaks(x, i), x["line"])), "").alias("text"))
