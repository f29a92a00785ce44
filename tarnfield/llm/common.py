"""Helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfield.sources.scratch import durable, forget, scratch_dir, sized_broadcast

__all__ = ["count_chars", "durable", "forget", "free_name", "let", "own_columns", "pieces_of", "read", "scratch_dir", "sized_broadcast", "words_of"]

#: The separators of words besides the space.
_OTHER_SEPARATORS = "\t\n\x0b\f\r"


def free_name(name: str, *tables: DataFrame) -> str:
    """name, with underscores behind it until no column of the tables is called so in any case."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


def own_columns(df: DataFrame) -> list[Column]:
    """All columns of df by name, names with dots too."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def pieces_of(text: Column) -> Column:
    """text cut at every single separator (space, U+0009 to U+000D); null counts as empty. n separators make n + 1 pieces."""
    spaced = F.coalesce(text, F.lit(""))
    for c in _OTHER_SEPARATORS:
        spaced = F.replace(spaced, F.lit(c), F.lit(" "))
    return F.split(spaced, " ")  # one plain character: no regular expression runs


def words_of(text: Column) -> Column:
    """Array of the words `[^\\x20\\x09-\\x0D]+` of text, in order; null and blank texts have none."""
    return F.array_remove(pieces_of(text), "")


def count_chars(text: Column, chars: str) -> Column:
    """How many code points of text are among chars."""
    rest = text
    for c in chars:
        rest = F.replace(rest, F.lit(c), F.lit(""))
    return F.length(text) - F.length(rest)


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
