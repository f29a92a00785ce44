"""The library's inputs made from the driver's tables, all row by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CORPUS = "docs"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def path_of(doc_id: Column, source: Column) -> Column:
    """Path of a document as a file; every tenth is a test file."""
    folder = F.when(doc_id % 10 == 0, "tests/").otherwise("")
    return F.concat(folder, source, F.lit("/doc_"), doc_id.cast("string"), F.lit(".py"))


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return docs.select(F.lit(CORPUS).alias("corpus_id"), path_of(F.col("doc_id"), F.col("source")).alias("file_path"), "text")


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python source for each supplier, whose structure follows from its keys."""
    k, n = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")
    text = F.concat(
        F.lit("import pkg.m_"), n, F.lit("\nfrom lib.util import helper_"), n, F.lit("\n\n\nclass Part_"), k, F.lit("(Base):\n    def load_"), k,
        F.lit("(self, path_"), n, F.lit("):\n        return helper_"), n, F.lit("(path_"), n, F.lit(")\n\n\nasync def run_"), k, F.lit("(a, *, key=None, **more):\n    await client.send_"), n, F.lit("(a)\n"),
    )
    broken = F.when(F.col("s_suppkey") % 7 == 0, F.concat(text, F.lit("def broken(:\n"))).otherwise(text)
    path = F.concat(F.lit("Code/N"), n, F.lit("/part_"), k, F.lit(".py"))
    return read(spark, sf_dir, "supplier").select(F.lit("code").alias("corpus_id"), path.alias("file_path"), broken.alias("text"))


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.lit(CORPUS).alias("corpus_id"), F.col("text").alias("query"))


def document_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth document asks with its text; its own file and the next document's of that source are the gold files.

    The first is listed twice where the id is a multiple of 100; one case in three has a gold file that the corpus lacks.
    """
    docs = read(spark, sf_dir, "documents").filter("doc_id % 50 = 0")
    own = path_of(F.col("doc_id"), F.col("source"))
    other = path_of(F.col("doc_id") + 1, F.col("source"))
    absent = F.concat(F.lit("absent/doc_"), F.col("doc_id").cast("string"), F.lit(".py"))
    gold = F.when(F.col("doc_id") % 150 == 50, F.array(absent)).when(F.col("doc_id") % 100 == 0, F.array(own, other, own)).otherwise(F.array(own, other))
    return docs.select(F.col("doc_id").alias("query_id"), F.lit(CORPUS).alias("corpus_id"), F.col("text").alias("query"), gold.alias("relevant"))
