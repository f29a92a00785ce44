"""Neighbour recall and the final ranking of what it brings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnfield.operators.index import CHUNK

RESULT = ["query_id", "corpus_id", "file_path", "chunk_no", "start_line", "end_line", "score", "source"]


def default_limit(k: int, window: int) -> int:
    return max(20, k * (2 * window + 1))


def expand_with_neighbors(seeds: DataFrame, chunks: DataFrame, window: int = 1, max_results: int | None = 20) -> DataFrame:
    """recalled results with `position`: every seed's neighbours in rank order, each chunk once.

    A chunk belongs to the first (seed rank, offset) that reaches it. Seeds are
    expanded until max_results chunks are there, and a chunk that is itself one
    of the expanded seeds carries that seed's score and source; others carry
    their seed's score and the source recall:seed-<rank><offset>. A seed that is
    not in the chunk table stays. None or 0 means no limit.
    """
    by_query = Window.partitionBy("query_id")
    if window <= 0:
        kept = seeds if not max_results else seeds.filter(F.col("rank") <= max_results)
        return kept.select(*RESULT, F.col("rank").alias("position"))
    own = seeds.select(*RESULT, F.col("rank").alias("seed"), F.lit(0).alias("offset"))
    around = seeds.select("query_id", *CHUNK, F.col("rank").alias("seed"), F.explode(F.sequence(F.lit(-window), F.lit(window))).alias("offset")).filter("offset <> 0")
    around = around.withColumn("chunk_no", F.col("chunk_no") + F.col("offset"))
    near = around.join(chunks.select(*CHUNK, "start_line", "end_line"), CHUNK)
    lines = ["start_line", "end_line"]
    reached = own.select("query_id", *CHUNK, *lines, "seed", "offset").unionByName(near.select("query_id", *CHUNK, *lines, "seed", "offset"))
    first = reached.groupBy("query_id", *CHUNK).agg(F.min(F.struct("seed", "offset")).alias("at"), *[F.min(c).alias(c) for c in lines])
    first = first.select("query_id", *CHUNK, *lines, "at.seed", "at.offset")
    if max_results:
        # chunks up to and with each seed; the first seed that reaches the limit is the last one expanded
        so_far = F.count("*").over(by_query.orderBy("seed").rangeBetween(Window.unboundedPreceding, 0))
        first = first.withColumn("so_far", so_far)
        last = F.min(F.when(F.col("so_far") >= max_results, F.col("seed"))).over(by_query)
        first = first.withColumn("last", last).filter(F.col("last").isNull() | (F.col("seed") <= F.col("last")))
        first = first.withColumn("position", F.row_number().over(by_query.orderBy("seed", "offset"))).filter(F.col("position") <= max_results)
    else:
        first = first.withColumn("last", F.lit(None).cast("int")).withColumn("position", F.row_number().over(by_query.orderBy("seed", "offset")))
    giving = seeds.select("query_id", F.col("rank").alias("seed"), F.col("score").alias("given"))
    itself = seeds.select("query_id", *CHUNK, F.col("rank").alias("own_rank"), F.col("score").alias("own_score"), F.col("source").alias("own_source"))
    rows = first.join(giving, ["query_id", "seed"]).join(itself, ["query_id", *CHUNK], "left")
    is_seed = F.col("own_rank").isNotNull() & (F.col("last").isNull() | (F.col("own_rank") <= F.col("last")))
    label = F.format_string("recall:seed-%d%+d", "seed", "offset")
    return rows.select(
        "query_id", *CHUNK, *lines,
        F.when(is_seed, F.col("own_score")).otherwise(F.col("given")).alias("score"),
        F.when(is_seed, F.col("own_source")).otherwise(label).alias("source"),
        "position",
    )


def rescore(recalled: DataFrame, scored: DataFrame, chunks: DataFrame) -> DataFrame:
    """recalled with each chunk's own score for the query: zero for known chunks without a match; unknown chunks are dropped."""
    known = recalled.drop("score").join(chunks.select(*CHUNK), CHUNK, "left_semi")
    fresh = known.join(scored.select("query_id", *CHUNK, "score"), ["query_id", *CHUNK], "left")
    return fresh.withColumn("score", F.coalesce("score", F.lit(0.0)))


def final_results(rescored: DataFrame, final_k: int | None = None, min_score: float = 0.0) -> DataFrame:
    """rescored rows of at least min_score with `rank`: score, then searched before recalled, then earlier position. None keeps all, 0 or less none."""
    kept = rescored.filter(F.col("score") >= min_score)
    direct = F.col("source").isin("hybrid", "bm25").cast("int")
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), direct.desc(), "position")
    ranked = kept.withColumn("rank", F.row_number().over(order))
    return ranked if final_k is None else ranked.filter(F.col("rank") <= max(final_k, 0))
