"""Task memory: token search, identity, and appending without duplicates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnfield.functions.tokens import tokenize
from tarnfield.operators import blocks
from tarnfield.operators.index import Tokenizer
from tarnfield.sources.scratch import BROADCAST_BYTES, byte_size, durable, sized_broadcast

SCHEMA = "id string, created_at string, task string, status string, summary string, files array<string>, decisions array<string>"


def normal_task(task: Column) -> Column:
    """Lower case, runs of white space as one blank."""
    return F.trim(F.regexp_replace(F.lower(task), "(?U)\\s+", " "))


def identity() -> list[Column]:
    """Two memories are the same when task (normalised) and set order of files agree."""
    return [normal_task(F.col("task")).alias("task_key"), F.array_sort("files").alias("files_key")]


def memory_tokens(memories: DataFrame, key: str = "seq", tokenizer: Tokenizer = tokenize) -> DataFrame:
    """(seq, token): distinct tokens of task, summary, files and decisions; store it beside the memories."""
    text = F.concat_ws(" ", "task", "summary", F.array_join("files", " "), F.array_join("decisions", " "))
    return memories.select(key, F.explode(F.array_distinct(tokenizer(text))).alias("token"))


#: Memories with a token from which on the token's rows are spread over SALTS tasks, and their number.
HOT, SALTS = 10_000, 32


def _salted(words: DataFrame, tokens: DataFrame) -> DataFrame:
    """words joined to tokens; the rows of a token that HOT memories or more have are dealt by memory, and meet copies of its few words."""
    hot = durable(tokens.groupBy("token").agg(F.count("*").alias("n_rows")).filter(F.col("n_rows") >= HOT).select("token", F.lit(SALTS).alias("salts")))
    marked = lambda df: df.join(sized_broadcast(hot), "token", "left").na.fill(1, ["salts"])
    dealt = marked(tokens).withColumn("salt", F.pmod(F.xxhash64("seq"), "salts")).drop("salts")
    copied = marked(words).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts").cast("long") - 1))).drop("salts")
    return copied.join(dealt, ["token", "salt"]).drop("salt")


#: Memories that meet a block of tasks together.
BLOCK = 4096


def search(tasks: DataFrame, tokens: DataFrame, limit: int = 5, tokenizer: Tokenizer = tokenize) -> DataFrame:
    """(task_id, seq, score, rank) of tasks(task_id, task): share of the task's distinct tokens that a memory has, latest first among equals.

    Tokens of the tasks are numbered; a memory is a row of the numbers it has.
    Blocks of memories meet blocks of tasks by matrix products, and rows are
    made of a block's best memories for a task only, not of all that share a
    token.  If the tasks' tokens are many, frequent ones are split by memory.
    """
    own = tasks.select("task_id", F.array_distinct(tokenizer(F.col("task"))).alias("t"))
    words = durable(own.select("task_id", F.size("t").alias("n"), F.explode("t").alias("token")))
    known = durable(words.select("token").distinct().coalesce(1).select("token", F.monotonically_increasing_id().cast("int").alias("id")))
    small = byte_size(known) <= BROADCAST_BYTES
    listed = F.collect_list(F.struct("id")).alias("terms")
    asked = words.join(sized_broadcast(known), "token").groupBy("task_id").agg(F.first("n").alias("n"), listed)
    asked = durable(blocks.packed(asked, blocks.QUERIES))
    hits = tokens.join(F.broadcast(known), "token") if small else _salted(known, tokens)
    memories = durable(blocks.packed(hits.groupBy("seq").agg(listed), BLOCK))
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c, df in (("task_id", tasks), ("seq", tokens)))
    pairs = asked.select(F.col("rows").alias("q")).crossJoin(memories.select(F.col("rows").alias("c")))
    best = pairs.mapInArrow(_best(max(limit, 1)), f"{kinds}, score double")
    order = Window.partitionBy("task_id").orderBy(F.desc("score"), F.desc("seq"))
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= max(limit, 0))


def _best(k: int):
    """Of each pair of blocks the k best memories of each task."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                q, c = (pa.concat_arrays([batch.column(n)[i].values]) for n in (0, 1))
                shared = blocks.shared_terms(q, c)
                latest = np.empty(len(c), np.int64)
                latest[pc.sort_indices(c.field("seq"), null_placement="at_start").to_numpy()] = np.arange(len(c))
                key = shared * len(c) + latest
                at = np.argpartition(key, len(c) - min(k, len(c)), axis=1)[:, -k:]
                task, spot = np.repeat(np.arange(len(q)), at.shape[1]), at.ravel()
                found = shared[task, spot] > 0
                task, spot = task[found], spot[found]
                score = shared[task, spot] / q.field("n").to_numpy(zero_copy_only=False)[task]
                yield pa.RecordBatch.from_arrays([q.field("task_id").take(pa.array(task)), c.field("seq").take(pa.array(spot)), pa.array(score)], ["task_id", "seq", "score"])

    return best


def new_memories(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of batch(seq, ...) whose identity is neither stored nor earlier in the batch."""
    keyed = batch.select("*", *identity())
    known = stored.select(*identity()).distinct()
    fresh = keyed.join(known, ["task_key", "files_key"], "left_anti")
    first = F.row_number().over(Window.partitionBy("task_key", "files_key").orderBy("seq"))
    return fresh.withColumn("n", first).filter("n = 1").select(*batch.columns)


def build(runs: DataFrame, created_at: str) -> DataFrame:
    """Memory records of runs(task, status, summary, files, decisions) made at created_at (ISO text, seconds)."""
    return runs.select(
        F.lit(f"agent-{created_at}").alias("id"), F.lit(created_at).alias("created_at"), "task", "status", "summary",
        F.array_distinct("files").alias("files"), F.array_distinct("decisions").alias("decisions"),
    )


def summary_text(task: Column, files: Column) -> Column:
    """One line that names the task and its first three files."""
    named = F.when(F.size(files) > 0, F.array_join(F.slice(files, 1, 3), ", ")).otherwise("none")
    return F.concat(F.lit("Task: "), task, F.lit(" | files: "), named)


def format_memories(memory_rows: Column) -> Column:
    """Array of memory structs as lines."""
    line = lambda m: F.format_string("- %s [%s] %s; files=%s", m["created_at"], m["status"], m["summary"], F.array_join(m["files"], ", "))
    return F.when(F.size(memory_rows) > 0, F.array_join(F.transform(memory_rows, line), "\n")).otherwise("Nothing like it was done before.")
