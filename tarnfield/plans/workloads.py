"""Whole workloads made of the operators: search to evidence, evaluation, parameter search, task runs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfield.operators import context, evaluate, index, memory, recall, search, tasks
from tarnfield.operators.chunking import split_files
from tarnfield.operators.facts import file_facts
from tarnfield.operators.index import CHUNK, PLACE, Index, Tokenizer
from tarnfield.functions.tokens import tokenize
from tarnfield.sources.scratch import durable, sized_broadcast


@dataclass(frozen=True)
class Corpus:
    """Chunks with text, the stored index tables over them, and the tokens that made them."""

    chunks: DataFrame
    index: Index
    tokenizer: Tokenizer = tokenize


def build_corpus(files: DataFrame, chunk_size: int | Column = 40, overlap: int | Column = 5, tokenizer: Tokenizer = tokenize, structure: bool = True, keep: Sequence[str] = (), lookup: bool = True) -> Corpus:
    """Chunk, parse and index files(corpus_id, file_path, text), whose paths are unique; the tables are written and serve any number of queries.

    Without structure no file is parsed: enough for scores of the content field.
    Size and overlap may be columns of files, which keep then names.  Without lookup no postings are sorted for
    small batches: enough where large ones ask, which read all chunks anyway.
    """
    chunks = durable(split_files(index.in_path_order(files), chunk_size, overlap, ["file_no", *keep]))
    return Corpus(chunks, index.build(chunks, durable(file_facts(files)) if structure else None, tokenizer, lookup), tokenizer)


def corpus_statistics(files: DataFrame, field: str, chunk_size: int = 40, overlap: int = 5, tokenizer: Tokenizer = tokenize) -> DataFrame:
    """df and idf of a field's terms, as the index of build_corpus() has them, straight from the files."""
    facts = durable(file_facts(files)) if field == "metadata" else None
    return index.statistics(split_files(files, chunk_size, overlap), facts, tokenizer)


@dataclass(frozen=True)
class Found:
    """The stages of a retrieval, one row for each query and result."""

    seeds: DataFrame
    recalled: DataFrame
    final: DataFrame
    blocks: DataFrame


def retrieve(
    corpus: Corpus, queries: DataFrame, top_k: int = 5, candidate_k: int | None = None, window: int = 2,
    final_k: int | None = None, min_score: float = 0.0, recall_limit: int | None = -1, final_filter: bool = True,
) -> Found:
    """Hybrid search, neighbour recall, final ranking and evidence blocks for queries(query_id, corpus_id, query).

    candidate_k of None or 0 means top_k; final_k of None means top_k and 0 all;
    recall_limit of -1 means the default for k and window, None no limit.
    """
    wide = candidate_k or top_k
    ranking, seeds = first_results(corpus, queries, wide)
    limit = recall.default_limit(wide, window) if recall_limit == -1 else recall_limit
    last = {None: top_k, 0: None}.get(final_k, final_k)
    return follow_up(corpus, ranking, seeds, window, limit, last, min_score, final_filter)


def first_results(corpus: Corpus, queries: DataFrame, k: int) -> tuple[search.Ranking, DataFrame]:
    """The hybrid ranking and its stored results."""
    ranking = search.rank_queries(corpus.index, queries, k, corpus.tokenizer)
    return ranking, durable(search.placed(corpus.index, ranking.best).withColumn("source", F.lit("hybrid")).select(*recall.RESULT, "rank"))


def follow_up(
    corpus: Corpus, ranking: search.Ranking, seeds: DataFrame, window: int, limit: int | None, last: int | None, min_score: float = 0.0, final_filter: bool = True
) -> Found:
    """Recall around stored seeds, the final ranking of at most last results, and their blocks."""
    own = corpus.index
    recalled = durable(recall.expand_with_neighbors(seeds, own.chunks, window, limit))
    if final_filter:
        spots = durable(own.chunks.select(*CHUNK, *PLACE[:2]).join(sized_broadcast(recalled.select("query_id", *CHUNK)), CHUNK))
        scored = ranking.scores_of(own, spots).select("query_id", *PLACE, "score").join(spots, ["query_id", *PLACE])
        final = recall.final_results(recall.rescore(recalled, durable(scored), spots), last, min_score)
    else:
        final = recalled.withColumn("rank", F.col("position"))
    final = durable(final.select(*recall.RESULT, "rank"))
    return Found(seeds, recalled, final, durable(context.compact(with_text(final, corpus.chunks))))


def with_text(results: DataFrame, chunks: DataFrame) -> DataFrame:
    """Stored results with their chunks' text: only now, for a few rows, is the text read."""
    return chunks.select(*CHUNK, "text").join(sized_broadcast(results), CHUNK)


@dataclass(frozen=True)
class Evaluation:
    """Per-case metrics, flags with reasons and diagnosis, and the one-row summary."""

    metrics: DataFrame
    flags: DataFrame
    summary: DataFrame


def evaluate_cases(found: Found, cases: DataFrame, k: int = 5, roots: Sequence[str] = ()) -> Evaluation:
    """Evaluation of a retrieval of cases(query_id, query, relevant)."""
    seeds, recalled, final = (evaluate.gold_matches(x, cases, roots) for x in (found.seeds, found.recalled, found.final))
    metrics = durable(evaluate.case_metrics(final, cases, k))
    flags = evaluate.stage_flags(seeds, recalled, final, cases, k)
    flags = durable(flags.withColumns({"reasons": evaluate.reasons(), "diagnosis": evaluate.diagnosis()}))
    return Evaluation(metrics, flags, evaluate.summary(metrics, flags))


def parameter_search(
    spark: SparkSession, files: DataFrame, cases: DataFrame, k: int = 5, settings: Sequence[tuple[int, int, int]] = evaluate.SETTINGS
) -> DataFrame:
    """(setting_no, chunk_size, overlap, recall_window, mrr) of each setting.

    Every size and overlap is a corpus of its own in one index, and every case
    asks in each of them, so there is one build and one ranking for all
    settings; only recall runs once for each different window.
    """
    shapes = list(dict.fromkeys((size, overlap) for size, overlap, _ in settings))
    name = lambda c, size, overlap: F.concat_ws("|", c, size.cast("string"), overlap.cast("string"))
    own = F.explode(F.array(*[F.struct(F.lit(s).alias("chunk_size"), F.lit(o).alias("overlap")) for s, o in shapes]))
    shaped = files.select("*", own.alias("shape")).select("file_path", "text", "shape.*", name(F.col("corpus_id"), F.col("shape.chunk_size"), F.col("shape.overlap")).alias("corpus_id"))
    corpus = build_corpus(shaped, F.col("chunk_size"), F.col("overlap"), keep=["chunk_size", "overlap"], lookup=False)
    asked = cases.select("*", own.alias("shape")).withColumn("corpus_id", name(F.col("corpus_id"), F.col("shape.chunk_size"), F.col("shape.overlap")))
    asked = durable(asked.withColumns({"case_id": F.col("query_id"), "query_id": F.struct("query_id", "corpus_id").cast("string")}))
    ranking, seeds = first_results(corpus, asked, k)
    out = []
    for window in dict.fromkeys(w for _, _, w in settings):
        mine = [(no, s, o) for no, (s, o, w) in enumerate(settings) if w == window]
        rows = F.explode(F.array(*[F.struct(F.lit(no).alias("setting_no"), F.lit(s).alias("s"), F.lit(o).alias("o")) for no, s, o in mine]))
        wanted = asked.select("*", rows.alias("x")).filter("shape.chunk_size = x.s and shape.overlap = x.o")
        part = durable(wanted.select("query_id", "corpus_id", "query", "relevant", "x.setting_no", "shape.*"))
        own_seeds = durable(seeds.join(sized_broadcast(part.select("query_id")), "query_id", "left_semi"))
        found = follow_up(corpus, ranking, own_seeds, window, recall.default_limit(k, window), k)
        metrics = evaluate_cases(found, part, k).metrics.join(part.select("query_id", "setting_no", "chunk_size", "overlap"), "query_id")
        out.append(metrics.groupBy("setting_no", "chunk_size", "overlap").agg(F.round(F.avg("rr"), 6).alias("mrr")).withColumn("recall_window", F.lit(window)))
    every = out[0]
    for more in out[1:]:
        every = every.unionByName(more)
    listed = spark.createDataFrame([(no, *s) for no, s in enumerate(settings)], "setting_no int, chunk_size int, overlap int, recall_window int")
    every = listed.join(F.broadcast(every.select("setting_no", "mrr")), "setting_no", "left")  # a row for each setting
    return every.select("setting_no", "chunk_size", "overlap", "recall_window", F.coalesce("mrr", F.lit(0.0)).alias("mrr"))


def task_runs(corpus: Corpus, runs: DataFrame, memories: DataFrame, created_at: str, top_k: int = 5, window: int = 2) -> DataFrame:
    """One nested row for each of runs(query_id, corpus_id, query): profile, memories, candidate files, checks and the memory record to add."""
    found = retrieve(corpus, runs, top_k, window=window)
    task_rows = runs.select(F.col("query_id").alias("task_id"), F.col("query").alias("task"))
    near = memory.search(task_rows, memory.memory_tokens(memories)).join(memories, "seq")
    listed = near.groupBy("task_id").agg(F.sort_array(F.collect_list(F.struct("rank", "seq", "created_at", "status", "summary", "files"))).alias("memories"))
    rows = runs.select("query_id", F.col("query").alias("task"), tasks.profile(F.col("query")).alias("profile"))
    rows = rows.join(tasks.candidate_files(found.final), "query_id", "left").join(listed.withColumnRenamed("task_id", "query_id"), "query_id", "left")
    rows = rows.withColumn("files", F.coalesce("files", F.array().cast("array<string>")))
    return rows.select(
        "query_id", "task", "profile", "memories", "files",
        tasks.recommended_checks(F.col("profile.kind"), F.col("files")).alias("checks"),
        F.struct(
            F.lit(f"agent-{created_at}").alias("id"), F.lit(created_at).alias("created_at"), "task", F.lit("planned").alias("status"),
            memory.summary_text(F.col("task"), F.col("files")).alias("summary"), "files",
            tasks.decisions(F.col("profile.kind"), F.col("profile.confidence"), top_k, window, False).alias("decisions"),
        ).alias("memory"),
    )
