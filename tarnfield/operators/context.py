"""Evidence blocks: neighbouring results of a file merged, and rendered under a size budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnfield.functions.text import lines_of, preview, right_trim

#: Fixed value: the mark of a block that was cut.
CUT_MARK = "\n...[代码已截断]"


def compact(results: DataFrame) -> DataFrame:
    """context_blocks(query_id, file_path, start_line, end_line, text, score, sources, chunk_count, first_rank) of ranked results with text.

    Results of one file (by its exact path) that overlap or follow each other
    directly become one block; lines come once. first_rank counts from zero.
    """
    in_file = Window.partitionBy("query_id", "corpus_id", "file_path").orderBy("start_line", "end_line", "rank")
    before = F.max("end_line").over(in_file.rowsBetween(Window.unboundedPreceding, -1))
    rows = results.withColumn("reached", before).withColumn("new", (F.col("reached").isNull() | (F.col("start_line") > F.col("reached") + 1)).cast("int"))
    rows = rows.withColumns({"block": F.sum("new").over(in_file), "at": F.row_number().over(in_file)})
    lines = lines_of(F.col("text"))
    skip = F.when(F.col("new") == 1, 0).otherwise(F.greatest(F.col("reached") - F.col("start_line") + 1, F.lit(0)))
    fresh = F.slice(lines, skip + 1, F.greatest(F.size(lines) - skip, F.lit(0)))
    rows = rows.withColumn("fresh", fresh)
    parts = F.sort_array(F.collect_list(F.struct("at", "source", "fresh")))
    blocks = rows.groupBy("query_id", "corpus_id", "file_path", "block").agg(
        F.min("start_line").alias("start_line"),
        F.max("end_line").alias("end_line"),
        parts.alias("parts"),
        F.max("score").alias("score"),
        F.count("*").cast("int").alias("chunk_count"),
        (F.min("rank") - 1).alias("first_rank"),
    )
    return blocks.select(
        "query_id", "corpus_id", "file_path", "start_line", "end_line",
        F.array_join(F.flatten(F.transform("parts", lambda p: p["fresh"])), "\n").alias("text"),
        "score",
        F.array_distinct(F.transform("parts", lambda p: p["source"])).alias("sources"),
        "chunk_count", "first_rank",
    )


def header(index: Column, block: Column) -> Column:
    label = F.when(F.size(block["sources"]) == 1, "source").otherwise("sources")
    note = F.when(block["chunk_count"] > 1, F.concat(F.lit(", chunks="), block["chunk_count"].cast("string"))).otherwise("")
    return F.format_string(
        "### [%d] %s:%d-%d (score=%.4f, %s=%s%s)",
        index, block["file_path"], block["start_line"], block["end_line"], block["score"], label, F.array_join(block["sources"], ","), note,
    )


def _framed(head: Column, text: Column) -> Column:
    code = right_trim(text)
    return F.struct(head.alias("head"), code.alias("code"), F.concat(head, F.lit("\n```python\n"), code, F.lit("\n```")).alias("full"))


def _within(framed: Column, max_chars: int, inside: bool) -> Column:
    """The framed parts in order as one text. Each may use what the ones before left; the blank lines between do not count.

    A part that does not fit is cut inside its code (if so wanted, and if its frame fits), or as a whole; both get the cut mark.
    """

    def add(state: Column, b: Column) -> Column:
        left = max_chars - state["used"]
        room = F.greatest(F.lit(0), left - (F.length(b["head"]) + 14) - 20) if inside else F.lit(0)
        cut_code = F.concat(b["head"], F.lit("\n```python\n"), F.substring(b["code"], F.lit(1), room), F.lit(CUT_MARK), F.lit("\n```"))
        cut_all = F.concat(right_trim(F.substring(b["full"], F.lit(1), F.greatest(F.lit(0), left - 40))), F.lit(CUT_MARK))
        shown = F.when(F.length(b["full"]) <= left, b["full"]).when(room > 0, cut_code).otherwise(cut_all)
        go = (left > 0) & ~state["stop"]
        return F.struct(
            F.when(go, state["used"] + F.length(shown)).otherwise(state["used"]).alias("used"),
            F.when(go, F.concat(state["out"], F.array(shown))).otherwise(state["out"]).alias("out"),
            (state["stop"] | (left <= 0)).alias("stop"),
        )

    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("out"), F.lit(False).alias("stop"))
    return F.aggregate(framed, start, add, lambda s: F.array_join(s["out"], "\n\n"))


def render(blocks: DataFrame, max_chars: int = 12000) -> DataFrame:
    """(query_id, context): blocks in rank order as text of at most about max_chars; a block that does not fit is cut inside its code."""
    fields = ["first_rank", "file_path", "start_line", "end_line", "text", "score", "sources", "chunk_count"]
    listed = blocks.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("blocks"))  # few per query
    framed = F.transform("blocks", lambda b, i: _framed(header(i + 1, b), b["text"]))
    return listed.select("query_id", _within(framed, max_chars, inside=True).alias("context"))


def render_results(results: DataFrame, max_chars: int = 12000) -> DataFrame:
    """(query_id, context): ranked results as they are, not merged into blocks; one that does not fit is cut as a whole."""
    fields = ["rank", "file_path", "start_line", "end_line", "text", "score", "source"]
    listed = results.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("rows"))  # few per query
    head = lambda r, i: F.format_string("[%d] %s:%d-%d (score=%.4f, source=%s)", i + 1, r["file_path"], r["start_line"], r["end_line"], r["score"], r["source"])
    framed = F.transform("rows", lambda r, i: _framed(head(r, i), r["text"]))
    return listed.select("query_id", _within(framed, max_chars, inside=False).alias("context"))


def result_records(results: DataFrame, include_text: bool = False) -> DataFrame:
    """(query_id, rows): ranked results as an array of records with a preview."""
    text = ["text"] if include_text else []
    rows = results.withColumn("preview", preview(F.col("text"))).withColumnRenamed("file_path", "file")
    record = F.struct("rank", "file", "start_line", "end_line", "score", "source", "preview", *text)
    return rows.groupBy("query_id").agg(F.sort_array(F.collect_list(record)).alias("rows"))


def block_records(blocks: DataFrame, include_text: bool = False) -> DataFrame:
    """(query_id, rows): context blocks as an array of records; ranks count from one."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("first_rank")).alias("rank")
    rows = blocks.select("query_id", rank, F.col("file_path").alias("file"), "start_line", "end_line", "score", "sources", "chunk_count",
                         (F.col("first_rank") + 1).alias("first_rank"), F.length("text").alias("char_count"), preview(F.col("text")).alias("preview"), "text")
    keep = [c for c in rows.columns if c != "query_id" and (include_text or c != "text")]
    return rows.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct(*keep))).alias("rows"))


def retrieval_trace(queries: DataFrame, seeds: DataFrame, recalled: DataFrame, final: DataFrame, blocks: DataFrame, params: dict[str, object]) -> DataFrame:
    """(query_id, query, params, summary, stages): one nested row for each query, with counts and records of the four stages."""
    stages = {"initial_search": result_records(seeds), "neighbor_recall": result_records(recalled), "final_filter": result_records(final), "context_compaction": block_records(blocks)}
    rows = queries.select("query_id", "query")
    for name, table in stages.items():
        rows = rows.join(table.withColumnRenamed("rows", name), "query_id", "left")
    some = lambda n: F.coalesce(F.col(n), F.array().cast(rows.schema[n].dataType))
    literal = F.create_map(*[F.lit(x) for k, v in params.items() for x in (k, str(v))])
    counts = F.struct(*[F.size(some(n)).alias(f"{n}_count") for n in stages])
    return rows.select("query_id", "query", literal.alias("params"), counts.alias("summary"), F.struct(*[some(n).alias(n) for n in stages]).alias("stages"))
