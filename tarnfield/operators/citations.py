"""Citations in generated answers, checked against the evidence that was shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfield.functions.paths import path_text
from tarnfield.functions.text import right_trim

#: The form of a citation, and phrases of a refusal.
CITATION = r"(?U)((?:[A-Za-z]:)?[\w./\\-]+?\.py):(\d+)-(\d+)"
REFUSALS = ("cannot find", "not enough evidence")
REFUSAL_ZH = "无法在检索到的代码中找到答案"
REPORT_TITLE = "## 引用校验"
REPORT_MISSING = "- 未检测到 path:start-end 格式引用，请补充来自检索上下文的代码位置。"
REPORT_INVALID = "- 无效引用: "


def citations_of(answer: Column) -> Column:
    """Array of (path, start_line, end_line, text) in text order, duplicates kept; a line number of more than 38 digits is null, so no block supports it."""
    part = lambda i: F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(CITATION), F.lit(i))
    zipped = F.arrays_zip(part(1).alias("path"), part(2).alias("a"), part(3).alias("b"), part(0).alias("text"))
    number = lambda x: x.try_cast("decimal(38,0)")
    return F.transform(zipped, lambda x: F.struct(x["path"].alias("path"), number(x["a"]).alias("start_line"), number(x["b"]).alias("end_line"), x["text"].alias("text")))


def is_refusal(answer: Column) -> Column:
    answer = F.coalesce(answer, F.lit(""))
    low = F.lower(answer)
    return answer.contains(REFUSAL_ZH) | low.contains(REFUSALS[0]) | low.contains(REFUSALS[1])


def paths_match(a: Column, b: Column) -> Column:
    """Same path, or one ends with a slash and the other."""
    x, y = path_text(a), path_text(b)
    return (x == y) | y.endswith(F.concat(F.lit("/"), x)) | x.endswith(F.concat(F.lit("/"), y))


def extract(answers: DataFrame) -> DataFrame:
    """(query_id, citation_no, path, start_line, end_line, text) of answers(query_id, answer)."""
    return answers.select("query_id", F.posexplode(citations_of(F.col("answer"))).alias("citation_no", "c")).select("query_id", "citation_no", "c.*")


def check(answers: DataFrame, blocks: DataFrame) -> DataFrame:
    """extract() with `supported`: the range is well formed and lies in a block of the same query whose path matches.

    The join is on the query and the file name; only blocks of one query meet.
    """
    name = lambda c: F.element_at(F.split(path_text(F.col(c)), "/"), -1)
    cited = extract(answers).withColumn("name", name("path"))
    shown = blocks.select("query_id", F.col("file_path").alias("shown"), F.col("start_line").alias("from_line"), F.col("end_line").alias("to_line")).withColumn("name", name("shown"))
    fits = paths_match(F.col("path"), F.col("shown")) & (F.col("start_line") >= F.col("from_line")) & (F.col("end_line") <= F.col("to_line"))
    good = cited.join(shown, ["query_id", "name"]).filter(fits & (F.col("start_line") > 0) & (F.col("end_line") >= F.col("start_line")))
    good = good.select("query_id", "citation_no").distinct().withColumn("supported", F.lit(True))
    return cited.drop("name").join(good, ["query_id", "citation_no"], "left").na.fill(False, ["supported"])


def validate(answers: DataFrame, blocks: DataFrame) -> DataFrame:
    """(query_id, n_citations, invalid, missing_citations, has_issues, report): report is the answer, with a note where there are issues. A null answer counts as empty."""
    checked = check(answers, blocks).groupBy("query_id").agg(
        F.count("*").alias("n_citations"),
        F.transform(F.sort_array(F.collect_list(F.when(~F.col("supported"), F.struct("citation_no", "text")))), lambda x: x["text"]).alias("invalid"),
    )
    seen = blocks.select("query_id").distinct().withColumn("has_results", F.lit(True))
    answers = answers.select("query_id", F.coalesce("answer", F.lit("")).alias("answer"))
    rows = answers.join(checked, "query_id", "left").join(seen, "query_id", "left").na.fill(0, ["n_citations"]).na.fill(False, ["has_results"])
    rows = rows.withColumn("invalid", F.coalesce("invalid", F.array().cast("array<string>")))
    missing = F.col("has_results") & (F.col("n_citations") == 0) & ~is_refusal(F.col("answer"))
    rows = rows.withColumn("missing_citations", missing).withColumn("has_issues", missing | (F.size("invalid") > 0))
    notes = F.concat(F.array(F.lit(""), F.lit(REPORT_TITLE)), F.when(F.col("missing_citations"), F.array(F.lit(REPORT_MISSING))).otherwise(F.array().cast("array<string>")),
                     F.transform("invalid", lambda x: F.concat(F.lit(REPORT_INVALID), x)))
    report = F.when(F.col("has_issues"), F.concat(right_trim(F.col("answer")), F.lit("\n"), F.array_join(notes, "\n"))).otherwise(F.col("answer"))
    return rows.select("query_id", "n_citations", "invalid", "missing_citations", "has_issues", report.alias("report"))
