"""Task profiles: kind, confidence, reasons, candidate files and recommended checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfield.functions.paths import is_test_path, test_module
from tarnfield.functions.text import fold, let

#: Keywords by kind of task; the first kind with a hit wins.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("bugfix", ("修复", "报错", "错误", "异常", "失败", "bug", "bad case", "badcase")),
    ("test", ("测试", "单测", "unittest", "pytest", "断言")),
    ("evaluation", ("评测", "trace", "轨迹", "指标", "mrr", "recall")),
    ("docs", ("文档", "readme", "agent.md", "changelog", "说明")),
    ("feature", ("增加", "新增", "实现", "支持", "功能", "添加")),
    ("optimization", ("优化", "改进", "提升", "重构", "清理")),
)
#: Commands by kind; a repository sets its own.
CHECKS: Mapping[str, Sequence[str]] = {
    **dict.fromkeys(("feature", "bugfix", "optimization", "general"), ("python -m unittest", "python -m compileall .")),
    "test": ("python -m unittest",),
    "evaluation": ("python -m unittest",),
    "docs": ("python -m compileall .",),
}


def profile(task: Column) -> Column:
    """Struct of kind, confidence and reasons (the keywords found, in rule order)."""

    def of_folded(low: Column) -> Column:
        hits = [(kind, F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))) for kind, words in RULES]
        found = F.array(*[F.struct(F.lit(k).alias("kind"), h.alias("reasons")) for k, h in hits])
        return F.get(F.filter(found, lambda x: F.size(x["reasons"]) > 0), 0)

    none = F.struct(F.lit("general").alias("kind"), F.lit(0.2).alias("confidence"), F.array().cast("array<string>").alias("reasons"))
    sure = lambda b: F.struct(b["kind"].alias("kind"), F.least(F.lit(0.95), 0.45 + 0.15 * F.size(b["reasons"])).alias("confidence"), b["reasons"].alias("reasons"))
    return let(let(fold(task), of_folded), lambda b: F.when(b.isNotNull(), sure(b)).otherwise(none))


def candidate_files(results: DataFrame) -> DataFrame:
    """(query_id, files): distinct files of ranked results, those that are no tests first, then by rank."""
    first = results.groupBy("query_id", "file_path").agg(F.min("rank").alias("rank"))
    rows = first.select("query_id", F.struct(is_test_path(F.col("file_path")).alias("t"), F.col("rank").alias("r"), F.col("file_path").alias("f")).alias("x"))
    return rows.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["f"]).alias("files"))


def recommended_checks(kind: Column, files: Column, commands: Mapping[str, Sequence[str]] = CHECKS) -> Column:
    """Test commands for the test files, then the commands of the kind, each once."""
    own = F.transform(F.filter(files, is_test_path), lambda f: F.concat(F.lit("python -m unittest "), test_module(f)))
    table = F.array().cast("array<string>")
    for name, lines in commands.items():
        table = F.when(kind == name, F.array(*map(F.lit, lines))).otherwise(table)
    return F.array_distinct(F.concat(own, table))


def decisions(kind: Column, confidence: Column, top_k: int, window: int, used_model: bool) -> Column:
    """What a run was done with: profile, search parameters, and whether a model wrote the plan."""
    return F.array(
        F.format_string("profile: %s (%.2f)", kind, confidence),
        F.lit(f"search: best {top_k} chunks by the hybrid score, neighbours up to {window} away"),
        F.lit("evidence: neighbouring chunks merged into blocks"),
        F.lit("plan: written by a model" if used_model else "plan: files and checks only, no model"),
    )
