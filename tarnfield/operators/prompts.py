"""Prompt datasets: system and user messages for each query, by mode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (system text, what is asked of the model) by mode; the first one also serves unknown modes.
TEMPLATES = {
    "judge": ("You decide whether the shown code answers the question. Cite evidence as path:start-end.", "Judge the evidence."),
    "code_understand": ("You explain code from the shown evidence only. Cite evidence as path:start-end.", "Explain how the code works."),
    "code_generate": ("You write code in the style of the shown evidence.", "Write the code that is asked for."),
    "leetcode": ("You solve programming exercises, using the shown code as reference.", "Solve the exercise and state its complexity."),
    "api": ("You write usage examples for the shown interfaces.", "Write examples that use the interfaces."),
}
DEFAULT_MODE = "judge"


def _messages(system: Column, user: Column) -> Column:
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.array(message("system", system), message("user", user))


def _pick(mode: Column, index: int) -> Column:
    text = F.lit(TEMPLATES[DEFAULT_MODE][index])
    for name, pair in TEMPLATES.items():
        text = F.when(mode == name, F.lit(pair[index])).otherwise(text)
    return text


def answer_prompts(rows: DataFrame) -> DataFrame:
    """(query_id, messages) of rows(query_id, mode, query, context)."""
    mode = F.lower("mode")
    user = F.concat(F.lit("## Question\n"), F.col("query"), F.lit("\n\n## Evidence\n"), F.coalesce("context", F.lit("")), F.lit("\n\n"), _pick(mode, 1))
    return rows.select("query_id", _messages(_pick(mode, 0), user).alias("messages"))


def task_prompts(rows: DataFrame) -> DataFrame:
    """(query_id, messages) of rows(query_id, task, kind, confidence, reasons, checks, memories, context)."""
    system = F.lit("You plan a code change from the shown evidence and memories. Name the files, the steps, the tests and the risks; say what is missing.")
    user = F.concat_ws(
        "\n",
        F.lit("## Task"), "task", F.lit("\n## Profile"),
        F.concat(F.lit("- kind: "), F.col("kind")),
        F.format_string("- confidence: %.2f", "confidence"),
        F.concat(F.lit("- reasons: "), F.array_join("reasons", ", ")),
        F.concat(F.lit("- recommended_checks: "), F.array_join("checks", ", ")),
        F.lit("\n## Memories"), "memories", F.lit("\n## Evidence"), F.coalesce("context", F.lit("")),
    )
    return rows.select("query_id", _messages(system, user).alias("messages"))
