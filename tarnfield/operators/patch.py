"""Import patching of exercise files that use names which a judge provides."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Names that need the import, and the line that brings them.
NAMES = (
    "ListNode", "TreeNode", "Node", "Optional", "List", "Dict", "Set", "Tuple", "Deque", "defaultdict", "deque",
    "Counter", "lru_cache", "cache", "heappush", "heappop", "heapify", "inf",
)
SHIM = "leetcode_types"
IMPORT_LINE = f"from {SHIM} import *\n"
SKIPPED = (".git", ".venv", "venv", "__pycache__")

_BREAKS = r"\n\r\v\f\x1c-\x1e\x85\u2028\u2029"
_REST = rf"[^{_BREAKS}]*"
_LINE = rf"{_REST}(?:\r\n|[{_BREAKS}]|\Z)"
_ASIDE = rf"(?:[^\S{_BREAKS}]*(?:\#{_REST})?(?:\r\n|[{_BREAKS}]))*(?:[^\S{_BREAKS}]*\#{_REST}\Z)?"
#: What an import may not stand before: interpreter and coding lines, comments, a docstring (an open one reaches to the end), future imports.
_TOP = re.compile(
    rf"""(?:\#!{_LINE})?
    (?:(?={_REST}coding){_LINE})?
    {_ASIDE}
    (?:[^\S{_BREAKS}]*(?P<quote>\"{{3}}|'{{3}})(?s:.*?)(?:(?P=quote){_LINE}|\Z))?
    {_ASIDE}
    (?:from\ __future__\ import\ {_LINE})*""",
    re.VERBOSE,
)


def with_import(text: str) -> str:
    """text with the import line under what has to stay on top."""
    at = _TOP.match(text).end()
    return text[:at] + IMPORT_LINE + text[at:]


@F.pandas_udf(StringType())
def _patched(texts: pd.Series) -> pd.Series:
    return texts.map(with_import)


def needs_patch(files: DataFrame) -> DataFrame:
    """files with `has_import` and `patch`: whether the import is there, and whether it has to come in."""
    parts = F.split("file_path", "/")
    usable = ~F.arrays_overlap(parts, F.array(*map(F.lit, SKIPPED))) & (F.element_at(parts, -1) != f"{SHIM}.py")
    has = F.col("text").contains(f"from {SHIM} import")
    return files.filter(usable).withColumn("has_import", has).withColumn("patch", ~has & F.col("text").rlike(f"(?U)\\b({'|'.join(NAMES)})\\b"))


def patch_files(files: DataFrame) -> DataFrame:
    """The files that change, with their new text."""
    return needs_patch(files).filter("patch").withColumn("text", _patched("text")).select(*files.columns)


def shim_directories(files: DataFrame) -> DataFrame:
    """(corpus_id, directory) that need the shim beside their files."""
    used = needs_patch(files).filter(F.col("patch") | F.col("has_import"))
    return used.select("corpus_id", F.regexp_replace("file_path", "/?[^/]*$", "").alias("directory")).distinct()
