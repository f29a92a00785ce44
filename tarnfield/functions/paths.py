"""Column functions on file paths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnfield.functions.text import fold


def file_key(path: Column) -> Column:
    """Path with forward slashes in full case folding."""
    return fold(F.replace(path, F.lit("\\"), F.lit("/")))


def path_text(path: Column) -> Column:
    """file_key without blanks at the ends."""
    return F.trim(file_key(path))


def path_parts(path: Column) -> Column:
    """Sort key of a path: its parts, so that a folder's files stand before a name that goes on after the folder's."""
    return F.split(path, "/")


def is_test_path(path: Column) -> Column:
    key = file_key(path)
    name = F.element_at(F.split(key, "/"), -1)
    return key.startswith("tests/") | key.contains("/tests/") | name.startswith("test_") | name.endswith("_test.py")


def module_name(path: Column) -> Column:
    return F.replace(F.regexp_replace(file_key(path), "\\.py$", ""), F.lit("/"), F.lit("."))


def directories(path: Column) -> Column:
    parts = F.split(file_key(path), "/")
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def test_module(path: Column) -> Column:
    """Dotted name of a test file from its first part `tests` on, or of the whole path."""
    parts = F.filter(F.split(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "\\.py$", ""), "/"), lambda p: p != "")
    at = F.array_position(parts, "tests")
    return F.array_join(F.when(at > 0, F.slice(parts, at.cast("int"), F.size(parts))).otherwise(parts), ".")


def readable_path(path: Column, roots: Sequence[str] = ()) -> Column:
    """Path relative to the first root that holds it, with forward slashes."""
    plain = F.replace(path, F.lit("\\"), F.lit("/"))
    found = plain
    for root in reversed(roots):
        base = root.replace("\\", "/").rstrip("/") + "/"
        found = F.when(plain.startswith(base), F.substring(plain, len(base) + 1, 1 << 20)).otherwise(found)
    return found


def comparable_forms(path: Column, roots: Sequence[str] = ()) -> Column:
    """Distinct forms of a path that count as the same file: as written, under each root, and relative to each root."""
    own = path_text(path)
    bases = [r.replace("\\", "/").rstrip("/").casefold() + "/" for r in roots]
    absolute = own.rlike("^(/|[a-z]:/)")
    full = [F.when(absolute, own).otherwise(F.concat(F.lit(b), own)) for b in bases] or [own]
    inside = [F.when(f.startswith(b), F.substring(f, len(b) + 1, 1 << 20)) for f in full for b in bases]
    return F.filter(F.array_distinct(F.array_compact(F.array(own, *full, *inside))), lambda x: x != "")
