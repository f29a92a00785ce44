"""Column functions on text."""

from __future__ import annotations

import sys
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Everything that ends a line.
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def lines_of(text: Column) -> Column:
    """Lines without their breaks; a closing break makes no empty line, and empty or null text has no lines."""
    parts = F.split(F.coalesce(text, F.lit("")), LINE_BREAK)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


@cache
def _folds() -> dict[str, str]:
    """Lower-case characters that full case folding turns into something else, such as sharp s; made from Unicode's own rules."""
    every = (chr(i) for i in range(sys.maxunicode + 1) if not 0xD800 <= i < 0xE000)
    pairs = {c.lower(): c.casefold() for c in every if c.lower() != c.casefold() and len(c.lower()) == 1}
    return {c: x for c, x in pairs.items() if c != x}


def fold(text: Column) -> Column:
    """text in full case folding; only texts with one of the few characters that lower case leaves apart are taken character by character."""
    low, folds = F.lower(text), _folds()
    table = F.str_to_map(F.lit("\x01".join(f"{c}\x02{x}" for c, x in folds.items())), F.lit("\x01"), F.lit("\x02"))  # one literal after optimisation
    chars = F.regexp_extract_all(low, F.lit("(?s)."), F.lit(0))
    folded = F.array_join(F.transform(chars, lambda c: F.coalesce(F.try_element_at(table, c), c)), "")
    # the class is a long chain of characters for Java, so it is only asked about those beyond ASCII, where all of them are
    return F.when(low.rlike(f"(?=[^\\x00-\\x7f])[{''.join(folds)}]"), folded).otherwise(low)


def preview(text: Column, max_chars: int = 120) -> Column:
    """Trimmed non-blank lines joined by a blank; over max_chars the first max_chars - 3, right-trimmed, and three dots."""
    white = "[\\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\x1c-\x1f\x85]"
    strip = lambda x: F.regexp_replace(x, f"^{white}+|{white}+$", "")
    joined = F.array_join(F.filter(F.transform(lines_of(text), strip), lambda x: x != ""), " ")
    cut = F.concat(F.regexp_replace(F.substring(joined, 1, max_chars - 3), f"{white}+$", ""), F.lit("..."))
    return F.when(F.length(joined) > max_chars, cut).otherwise(joined)


def right_trim(text: Column) -> Column:
    return F.regexp_replace(text, "\\s+$", "")


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once for each row."""
    return F.get(F.transform(F.array(value), body), 0)
