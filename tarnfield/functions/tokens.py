"""Tokens of code and mixed-language text, as column functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnfield.functions.text import let

#: Code words for Chinese terms, appended when a run of Chinese characters holds the term.
SYNONYMS: dict[str, tuple[str, ...]] = {
    "检索": ("retrieval", "search"),
    "搜索": ("search",),
    "评测": ("eval", "evaluation"),
    "评价": ("eval", "evaluation"),
    "召回": ("recall",),
    "结果": ("result",),
    "文件": ("file",),
    "正确": ("relevant", "correct"),
    "相关": ("relevant",),
    "过滤": ("filter",),
    "筛选": ("filter",),
    "排序": ("rank", "sort"),
    "分词": ("tokenize", "tokenizer"),
    "切片": ("chunk", "split"),
    "代码块": ("chunk",),
    "大模型": ("llm",),
    "调用": ("call", "client"),
    "被调用": ("call", "caller", "callee"),
    "导入": ("import", "from"),
    "引用": ("reference", "import"),
    "接口": ("api",),
    "函数": ("function", "def"),
    "方法": ("method", "function", "def"),
    "类": ("class",),
    "签名": ("signature",),
    "继承": ("inherit", "base", "class"),
    "模块": ("module",),
    "路径": ("path", "file"),
    "文件树": ("filetree", "tree", "path"),
    "索引": ("index",),
    "测试": ("test", "testing"),
    "单测": ("test", "unittest"),
    "断言": ("assert",),
}

#: Fixed value: words of a query that ask for tests.
TEST_WORDS = ("test", "tests", "testing", "unittest", "pytest", "测试", "单测", "断言")

_CJK = "[\u4e00-\u9fff]"
#: What makes more of a token than its lower-case form.
_COMPOUND = "[A-Z_\u4e00-\u9fff](?:(?<=[_\u4e00-\u9fff])|(?<=[A-Za-z0-9][A-Z]))"
_TOKEN = f"[A-Za-z_][A-Za-z_0-9]*|\\p{{Nd}}+|{_CJK}+"


def split_identifier(name: Column) -> Column:
    """Lower-case parts of a snake or camel case name."""
    spaced = F.regexp_replace(F.regexp_replace(name, "(.)([A-Z][a-z]+)", "$1 $2"), "([a-z0-9])([A-Z])", "$1 $2")
    return F.filter(F.split(F.lower(spaced), "[_ ]+"), lambda p: p != "")


def identifier_tokens(name: Column, keep_full: bool = True) -> Column:
    """The whole name in lower case, then its parts, each once; a name of underscores only has none."""
    parts = split_identifier(name)
    if not keep_full:
        return F.array_distinct(parts)
    whole = F.lower(F.trim(name, F.lit("_")))
    return F.when(whole == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(F.array(whole), parts)))


#: Finds the longest term at each place of a run.
_TERMS = "(?=(" + "|".join(sorted(SYNONYMS, key=len, reverse=True)) + "))"


def _code_words(run: Column) -> Column:
    """The code words for the terms in a run, each once, in the order of SYNONYMS."""
    ranks = {k: [i for i, x in enumerate(SYNONYMS) if k.startswith(x)] for k in SYNONYMS}  # a term holds those that begin it
    table = F.create_map(*[c for k, r in ranks.items() for c in (F.lit(k), F.array(*map(F.lit, r)))])
    words = F.array(*[F.array(*map(F.lit, v)) for v in SYNONYMS.values()])
    found = F.flatten(F.transform(F.array_distinct(F.regexp_extract_all(run, F.lit(_TERMS), F.lit(1))), lambda k: F.element_at(table, k)))
    return F.array_distinct(F.flatten(F.transform(F.sort_array(F.array_distinct(found)), lambda i: F.get(words, i))))


def cjk_tokens(run: Column, least: int = 1, most: int = 4) -> Column:
    """All n-grams of a run of Chinese characters, duplicates kept, and the code words for the terms in it."""
    grams = F.concat(*[F.regexp_extract_all(run, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in range(least, max(least, most) + 1)])
    has_term = run.rlike(f"(?=[{''.join(sorted({k[0] for k in SYNONYMS}))}])(?:{'|'.join(SYNONYMS)})")
    return let(grams, lambda g: F.when(has_term, F.concat(g, F.array_except(_code_words(run), g))).otherwise(g))


def tokenize(text: Column, keep_full: bool = True, cjk_min: int = 1, cjk_max: int = 4) -> Column:
    """Tokens of identifiers, numbers and Chinese runs in text order, duplicates kept; null text has none.

    Texts without compound names or Chinese, and all plain words in others, take a short way to the same result.
    """
    own = F.coalesce(text, F.lit(""))
    found = F.regexp_extract_all(own, F.lit(_TOKEN), F.lit(0))
    one = lambda t: (
        F.when(~t.rlike(_COMPOUND), F.array(F.lower(t)))
        .when(t.rlike("^[A-Za-z_]"), identifier_tokens(t, keep_full))
        .otherwise(cjk_tokens(t, cjk_min, cjk_max))
    )
    # in lower case a whole text has the same tokens, unless a letter that is none of a token becomes one
    plain = F.regexp_extract_all(F.lower(own), F.lit(_TOKEN), F.lit(0))
    return F.when(own.rlike(_COMPOUND) | F.contains(own, F.lit("\u0130")) | F.contains(own, F.lit("\u212a")), F.flatten(F.transform(found, one))).otherwise(plain)


def is_chinese(text: Column) -> Column:
    return text.rlike("\\A[\u4e00-\u9fff]*\\z")


def has_any(tokens: Column, words: Sequence[str]) -> Column:
    """Whether one of words is among the tokens, as TEST_WORDS are in a query for tests."""
    return F.arrays_overlap(tokens, F.array(*map(F.lit, words)))
