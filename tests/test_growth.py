"""Steps whose cost grew too fast: what is evaluated once, and what rows are asked."""

from tarnfield.functions.text import fold
from tarnfield.plans import queries
from pyspark.sql import functions as F


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_folding_asks_its_class_about_characters_beyond_ascii_only(spark):
    rows = spark.createDataFrame([("Straße",), ("PLAIN",), (None,), ("ŉ ſ",)], "t string").select(fold(F.col("t")).alias("x"))
    assert [r["x"] for r in rows.collect()] == ["strasse", "plain", None, "ʼn s"]
    assert "(?=[^\\x00-\\x7f])" in optimized(rows)


def test_token_counts_need_no_sorted_tokens(spark, small):
    from tarnfield.functions import tokens

    plan = optimized(queries.QUERIES["token_counts"](spark, small))
    assert plan.count(tokens._TOKEN) == 2 and "content_tf" not in plan


def test_chinese_tokens_are_made_once(spark, small):
    """The filter and both columns made them anew; tokenize() itself names the pattern in both of its ways."""
    from tarnfield.functions import tokens

    assert optimized(queries.QUERIES["cjk_tokens"](spark, small)).count(tokens._TOKEN) == 2


def test_chinese_terms_within_each_other(spark):
    from tarnfield.functions import tokens

    run = spark.createDataFrame([("文件树",), ("被调用",), ("调",), ("类文件",)], "r string").select(tokens.cjk_tokens(F.col("r"), 1, 2).alias("x"))
    assert [r["x"] for r in run.collect()] == [
        ["文", "件", "树", "文件", "件树", "file", "filetree", "tree", "path"],
        ["被", "调", "用", "被调", "调用", "call", "client", "caller", "callee"],
        ["调"],
        ["类", "文", "件", "类文", "文件", "file", "class"],
    ]


def test_loaded_files_are_read_once(spark, small):
    """The sort over them read and decoded every file twice."""
    assert "binaryFile" not in optimized(queries.QUERIES["loaded_files"](spark, small)) and "_decoded" not in optimized(queries.QUERIES["loaded_files"](spark, small))


def test_statistics_need_no_postings_and_equal_those_of_an_index(spark, small, monkeypatch):
    from tarnfield.operators import chunking, facts, index

    code = "import os.path\nfrom lib import load\n\n\nclass Loader(Base):\n    def load(self, path):\n        return helper(path)\n\n\ndef other(x):\n    return x\n"
    files = [("a", "src/loader.py", code), ("a", "src/prose.py", "def load nothing that parses\nclass of its own\n" * 3), ("b", "loader.py", code), ("b", "none.py", None), ("b", "p.py", "plain words\n")]
    files = index.in_path_order(spark.createDataFrame(files, "corpus_id string, file_path string, text string"))
    chunks = index.durable(chunking.split_files(files, 4, 1, ["file_no"]))
    known = index.durable(facts.file_facts(files))
    whole = index.build(chunks, known).terms
    for field, given in (("content", None), ("metadata", known)):
        rows = lambda df: sorted((r[0], r[1], r[2], round(r[3], 9)) for r in df.filter(f"{field}_df > 0").select("corpus_id", "term", f"{field}_df", f"{field}_idf").collect())  # noqa: B023, E731
        assert rows(index.statistics(chunks, given)) == rows(whole)
    monkeypatch.setattr(queries.workloads, "build_corpus", None)
    assert all(queries.QUERIES[f"{n}_statistics"](spark, small).count() for n in ("term", "metadata"))


def test_postings_of_chunks_are_neither_joined_nor_moved(spark, monkeypatch):
    """They were joined with their files' terms and shuffled once more, after the chunks had been dealt."""
    from tarnfield.operators import index
    from tarnfield.plans import workloads

    stored, store = [], index.durable_buckets
    monkeypatch.setattr(index, "durable_buckets", lambda tables, *a, **k: (stored.append(tables), store(tables, *a, **k))[1])
    workloads.build_corpus(spark.createDataFrame([("c", "a.py", "import os\nx = os\n"), ("c", "b.py", "y")], "corpus_id string, file_path string, text string"))
    plan = stored[-1][0]._jdf.queryExecution().executedPlan().toString()
    assert "counts" in plan and "Join" not in plan and "Exchange" not in plan


CODE = "import os.path\nfrom lib import load\n\n\nclass Loader(Base):\n    def load(self, path):\n        return helper(path)\n"


def _corpus(spark, **more):
    from tarnfield.plans import workloads

    files = [("c", "src/loader.py", CODE), ("c", "tests/prose.py", "def load nothing\nclass of its own\n" * 9), ("c", "b.py", None), *[("c", f"d{i}.py", f"word{i} load path\n" * i) for i in range(20)]]
    return workloads.build_corpus(spark.createDataFrame(files, "corpus_id string, file_path string, text string"), 4, 1, **more)


def test_large_batches_sort_no_postings_and_find_the_same(spark, small, monkeypatch):
    """Postings were written once more, sorted by bands, for batches that read all of them anyway."""
    from tarnfield.operators import index, search

    found, asked = {}, spark.createDataFrame([("a", "c", "which function calls helper in the Loader signature"), ("b", "c", "word7 load import path"), ("n", "c", None), ("o", "c", "absent")], "query_id string, corpus_id string, query string")
    for lookup, most in ((True, 256), (True, 0), (False, 0)):
        monkeypatch.setattr(search, "_MOST_BANDS", most)
        best = search.search(_corpus(spark, lookup=lookup).index, asked, 4)
        found[lookup, most] = sorted((r["query_id"], r["rank"], r["file_path"], r["start_line"], round(r["score"], 9)) for r in best.collect())
    assert found[True, 256] == found[True, 0] == found[False, 0] and len(found[True, 256]) == 16
    sorts, store = [], index.durable_buckets
    monkeypatch.setattr(index, "durable_buckets", lambda *a, **k: (sorts.append(k.get("sort")), store(*a, **k))[1])
    queries.forget_stages()
    queries.docs_corpus(spark, small)
    assert len(sorts) > 1 and not any(sorts)


def test_chunks_of_a_large_batch_are_not_moved(spark):
    """All postings were grouped by chunk once more, after the chunks had been dealt."""
    from tarnfield.operators import search

    own = _corpus(spark, lookup=False).index
    asked = search.Asked.of(own, search.query_terms(spark.createDataFrame([("a", "c", "which function has a call of helper in load")], "query_id string, corpus_id string, query string")))
    hits = search._chunk_hits(own, F.broadcast(search._numbered_terms(asked)))
    rows = hits.collect()
    assert {r["kind"] for r in rows} == {"text", "calls", "signature"}
    places = [(r["file_no"], r["part"], r["chunk_no"]) for r in rows]
    assert sum(a != b for a, b in zip(places, places[1:])) + 1 == len(set(places))
    assert "Exchange hashpartitioning" not in hits._jdf.queryExecution().executedPlan().toString()


def test_query_tokens_are_made_once(spark, small):
    from tarnfield.functions import tokens
    from tarnfield.operators import search
    from tarnfield.plans import tables

    assert optimized(search.query_terms(tables.document_cases(spark, small))).count(tokens._TOKEN) == 2
