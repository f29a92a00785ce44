"""Steps of searches and sources that grew faster than their input, or needed tables of all terms."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from tarnfield.operators import blocks, chunking, facts, search
from tarnfield.plans import queries, tables


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def ranked(df) -> list:
    return sorted((r["query_id"], r["rank"], r["file_no"], r["chunk_no"], round(r["score"], 9)) for r in df.collect())


def test_many_terms_are_neither_joined_to_the_chunks_nor_do_they_move_them(spark, small, monkeypatch):
    """Beyond the broadcast limit all postings were joined with the terms by shuffles, dealt and sorted again."""
    index, asked = queries.docs_corpus(spark, small).index, tables.document_cases(spark, small)
    want, plans, store = ranked(search.rank_queries(index, asked, 4).best), [], search.durable
    monkeypatch.setattr(search, "sized_broadcast", lambda df, *a: df)
    monkeypatch.setattr(search, "durable", lambda df, *a: (plans.append(df._jdf.queryExecution().executedPlan().toString()), store(df, *a))[1])
    assert ranked(search.rank_queries(index, asked, 4).best) == want
    made = [p for p in plans if "of_file" in p and "MapInArrow" in p]
    assert len(made) == 1 and "Exchange hashpartitioning" not in made[0] and "Generate" not in made[0]


def test_terms_of_corpora_and_kinds_have_numbers_of_their_own():
    import pyarrow as pa

    names, kinds, terms = ["a", "a", "b", "a"], np.array([0, 1, 0, 0]), ["x", "x", "x", "y"]
    ids = blocks.term_ids(blocks.hashed(pa.array(names)), kinds, pa.array(terms))
    assert len(set(ids)) == 4
    again = blocks.term_ids(blocks.hashed(pa.array(names[::-1])), kinds[::-1], pa.array(terms[::-1]))
    assert again[::-1].tolist() == ids.tolist()


@pytest.mark.parametrize("wide", [1, 3, 1024])
def test_dense_products_are_made_in_parts(monkeypatch, wide):
    """The dense products of all frequent terms of a pair of blocks were held at once."""
    sizes, count = [], np.bincount
    monkeypatch.setattr(blocks, "_DENSE", 0)
    monkeypatch.setattr(blocks, "_WIDE", wide)
    monkeypatch.setattr(blocks.np, "bincount", lambda x, *a, **k: (sizes.append(a[1]) if len(a) > 1 else None, count(x, *a, **k))[1])
    draw = np.random.default_rng(2)
    q, c = draw.integers(0, 3, (7, 30)), draw.random((11, 30)) * (draw.random((11, 30)) < 0.3)
    listed = lambda m: (lambda at, ids: (at[o := np.argsort(ids, kind="stable")], ids[o], m[at, ids][o].astype(float)))(*np.nonzero(m))
    assert np.allclose(blocks._product(listed(q), listed(c), (7, 11)), q @ c.T)
    assert max(sizes) <= max(11 * wide, 77)


def _blocks(draw, n: int, families: int) -> list[blocks.Block]:
    import pyarrow as pa

    made = []
    for b in range(n):
        at, ids = np.nonzero(draw.random((16, 12)) < 0.4)
        order = np.argsort(ids, kind="stable")
        rows = {"file_no": np.arange(16) + 16 * b, "part": np.zeros(16, int), "chunk_no": np.zeros(16, int), "family": draw.integers(0, families, 16), "is_test": np.arange(16) % 3 == 0}
        terms = {"content": np.round(draw.random(len(at)), 1) + 0.1, "metadata": np.zeros(len(at)), "shared": np.ones(len(at), np.int8), "kind": np.zeros(len(at), np.int8)}
        made.append(blocks.Block(pa.RecordBatch.from_arrays([pa.array(x) for x in rows.values()], list(rows)), {"at": at[order].astype(np.int32), "id": ids[order]} | terms))
    return made


@pytest.mark.parametrize("short", [False, True])
def test_a_task_hands_on_few_rows_of_a_query_and_none_of_the_first_is_missing(short):
    """Every pair of blocks handed on its own best rows."""
    import pyarrow as pa

    draw, k, n = np.random.default_rng(4), 3, 9
    at, ids = np.nonzero(draw.random((n, 12)) < 0.5)
    order = np.argsort(ids, kind="stable")
    rows = {"query_id": np.arange(n), "corpus_id": ["c"] * n, "n_terms": np.bincount(at, minlength=n), "asks_tests": np.arange(n) % 2 == 0, "top_content": np.full(n, 3.0), "top_metadata": np.zeros(n)}
    terms = {"qtf": np.ones(len(at)), "content_idf": np.ones(len(at)), "metadata_idf": np.ones(len(at)), "plain": np.ones(len(at), np.int8), "kind": np.zeros(len(at), np.int8)}
    q = blocks.Block(pa.RecordBatch.from_arrays([pa.array(x) for x in rows.values()], list(rows)), {"at": at[order].astype(np.int32), "id": ids[order]} | terms)
    own, every = search._Best(q, k), []
    own.short = short
    for c in _blocks(draw, 40, 50):
        own.add(c)
        content, metadata, shared, structure, matches = blocks.sums(q, c, search._WORTH)
        score = (0.5 * content / 3 + 0.1 * shared / q.of("n_terms")[:, None]) * search._role(q, c)
        every += [(i, -round(score[i, j] * 1e9), int(c.of("file_no")[j]), int(c.of("family")[j])) for i, j in zip(*np.nonzero(matches))]
    found = own.rows()
    got = {(q_, f) for q_, f in zip(found.column("query_id").to_pylist(), found.column("file_no").to_pylist())}
    assert found.num_rows <= 2 * k * n
    none = search._Best(q, k)
    none.floor = np.full(n, 10**12)
    none.add(_blocks(draw, 1, 5)[0])
    assert none.rows().num_rows == 0 and none.rows().schema == found.schema
    for i in range(n):
        mine, seen = sorted(x[1:] for x in every if x[0] == i), set()
        heads = [x for x in mine if x[2] not in seen and not seen.add(x[2])]
        assert {(i, x[1]) for x in heads[:k]} <= got


def test_content_search_makes_no_rows_of_pairs_and_finds_the_same(spark, small, monkeypatch):
    """All pairs of a query and a chunk with a common term were rows, summed up term by term, over postings that were sorted before."""
    index, asked = queries.docs_corpus(spark, small).index, tables.benchmark_queries(spark, small)
    want = search.top_k(search.content_scores(index, search.query_terms(asked)), 5, diverse=False)
    assert ranked(search.rank_content(index, asked, 5)) == ranked(want)
    monkeypatch.setattr(search, "content_scores", None)
    assert queries.QUERIES["bm25_search"](spark, small).count() == want.count()


def test_chunks_do_not_bring_all_lines_of_their_file(spark):
    files = spark.createDataFrame([("c", "a.py", "a\nb\nc\nd\ne\n"), ("c", "b.py", None)], "corpus_id string, file_path string, text string")
    found = chunking.split_files(files, 2, 1)
    assert [(r["chunk_no"], r["start_line"], r["end_line"], r["text"]) for r in found.collect()] == [(0, 1, 2, "a\nb"), (1, 2, 3, "b\nc"), (2, 3, 4, "c\nd"), (3, 4, 5, "d\ne")]
    assert "posexplode(transform(" in plan_of(found)


def test_texts_without_a_mark_of_code_are_not_moved_to_be_parsed(spark):
    texts = ["plain prose, no code", "import os\n", "f(1)", "class A: pass", "def f(): pass", None, "x = 1\n"]
    rows = spark.createDataFrame([("c", f"{i}.py", t) for i, t in enumerate(texts)], "corpus_id string, file_path string, text string")
    found = sorted(facts.file_facts(rows).collect(), key=lambda r: r["file_path"])
    assert [([s["name"] for s in r["symbols"]], r["imports"], r["calls"]) for r in found] == [([s["name"] for s in p["symbols"]], p["imports"], p["calls"]) for p in map(facts.parse, texts)]
    assert "Contains(text" in plan_of(facts.file_facts(rows)) or "contains(text" in plan_of(facts.file_facts(rows)).lower()


def test_letters_that_become_letters_of_tokens(spark):
    from tarnfield.functions.tokens import tokenize

    rows = spark.createDataFrame([("a K b",), ("İx Ypsilon",), ("Plain ÜBER x1",), (None,)], "t string").select(tokenize(F.col("t")).alias("x"))
    assert [r["x"] for r in rows.collect()] == [["a", "b"], ["x", "ypsilon"], ["plain", "ber", "x1"], []]


def test_first_rows_alone_start_from_the_highest_content(spark, small):
    """Each task compared short queries with all of its chunks, as it did not know what others had found."""
    index, asked = queries.docs_corpus(spark, small).index, tables.document_cases(spark, small)
    ranking = search.rank_queries(index, asked, 1)
    sums = search.field_sums(index, ranking.asked)
    pairs = search.top_k(search.fused(sums, search.highest(sums), ranking.asked.about), 1, most_parts=2)
    assert ranked(ranking.best) == ranked(pairs)
    seen = spark.createDataFrame([(1, 2.0, 1.0, 0.5, 0.85), (1, 3.0, 0.2, 0.1, 1.0)], "query_id int, content double, metadata double, there double, role double")
    assert search._floors(seen).first()["floor"] == 530_000_000 - 2


def test_short_files_are_written_by_many_tasks(spark, tmp_path):
    """Tasks were dealt by bytes, so that one or two wrote all short files."""
    from tarnfield.sources import files

    rows = spark.createDataFrame([(i, f"text {i}\nmore") for i in range(60)], "doc_id long, value string")
    files.write_files(rows, str(tmp_path / "w"), "doc_id")
    found = list((tmp_path / "w").glob("doc_id=*/part-*.txt"))
    assert len(found) == 60 and len({f.name[:10] for f in found}) > 1
    texts = files.load_files(spark, str(tmp_path / "w"), "w", "*.txt").collect()
    assert sorted(r["text"] for r in texts) == sorted(f"text {i}\nmore\n" for i in range(60))
