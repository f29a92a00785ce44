"""Scores by blocks equal the scores of single pairs, however small the blocks are."""

import numpy as np
import pytest
from tarnfield.operators import blocks, search
from tarnfield.plans import queries, tables


@pytest.mark.parametrize("dense", [0, 5, 10**9])
def test_products_of_dense_and_rare_terms(monkeypatch, dense):
    monkeypatch.setattr(blocks, "_DENSE", dense)
    draw = np.random.default_rng(1)
    q, c = draw.integers(0, 3, (7, 30)), draw.random((11, 30)) * (draw.random((11, 30)) < 0.3)
    q[:, 4], c[:, 5] = 0, 0
    listed = lambda m: (lambda at, ids: (at[o := np.argsort(ids, kind="stable")], ids[o], m[at, ids][o].astype(float)))(*np.nonzero(m))
    assert np.allclose(blocks._product(listed(q), listed(c), (7, 11)), q @ c.T)


@pytest.mark.parametrize("dense", [0, 10**9])
def test_values_of_repeated_terms_add_up(monkeypatch, dense):
    monkeypatch.setattr(blocks, "_DENSE", dense)
    of = lambda *rows: tuple(np.array(x) for x in zip(*rows))
    found = blocks._product(of((0, 1, 2.0), (1, 1, 1.0), (1, 4, 3.0)), of((0, 1, 0.5), (0, 1, 0.25), (1, 4, 1.0), (1, 4, 1.0)), (2, 2))
    assert found.tolist() == [[1.5, 0.0], [0.75, 6.0]]


def test_best_places_keep_families_and_break_ties_by_place():
    score, family, place = np.array([[0.9, 0.9, 0.8, 0.1, 0.9]]), np.array([1, 1, 1, 2, 3]), np.array([1, 0, 2, 3, 4])
    _, found = blocks.best_places(score, score > 0, family, place, 2)
    assert set(found) == {0, 1, 4}
    _, found = blocks.best_places(score, score > 0, family, place, 4)  # fewer families than asked for
    assert set(found) == {0, 1, 2, 3, 4}


def test_ranking_by_small_blocks_equals_scores_of_pairs(spark, small, monkeypatch):
    monkeypatch.setattr(blocks, "CHUNKS", 7)
    monkeypatch.setattr(blocks, "QUERIES", 3)
    index, asked = queries.docs_corpus(spark, small).index, tables.document_cases(spark, small)
    ranking = search.rank_queries(index, asked, 4)
    sums = search.field_sums(index, ranking.asked)
    pairs = search.top_k(search.fused(sums, search.highest(sums), ranking.asked.about), 4, most_parts=2)
    rows = lambda df: sorted((r["query_id"], r["rank"], r["file_no"], r["chunk_no"], round(r["score"], 9)) for r in df.collect())
    assert rows(ranking.best) == rows(pairs)


def test_recalled_chunks_meet_their_own_queries_only(spark, small):
    index, asked = queries.docs_corpus(spark, small).index, tables.document_cases(spark, small)
    ranking = search.rank_queries(index, asked, 3)
    spots = search.durable(ranking.best.select("query_id", *search.PLACE))
    scored = ranking.scores_of(index, spots)
    assert scored.count() == spots.count()


def test_memories_are_found_by_small_blocks_and_not_by_rows_of_pairs(spark, monkeypatch):
    from pyspark.sql import functions as F
    from tarnfield.operators import memory

    draw = np.random.default_rng(3)
    texts = {f"m{i:03d}": set(draw.choice(list("abcdefghij"), 4)) for i in range(150)}
    asked = {i: set(draw.choice(list("abcdefghijkl"), 5)) for i in range(9)} | {9: {"x"}}
    tokens = spark.createDataFrame([(s, t) for s, own in texts.items() for t in own], "seq string, token string")
    tasks = spark.createDataFrame([(i, " ".join(own)) for i, own in asked.items()], "task_id int, task string")
    want = []
    for i, own in asked.items():
        scored = sorted(((len(own & x) / len(own), s) for s, x in texts.items() if own & x), reverse=True)
        want += [(i, s, score, rank) for rank, (score, s) in enumerate(scored[:6], 1)]
    monkeypatch.setattr(memory, "BLOCK", 16)
    monkeypatch.setattr(blocks, "QUERIES", 4)
    found = memory.search(tasks, tokens, 6, lambda c: F.split(c, " "))
    assert sorted(tuple(r) for r in found.select("task_id", "seq", "score", "rank").collect()) == sorted(want)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "token" not in plan


@pytest.mark.parametrize("together", [0, 7, 1000])
def test_blocks_are_cut_between_rows(together):
    import pyarrow as pa

    draw = np.random.default_rng(5)
    keys = np.repeat(np.arange(23), draw.integers(1, 9, 23))
    rows = pa.RecordBatch.from_arrays([pa.array(keys), pa.array(keys % 2 == 0), pa.array(draw.integers(0, 40, len(keys)), pa.int32()), pa.array(draw.random(len(keys)))], ["place", "is_test", "id", "worth"])
    made = list(blocks.cut((rows.slice(i, 6) for i in range(0, len(keys), 6)), 4, ["place"], ["place", "is_test"], together))
    made = [blocks.Block.loaded(b.stored()) for b in made]
    assert [len(b) for b in made] == [4, 4, 4, 4, 4, 3] and all((np.diff(b.terms["id"]) >= 0).all() for b in made)
    of = lambda b: zip(b.of("place")[b.terms["at"]], b.of("is_test")[b.terms["at"]], b.terms["id"], b.terms["worth"])
    assert sorted(x for b in made for x in of(b)) == sorted(zip(*(c.to_pylist() for c in rows.columns)))
    assert not list(blocks.cut(iter([rows.slice(0, 0)]), 4, ["place"], ["place", "is_test"], together))


def test_highest_sums_need_no_shared_counts_unless_a_term_is_worth_nothing():
    import pyarrow as pa

    of = lambda ids, **own: blocks.Block(pa.RecordBatch.from_arrays([pa.array(ids)], ["x"]), {n: np.array(v) for n, v in own.items()})
    q = of([0, 1], at=[0, 1, 0], id=[1, 1, 2], kind=[0, 0, 0], qtf=[2, 1, 1])
    c = of([0, 1], at=[0, 1, 1], id=[1, 1, 2], kind=[0, 0, 0], content=[0.5, 0.0, 1.0], metadata=[0.0, 0.25, 0.0], shared=[1, 1, 1])
    found, every = blocks.fields(q, c), blocks.sums(q, c, [])
    assert [x.tolist() for x in found] == [x.tolist() for x in every[:2]] == [[[1.0, 1.0], [0.5, 0.0]], [[0.0, 0.5], [0.0, 0.25]]]
    c.terms["content"][2] = 0.0
    assert blocks.fields(q, c) is None and blocks.sums(q, c, [])[4].all()


@pytest.mark.parametrize("once", [1, 3, 50])
def test_rare_terms_are_added_up_in_parts(monkeypatch, once):
    """All single products of a pair of blocks were held at once."""
    sizes, count = [], np.bincount
    monkeypatch.setattr(blocks.np, "bincount", lambda x, *a, **k: (sizes.append(len(x)) if a else None, count(x, *a, **k))[1])
    monkeypatch.setattr(blocks, "_AT_ONCE", once)
    draw = np.random.default_rng(2)
    q, c = draw.integers(0, 3, (7, 30)), draw.random((11, 30)) * (draw.random((11, 30)) < 0.3)
    listed = lambda m: (lambda at, ids: (at[o := np.argsort(ids, kind="stable")], ids[o], m[at, ids][o].astype(float)))(*np.nonzero(m))
    assert np.allclose(blocks._product(listed(q), listed(c), (7, 11)), q @ c.T)
    assert max(sizes) <= once + 11
