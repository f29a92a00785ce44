"""Ranking, recall, evidence, evaluation, citations, memory and tasks against plain loops and small examples."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F
from tarnfield.operators import chunking, citations, context, evaluate, facts, index, memory, prompts, recall, search, tasks
from tarnfield.plans import workloads
from tarnfield.sources.memories import append_memories, read_memories
from tarnfield.streaming import memory_stream
from tarnfield.streaming.memory_stream import append_stream

FILES = "corpus_id string, file_path string, text string"
QUERIES = "query_id string, corpus_id string, query string"
SCORED = "query_id int, corpus_id string, family long, file_no long, part int, chunk_no int, score double"


def found(spark, files, queries, k=5, size=40, **how):
    corpus = workloads.build_corpus(spark.createDataFrame(files, FILES), size, 0)
    q = spark.createDataFrame([(str(i), "c", text) for i, text in enumerate(queries)], QUERIES)
    out = workloads.retrieve(corpus, q, k, **how)
    return {(r["query_id"], r["rank"]): r["file_path"] for r in out.seeds.collect()}, out


def test_bm25_equals_plain_formula(spark):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(30)] + ["the"] * 20
    bodies = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 40))) for _ in range(25)]
    corpus = workloads.build_corpus(spark.createDataFrame([("c", f"f{i}", b) for i, b in enumerate(bodies)], FILES))
    docs = {r["file_path"]: r["tokens"] for r in corpus.chunks.select("file_path", index.content_tokens().alias("tokens")).collect()}
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    df = {t: sum(t in d for d in docs.values()) for d in docs.values() for t in d}
    raw = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {t: v if v >= 0 else 0.25 * mean for t, v in raw.items()}
    query = "w1 the w2 w2 unknown"
    want = {}
    for name, d in docs.items():
        parts = [idf[t] * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for t in search_tokens(spark, query) if t in d]
        if parts:
            want[name] = sum(parts)
    terms = search.query_terms(spark.createDataFrame([("q", "c", query)], QUERIES))
    got = {r["file_path"]: r["score"] for r in search.placed(corpus.index, search.content_scores(corpus.index, terms)).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def search_tokens(spark, text):
    from tarnfield.functions.tokens import tokenize

    return spark.range(1).select(tokenize(F.lit(text))).first()[0]


def test_a_user_sets_the_tokenizer(spark):
    only_whole = lambda c: F.split(F.lower(c), "[^a-z_]+")
    files = spark.createDataFrame([("c", "a.py", "read_rows = 1"), ("c", "b.py", "read = 1")], FILES)
    q = spark.createDataFrame([("q", "c", "read")], QUERIES)
    for tokenizer, want in ((only_whole, ["b.py"]), (search.tokenize, ["a.py", "b.py"])):
        corpus = workloads.build_corpus(files, tokenizer=tokenizer)
        found = search.content_scores(corpus.index, search.query_terms(q, tokenizer))
        assert sorted(r["file_path"] for r in search.placed(corpus.index, found).collect()) == want


def rows_read(df):
    """Rows that the scan of a table without joins gave to its filter."""
    assert df.collect() is not None
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.finalPhysicalPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_a_small_batch_reads_few_postings(spark, monkeypatch):
    monkeypatch.setattr(index, "PAGE_ROWS", 128)
    rng = random.Random(4)
    files = [("c", f"d{i % 7}/f{i}.py", "\n".join(" ".join(f"w{rng.randint(0, 5000)}" for _ in range(12)) for _ in range(60))) for i in range(120)]
    own = workloads.build_corpus(spark.createDataFrame(files, FILES), 4, 1).index
    queries = spark.createDataFrame([(str(i), "c", f"w{i * 37} w{i * 91}") for i in range(10)], QUERIES)
    asked = search.Asked.of(own, search.query_terms(queries))
    hits = own.postings.filter(asked.bands)
    assert rows_read(hits) < own.postings.count() / 10
    # nothing that a query asks for is left out
    names = ["corpus_id", "kind", "term"]
    matched = lambda postings: postings.join(asked.words.select(*names).distinct(), names, "left_semi").count()
    assert matched(hits) == matched(own.postings) > 100
    many = search.Asked.of(own, search.query_terms(spark.createDataFrame([("q", "c", " ".join(f"w{i}" for i in range(600)))], QUERIES)))
    assert matched(own.postings.filter(many.bands)) == matched(own.postings) and own.postings.filter(many.bands).count() == own.postings.count()
    nothing = search.Asked.of(own, search.query_terms(queries.filter("false")))
    assert own.postings.filter(nothing.bands).count() == 0


@pytest.mark.parametrize("most", [1, 2, 5, 64])
def test_ranges_hold_all_bands(most):
    rng = random.Random(most)
    for n in (0, 1, 3, 40, 200):
        bands = sorted(rng.sample(range(1000), n))
        got = search._ranges(bands, most)
        assert len(got) == min(most, n) and all(sum(a <= b <= z for a, z in got) == 1 for b in bands)
        assert sum(z - a for a, z in got) <= (bands[-1] - bands[0] if bands else 0)


def test_term_counts_equal_plain_counts(spark):
    from collections import Counter

    rng = random.Random(2)
    rows = [([rng.choice("abcdeé") for _ in range(rng.randint(0, 30))], [rng.choice("abxy") for _ in range(rng.randint(0, 9))]) for _ in range(50)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, c array<string>, m array<string>")
    for r in df.select("i", index.term_counts(F.col("c"), F.col("m")).alias("t")).collect():
        c, m = map(Counter, rows[r["i"]])
        assert {x["term"]: (x["content_tf"], x["metadata_tf"]) for x in r["t"]} == {t: (c[t], m[t]) for t in {*c, *m}}


def test_file_metadata_adds_up_and_structure_decides(spark):
    files = [
        ("c", "src/loader.py", "def read_rows(path):\n    return open(path)\n"), ("c", "src/user.py", "import loader\n\n\ndef use():\n    return loader.read_rows('x')\n"),
        ("c", "tests/test_loader.py", "import loader\n\n\ndef test_rows():\n    assert loader\n"), ("c", "src/other.py", "x = 1\n"),
    ]
    seeds, _ = found(spark, files, ["who calls read_rows, caller", "signature of read_rows", "test loader", "zzz"])
    assert seeds["0", 1] == "src/user.py" and seeds["1", 1] == "src/loader.py" and seeds["2", 1] == "tests/test_loader.py"
    assert [seeds["3", r] for r in range(1, 5)] == ["src/loader.py", "src/other.py", "src/user.py", "tests/test_loader.py"]


def test_diverse_top_k_equals_the_loop(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for q in range(60):
        # files 4 and 5 are one family, and a part has two chunks
        own = [(q, "c", min(f, 4), f, n // 2, n, float(rng.randint(0, 4))) for f in range(rng.randint(1, 6)) for n in range(rng.randint(1, 6))]
        rows += own
        ranked = sorted(own, key=lambda r: (-r[6], r[3], r[5]))
        first, rest, seen = [], [], set()
        for r in ranked:
            (rest if r[2] in seen else first).append(r)
            seen.add(r[2])
        want[q] = [(r[3], r[5]) for r in (first + rest)[:5]]
    got = search.top_k(spark.createDataFrame(rows, SCORED), 5, most_parts=6).orderBy("query_id", "rank").collect()
    assert {q: [(r["file_no"], r["chunk_no"]) for r in got if r["query_id"] == q] for q in want} == want
    assert search.top_k(spark.createDataFrame(rows, SCORED), 0).count() == 0


def recall_loop(seeds, sizes, w, limit):
    """Seeds in rank order with their neighbours; a later seed that was already reached takes its own score and label."""
    out = {}
    for r, (path, no, score) in enumerate(seeds, 1):
        for o in range(-w, w + 1):
            if not 0 <= no + o < sizes[path]:
                continue
            key, row = (path, no + o), (score, "hybrid" if o == 0 else f"recall:seed-{r}{o:+d}")
            if key not in out or o == 0:
                out[key] = row
        if limit and len(out) >= limit:
            break
    return [(k, *v) for k, v in out.items()][: limit or None]


@pytest.mark.parametrize("w, limit", [(1, 20), (2, 6), (2, None), (1, 4)])
def test_recall_equals_the_loop(spark, w, limit):
    rng = random.Random(5)
    sizes = {"a": 6, "b": 3, "c": 1}
    chunks = spark.createDataFrame([("x", p, i, i, i) for p, n in sizes.items() for i in range(n)], "corpus_id string, file_path string, chunk_no int, start_line int, end_line int")
    rows, want = [], {}
    for q in range(40):
        picked = rng.sample([(p, i) for p, n in sizes.items() for i in range(n)], rng.randint(1, 6))
        seeds = [(p, i, 10.0 - r) for r, (p, i) in enumerate(picked)]
        rows += [(q, "x", p, i, i, i, s, "hybrid", r) for r, (p, i, s) in enumerate(seeds, 1)]
        want[q] = recall_loop(seeds, sizes, w, limit)
    seeds = spark.createDataFrame(rows, "query_id int, corpus_id string, file_path string, chunk_no int, start_line int, end_line int, score double, source string, rank int")
    got = recall.expand_with_neighbors(seeds, chunks, w, limit).orderBy("query_id", "position").collect()
    for q in want:
        assert [((r["file_path"], r["chunk_no"]), r["score"], r["source"]) for r in got if r["query_id"] == q] == want[q]
    assert recall.expand_with_neighbors(seeds, chunks, 0, 2).filter("query_id = 0").count() <= 2


def test_final_order(spark):
    rows = [(1, "c", "a", 0, 1, 1, 0.5, "recall:seed-1+1", 1), (1, "c", "b", 0, 1, 1, 0.5, "hybrid", 2), (1, "c", "d", 0, 1, 1, 0.9, "recall:seed-1-1", 3), (1, "c", "e", 0, 1, 1, -0.1, "hybrid", 4)]
    df = spark.createDataFrame(rows, "query_id int, corpus_id string, file_path string, chunk_no int, start_line int, end_line int, score double, source string, position int")
    order = lambda k: [r["file_path"] for r in recall.final_results(df, k).orderBy("rank").collect()]
    assert (order(None), order(2), order(0)) == (["d", "b", "a"], ["d", "b"], [])


def blocks_loop(results):
    out = []
    for path in dict.fromkeys(r[0] for r in results):
        own = sorted(((s, e, k, sc, so) for k, (p, s, e, sc, so) in enumerate(results) if p == path))
        mine = []
        for s, e, k, sc, so in own:
            if mine and s <= mine[-1]["end"] + 1:
                b = mine[-1]
                b["lines"] |= {i for i in range(s, e + 1) if i > b["end"]}
                b |= {"end": max(b["end"], e), "score": max(b["score"], sc), "n": b["n"] + 1, "first": min(b["first"], k), "sources": b["sources"] + [so] * (so not in b["sources"])}
            else:
                mine.append({"path": path, "start": s, "end": e, "lines": set(range(s, e + 1)), "score": sc, "n": 1, "first": k, "sources": [so]})
        out += mine
    return sorted(out, key=lambda b: b["first"])


def test_blocks_equal_the_fold(spark):
    rng = random.Random(9)
    rows, want = [], {}
    for q in range(60):
        results = []
        for _ in range(rng.randint(1, 6)):
            s = rng.randint(1, 20)
            results.append((rng.choice("ab"), s, s + rng.randint(0, 6), rng.random(), rng.choice(["hybrid", "recall:seed-1+1"])))
        want[q] = blocks_loop(results)
        rows += [(q, "c", p, s, e, "\n".join(f"{p}{i}" for i in range(s, e + 1)), sc, so, k) for k, (p, s, e, sc, so) in enumerate(results, 1)]
    df = spark.createDataFrame(rows, "query_id int, corpus_id string, file_path string, start_line int, end_line int, text string, score double, source string, rank int")
    got = context.compact(df).orderBy("query_id", "first_rank").collect()
    for q in want:
        mine = [r for r in got if r["query_id"] == q]
        assert [(r["file_path"], r["start_line"], r["end_line"], r["score"], r["chunk_count"], r["first_rank"], r["sources"]) for r in mine] == [
            (b["path"], b["start"], b["end"], b["score"], b["n"], b["first"], b["sources"]) for b in want[q]
        ]
        assert [r["text"] for r in mine] == ["\n".join(f"{b['path']}{i}" for i in sorted(b["lines"])) for b in want[q]]


def test_each_result_within_its_own_budget(spark):
    rows = [("q", 1, "a.py", 1, 2, "x" * 10, 0.5, "hybrid"), ("q", 2, "b.py", 1, 2, "y" * 50, 0.25, "hybrid")]
    df = spark.createDataFrame(rows, "query_id string, rank int, file_path string, start_line int, end_line int, text string, score double, source string")
    whole = [f"[{i}] {p}:1-2 (score={x:.4f}, source=hybrid)\n```python\n{t}\n```" for i, p, x, t in ((1, "a.py", 0.5, "x" * 10), (2, "b.py", 0.25, "y" * 50))]
    for most in (1000, 150, 100, 60, 20):
        shown, used = [], 0
        for block in whole:
            left = most - used
            if left > 0:
                shown.append(block if len(block) <= left else block[: max(0, left - 40)].rstrip() + context.CUT_MARK)
                used += len(shown[-1])
        assert context.render_results(df, most).first()["context"] == "\n\n".join(shown)


def budget_loop(blocks, most):
    shown, used = [], 0
    for i, (path, a, b, text, score, sources, n) in enumerate(blocks, 1):
        head = f"### [{i}] {path}:{a}-{b} (score={score:.4f}, {'source' if len(sources) == 1 else 'sources'}={','.join(sources)}{f', chunks={n}' if n > 1 else ''})"
        code = text.rstrip()
        block = f"{head}\n```python\n{code}\n```"
        left = most - used
        if left <= 0:
            break
        if len(block) > left:
            room = max(0, left - (len(head) + 14) - 20)
            block = f"{head}\n```python\n{code[:room]}{context.CUT_MARK}\n```" if room else block[: max(0, left - 40)].rstrip() + context.CUT_MARK
        shown.append(block)
        used += len(block)
    return "\n\n".join(shown)


def test_budget_equals_the_loop(spark):
    rng = random.Random(11)
    rows, want = [], {}
    for q in range(40):
        blocks = [(f"p{i}.py", 1, 9, "x" * rng.randint(0, 120) + "\n ", 0.5, ["hybrid", "r"][: rng.randint(1, 2)], rng.randint(1, 2)) for i in range(rng.randint(1, 5))]
        rows += [(q, "c", p, a, b, t, s, so, n, i) for i, (p, a, b, t, s, so, n) in enumerate(blocks)]
        want[q] = {m: budget_loop(blocks, m) for m in (60, 150, 300, 1000)}
    df = spark.createDataFrame(rows, "query_id int, corpus_id string, file_path string, start_line int, end_line int, text string, score double, sources array<string>, chunk_count int, first_rank int")
    for m in (60, 150, 300, 1000):
        assert {r["query_id"]: r["context"] for r in context.render(df, m).collect()} == {q: w[m] for q, w in want.items()}


def test_evaluation_of_one_case(spark):
    cases = spark.createDataFrame([("a", ["x.py", "y.py", "x.py"]), ("b", ["z.py"])], "query_id string, relevant array<string>")
    rows = lambda *v: spark.createDataFrame(list(v), "query_id string, rank int, file_path string")
    final = evaluate.gold_matches(rows(("a", 1, "q.py"), ("a", 2, "X.py"), ("a", 3, "x.py"), ("b", 1, "q.py")), cases)
    got = {r["query_id"]: (r["rr"], round(r["recall_at_k"], 4), r["hit_count"]) for r in evaluate.case_metrics(final, cases, 5).collect()}
    assert got == {"a": (0.5, 0.3333, 1), "b": (0.0, 0.0, 0)}
    seeds = evaluate.gold_matches(rows(("a", 9, "y.py"), ("b", 2, "z.py")), cases)
    recalled = evaluate.gold_matches(rows(("b", 7, "z.py")), cases).withColumn("position", F.col("rank"))
    flags = evaluate.stage_flags(seeds, recalled, final, cases, 5).withColumns({"r": evaluate.reasons(), "d": evaluate.diagnosis()})
    got = {x["query_id"]: (x["d"], x["r"]) for x in flags.collect()}
    assert got == {"a": ("hit_final_top_k", [evaluate.REASONS[0]]), "b": ("recall_review_pushed_below_top_k", [evaluate.REASONS[2], evaluate.REASONS[3]])}
    records = spark.createDataFrame([("1", "odd"), ("2", evaluate.DIAGNOSES[3]), ("3", None)], "query_id string, diagnosis string")
    assert [(r["diagnosis"], r["n"]) for r in evaluate.diagnosis_histogram(records).orderBy("position").collect()] == [*[(d, int(i == 3)) for i, d in enumerate(evaluate.DIAGNOSES)], ("odd", 1), ("unknown", 1)]
    best = evaluate.best_setting(spark.createDataFrame([(0, 0.5), (1, 0.7), (2, 0.7)], "setting_no int, mrr double"))
    assert best.first()["setting_no"] == 1


def test_citations(spark):
    answers = [
        ("a", "see src/x.py:3-5 and x.py:2-9, 中src/x.py:5-4"), ("b", "nothing here  "), ("c", "Cannot find it"), ("d", "C:\\r\\src\\X.py:1-2"), ("e", "x.py:0-1"),
    ]
    blocks = spark.createDataFrame([(q, "src/x.py", 1, 8) for q in "abcde"], "query_id string, file_path string, start_line int, end_line int")
    df = spark.createDataFrame(answers, "query_id string, answer string")
    got = {r["query_id"]: r for r in citations.validate(df, blocks).collect()}
    assert got["a"]["n_citations"] == 3 and got["a"]["invalid"] == ["x.py:2-9", "中src/x.py:5-4"]
    assert got["b"]["missing_citations"] and got["b"]["report"].startswith("nothing here\n\n" + citations.REPORT_TITLE)
    assert not got["c"]["has_issues"] and got["c"]["report"] == "Cannot find it"
    assert not got["d"]["has_issues"] and got["e"]["invalid"] == ["x.py:0-1"]


MEMORY = "seq long, task string, summary string, files array<string>, decisions array<string>"


def test_memory(spark):
    rows = [(1, "Fix loader", "s", ["b", "a"], []), (2, "fix  LOADER ", "s", ["a", "b"], []), (3, "other", "loader", ["c"], []), (4, "Fix\tloader", "s", ["a"], [])]
    m = spark.createDataFrame(rows, MEMORY)
    hits = memory.search(spark.createDataFrame([(7, "loader fix"), (8, "zzz")], "task_id int, task string"), memory.memory_tokens(m)).collect()
    assert [(r["seq"], r["score"]) for r in sorted(hits, key=lambda r: r["rank"])] == [(4, 1.0), (2, 1.0), (1, 1.0), (3, 0.5)]
    fresh = memory.new_memories(m, m.filter("seq = 3"))
    assert sorted(r["seq"] for r in fresh.collect()) == [1, 4]
    built = memory.build(spark.createDataFrame([("t", "s", "x", ["a", "a"], ["d"])], "task string, status string, summary string, files array<string>, decisions array<string>"), "2024-01-01T00:00:00+00:00").first()
    assert built["id"] == "agent-2024-01-01T00:00:00+00:00" and built["files"] == ["a"]


def test_memory_stream_skips_what_is_stored(spark, tmp_path):
    source, store = tmp_path / "in", str(tmp_path / "store")
    source.mkdir()
    record = lambda task, files: json.dumps({"id": "i", "created_at": "t", "task": task, "status": "s", "summary": "", "files": files, "decisions": []})
    (source / "1.json").write_text("\n".join([record("A b", ["x", "y"]), record("a  B", ["y", "x"])]))
    append_stream(spark, str(source), store, str(tmp_path / "cp")).awaitTermination()
    (source / "2.json").write_text("\n".join([record("a b", ["x", "y"]), record("new", [])]))
    append_stream(spark, str(source), store, str(tmp_path / "cp")).awaitTermination()
    assert sorted(r["task"] for r in read_memories(spark, store).collect()) == ["A b", "new"]


def test_a_batch_that_runs_again_appends_once(spark, tmp_path):
    store, known = str(tmp_path / "store"), str(tmp_path / "known")
    schema = "id string, created_at string, task string, status string, summary string, files array<string>, decisions array<string>, source_file string, source_block long"
    rows = lambda *named: spark.createDataFrame([(i, "t", task, "s", "", ["f"], [], file, 0) for i, task, file in named], schema)
    append_memories(rows(("0", "old", "x")), store)
    memory_stream._identities(spark, known, store)
    for _ in range(2):
        memory_stream.append_batch(rows(("1", "a", "f2"), ("2", "A ", "f1"), ("3", "OLD", "f1"), ("4", "b", "f1")), 0, store, known)
    for _ in range(2):
        memory_stream.append_batch(rows(("5", "a", "f3"), ("6", "c", "f3")), 1, store, known)
    assert sorted(r["id"] for r in read_memories(spark, store).collect()) == ["0", "2", "4", "6"]


def test_a_token_of_every_memory_makes_no_large_task(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i, "all " + " ".join(rng.choice("abcdefgh") for _ in range(3))) for i in range(3_000)]
    m = spark.createDataFrame(rows, "seq long, task string")
    tokens = m.select("seq", F.explode(F.array_distinct(F.split("task", " "))).alias("token"))
    asked = spark.createDataFrame([(1, "all a b"), (2, "all"), (3, "zz")], "task_id int, task string")
    split = lambda c: F.split(c, " ")
    ranked = lambda: sorted(tuple(r) for r in memory.search(asked, tokens, 7, split).select("task_id", "seq", "score", "rank").collect())
    want = ranked()
    monkeypatch.setattr(memory, "HOT", 500)
    monkeypatch.setattr(memory, "BROADCAST_BYTES", 0)
    assert ranked() == want and [r[1] for r in want if r[0] == 2] == list(range(2_993, 3_000))
    words = spark.createDataFrame([(1, 1, "all")], "task_id int, n int, token string")
    dealt = memory._salted(words, tokens).repartition(16, "token", F.pmod(F.xxhash64("seq"), F.lit(memory.SALTS)))
    assert max(r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()) < 1_000


def test_symbols_of_a_long_file_meet_their_chunks(spark):
    """A class over 50 000 lines with a function each hundred: no chunk has more symbols than touch its lines."""
    body = "class Big:\n" + "".join(f"    def f{i}(self):\n" + "        pass\n" * 99 for i in range(500))
    files = spark.createDataFrame([("c", "big.py", body), ("c", "other.py", "x = 1\n"), ("c", "none.py", "def broken(")], FILES)
    chunks = chunking.split_files(files, 40, 5)
    got = {(r["file_path"], r["chunk_no"]): r for r in facts.chunk_symbols(chunks, facts.file_facts(files)).collect()}
    symbols = facts.parse(body)["symbols"]
    assert len(got) == chunks.count() and got["other.py", 0]["symbols"] == [] and got["none.py", 0]["symbols"] == []
    for r in chunks.filter("file_path = 'big.py'").collect():
        want = [s["name"] for s in symbols if s["start_line"] <= r["end_line"] and r["start_line"] <= s["end_line"]]
        assert [s["name"] for s in got["big.py", r["chunk_no"]]["symbols"]] == want and 2 <= len(want) <= 3


def test_citations_without_an_answer_and_with_huge_numbers(spark):
    blocks = spark.createDataFrame([("1", "a.py", 1, 9), ("2", "a.py", 1, 9), ("3", "a.py", 1, 9)], "query_id string, file_path string, start_line int, end_line int")
    answers = spark.createDataFrame([("1", None), ("2", "see a.py:1-" + "9" * 40), ("3", "a.py:2-3"), ("4", None)], "query_id string, answer string")
    got = {r["query_id"]: (r["n_citations"], list(r["invalid"]), r["missing_citations"], r["has_issues"]) for r in citations.validate(answers, blocks).collect()}
    assert got == {"1": (0, [], True, True), "2": (1, ["a.py:1-" + "9" * 40], False, True), "3": (1, [], False, False), "4": (0, [], False, False)}


def test_task_profiles_and_checks(spark):
    texts = ["修复 BUG", "add pytest for recall", "plain", "更新 README 说明"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, task string")
    got = [r["p"] for r in df.orderBy("i").select(tasks.profile(F.col("task")).alias("p")).collect()]
    assert [(p["kind"], round(float(p["confidence"]), 2), p["reasons"]) for p in got] == [("bugfix", 0.75, ["修复", "bug"]), ("test", 0.6, ["pytest"]), ("general", 0.2, []), ("docs", 0.75, ["readme", "说明"])]
    checks = spark.range(1).select(tasks.recommended_checks(F.lit("test"), F.array(F.lit("src/a.py"), F.lit("x/tests/test_a.py")))).first()[0]
    assert checks == ["python -m unittest tests.test_a", "python -m unittest"]
    files = tasks.candidate_files(spark.createDataFrame([("q", 1, "tests/a.py"), ("q", 2, "b.py"), ("q", 3, "b.py"), ("q", 4, "a.py")], "query_id string, rank int, file_path string"))
    assert files.first()["files"] == ["b.py", "a.py", "tests/a.py"]


def test_prompts(spark):
    rows = spark.createDataFrame([("1", "API", "q", "ctx"), ("2", "odd", "q", None)], "query_id string, mode string, query string, context string")
    got = {r["query_id"]: r["messages"] for r in prompts.answer_prompts(rows).collect()}
    assert got["1"][0]["content"] == prompts.TEMPLATES["api"][0] and got["2"][0]["content"] == prompts.TEMPLATES["judge"][0]
    assert [m["role"] for m in got["1"]] == ["system", "user"] and "ctx" in got["1"][1]["content"]
