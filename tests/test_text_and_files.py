"""Tokens, paths, chunks, code facts, loading, patching."""

import pytest
from pyspark.sql import functions as F
from tarnfield.functions import paths, text, tokens
from tarnfield.operators import chunking, facts, patch
from tarnfield.sources import cases, files, lines, memories


def column(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_tokens(spark):
    got = column(spark, ["build_binary_tree", "twoSum", "HTTPServer", "_p__", "12ab", "___", None, "a.b a"], tokens.tokenize)
    assert got == [
        ["build_binary_tree", "build", "binary", "tree"],
        ["twosum", "two", "sum"],
        ["httpserver", "http", "server"],
        ["p"],
        ["12", "ab"],
        [],
        [],
        ["a", "b", "a"],
    ]
    assert column(spark, ["twoSum"], lambda c: tokens.tokenize(c, keep_full=False)) == [["two", "sum"]]


def test_chinese_tokens(spark):
    run = "被调用函数"
    grams = [run[i : i + n] for n in range(1, 5) for i in range(len(run) - n + 1)]
    got = column(spark, ["类", run], tokens.tokenize)
    assert got[0] == ["类", "class"]
    assert got[1][: len(grams)] == grams and set(got[1][len(grams) :]) == {"call", "client", "caller", "callee", "function", "def"}
    assert column(spark, ["", "类型", "类a"], tokens.is_chinese) == [True, True, False]


def test_lines_and_preview(spark):
    samples = ["", "a", "a\n", "a\r\nb\x0cc\u2028d", "\n\n", "  x \n\n y", "z" * 130]
    assert column(spark, samples, text.lines_of) == [s.splitlines() for s in samples]
    want = [" ".join(x.strip() for x in s.splitlines() if x.strip()) for s in samples]
    assert column(spark, samples, text.preview) == [w if len(w) <= 120 else w[:117].rstrip() + "..." for w in want]


def test_folding_equals_the_standard(spark):
    """Every code point alone, and in a word with others."""
    import unicodedata

    every = [chr(i) for i in range(0x30000) if not 0xD800 <= i < 0xE000 and unicodedata.category(chr(i)) != "Cn"]
    texts = every + ["a" + "".join(every[i : i + 50]) + "😀" for i in range(0, 12_000, 50)] + ["STRASSE ẞ ß ΣΑΣ ŉ ﬃ Ⴀ Ꭰ ꭰ"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", text.fold(F.col("t")).alias("f")).collect()
    wrong = [(texts[r["i"]], r["f"]) for r in got if r["f"] != texts[r["i"]].casefold()]
    assert not wrong, wrong[:5]


def test_paths(spark):
    p = ["tests/a.py", "src\\Tests\\b.py", "src/test_x.py", "x_test.py", "src/latest/a.py"]
    assert column(spark, p, paths.is_test_path) == [True, True, True, True, False]
    assert column(spark, p[:2], paths.module_name) == ["tests.a", "src.tests.b"]
    assert column(spark, ["a/tests/u/test_x.py", "q/w.py"], paths.test_module) == ["tests.u.test_x", "q.w"]
    assert column(spark, ["/r/a/b.py", "a\\b.py"], lambda c: paths.readable_path(c, ["/r/a", "/r"])) == ["b.py", "a/b.py"]
    forms = column(spark, ["/r/a/B.py", "a/B.py"], lambda c: F.array_sort(paths.comparable_forms(c, ["/r"])))
    assert set(forms[0]) & set(forms[1])


@pytest.mark.parametrize("size, overlap", [(4, 1), (3, 0), (5, 4), (40, 5)])
def test_chunks_equal_the_loop(spark, size, overlap):
    rows = [("c", f"f{n}", "\n".join(f"l{i}" for i in range(n))) for n in range(0, 60)]
    got = {(r["file_path"], r["chunk_no"]): (r["start_line"], r["end_line"], r["text"]) for r in chunking.split_files(spark.createDataFrame(rows, "corpus_id string, file_path string, text string"), size, overlap).collect()}
    want = {}
    for _, path, body in rows:
        lines, at, no = body.splitlines(), 0, 0
        while lines:
            part = lines[at : at + size]
            want[path, no] = (at + 1, at + len(part), "\n".join(part))
            if at + size >= len(lines):
                break
            at, no = at + size - overlap, no + 1
    assert got == want
    with pytest.raises(ValueError):
        chunking.split_files(None, 4, 4)


SOURCE = '''import os.path as p
from . import q
from a.b import c


class A(Base, x.Y):
    def f(self, a, /, b, *args, key=1, **kw):
        async def inner():
            await client.get(a).json()
        return helper(b)
'''


def test_code_facts(spark):
    df = spark.createDataFrame([("c", "Pkg\\m.py", SOURCE), ("c", "bad.py", "def f(:"), ("c", "nul.py", "a\x00"), ("c", "none.py", None)], "corpus_id string, file_path string, text string")
    got = {r["file_path"]: r for r in facts.file_facts(df).collect()}
    one = got["Pkg\\m.py"]
    assert (one["module"], one["directories"]) == ("pkg.m", ["pkg"])
    assert [(s["name"], s["kind"], s["start_line"], s["end_line"], s["signature"], s["parent"]) for s in one["symbols"]] == [
        ("A", "class", 6, 10, "A(Base, x.Y)", None),
        ("f", "function", 7, 10, "f(self, a, b, key, args, kw)", "A"),
        ("inner", "async_function", 8, 9, "inner()", "f"),
    ]
    assert one["imports"] == ["os.path", "os", "path", "q", "a.b", "a", "b", "c", "a.b.c"]
    assert one["calls"] == ["helper", "json", "client.get", "get"]
    assert all(got[n]["symbols"] == got[n]["calls"] == [] for n in ("bad.py", "nul.py", "none.py"))
    meta = facts.chunk_metadata(chunking.split_files(df.filter(F.col("file_path") == "Pkg\\m.py"), 5, 0), facts.file_facts(df))
    words = {r["chunk_no"]: r["metadata"] for r in meta.collect()}
    own = df.filter(F.col("file_path") == "Pkg\\m.py")
    twice = own.unionByName(own.withColumn("file_path", F.lit("PKG\\m.py")))
    assert facts.chunk_metadata(chunking.split_files(twice, 5, 0), facts.file_facts(twice)).count() == 4
    deep = facts.parse("x = " + " + ".join(["f()"] * 1500))
    assert deep["calls"] == ["f"]
    assert "symbols A f inner imports os.path" in words[0] and "function f A.f signature f(self, a, b, key, args, kw)" in words[1]


def test_structural_terms(spark):
    assert column(spark, ["a.B(c,d)", "__", "x\\y"], facts.structural_terms) == [["a_b_c_d", "a", "b", "c", "d"], [], ["x/y"]]


def test_load_files(spark, tmp_path):
    for name in ("a/b.py", "a-b.py", "legacy/x.py", "a/legacy/y.py", "a/.venv/z.py", "a/n.txt"):
        f = tmp_path / "root" / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes("é = 1".encode() + b"\xff\n")
    got = files.in_file_order(files.load_files(spark, str(tmp_path / "root"), "c")).collect()
    assert [(r["file_path"], r["text"]) for r in got] == [(n, "é = 1\n") for n in ("a/b.py", "a/legacy/y.py", "a-b.py")]
    assert files.load_files(spark, str(tmp_path / "root/legacy"), "c").count() == 1


def test_cases(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"question": "q1", "gold_files": ["a"], "level": 1}\n\n{"id": "x", "query": "q2", "question": "z", "relevant": ["b", "b"]}\n')
    (tmp_path / "c.json").write_text('[{"id": "y", "query": "", "question": "q3", "relevant": [], "gold_files": ["c"]}]')
    got = [tuple(r) for r in cases.normalize_cases(cases.load_cases(spark, str(tmp_path / "c.jsonl"))).collect()]
    assert got == [("case-1", "q1", ["a"]), ("x", "q2", ["b", "b"])]
    assert [tuple(r) for r in cases.normalize_cases(cases.load_cases(spark, str(tmp_path / "c.json"))).collect()] == [("y", "q3", ["c"])]
    (tmp_path / "bad.jsonl").write_text('{"id": "n", "query": "q"}\n')
    raw = cases.load_cases(spark, str(tmp_path / "bad.jsonl"))
    assert cases.bad_cases(raw).count() == 1 and cases.normalize_cases(raw, strict=False).count() == 0
    several = spark.createDataFrame([(i, f"q{i}", ["g"]) for i in range(40)], "at int, question string, gold_files array<string>").repartitionByRange(5, "at").sortWithinPartitions("at")
    several.write.json(str(tmp_path / "many"))
    numbered = cases.normalize_cases(cases.load_cases(spark, str(tmp_path / "many/*.json"), lines=True))
    assert {r["query_id"]: r["query"] for r in numbered.collect()} == {f"case-{i + 1}": f"q{i}" for i in range(40)}
    with pytest.raises(Exception, match="without query or gold"):
        cases.normalize_cases(raw).collect()
    assert cases.sibling_paths("out/t.jsonl") == ("out/t_stage_files.jsonl", "out/t_stage_summary.json")
    cases.write_json(spark.createDataFrame([("é",)], "a string"), str(tmp_path / "o"))
    assert spark.read.json(str(tmp_path / "o")).first()[0] == "é"


def test_import_patch(spark):
    body = '#!/bin/py\n# -*- coding: utf-8 -*-\n\n"""Doc\nmore"""\n# c\nfrom __future__ import annotations\nx: List[int] = []\n'
    lines_above = lambda t: patch.with_import(t).splitlines().index(patch.IMPORT_LINE.strip())
    tops = {
        body: 7, "x = 1\n": 0, '"""one"""\ny = 2\n': 1, "'''never closed\n": 1, "# a\n\n  # b\r\nx\n": 3, "from __future__ import a\nfrom __future__ import b\nx\n": 2,
        "x = 'coding'\ny\n": 1, "#!/bin/py\nx\n": 1, '"""a\nb""" + """c"""\n# d\nz\n': 3, "": 0, "# only\n# comments\n": 2,
    }
    for source, n in tops.items():
        assert lines_above(source) == n, source
        assert patch.with_import(source).replace(patch.IMPORT_LINE, "", 1) == source
    assert len(patch.with_import("# c\n" * 200_000 + "x")) > 800_000
    rows = [("c", "d/a.py", body), ("c", "d/b.py", "y = 1\n"), ("c", "e/c.py", "from leetcode_types import *\nNode()\n"), ("c", "venv/q.py", "deque()"), ("c", "leetcode_types.py", "Node")]
    df = spark.createDataFrame(rows, "corpus_id string, file_path string, text string")
    got = patch.patch_files(df).collect()
    assert [r["file_path"] for r in got] == ["d/a.py"] and got[0]["text"].splitlines()[7] == "from leetcode_types import *"
    assert {r["directory"] for r in patch.shim_directories(df).collect()} == {"d", "e"}


def test_numbers_of_lines_in_parts_of_files(spark, tmp_path):
    sizes = {"b.txt": 700, "a.txt": 1, "c.txt": 0, "d.txt": 300}
    for name, n in sizes.items():
        (tmp_path / name).write_text("".join(f"{name}:{i + 1}\n" if i % 5 else "\n" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1024)
    try:
        stored = lines.stored_with_spots(spark.read.text(str(tmp_path)))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert stored.select(*lines.SPOT).distinct().count() > 6
    in_files = lines.numbered(stored, "no", each_file=True).collect()
    assert len(in_files) == 1001 and all(r["value"].split(":")[1] == str(r["no"]) for r in in_files if r["value"])
    through = {r["value"]: r["no"] for r in lines.numbered(stored, "no").collect() if r["value"]}
    assert through == {f"{f}:{i + 1}": i + 1 + before for f, before in (("b.txt", 1), ("d.txt", 701)) for i in range(sizes[f]) if i % 5}
    # a store whose blank lines count, broken in a later part of a file
    (tmp_path / "store").mkdir()
    (tmp_path / "store" / "m.json").write_text('{"id": "x"}\n\n' * 50 + "[broken\n")
    assert [tuple(r) for r in memories.broken_records(spark, str(tmp_path / "store")).collect()] == [("m.json", 101, "[broken")]


def test_memory_store(spark, tmp_path):
    store = str(tmp_path / "store")
    assert memories.read_memories(spark, store).count() == 0
    one = spark.createDataFrame([("i", "t", "task", "s", "sum", ["f"], ["d"])], memories.SCHEMA)
    memories.append_memories(one, store)
    memories.append_memories(one, store)
    assert memories.read_memories(spark, store).count() == 2
    (tmp_path / "store" / "bad.json").write_text('{"id": "x"}\n{"id": 1, "files": "no\n')
    assert [tuple(r) for r in memories.broken_records(spark, store).select("file", "line_no").collect()] == [("bad.json", 2)]
    with pytest.raises(Exception, match="bad.json, line 2"):
        memories.read_memories(spark, store).collect()
