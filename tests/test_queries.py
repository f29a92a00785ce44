import __spark_entry__
import duckdb
import pytest
from tarnfield.plans import queries

TABLES = ("documents", "benchmark", "conversations", "supplier", "customer", "part")


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_its_sql(spark, small, name):
    got = queries.QUERIES[name](spark, small)
    names = sorted(got.columns)
    mine = sorted(tuple(plain(r[c]) for c in names) for r in got.collect())
    assert mine
    if name in queries.SQL:
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
        found = con.execute(queries.SQL[name])
        at = [[d[0] for d in found.description].index(c) for c in names]
        assert mine == sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["query_id", "file_path", "chunk_no", "score", "rank"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_queries_after_clearing_make_their_tables_anew(spark, small):
    from tarnfield.sources.scratch import clear

    first = queries.QUERIES["term_statistics"](spark, small).count()
    clear(spark)
    assert queries.QUERIES["term_statistics"](spark, small).count() == first


def test_entry_without_a_library_of_the_subpackage(tmp_path):
    import subprocess
    import sys
    from pathlib import Path

    (tmp_path / "zstandard.py").write_text("raise ImportError('left out')")
    code = "import __spark_entry__ as e; q = e.queries(); assert 'bm25_search' in q and 'op1_toxicity' not in q; e.oracle_sql()"
    root = str(Path(__spark_entry__.__file__).parent)
    subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=root, env={"PYTHONPATH": f"{tmp_path}:{root}", "PATH": "/usr/bin:/bin"}, check=True)


def test_entry_without_the_subpackage(tmp_path):
    """A copy of the repository without the subpackage and the pipeline still registers the other queries."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__spark_entry__.__file__).parent
    shutil.copytree(root / "tarnfield", tmp_path / "tarnfield", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'bm25_search' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
