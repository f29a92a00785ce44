import __spark_entry__
import corpus_pipeline
import duckdb
import pytest
from tarnfield.llm import decontamination, importance, pieces, pii, quality_rules, registry, secrets, sharding, simhash, toxicity


def test_stages_and_run(spark, small):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "SimHash near-dedup", "benchmark decontamination", "secret scans", "SentencePiece encoding and decoding"]
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, small)
        assert after.columns == docs.columns
        n = after.count()
        assert 0 < n <= docs.count()
        docs = spark.createDataFrame(after.collect(), docs.schema)
    want = {r["doc_id"] for r in docs.collect()}
    out = corpus_pipeline.run(spark, small).collect()
    assert {r["doc_id"] for r in out} == want and all(r["lossless"] for r in out)


CLASHING = (
    "verdict secrets fp key item_id slot shard ratios tokens kept leak own_key own_mark kept_id kept_mark whole_text assign access hex found "
    "decoded ids text_ words w t r mark component_id fingerprint held_out score tie log_weight `a.b` Verdict2 __key __fp"
).split()
LONG = ("The quick brown fox jumps over lazy dogs 12 times, token=abcdefgh" + "%d and deadbeefdeadbeefdeadbeefdeadbeef7 again. ") * 9_000  # over 1 MB


def odd_rows(spark, schema):
    """Nulls in every column, empty and long texts, ties and repeats, and clashing further columns."""
    texts = [(None, None), (1, ""), (1, ""), (None, "w " * 70), (2, LONG % tuple(range(9_000))), (3, "tie of words " * 30), (4, "tie of words " * 30), (5, None)]
    rows = [(i, t, *[None] * (len(schema) - 2), *["x"] * len(CLASHING)) for i, t in texts]
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema) + ", " + ", ".join(f"{c} string" for c in CLASHING)
    return spark.createDataFrame(rows, ddl)


@pytest.mark.parametrize("number", range(5))
def test_stages_take_empty_and_odd_rows(spark, small, number):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    odd = odd_rows(spark, docs.schema)
    name, stage = corpus_pipeline.STAGES[number]
    for rows in (odd.limit(0), odd):
        out = stage(spark, rows, small)
        n = out.count()
        assert n <= rows.count()
        if number < 4:
            assert out.dtypes == rows.dtypes
        if number >= 3:
            assert n == rows.count()
    kept = stage(spark, odd, small).collect()
    if number == 1:
        assert sorted(str(r["doc_id"]) for r in kept) == ["1", "2", "3", "None"]
    if number == 3:
        long = next(r["text"] for r in kept if r["doc_id"] == 2)
        assert len(long) > 400_000 and long.count("[SECRET]") == 18_000
    if number == 4:
        assert all(r["lossless"] for r in kept)


def test_operators_take_odd_rows(spark, small):
    labels, items = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("labels", "benchmark"))
    odd = odd_rows(spark, spark.read.parquet(f"{small}/documents.parquet").schema)
    calls = {
        "toxicity": lambda d: toxicity.score(d, toxicity.fit(d, labels)),
        "importance": lambda d: importance.resample(d, labels),
        "quality": lambda d: quality_rules.judge(d, labels),
        "sharding": lambda d: sharding.place(d, {"a": 1.0, "b": 1.0}),
        "secrets": secrets.scan,
        "pii": pii.scan,
        "simhash": simhash.near_duplicates,
        "pieces": pieces.encode,
    }
    for name, call in calls.items():
        for rows in (odd.limit(0), odd):
            assert call(rows).count() == rows.count(), name
    assert decontamination.find_leaks(odd, items).count() == 0


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_queries_equal_their_sql(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    got = registry.QUERIES[name](spark, small)
    names = sorted(got.columns)
    mine = sorted(str(tuple(r[c] for c in names)) for r in got.collect())
    found = con.execute(registry.ORACLE_SQL[name])
    at = [[d[0] for d in found.description].index(c) for c in names]
    assert mine == sorted(str(tuple(r[i] for i in at)) for r in found.fetchall())


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    assert all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 14)) and "pipeline" in names


def test_operators_take_ids_of_text(spark, small):
    """Ids that are no numbers come back as they are; near-duplicate classes, whose ids are numbers, take them as null."""
    labels = spark.read.parquet(f"{small}/labels.parquet")
    docs = spark.createDataFrame([("a", "some words to read"), ("b", None), ("12", "mail x@host.org")], "doc_id string, text string")
    for call in (lambda d: toxicity.score(d, toxicity.fit(d, labels.withColumn("doc_id", labels["doc_id"].cast("string")))), pii.scan, pieces.encode, pieces.round_trip):
        assert {r["doc_id"] for r in call(docs).collect()} == {"a", "b", "12"}
    assert sorted(str(r["doc_id"]) for r in simhash.near_duplicates(docs).collect()) == ["12", "None", "None"]
    assert simhash.keep_one_of_each(docs).columns == docs.columns
