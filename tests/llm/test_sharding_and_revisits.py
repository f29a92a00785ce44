import pytest
from tarnfield.llm import revisits, sharding
from pyspark.sql import functions as F


def plain_table(names, size):
    """Turn by turn, from whole permutations."""
    import xxhash

    order = {}
    for n in sorted(names):
        at, step = xxhash.xxh64_intdigest(n, 1) % size, xxhash.xxh64_intdigest(n, 2) % (size - 1) + 1
        order[n] = iter([(at + j * step) % size for j in range(size)])
    table = [None] * size
    while None in table:
        for n in sorted(names):
            if None not in table:
                break
            slot = next(s for s in order[n] if table[s] is None)
            table[slot] = n
    return table


def test_table_equals_plain_filling_and_moves_little():
    names = {f"s{i}": 1.0 for i in range(7)}
    table = sharding.lookup_table(names, 1009)
    assert table == plain_table(names, 1009)
    counts = sharding.shares(table)
    assert max(counts.values()) - min(counts.values()) <= 1
    less = sharding.lookup_table({n: 1.0 for n in names if n != "s3"}, 1009)
    moved = sum(a != b for a, b in zip(table, less) if a != "s3")
    assert moved < 0.25 * 1009
    half = sharding.shares(sharding.lookup_table({"a": 1.0, "b": 0.5}, 1009))
    assert abs(half["a"] - 2 * half["b"]) <= 3
    for bad in ({}, {"a": 0.0}):
        with pytest.raises(ValueError):
            sharding.lookup_table(bad, 1009)
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 1000)


def test_placement(spark, tmp_path):
    rows = [(i, f"t{i}", "x") for i in range(500)] + [(None, f"n{i}", "x") for i in range(50)] + [(None, None, "x"), (7, "t7", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    shards = {f"s{i}": 1.0 for i in range(4)}
    placed = sharding.place(df, shards)
    got = placed.collect()
    table = sharding.lookup_table(shards)
    assert len(got) == len(rows) and all(table[r["slot"]] == r["shard"] for r in got)
    assert len({r["shard"] for r in got if r["doc_id"] == 7}) == 1
    assert len({r["shard"] for r in got if r["doc_id"] is None}) == 4
    sharding.write_shards(placed, str(tmp_path / "out"), 2)
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(rows)
    assert sharding.place(df.limit(0), shards).count() == 0


RECORDS = "record_id long, url string, date long, kind string, etag string, last_modified string, digest string, headers map<string,string>"


def brute(records):
    out = {}
    for r in records:
        if r[3] != "revisit":
            continue
        earlier = [x for x in records if x[3] == "response" and r[1] and x[1] == r[1] and x[2] is not None and r[2] is not None and x[2] < r[2]]
        best = max(earlier, key=lambda x: (x[2], x[0]), default=None)
        if best is None:
            out[r[0]] = (None, "no_earlier_response")
            continue
        pairs = [(a, b) for a, b in zip(r[4:7], best[4:7]) if a is not None and b is not None]
        same = bool(pairs) and pairs[0][0].removeprefix("W/") == pairs[0][1].removeprefix("W/")
        out[r[0]] = (best[0], "resolved" if same else "validator_mismatch")
    return out


def test_as_of_join_equals_brute_force(spark):
    import random

    rng = random.Random(6)
    urls = ["http://a.org/x", "http://a.org/y", None, "http://hot.org/z"]
    some = lambda *v: rng.choice(v)
    rows = [
        (i, some(*urls, "http://hot.org/z", "http://hot.org/z"), some(None, *range(60)), some("response", "revisit", "revisit", "metadata"), some(None, '"a"', 'W/"a"', '"b"'), some(None, "m1", "m2"), some(None, "d"), {"Date": str(i)})
        for i in range(400)
    ]
    df = spark.createDataFrame(rows, RECORDS).withColumn("date", F.timestamp_seconds("date"))
    got = {r["record_id"]: (r["response_id"], r["status"]) for r in revisits.resolve(df.withColumn("slice", F.lit("own"))).collect()}
    assert got == brute(rows)
    assert revisits.resolve(df.limit(0)).count() == 0


def test_headers_and_payload(spark):
    rows = [
        (1, "HTTP://A.org:80/x/?b=2&utm_source=q&a=1#top", 10, "response", '"a"', None, "d1", {"Content-Length": "9", "ETag": "a", "Server": "s"}),
        (2, "http://u:p@a.org/x?a=1&b=2", 20, "revisit", 'W/"a"', None, None, {"content-length": "0", "etag": "b", "Cache-Control": "x"}),
        (3, "http://a.org/x?a=1&b=2", 10, "revisit", '"a"', None, None, None),
        (4, "not a url", 30, "revisit", None, None, None, {}),
        (5, "http://a.org:443/y", 10, "response", '"p"', None, "d5", {"Date": "1", "date": "2", "Server": "t"}),
        (6, "https://a.org:443/y", 20, "revisit", '"p"', None, None, {"Age": "1"}),
        (7, "http://A.org:443/y/", 20, "revisit", '"p"', None, None, {"AGE": "1", "age": "2", "Age": "3"}),
        (8, "https://b.org:80/", 20, "revisit", '"p"', None, None, {}),
    ]
    df = spark.createDataFrame(rows, RECORDS).withColumn("date", F.timestamp_seconds("date"))
    got = {r["record_id"]: r for r in revisits.with_payload(revisits.resolve(df), df.withColumn("html", F.lit("body")), "record_id", "html").collect()}
    assert got[2]["headers"] == {"content-length": "9", "etag": "b", "server": "s", "cache-control": "x"} and got[2]["payload"] == "body"
    assert got[2]["canonical_url"] == "http://a.org/x?a=1&b=2" and got[2]["digest"] == "d1"
    assert got[7]["headers"] == {"date": "2", "server": "t", "age": "2"} and got[7]["canonical_url"] == "http://a.org:443/y"
    assert got[6]["status"] == "no_earlier_response" and (got[6]["canonical_url"], got[8]["canonical_url"]) == ("https://a.org/y", "https://b.org:80/")
    assert got[3]["status"] == got[4]["status"] == "no_earlier_response" and got[4]["payload"] is None


def test_slices_hold_equal_numbers_whatever_the_times(spark):
    """One hot URL, all records in one month but one, many of them in one instant."""
    rows = [(i, "http://hot.org/", 1_000_000 + (i % 3 and i), "revisit" if i % 2 else "response", '"a"', None, "d", {}) for i in range(2000)]
    rows += [(2000, "http://hot.org/", 253_000_000_000, "revisit", '"a"', None, None, {})]
    df = spark.createDataFrame(rows, RECORDS).withColumn("date", F.timestamp_seconds("date"))
    got = {r["record_id"]: (r["response_id"], r["status"]) for r in revisits.resolve(df).collect()}
    assert got == brute(rows)
    ranges = df.repartitionByRange(revisits.LEAST_SLICES, "url", "date", "record_id").groupBy(F.spark_partition_id()).count()
    assert max(r["count"] for r in ranges.collect()) < 3 * len(rows) / revisits.LEAST_SLICES
