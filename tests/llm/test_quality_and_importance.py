import math
import random
import re
from collections import Counter

import xxhash
from tarnfield.llm import importance, quality_rules as quality

DOCS = "doc_id long, text string, lang string, verdict string, ratios string"
LABELS = "doc_id long, quality int, toxic int"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def base(text):
    text = text or ""
    w = words(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def texts():
    rng = random.Random(3)
    some = ["alpha", "béta", "x|y", "#", "the", "a", "of", "naïve", "\x1cq", "　", "end."]
    made = ["".join(rng.choice(some) + rng.choice([" ", "\n", "  ", "\t", "\r\n", "\x0b"]) for _ in range(rng.randint(0, 90))) for _ in range(60)]
    long = " ".join(f"w{i % 700}" for i in range(30_000))
    return [None, "", " \n ", "one", "one two", "a a a a a a a", "x " * 60, long, *made, made[5], made[5]]


def spark_hash(*parts):
    seed = 42
    for p in parts:
        seed = xxhash.xxh64_intdigest(p.encode(), seed)
    return seed - (1 << 64) if seed >= 1 << 63 else seed


def ratios(rows, good, buckets, grams):
    raw, target = Counter(), Counter()
    for i, t in rows:
        g = grams(t)
        raw.update(g)
        if i in good:
            target.update(g)
    nr, nt = sum(raw.values()), sum(target.values())
    return [round(math.log((target[b] + 1) / (nt + buckets) / ((raw[b] + 1) / (nr + buckets))) * 1e6) for b in range(buckets)]


def test_quality_equals_brute_force(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame([(i, t, "en", "v", "r") for i, t in rows], DOCS)
    good = set(range(8, 40))
    labels = spark.createDataFrame([(i, int(i in good), 0) for i in range(0, 60)] + [(None, 1, 0), (8, 1, 0)], LABELS)

    def grams(t):
        w = words(t)
        return [spark_hash(x) % quality.BUCKETS for x in w] + [spark_hash(a, b) % quality.BUCKETS for a, b in zip(w, w[1:])]

    table = ratios(rows, good, quality.BUCKETS, grams)
    judged = quality.judge(docs.withColumnRenamed("verdict", "other"), labels)
    assert {"lang", "other", "ratios"} <= set(judged.columns)
    got = {r["doc_id"]: r["verdict"] for r in judged.collect()}
    for i, t in rows:
        v = got[i]
        n, chars, symbols, lines, repeated = base(t)
        assert (v["n_words"], v["word_chars"], v["n_symbols"], v["n_dup_lines"], v["n_repeat_words"]) == (n, chars, symbols, lines, repeated), (i, t)
        failed = n < 50 or 100 * repeated > 50 * n
        score = sum(table[b] for b in grams(t)) / max(1, 2 * n - 1) / 1e6
        assert abs(v["score"] - score) < 1e-9
        assert v["base_failed"] == failed and v["kept"] == (not failed and score >= quality.THRESHOLD)


def test_quality_of_empty_tables(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert quality.judge(docs.drop("verdict"), labels).count() == 0
    one = spark.createDataFrame([(None, "w " * 80, "", "", "")], DOCS).drop("verdict")
    row = quality.judge(one, labels).first()["verdict"]
    assert row["score"] == 0 and row["n_words"] == 80 and row["base_failed"]


def test_kept_share_on_labelled_documents(spark, small):
    got = quality.op3_quality_rules(spark, small).join(spark.read.parquet(f"{small}/labels.parquet"), "doc_id")
    rows = got.filter("not base_failed").select("quality", "kept").collect()
    good = [r["kept"] for r in rows if r["quality"] == 1]
    assert good and all(good)


def test_importance_equals_brute_force(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame([(i, t) for i, t in rows] + [(None, "nothing of an id")], "doc_id long, text string")
    good = set(range(10, 30))
    labels = spark.createDataFrame([(i, int(i in good), 0) for i in range(50)], LABELS)

    def grams(t):
        w = words((t or "").lower())
        h = lambda *x: spark_hash("dsir", *x) % importance.BUCKETS
        return [h(x) for x in w] + [h(a, b) for a, b in zip(w, w[1:])]

    every = [*rows, (None, "nothing of an id")]
    table = ratios(every, good, importance.BUCKETS, grams)
    want = []
    for i, t in every:
        tie = spark_hash(str(importance.SEED), "" if i is None else str(i), t or "")
        u = (((tie & (1 << 64) - 1) >> 11) + 0.5) / (1 << 53)
        weight = sum(table[b] for b in grams(t)) / 1e6
        want.append((weight - math.log(-math.log(u)), i, weight))
    want.sort(key=lambda x: -x[0])
    k = round(0.3 * len(every))
    got = importance.resample(docs, labels, 0.3).collect()
    assert len(got) == len(every)
    assert {r["doc_id"] for r in got if r["kept"]} == {i for _, i, _ in want[:k]}
    weights = {i: w for _, i, w in want}
    assert all(abs(r["log_weight"] - weights[r["doc_id"]]) < 1e-6 for r in got)


def test_take_largest_settles_ties_and_bounds(spark):
    rows = [(i, float(i % 3), i) for i in range(300)]
    scored = spark.createDataFrame([(i, 0.0, key, tie) for i, key, tie in rows], "doc_id long, log_weight double, key double, tie long")
    for k in (0, 1, 99, 100, 101, 299, 300, 500):
        got = {r["doc_id"] for r in importance.take_largest(scored, k).filter("kept").collect()}
        want = {i for i, _, _ in sorted(rows, key=lambda r: (-r[1], -r[2]))[:k]}
        assert got == want, k
    alike = spark.createDataFrame([(1, 0.5, 1.5, -7)] * 10 + [(None, 0.5, 1.5, -7)] * 4 + [(2, 0.1, float(-i), 1 << 62) for i in range(5)], scored.schema)
    for k in (1, 5, 9, 12, 16):
        got = importance.take_largest(alike, k).collect()
        assert len(got) == 19 and sum(r["kept"] for r in got) == k
        want = sorted(alike.collect(), key=lambda r: (r["key"], r["tie"], -1 if r["doc_id"] is None else r["doc_id"]))[-k:]
        assert sorted(map(str, [r[:4] for r in got if r["kept"]])) == sorted(str(tuple(r)) for r in want)
    same = spark.createDataFrame([(7, "ten equal rows")] * 10, "doc_id long, text string")
    assert sum(r["kept"] for r in importance.resample(same, spark.createDataFrame([], LABELS), 0.5).collect()) == 5
    assert importance.resample(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], LABELS)).count() == 0
