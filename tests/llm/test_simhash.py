import random

import numpy as np
import pytest
import xxhash
from tarnfield.llm import simhash
from tarnfield.llm.components import connected_components


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    ids = list(range(len(prints)))
    group = {i: i for i in ids}

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in ids:
        for j in ids[:i]:
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 3:
                group[top(i)] = top(j)
    least = {}
    for i in ids:
        if prints[i][0] is not None:
            least[top(i)] = min(least.get(top(i), prints[i][0]), prints[i][0])
    return [least.get(top(i)) for i in ids]


def made_texts():
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [None, "", " \t\n", "Ein Wort", "ein wort", "EIN  WORT", "x", " a b", "É é", "é É"]
    for _ in range(25):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(5, 200))]
        texts.append(" ".join(words))
        for _ in range(rng.randint(0, 6)):
            copy = list(words)
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    return texts + texts[12:20]


@pytest.mark.parametrize("limit, least", [(128, 64), (2, 64), (128, 1)])
def test_components_equal_brute_force(spark, monkeypatch, limit, least):
    monkeypatch.setattr(simhash, "LEAST_SAMPLED", least)
    monkeypatch.setattr(simhash, "SAMPLED", 64 if least > 1 else 2)
    rows = [(100 - i if i % 9 else None, t) for i, t in enumerate(made_texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    prints = [(i, brute_fingerprint(t)) for i, t in rows]
    want = sorted(((i, f"{fp:016x}", c) for (i, fp), c in zip(prints, brute_components(prints))), key=str)
    got = [tuple(r) for r in simhash.near_duplicates(docs, bucket_limit=limit).collect()]
    assert sorted(got, key=str) == want


def test_golay_probe_finds_every_word_within_one_bit():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 23, 20_000)
    for y in (x, x ^ (1 << rng.integers(0, 23, len(x)))):
        assert (simhash.primary_index(x)[:, None] == simhash.probe_indices(y)).any(axis=1).all()


def test_keys_meet_for_every_pattern_of_three_bits():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    flips = np.zeros(len(x), np.uint64)
    for _ in range(3):
        flips ^= np.uint64(1) << rng.integers(0, 64, len(x)).astype(np.uint64)
    y = x ^ flips
    wx, kx, px = simhash.keys_of(x)
    wy, ky, py = simhash.keys_of(y)
    primary = {(w, k) for w, k in zip(wx[~px].tolist(), kx[~px].tolist())}
    met = {w for w, k in zip(wy[py].tolist(), ky[py].tolist()) if (w, k) in primary}
    assert met == set(range(len(x)))


def test_keep_one_of_each(spark):
    rows = [(5, "a b c d e f", 1, "k"), (3, "a b c d e f", 2, "k"), (3, "a b c d e f", 2, "k"), (9, "other words stand here", 3, "k"), (None, "", 4, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int, component_id string")
    kept = simhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r["doc_id"]) for r in kept.collect())) == ["3", "9", "None"]
    near = " ".join(f"w{i}" for i in range(400))
    nameless = [(None, near, 1), (None, near + " more", 2), (None, near, 1), (None, "apart from them", 3), (7, near.upper(), 4), (7, "another text of seven", 5)]
    for rows, n in ((nameless[:4], 2), (nameless, 3)):
        some = spark.createDataFrame(rows, "doc_id long, text string, `own.mark` int")
        got = simhash.keep_one_of_each(some)
        assert got.columns == some.columns and got.count() == n
    assert simhash.keep_one_of_each(docs.limit(0)).count() == 0
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_connected_components_of_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(40)]
    star = [(1000, i) for i in range(1001, 1100)]
    got = dict(connected_components(spark.createDataFrame(path + star + [(7, 7), (None, 3)], "a long, b long")).collect())
    assert got == {i: 0 for i in range(41)} | {i: 1000 for i in range(1000, 1100)}
