"""Importance resampling over word splits, removal of repeated passages, and the prefix trie, each against brute force."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from tarnfield.llm import prefix_trie, repeats, resampling

order = lambda r: tuple((x is None, x) for x in r)


# ---------------------------------------------------------------- resampling


def plain_draw(docs, target, percent=10, least=20, sizes=(1,), buckets=10_000):
    def grams(text):
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", low)
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in sizes for i in range(len(w) - n + 1)]

    own = [(i, *grams(t)) for i, t in docs]
    s, t = np.zeros(buckets), np.zeros(buckets)
    for _, _, g in own:
        np.add.at(s, g, 1)
    for x in target:
        np.add.at(t, grams(x)[1], 1)
    gain = [math.floor(1000 * math.log(((b + 1) * (s.sum() + buckets)) / ((a + 1) * (t.sum() + buckets)))) for a, b in zip(s, t)]
    rows = []
    for i, n, g in own:
        weight = sum(gain[b] for b in g)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0]))
    rank = {id(r): k + 1 for k, r in enumerate(able[: percent * len(able) // 100])}
    return sorted(((r[0], r[2], r[3], r[4], rank.get(id(r))) for r in rows), key=order)


def drawn(df):
    return sorted(((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in df.collect()), key=order)


@pytest.mark.parametrize("sizes", [(1, 1), (1, 3)])
def test_resampling_equals_brute_force(spark, sizes):
    random.seed(5)
    words = ["Alpha", "beta9", "GAMMA", "é", "Éa", "x_y", "straße", "\x00z", "中文", "q"]
    docs = [(i, " ".join(random.choice(words) + random.choice(["", ".", "\n", "-"]) for _ in range(random.randint(0, 60)))) for i in range(120)]
    docs += [(200, None), (201, ""), (202, "  ..."), (None, "alpha " * 30), (3, docs[3][1]), (3, docs[3][1])]
    target = ["alpha gamma gamma", None, "中文 q q"]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    for percent, least in ((10, 20), (100, 0), (37, 5)):
        got = drawn(resampling.resample(df, goal, percent, least, sizes))
        assert got == plain_draw(docs, target, percent, least, range(sizes[0], sizes[1] + 1))


def test_resampling_takes_long_texts_and_ids_of_text(spark, monkeypatch):
    split = resampling.Splitter()
    text = resampling.lowered("Ab cd-é 12" * 3000)
    whole = split.offsets(text)
    monkeypatch.setattr(resampling, "_STRETCH", 101)
    assert split.offsets(text) == whole and split.offsets("x" * 500) == [(0, 500)]
    df = spark.createDataFrame([("a", "one two", "w"), ("b", None, "w")], "doc_id string, text string, rank string")
    goal = spark.createDataFrame([], "text string")
    got = resampling.resample(df, goal, least_words=1, percent=100).collect()
    assert {(r["doc_id"], r["n_features"], r["rank"]) for r in got} == {("a", 2, 1), ("b", 0, None)}
    assert resampling.resample(df.limit(0), goal).count() == 0


# ---------------------------------------------------------------- repeats


def plain_removal(docs, length):
    seen = {}
    bodies = [(i, (t or "").encode()) for i, t in docs]
    for _, b in bodies:
        for at in range(len(b) - length + 1):
            seen[b[at : at + length]] = seen.get(b[at : at + length], 0) + 1
    out = []
    for i, b in bodies:
        gone = bytearray(len(b))
        for at in range(len(b) - length + 1):
            if seen[b[at : at + length]] > 1:
                gone[at : at + length] = b"\1" * length
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((i, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out, key=order)


def removed(df):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in df.collect()), key=order)


def passages(seed, n, letters="abcd e", most=500):
    """Texts put together from slices of a few sources, so that passages repeat with all kinds of borders."""
    rng = random.Random(seed)
    sources = ["".join(rng.choice(letters) for _ in range(most)) for _ in range(3)]
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 4)):
            s, a, b = rng.choice(sources), rng.randint(0, most), rng.randint(0, most)
            parts.append(s[min(a, b) : max(a, b)] + rng.choice(["", "é", "x" * rng.randint(0, 90), "qw"]))
        texts.append("".join(parts))
    return texts


@pytest.mark.parametrize("block_bytes", [1 << 20, 700, 1])
def test_repeats_equal_brute_force(spark, block_bytes):
    """Small blocks spread every anchor over several of them."""
    docs = list(enumerate(passages(1, 40))) + [(90, None), (91, ""), (92, "z" * 300), (93, "z" * 199), (94, "y" * 200), (None, "only here " + "é" * 130)]
    docs += [(7, docs[7][1]), (95, "ab" * 150), (96, "中文字" * 60 + "end"), (97, "start" + "中文字" * 60)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for length in (48, 200):
        assert removed(repeats.remove_repeats(df, length=length, block_bytes=block_bytes)) == plain_removal(docs, length), length


def test_a_passage_in_most_texts(spark):
    """One passage between different words, more segments of one anchor than a block takes."""
    rng = random.Random(2)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(260))
    docs = [(i, f"{rng.random():.15f}"[2:] + passage + f"{rng.random():.15f}"[2:]) for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert removed(repeats.remove_repeats(df, block_bytes=2_000)) == plain_removal(docs, 200)


def test_suffixes_are_sorted_and_their_prefixes_measured():
    rng = random.Random(4)
    for trial in range(80):
        text = "\0".join(passages(trial, 5, rng.choice(["ab", "abc d"]), 200)).encode() + bytes([255])
        data, depth = np.frombuffer(text, np.uint8), rng.choice([40, 200])
        wanted = np.array(sorted(rng.sample(range(len(text)), 1 + len(text) // 3)))
        found = repeats.suffix_order(data, wanted, depth)
        first = [(text + bytes(depth))[i : i + depth] for i in found]
        assert first == sorted(first) and set(wanted.tolist()) <= set(found.tolist()) and len(set(found.tolist())) == len(found)
        shared = [next((k for k in range(depth) if a[k] != b[k]), depth) for a, b in zip(first, first[1:])]
        assert repeats.common_prefixes(data, found, depth).tolist() == shared


def test_equal_windows_have_equal_anchors(monkeypatch):
    for trial in range(60):
        texts = [t.encode() for t in passages(trial, 6, "ab" if trial % 2 else "abc ")]
        monkeypatch.setattr(repeats, "_STEP", 1 << 20 if trial % 3 else 97)
        anchor = {}
        for owner, code, _, at, more in zip(*repeats.segments_of(texts, 48)):
            for i in range(at, at + more + 1):
                assert (owner, i) not in anchor
                anchor[owner, i] = code
        assert set(anchor) == {(d, i) for d, t in enumerate(texts) for i in range(len(t) - 47)}
        by_window = {}
        for (d, i), code in anchor.items():
            assert by_window.setdefault(texts[d][i : i + 48], code) == code


def test_repeats_take_odd_rows(spark):
    long = "The quick brown fox jumps over lazy dogs %d times. " * 20_000 % tuple(range(20_000))
    rows = [("a", long, 1, "x"), ("b", None, 2, "x"), (None, long[1000:900_000], 3, "x"), ("a", "short", None, None)]
    df = spark.createDataFrame(rows, "doc_id string, text string, uid int, body string")
    got = {(r["doc_id"], r["n_bytes"]): (r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in repeats.remove_repeats(df).collect()}
    assert got[None, 899_000] == (899_000, 1, b"") and got["b", 0] == (0, 0, b"") and got["a", 5] == (0, 0, b"short")
    assert got["a", len(long)][:2] == (899_000, 1)
    assert repeats.remove_repeats(df.limit(0)).count() == 0


# ---------------------------------------------------------------- trie


def plain_trie(turns):
    """Nodes of turns(conv_id, turn, role, text) by their prefixes."""
    place = lambda v: (v[1] is not None, v[1] or 0, hashlib.md5(f"{len(v[2])}:{v[2]}{v[3]}".encode()).digest())
    own = {}
    for c, _, r, x in sorted(((c, t, r or "", x or "") for c, t, r, x in turns if c is not None), key=lambda v: (v[0], *place(v))):
        own.setdefault(c, []).append((r, x))
    nodes, kids, whole = {}, {}, {}
    for c, s in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = tuple(own.get(c - c % 100, [])[:h] + s[h:])
        for d in range(len(whole[c]) + 1):
            nodes.setdefault(whole[c][:d], []).append(c)
    for k in nodes:
        if k:
            kids.setdefault(k[:-1], []).append(k)
    leaves, saved, out = {}, {}, []
    for k in sorted(nodes, key=len, reverse=True):
        below = kids.get(k, [])
        leaves[k] = sum(leaves[x] for x in below) or 1
        saved[k] = (len(nodes[k]) - 1) * (len(k[-1][1]) if k else 0) + sum(saved[x] for x in below)
        ends = ",".join(str(c) for c in sorted(c for c in nodes[k] if whole[c] == k))
        out.append((min(nodes[k]), len(k), min(nodes[k[:-1]]) if k else None, len(nodes[k]), len(below), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=order)


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie_rows(df):
    return sorted((tuple(r[c] for c in NODE) for r in df.collect()), key=order)


@pytest.mark.parametrize("size", [1 << 20, 600, 1])
def test_trie_equals_brute_force(spark, size, monkeypatch):
    """Containers of one byte burst until each holds one path."""
    monkeypatch.setattr(prefix_trie, "ID_CHUNK", 3)
    rng = random.Random(3)
    for few in (True, False):
        turns = [(None, 1, "user", "x")]
        for c in rng.sample(range(600), 90):
            for t in range(rng.choice([1, 2, 3, 8] if few else [1, 3, 14])):
                turns.append((c, rng.choice([t, t, t, None]), rng.choice(["user", "assistant", None] if t > 2 else ["user"]), rng.choice(["a", "bb", "é中 c", None] if t % 3 else ["a"])))
        df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(3)
        assert trie_rows(prefix_trie.shared_prefixes(df, size)) == plain_trie(turns)


def test_trie_of_many_copies_and_of_a_long_conversation(spark):
    turns = [(c, t, "user", f"t{t}") for c in range(0, 90_000, 300) for t in range(3)] + [(77, t, "user", "same" * (t % 3)) for t in range(3_000)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = trie_rows(prefix_trie.shared_prefixes(df, 5_000))
    assert got == plain_trie(turns) and len(got) > 3_000


def test_trie_takes_odd_rows(spark):
    schema = "conv_id long, turn long, role string, text string, path string, head int, no int"
    empty = spark.createDataFrame([], schema)
    assert trie_rows(prefix_trie.shared_prefixes(empty)) == []
    turns = [(100, None, None, None), (100, None, None, None), (101, 5, "user", "w " * 400_000), (None, 1, "user", "x")]
    df = spark.createDataFrame([(*t, "p", 1, 2) for t in turns], schema)
    assert trie_rows(prefix_trie.shared_prefixes(df)) == plain_trie(turns)
