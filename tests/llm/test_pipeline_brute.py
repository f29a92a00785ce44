"""Secret spans of the Markov models, and the whole pipeline, against plain loops."""

import math
import random
import re
from collections import Counter

import corpus_pipeline
import numpy as np
import pandas as pd
import xxhash
from tarnfield.llm import pieces, quality_rules, secrets
from test_quality_and_importance import base, ratios, spark_hash, words
from test_simhash import brute_components, brute_fingerprint
from test_text_operators import PATTERNS, brute_leaks, brute_segment, leak_tokens


def base_of(text):
    """(start, rank, end, word) of the three fixed kinds."""
    out = []
    for rank, (kind, p) in enumerate(PATTERNS.items()):
        for m in p.finditer(text or ""):
            word = m[1] if kind == "assign" else m[0]
            if len(word) >= (8, 16, 32)[rank]:
                out.append((m.start(), rank, m.end(), word))
    return out


def brute_secrets(texts):
    """All spans of each text, with models counted over all of them."""
    place = {c: i + 1 for i, c in enumerate(secrets.ALPHABET)}
    size = len(secrets.ALPHABET) + 1
    cells = lambda w: [(place[w[i - 1]] if i else 0) * size + place[c] for i, c in enumerate(w)]
    known, judged = [base_of(t) for t in texts], []
    for t, own in zip(texts, known):
        found = [(m.start(), 3, m.end(), m[0]) for m in re.finditer(r"[A-Za-z0-9+/_=-]{12,}", t or "")]
        judged.append([x for x in found if re.search("[A-Za-z]", x[3]) and len(set(x[3])) >= 6 and not any(s[0] < x[2] and x[0] < s[2] for s in own)])
    counts = [Counter(), Counter()]
    for kind, letters in secrets.RANDOM_KINDS.items():
        for i in range(secrets.SAMPLES):
            counts[1].update(cells("".join(letters[spark_hash(f"random strings:{kind}:{i}:{j}") % len(letters)] for j in range(1, secrets.SAMPLE_LENGTH + 1))))
    for tokens in judged:
        for *_, w in tokens:
            if re.search(secrets.ORDINARY, w):
                parts, number = re.findall("[a-z]{3,6}", w.lower()), spark_hash(w) % 200
                end = str(number) if number < 100 else ""
                big = [x.title() for x in parts]
                for name in (w, "_".join(parts) + end, parts[0] + "".join(big[1:]) + end, "".join(big), "/".join(parts), "-".join(parts), "_".join(parts).upper(), "_".join([*parts[:2], str(number)])):
                    counts[0].update(cells(name))
    first, second = [Counter(), Counter()], [Counter(), Counter()]
    for kind in (0, 1):
        for c, n in counts[kind].items():
            first[kind][c // size] += n
            second[kind][c % size] += n
    alone = lambda kind, c: (second[kind][c % size] + 0.5) / (sum(counts[kind].values()) + 0.5 * size)
    share = lambda kind, c: (counts[kind][c] + secrets.PRIOR * alone(kind, c)) / (first[kind][c // size] + secrets.PRIOR)
    ratio = lambda c: round(math.log(share(1, c) / share(0, c)) * 1e6) if counts[0] else 0
    random_ones = lambda tokens: [x for x in tokens if sum(map(ratio, cells(x[3]))) / len(x[3]) / 1e6 >= secrets.THRESHOLD]
    return [sorted(own + random_ones(tokens)) for own, tokens in zip(known, judged)]


def brute_redacted(text, spans):
    if text is None or not spans:
        return text
    out, at = "", 0
    for start, _, end, _ in spans:
        if start >= at:
            out += text[at:start] + "[SECRET]"
        at = max(at, end)
    return out + text[at:]


def random_key(rng, n=24):
    return "".join(rng.choice(secrets.ALPHABET[:62]) for _ in range(n))


def secret_text(rng):
    names = ["get_user_account_name", "internationalisation", "configuration_manager", "data/files/of_the_day", "representationlayer"]
    parts = [lambda: rng.choice(names), lambda: "the", lambda: "token=" + random_key(rng, 12), lambda: random_key(rng), lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40)),
             lambda: "AKIA" + "".join(rng.choice("ABCDEFGHIJ0123456789") for _ in range(16)), lambda: "secret: " + rng.choice(names) + "." + random_key(rng, 9)]
    return " ".join(rng.choice(parts)() for _ in range(rng.randint(0, 12)))


def test_all_secret_spans_equal_brute_force(spark):
    rng = random.Random(13)
    texts = [None, "", *(secret_text(rng) for _ in range(150)), " ".join(secret_text(rng) for _ in range(120))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute_secrets(texts)
    for r in secrets.scan(docs).collect():
        assert [tuple(s) for s in r["secrets"]] == want[r["doc_id"]], r["text"]
    assert sum(s[1] == 3 for spans in want for s in spans) > 50
    assert {r["doc_id"]: r["text"] for r in secrets.redact(docs).collect()} == {i: brute_redacted(t, want[i]) for i, t in enumerate(texts)}


def test_random_strings_are_found_and_names_left(spark):
    """Keys that no pattern knows, and names, neither seen in training."""
    rng = random.Random(17)
    known = [secret_text(rng) for _ in range(200)]
    keys = [f"see {random_key(rng, rng.randint(20, 44))} here" for _ in range(100)]
    parts = ["user", "account", "loader", "manager", "configuration", "path", "index", "reader", "update", "session"]
    names = ["_".join(rng.choice(parts) for _ in range(4)) for _ in range(100)]
    docs = spark.createDataFrame(list(enumerate(known + keys + names)), "doc_id long, text string")
    hit = {r["doc_id"]: len(r["secrets"]) for r in secrets.scan(docs).collect()}
    assert sum(hit[200 + i] for i in range(100)) >= 90 and sum(hit[300 + i] for i in range(100)) <= 5


def test_kinds_of_random_strings_among_the_documents(spark):
    """Planted tokens of many kinds among given documents: nearly all are found; identifiers, paths and words of the documents are left."""
    rng = random.Random(31)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    upper, lower, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    kinds = {
        "base62 12": (upper + lower + digits, 12), "base62 16": (upper + lower + digits, 16), "base62 20": (upper + lower + digits, 20), "base62 32": (upper + lower + digits, 32),
        "base64 40": (upper + lower + digits + "+/", 40), "base32 20": (upper + "234567", 20), "lower 24": (lower, 24), "lower digits 16": (lower + digits, 16),
        "lower digits 24": (lower + digits, 24), "upper digits 20": (upper + digits, 20),
    }
    words = [w for r in docs.limit(40).collect() for w in re.findall("[a-z]{3,9}", (r["text"] or "").lower())]
    some = lambda n: [rng.choice(words) for _ in range(n)]
    plain = {
        "snake": lambda: "_".join(some(3)), "camel": lambda: "".join(x.title() for x in some(3)), "path": lambda: "/".join(some(4)), "dashed": lambda: "-".join(some(3)),
        "numbered": lambda: "_".join(some(2)) + str(rng.randint(1, 99)), "joined": lambda: "".join(some(3)),
    }
    rows = []
    for kind, (letters, n) in kinds.items():
        rows += [(len(rows) + i, f"see {''.join(rng.choice(letters) for _ in range(n))} here", kind, True) for i in range(60)]
    for kind, make in plain.items():
        rows += [(len(rows) + i, f"see {make()} here", kind, False) for i in range(100)]
    planted = spark.createDataFrame([(-1 - i, t) for i, t, _, _ in rows], docs.schema)
    found = {r["doc_id"]: len(r["secrets"]) for r in secrets.scan(docs.union(planted)).filter("doc_id < 0").collect()}
    share = {}
    for i, _, kind, secret in rows:
        share.setdefault((secret, kind), []).append(found[-1 - i])
    share = {k: sum(x > 0 for x in v) / len(v) for k, v in share.items()}
    wrong = {k[1]: v for k, v in share.items() if (v < 0.9 if k[0] else v > 0.05)}
    assert not wrong


def test_pipeline_equals_brute_force(spark, tmp_path):
    rng = random.Random(23)
    vocabulary = [f"w{i}" for i in range(300)] + ["the", "of"]
    item = "Tom had 5 apples and gave 2 apples to Anna because she liked red fruit from the old garden near the house very much"
    plain = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    texts = [plain(rng.randint(20, 120)) for _ in range(60)]
    texts += [texts[3], texts[4] + " more", None, "", "x " * 80, plain(60) + " " + item.replace("5", "7").replace("Tom", "Bob") + " " + plain(30)]
    texts += [f"{plain(60)} {secret_text(rng)} {plain(10)}" for _ in range(20)]
    rows = list(enumerate(texts))
    sf = str(tmp_path)
    frame = pd.DataFrame({"doc_id": range(len(texts)), "text": texts, "lang": "en", "source": "s", "n_chars": [len(t or "") for t in texts]})
    frame.to_parquet(f"{sf}/documents.parquet", index=False)
    good = {i for i in range(len(texts)) if i % 10}
    pd.DataFrame({"doc_id": range(len(texts)), "quality": [int(i in good) for i in range(len(texts))], "toxic": 0}).to_parquet(f"{sf}/labels.parquet", index=False)
    pd.DataFrame({"item_id": [1], "text": [item]}).to_parquet(f"{sf}/benchmark.parquet", index=False)

    def grams(t):
        w = words(t)
        return [spark_hash(x) % quality_rules.BUCKETS for x in w] + [spark_hash(a, b) % quality_rules.BUCKETS for a, b in zip(w, w[1:])]

    table, kept = ratios(rows, good, quality_rules.BUCKETS, grams), []
    for i, t in rows:
        n, *_, repeated = base(t)
        score = sum(table[b] for b in grams(t)) / max(1, 2 * n - 1) / 1e6
        if n >= 50 and 100 * repeated <= 50 * n and score >= quality_rules.THRESHOLD:
            kept.append((i, t))
    assert 40 < len(kept) < len(rows)
    groups = brute_components([(i, brute_fingerprint(t)) for i, t in kept])
    kept = [(i, t) for (i, t), g in zip(kept, groups) if i == g]
    docs = spark.createDataFrame(kept, "doc_id long, text string")
    leaked = {d for d, _ in brute_leaks(*leak_tokens(spark, docs, spark.read.parquet(f"{sf}/benchmark.parquet")))}
    assert len(leaked) == 1
    kept = [(i, t) for i, t in kept if i not in leaked]
    clean = [brute_redacted(t, s) for (_, t), s in zip(kept, brute_secrets([t for _, t in kept]))]
    assert any("[SECRET]" in t for t in clean)
    p, want = pieces.pieces_of_model(pieces.MODEL), {}
    for (i, _), t in zip(kept, clean):
        chunks = p.chunks.findall((" " + t).replace(" ", pieces.MARK))
        own = pieces._mix(np.arange(1, 1 + len(chunks)).astype(np.uint64))
        keys = pieces._mix(np.uint64(xxhash.xxh64_intdigest(str(i), pieces.SEED)) ^ own)
        want[i] = [x for c, k in zip(chunks, keys) for x in brute_segment(p, c, int(k), pieces.RATE)]
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"]: r["ids"] for r in got} == want and all(r["lossless"] for r in got)
