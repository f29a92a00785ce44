"""Toxicity by compression distance between two zstandard dictionaries.

A text is cut into windows of twelve words, and each window is compressed twice:
with a dictionary trained on ordinary text, and with one trained on toxic text.
The bytes that the second saves are held against thresholds; a logistic curve,
calibrated on the training documents, turns the shares of a text's windows over
the thresholds into a score.

Both dictionaries rest on the same ordinary text, so a window of ordinary words
costs the same under both and the difference shows toxic content only.  The
toxic one ends with what zstandard's trainer keeps of the toxic documents' words
that are not ordinary: words with a beginning (four to eight characters, or the
whole word) that significantly more toxic than ordinary documents hold.  Without
that, what toxic documents have in common with all others fills the dictionary
and the windows' differences are mostly noise.

Fitted on at most TRAIN_LIMIT labelled rows, none of them held out.  Word counts
are made by Spark; the driver gets the selected beginnings of words in those
rows, at most two windows a row and class, and the features of each row.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfield.llm.common import durable, read

#: Bound on the labelled rows that the model is fitted on.
TRAIN_LIMIT = 20_000
#: Least number of training documents with a beginning, and least z-score of its excess in toxic documents.
LEAST_DOCS = 5
LEAST_Z = 6.0
STEM_SIZES = range(4, 9)
WINDOW = 12
#: Bytes of the two dictionaries' parts; least length of a match, so that shared syllables do not count as matches.
ORDINARY_BYTES, TOXIC_BYTES = 110 << 10, 2 << 10
LEAST_MATCH = 6
#: Saved bytes of a window: thresholds of the shares, and those of the counts.
SHARES, COUNTS = (1, 2, 3, 4, 5, 6, 8), (3, 4, 6)
#: What a missed toxic training document counts for in the calibration.
TOXIC_WEIGHT = 3.0
HOLDOUT_FOLDS = 5

_EDGES = b".,;:!?|*&%$#\"'()[]{}<>~`-_=+/\\"


def held_out(doc_id: int | None) -> bool:
    """Whether crc32 of the id as text leaves 0 modulo 5; a null id counts as the empty text, so it is held out."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % HOLDOUT_FOLDS == 0


def words_of_text(text: str | None) -> list[bytes]:
    """Words in lower case without punctuation at their ends."""
    return [w for w in (x.strip(_EDGES) for x in (text or "").lower().encode().split()) if w]


def windows_of(words: list[bytes]) -> list[bytes]:
    return [b" ".join(words[at : at + WINDOW]) for at in range(0, len(words), WINDOW)]


def stems(word: bytes) -> list[bytes]:
    """Beginnings of a word that are looked at, after a blank; the whole word has a blank behind it too."""
    text = word.decode()
    return [f" {text[:k]}".encode() for k in STEM_SIZES if k < len(text)] + [b" " + word + b" "]


@dataclass(frozen=True)
class ToxicityModel:
    toxic_dict: bytes
    ordinary_dict: bytes
    weights: tuple[float, ...]  # of features(), the last for the constant


class Scorer:
    """Compressors of one model; made once for each task."""

    def __init__(self, model: ToxicityModel):
        self.model = model
        self.toxic, self.ordinary = map(self._compressor, (model.toxic_dict, model.ordinary_dict))

    @staticmethod
    def _compressor(content: bytes) -> zstandard.ZstdCompressor:
        params = zstandard.ZstdCompressionParameters.from_level(
            3, strategy=zstandard.STRATEGY_DFAST, min_match=LEAST_MATCH, write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS
        )
        if not content:
            return zstandard.ZstdCompressor(compression_params=params)
        known = zstandard.ZstdCompressionDict(content)
        known.precompute_compress(compression_params=params)
        return zstandard.ZstdCompressor(dict_data=known, compression_params=params)

    def differences(self, text: str | None) -> np.ndarray:
        """By window, bytes that the toxic dictionary saves against the ordinary one."""
        toxic, ordinary = self.toxic.compress, self.ordinary.compress
        return np.array([len(ordinary(w)) - len(toxic(w)) for w in windows_of(words_of_text(text))] or [0], np.int64)

    def features(self, text: str | None) -> list[float]:
        d = self.differences(text)
        shares = [float((d >= t).mean()) for t in SHARES]
        counts = [math.log1p(int((d >= t).sum())) for t in COUNTS]
        return [*shares, *counts, float(d.mean()), min(int(d.max()), 20) / 10, 1.0]

    def score(self, text: str | None) -> float:
        z = sum(a * b for a, b in zip(self.model.weights, self.features(text)))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, limit: int) -> DataFrame:
    """(text, toxic) of up to limit labelled documents that are not held out, in the order of a hash of the id; a repeated id counts once."""
    known = labels.filter("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.filter(F.crc32(F.col("doc_id").cast("string")) % HOLDOUT_FOLDS != 0)
    order = F.xxhash64(F.col("doc_id").cast("string"))
    known = durable(known.select(F.col("doc_id").alias("known_id"), F.col("toxic").cast("int")).orderBy(order, "known_id").limit(limit))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    found = texts.join(F.broadcast(known), texts["id"] == known["known_id"])  # at most limit ids
    return found.groupBy("known_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")


def _stem_excess(rows: DataFrame, n_toxic: int, n_ordinary: int) -> DataFrame:
    """(stem, z) of stems in LEAST_DOCS training documents or more: z-score of the toxic documents among those with the stem."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = list({s for w in set(words_of_text(text)) for s in stems(w)})
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), pa.array([t] * len(own), pa.int32())], ["stem", "toxic"])

    counts = rows.mapInArrow(run, "stem binary, toxic int").groupBy("stem").agg(F.sum("toxic").alias("a"), F.count("*").alias("n"))
    n = n_toxic + n_ordinary
    share = n_toxic / n
    spread = F.sqrt(F.col("n") * share * (1 - share) * (1 - F.col("n") / n) + 1e-9)
    return counts.filter(F.col("n") >= LEAST_DOCS).select("stem", ((F.col("a") - F.col("n") * share) / spread).alias("z"))


def shortest(stems_z: list[tuple[bytes, float]]) -> frozenset[bytes]:
    """The stems that do not begin with another one of no lower z-score."""
    z = dict(stems_z)
    return frozenset(s for s in z if not any(z.get(s[:k], -math.inf) >= z[s] for k in range(2, len(s))))


def _trained(size: int, samples: list[bytes], **how: int) -> bytes:
    """A trained dictionary; of samples too few for zstandard's trainer, their end."""
    samples = [s for s in samples if len(s) >= 8]
    total = sum(map(len, samples))
    try:
        return zstandard.train_dictionary(min(size, max(256, total // 8)), samples, **how).as_bytes()
    except zstandard.ZstdError:
        return b" ".join(samples)[-size:]


def _content(dictionary: bytes) -> bytes:
    """A trained dictionary's text, which stands behind its tables and three first offsets."""
    head, offsets, text = dictionary.partition(np.array([1, 4, 8], "<u4").tobytes())
    return text if offsets else head


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + 0.1 * w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(x.shape[1]), grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = TRAIN_LIMIT) -> ToxicityModel:
    """Train both dictionaries and the calibration. Without labels of both classes every score is the prior, 1/4."""
    rows = durable(training_rows(docs, labels, id_col, text_col, limit))
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return ToxicityModel(b"", b"", (*[0.0] * (len(SHARES) + len(COUNTS) + 2), math.log(1 / 3)))
    excess = _stem_excess(rows, n1, n0).filter(F.col("z") >= LEAST_Z)
    chosen = shortest([(bytes(r["stem"]), r["z"]) for r in excess.collect()])

    def samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = words_of_text(text)
                if t:
                    words = [w for w in words if not chosen.isdisjoint(stems(w))]
                own = [b" " + w + b" " if t else w for w in windows_of(words)]
                yield pa.RecordBatch.from_arrays([pa.array([t] * len(own), pa.int32()), pa.array(own, pa.binary())], ["toxic", "window"])

    cut = durable(rows.mapInArrow(samples, "toxic int, window binary"))
    take = lambda t: [bytes(r["window"]) for r in cut.filter(F.col("toxic") == t).orderBy(F.xxhash64("window"), "window").limit(2 * limit).collect()]
    ordinary = _trained(ORDINARY_BYTES, take(0))
    toxic = ordinary + _content(_trained(TOXIC_BYTES, take(1), k=32, d=8)) if chosen else ordinary
    unfitted = ToxicityModel(toxic, ordinary, ())

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(unfitted)
        for b in batches:
            x = pa.array([scorer.features(t) for t in b.column(0).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([x, b.column(1)], ["x", "toxic"])

    got = rows.mapInArrow(measured, "x array<double>, toxic int").collect()  # at most limit rows
    y = np.array([r["toxic"] for r in got], float)
    weights = _logistic(np.array([r["x"] for r in got]), y, np.where(y > 0, TOXIC_WEIGHT, 1.0))
    return ToxicityModel(toxic, ordinary, tuple(np.round(weights, 9).tolist()))


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    Null and empty texts have one empty window and get the calibrated score of a
    text without savings; repeated rows come out repeated with equal scores; ids
    may be null; other columns of docs are not looked at; an empty table stays empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in batches:
            s = [scorer.score(t) for t in b.column(1).to_pylist()]
            held = [held_out(i) for i in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(held, pa.bool_()), pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32())],
                ["doc_id", "held_out", "score", "predicted"],
            )

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score(docs, fit(docs, read(spark, sf_dir, "labels")))
