"""Importance resampling towards a target distribution, over words that an untrained splitter finds.

The tokenizers library's Regex Split cuts ASCII-lowered text into words and says
where each stands.  Windows of those offset pairs are the features; a feature's
bucket is the CRC of its bytes.  Bucket histograms of the raw and of the target
texts give every bucket a gain, a document's weight is the sum of its features'
gains, and Gumbel noise keyed by seed and id turns the weights into a draw
without replacement of the highest scores.

Texts are split once: the stored table holds a document's bucket numbers, from
which histogram and weights follow.  Histograms are summed in each task before
the shuffle, so a frequent word is at most one row a task.  Ranks come from a
range partitioning by score and id with running counts of the partitions, so no
task sorts or holds the whole table.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Regex, pre_tokenizers

from tarnfield.llm.common import durable, read

#: Everything but ASCII characters that are no digit and no lower-case letter.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NGRAMS = (1, 1)
BUCKETS = 10_000
SEED = "2024"
LEAST_WORDS = 20
PERCENT = 10
#: Characters of a text that are split at once, up to the next separator.
_STRETCH = 1 << 20
#: Features whose buckets a task remembers; they are forgotten together when there are more.
_REMEMBERED = 1 << 18
_SEPARATOR = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]")


def lowered(text: str | None) -> str:
    """text with A-Z in lower case and all else as it is; null as the empty text."""
    return (text or "").encode().lower().decode()


class Splitter:
    """Words of lowered texts as offset pairs, and the buckets of their windows."""

    def __init__(self, ngrams: tuple[int, int] = NGRAMS, buckets: int = BUCKETS):
        self.split = pre_tokenizers.Split(Regex(WORD), behavior="removed", invert=True)
        self.sizes, self.n_buckets = range(ngrams[0], ngrams[1] + 1), buckets
        self.known: dict[str, int] = {}

    def offsets(self, low: str) -> list[tuple[int, int]]:
        """Start and end of each word; long texts go through the library in stretches that end at a separator."""
        if len(low) <= _STRETCH:
            return [at for _, at in self.split.pre_tokenize_str(low)]
        found, start = [], 0
        while start < len(low):
            cut = _SEPARATOR.search(low, min(start + _STRETCH, len(low)))
            end = cut.start() if cut else len(low)
            found += [(a + start, b + start) for _, (a, b) in self.split.pre_tokenize_str(low[start:end])]
            start = end
        return found

    def bucket(self, feature: str) -> int:
        got = self.known.get(feature)
        if got is None:
            if len(self.known) >= _REMEMBERED:
                self.known.clear()
            got = self.known[feature] = zlib.crc32(feature.encode()) % self.n_buckets
        return got

    def features(self, text: str | None) -> tuple[int, list[int]]:
        """(number of words, bucket of every window of words)."""
        low = lowered(text)
        pairs = self.offsets(low)
        words, bucket = [low[a:b] for a, b in pairs], self.bucket
        found: list[int] = []
        for n in self.sizes:
            grams = words if n == 1 else (" ".join(words[i : i + n]) for i in range(len(words) - n + 1))
            found += map(bucket, grams)
        return len(pairs), found


def bucketed(docs: DataFrame, id_col: str, text_col: str, ngrams: tuple[int, int] = NGRAMS, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, features) of every row: features are the buckets of all windows, repeats included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(ngrams, buckets)
        for b in batches:
            sizes, flat, ends = [], [], [0]
            for text in b.column(1):
                n, own = splitter.features(text.as_py())
                sizes.append(n)
                flat.append(np.array(own, np.int32))
                ends.append(ends[-1] + len(own))
            values = pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32), pa.int32())
            features = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), features], ["doc_id", "n_words", "features"])

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"doc_id {kind}, n_words long, features array<int>")


def histogram(rows: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) of a table with `features`: counted by task in an array of fixed size, then summed up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            total += np.bincount(b.column(0).flatten().to_numpy(zero_copy_only=False), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], ["bucket", "n"])

    return rows.select("features").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) for every bucket: thousandths of the log ratio of its smoothed shares of target and raw features, rounded down."""
    spark = raw.sparkSession
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    full = every.join(raw.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").na.fill(0, ["s", "t"])
    whole = lambda df: df.agg(F.coalesce(F.sum("n"), F.lit(0))).scalar().cast("double")
    up = (F.col("t") + 1.0) * (whole(raw) + float(buckets))
    down = (F.col("s") + 1.0) * (whole(target) + float(buckets))
    return full.select("bucket", F.floor(1000.0 * F.log(up / down)).cast("long").alias("gain"))


def noise(doc_id: Column, seed: str = SEED) -> Column:
    """Gumbel noise in thousandths, rounded down, by seed and id; a null id counts as the empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def with_scores(rows: DataFrame, by_bucket: list[int], seed: str = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of bucketed() rows; by_bucket holds a gain for every bucket."""
    held = rows.sparkSession.sparkContext.broadcast(np.array(by_bucket, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums = np.concatenate([[0], np.cumsum(held.value[b.column(2).flatten().to_numpy(zero_copy_only=False)])])
            ends = np.concatenate([[0], np.cumsum(b.column(2).value_lengths().to_numpy(zero_copy_only=False))])
            weight = sums[ends[1:]] - sums[ends[:-1]]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.diff(ends), pa.int64()), pa.array(weight, pa.int64())], ["doc_id", "n_words", "n_features", "weight"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.select("doc_id", "n_words", "features").mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")
    return out.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def ranked(rows: DataFrame, k: int) -> DataFrame:
    """A stored table with `rank`: 1, 2, ... for its k rows of highest score, ties to the smaller doc_id, null for the others.

    Rows are dealt into ranges of the order and sorted there; a row's rank is
    its place in its range and the rows of the ranges before.  Null ids come
    last among equals; rows alike in both stand in the order of their hash.
    """
    spark = rows.sparkSession
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc(F.col("tie"))]
    dealt = rows.withColumn("tie", F.monotonically_increasing_id())  # rows come from a stored table, so it stays
    dealt = dealt.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    placed = durable(dealt.withColumn("at", F.monotonically_increasing_id()))  # number of the range times 2**33, and the place in it
    part = F.shiftright("at", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()  # a row for each range
    before, starts = 0, []
    for r in sorted(sizes, key=lambda r: r["part"]):
        starts.append((r["part"], before))
        before += r["n"]
    offsets = spark.createDataFrame(starts, "part long, before long")
    rank = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    out = placed.withColumn("part", part).join(F.broadcast(offsets), "part")
    return out.select(*rows.columns, F.when(rank <= k, rank).alias("rank"))


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, ngrams: tuple[int, int] = NGRAMS, buckets: int = BUCKETS,
    seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of docs; rank is null for what is not drawn.

    Drawn are floor(percent * N / 100) of the N rows with at least least_words
    words.  Null and empty texts have no word and weight zero, and are never
    drawn where least_words is positive; ids may be null (hashed as the empty
    text) or of any type; rows that repeat an id and a text have one score and
    follow each other in rank; texts are split whole, however long; an empty
    table stays empty, and an empty target gives gains of the raw histogram
    alone; other columns are not looked at.
    """
    rows = durable(bucketed(docs, id_col, text_col, ngrams, buckets))
    wanted = bucketed(target.select(F.lit(0).alias("id"), target_col), "id", target_col, ngrams, buckets)
    by_bucket = gains(durable(histogram(rows, buckets)), durable(histogram(wanted, buckets)), buckets).orderBy("bucket").collect()  # buckets rows
    scored = durable(with_scores(rows, [r["gain"] for r in by_bucket], seed))
    eligible = scored.filter(F.col("n_words") >= least_words)
    drawn = ranked(eligible, percent * eligible.count() // 100)
    names = ["doc_id", "n_features", "weight", "score"]
    rest = scored.filter(F.col("n_words") < least_words).select(*names, F.lit(None).cast("long").alias("rank"))
    return drawn.select(*names, "rank").unionByName(rest)


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


#: CRC-32 in SQL, bit by bit for the table and byte by byte for a word.
CRC_SQL = """crc_table as (select list(c order by i) as tab from (select i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]),
  lambda a, x: case when a % 2 = 1 then xor(3988292384, a // 2) else a // 2 end) as c from (select unnest(range(0, 256)) as i)))"""


def crc_sql(word: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of the UTF-8 bytes of an expression; needs CRC_SQL's crc_table in the FROM clause."""
    digit = lambda at: f"(instr('0123456789ABCDEF', substr(hex(encode({word})), {at}, 1)) - 1)"
    bytes_of = f"list_transform(range(1, 2 * strlen({word}), 2), lambda i: cast({digit('i')} * 16 + {digit('i + 1')} as bigint))"
    return f"xor(4294967295, list_reduce(list_prepend(cast(4294967295 as bigint), {bytes_of}), lambda c, b: xor(tab[cast(xor(c, b) % 256 as int) + 1], c // 256)))"


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{WORD}')"

OP11_SQL = f"""with {CRC_SQL}, docs as (select doc_id, {_WORDS} as w from documents), raw as (select doc_id, unnest(w) as word from docs),
goal as (select unnest({_WORDS}) as word from benchmark), vocabulary as (select word from raw union select word from goal),
hashed as (select word, {crc_sql('word')} % {BUCKETS} as bucket from vocabulary, crc_table),
s as (select bucket, count(*) as s from raw join hashed using (word) group by 1), t as (select bucket, count(*) as t from goal join hashed using (word) group by 1),
totals as (select (select cast(count(*) as double) from raw) as s_all, (select cast(count(*) as double) from goal) as t_all),
gain as (select bucket, cast(floor(1000.0::double * ln(((coalesce(t, 0) + 1.0::double) * (s_all + {BUCKETS}.0::double)) / ((s + 1.0::double) * (t_all + {BUCKETS}.0::double)))) as bigint) as gain
  from s left join t using (bucket), totals),
weights as (select doc_id, cast(sum(gain) as bigint) as weight from raw join hashed using (word) join gain using (bucket) group by 1),
noisy as (select doc_id, len(w) as n_features, coalesce(weight, 0) as weight, cast('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8) as bigint) as h from docs left join weights using (doc_id)),
scored as (select doc_id, n_features, weight, weight + cast(floor(-1000.0::double * ln(-ln((h + 0.5::double) / 4294967296.0::double))) as bigint) as score from noisy),
drawn as (select doc_id, row_number() over (order by score desc, doc_id) as rank from scored where n_features >= {LEAST_WORDS})
select doc_id, n_features, weight, score, case when rank <= (select {PERCENT} * count(*) // 100 from drawn) then rank end as rank from scored left join drawn using (doc_id)"""
