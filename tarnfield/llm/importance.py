"""Quality by importance resampling.

Two generative models over hashed word unigrams and bigrams are fitted, one of
target text (documents labelled as good) and one of all raw text.  A document's
log importance weight is the log ratio of the two models; adding Gumbel noise
keyed by seed and document and taking the k largest keys draws k documents
without replacement in proportion to their weights.  k is a share of the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfield.llm.common import durable, let, read, words_of

BUCKETS = 10_000
#: Bound on the target documents that the target model is fitted on; raw counts cover all documents.
TARGET_LIMIT = 20_000
SHARE = 0.5
SEED = 17
UNITS = 1_000_000
#: Added to every count of both models.
SMOOTHING = 1.0
_BINS = 4096


def _bucket(*words: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit("dsir"), *words), F.lit(BUCKETS)).cast("int")


def _grams(w: Column) -> Column:
    two = F.transform(w, lambda x, i: F.when(i > 0, _bucket(F.get(w, i - 1), x)))
    return F.concat(F.transform(w, lambda x: _bucket(x)), F.array_compact(two))


def fit_ratios(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row: ratios, log(target share / raw share) by bucket in UNITS; zeros without target documents."""
    good = labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("target_id")).distinct()
    chosen = durable(good.orderBy(F.xxhash64(F.col("target_id").cast("string")), "target_id").limit(TARGET_LIMIT))
    rows = docs.select(F.col(id_col).alias("id"), words_of(F.lower(F.col(text_col))).alias("w"))
    rows = rows.join(F.broadcast(chosen), rows["id"] == chosen["target_id"], "left")
    grams = rows.select(F.col("target_id").isNotNull().cast("long").alias("t"), F.explode(_grams(F.col("w"))).alias("bucket"))
    counts = durable(grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("t").alias("target")))
    every = counts.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    full = every.join(F.broadcast(counts), "bucket", "left").na.fill(0, ["raw", "target"])  # BUCKETS rows
    full = full.withColumns({n: counts.agg(F.coalesce(F.sum(c), F.lit(0))).scalar() for n, c in (("n_raw", "raw"), ("n_target", "target"))})
    share = lambda c, n: (F.col(c) + SMOOTHING) / (F.col(n) + SMOOTHING * BUCKETS)
    ratio = F.when(F.col("n_target") > 0, F.round(F.log(share("target", "n_target") / share("raw", "n_raw")) * UNITS)).otherwise(0)
    listed = full.select("bucket", ratio.cast("long").alias("ratio")).agg(F.sort_array(F.collect_list(F.struct("bucket", "ratio"))).alias("all"))
    return listed.select(F.transform("all", lambda x: x["ratio"]).alias("ratios"))


def with_weights(docs: DataFrame, ratios: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """doc_id, log_weight, key, tie: the noise depends on the seed, the id and the text only."""
    w = words_of(F.lower(F.col(text_col)))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), w.alias("w"), ratios.scalar().alias("ratios"))

    def total(m: Column) -> Column:
        step = lambda x, i: F.get(m.r, _bucket(x)) + F.when(i > 0, F.get(m.r, _bucket(F.get(F.col("w"), i - 1), x))).otherwise(0)
        return F.aggregate(F.transform(F.col("w"), step), F.lit(0).cast("long"), lambda a, x: a + x)

    weight = let(F.struct(F.col("ratios").alias("r")), total) / UNITS
    tie = F.xxhash64(F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.col("text"), F.lit("")))
    uniform = (F.shiftrightunsigned(F.col("tie"), 11).cast("double") + 0.5) / float(1 << 53)
    scored = rows.select("doc_id", weight.alias("log_weight"), tie.alias("tie"))
    return scored.select("doc_id", "log_weight", (F.col("log_weight") - F.log(-F.log(uniform))).alias("key"), "tie")


def _border(rows: DataFrame, value: str, k: int) -> tuple[object, int, int]:
    """(border, rows above it, rows on it): the border is the k-th largest value of rows, 1 <= k <= their number.

    Found by counting rows in ever narrower bins, so no task sorts or holds the whole table.
    """
    bounds = rows.agg(F.min(value).alias("a"), F.max(value).alias("b"), F.count("*").alias("n")).first()
    low, high, above, size = bounds["a"], bounds["b"], 0, bounds["n"]
    while low < high:
        width = (high - low) / _BINS
        inside = rows.filter((F.col(value) >= low) & (F.col(value) <= high))
        number = F.least(F.floor((F.col(value) - low) / width), F.lit(_BINS - 1)) if low + width > low else (F.col(value) > low).cast("long")
        bins = inside.groupBy(number.alias("bin")).agg(F.count("*").alias("n"), F.min(value).alias("a"), F.max(value).alias("b"))
        for r in sorted(bins.collect(), key=lambda r: -r["bin"]):  # at most _BINS rows
            if above + r["n"] >= k:
                low, high, size = r["a"], r["b"], r["n"]
                break
            above += r["n"]
    return low, above, size


def take_largest(scored: DataFrame, k: int) -> DataFrame:
    """scored(doc_id, log_weight, key, tie) with `kept`: true for exactly k rows, those of largest key, then tie, then doc_id.

    scored must be a stored table.  Of rows that repeat all columns as many as
    there is room for are kept; since they are alike, the ones on the border are
    written anew with their number.
    """
    n = scored.count()
    if k >= n or k <= 0:
        return scored.withColumn("kept", F.lit(k > 0))
    half = lambda c, part: F.shiftright(c, 32) if part == "high" else F.col(c).bitwiseAND(F.lit((1 << 32) - 1))  # noqa: E731  exact as floating point too
    rows = scored.withColumn("id", F.coalesce("doc_id", F.lit(-(1 << 63))))
    levels = {"k": F.col("key"), "t1": half("tie", "high"), "t2": half("tie", "low"), "i1": half("id", "high"), "i2": half("id", "low")}
    rows = rows.withColumns(levels)
    border, room, over, equal = rows, k, F.lit(False), F.lit(True)
    for c in levels:
        value, above, size = _border(border, c, room)
        over, equal = over | equal & (F.col(c) > value), equal & (F.col(c) == value)
        room, border = room - above, border.filter(F.col(c) == value)
        if size == room:
            return rows.withColumn("kept", over | equal).select(*scored.columns, "kept")
    one = border.select(*scored.columns).first()
    alike = scored.sparkSession.range(size).select(*[F.lit(one[c]).cast(t).alias(c) for c, t in scored.dtypes], (F.col("id") < room).alias("kept"))
    return rows.filter(~equal).withColumn("kept", over).select(*scored.columns, "kept").union(alike)


def resample(docs: DataFrame, labels: DataFrame, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """doc_id, log_weight, key, kept of every row; exactly round(share * rows) rows are kept.

    Null and empty texts have no n-gram and weight one; ids may be null; rows
    that repeat an id and a text have one key and stand together in the order,
    so the border can fall among them; an empty table stays empty; other columns
    of docs are not looked at.
    """
    scored = durable(with_weights(docs, durable(fit_ratios(docs, labels, id_col, text_col)), id_col, text_col, seed))
    k = round(share * scored.count())
    return take_largest(scored, k).select("doc_id", "log_weight", "key", "kept")


def op2_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
