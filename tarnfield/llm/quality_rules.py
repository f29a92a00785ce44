"""Quality rules: fixed base rules and a length-normalised n-gram log-likelihood ratio.

Two multinomials over hashed word unigrams and bigrams are compared: one of
trusted text (documents labelled as good), one of the whole raw corpus.  A
document's score is the mean log ratio over its n-grams; it is kept if no base
rule fails and the score reaches a fixed threshold.  DataFrame functions only:
the corpus is counted in one pass into a table of fixed size, and a scalar
subquery hands that table to a second, shuffle-free pass over the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfield.llm.common import count_chars, durable, free_name, let, own_columns, pieces_of, read, words_of

BUCKETS = 1 << 14
#: Bound on the trusted documents that the target multinomial is fitted on; the raw counts cover all documents.
TRUSTED_LIMIT = 20_000
#: Mean log ratio per n-gram from which a document is kept.
THRESHOLD = -0.08
#: Ratios are held as integers in these units, so that sums do not depend on their order.
UNITS = 1_000_000

MIN_WORDS = 50
SYMBOLS = "#*$%&|<>"


def _bucket(*words: Column) -> Column:
    return F.pmod(F.xxhash64(*words), F.lit(BUCKETS)).cast("int")


def _grams(w: Column) -> Column:
    """Buckets of a word array's unigrams and bigrams."""
    one = F.transform(w, lambda x: _bucket(x))
    two = F.transform(w, lambda x, i: F.when(i > 0, _bucket(F.get(w, i - 1), x)))
    return F.concat(one, F.array_compact(two))


def _repeated_words(g: Column) -> Column:
    """Words covered by 3-word windows that occur twice or more; g: the windows' hashes in text order.

    Windows count as equal when their 64-bit hashes are; two of a text's n windows collide with a chance below n * n / 2**65.
    """

    def width(starts: Column) -> Column:
        gaps = F.transform(starts, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(starts, i + 1) - x, F.lit(3))))
        return F.aggregate(gaps, F.lit(0), lambda total, x: total + x)

    def few(twice: Column) -> Column:
        return let(F.array_compact(F.transform(g, lambda h, i: F.when(F.array_contains(twice, h), i))), width)

    def many(pairs: Column) -> Column:
        same = F.transform(pairs, lambda x, i: F.when((F.get(pairs, i - 1).h == x.h) | (F.get(pairs, i + 1).h == x.h), x.i))
        return let(F.sort_array(F.array_compact(same)), width)

    in_order = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    by_number = lambda twice: F.when(F.size(twice) <= 8, few(twice)).otherwise(let(in_order, many))
    twice = lambda s: let(F.array_distinct(F.filter(s, lambda h, i: h == F.get(s, i - 1))), by_number)
    return F.when(F.size(F.array_distinct(g)) < F.size(g), let(F.sort_array(g), twice)).otherwise(0)


def base_rules(text: Column, pieces: Column, w: Column) -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text, its pieces and its words."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    windows = F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    windows = F.slice(windows, F.lit(1), F.size(w) - 2)  # the last two are too short
    return {
        "n_words": F.size(w).cast("long"),
        "word_chars": (F.length(text) - (F.size(pieces) - 1)).cast("long"),
        "n_symbols": F.when(text.rlike(f"[{SYMBOLS}]"), count_chars(text, SYMBOLS)).otherwise(0).cast("long"),
        "n_dup_lines": F.when(F.contains(text, F.lit("\n")), let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))).otherwise(0).cast("long"),
        "n_repeat_words": F.when(F.size(w) >= 3, let(windows, _repeated_words)).otherwise(0).cast("long"),
    }


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > 50 * n_words)


def trusted_ids(labels: DataFrame, limit: int = TRUSTED_LIMIT) -> DataFrame:
    """Up to limit ids labelled as good, in the order of a hash of the id, so that the choice never changes."""
    good = labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("trusted_id")).distinct()
    return good.orderBy(F.xxhash64(F.col("trusted_id").cast("string")), "trusted_id").limit(limit)


def fit_ratios(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row: ratios, an array of BUCKETS integers, log(target share / raw share) of each bucket in UNITS.

    Counts are raised by one in both multinomials.  Without trusted documents all ratios are zero.
    """
    trusted = F.broadcast(durable(trusted_ids(labels)))  # at most TRUSTED_LIMIT ids
    rows = docs.select(F.col(id_col).alias("id"), words_of(F.col(text_col)).alias("w"))
    rows = rows.join(trusted, rows["id"] == trusted["trusted_id"], "left")
    counts = (
        rows.select(F.col("trusted_id").isNotNull().cast("long").alias("t"), F.explode(_grams(F.col("w"))).alias("bucket"))
        .groupBy("bucket")
        .agg(F.count("*").alias("raw"), F.sum("t").alias("target"))
    )
    return ratios_from_counts(durable(counts))


def ratios_from_counts(counts: DataFrame) -> DataFrame:
    every = counts.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    full = every.join(F.broadcast(counts), "bucket", "left").na.fill(0, ["raw", "target"])  # BUCKETS rows
    whole = full.withColumns({n: counts.agg(F.coalesce(F.sum(c), F.lit(0))).scalar() for n, c in (("n_raw", "raw"), ("n_target", "target"))})
    share = lambda c, n: (F.col(c) + 1) / (F.col(n) + BUCKETS)
    ratio = F.when(F.col("n_target") > 0, F.round(F.log(share("target", "n_target") / share("raw", "n_raw")) * UNITS)).otherwise(0)
    listed = whole.select("bucket", ratio.cast("long").alias("ratio")).agg(F.sort_array(F.collect_list(F.struct("bucket", "ratio"))).alias("all"))
    return listed.select(F.transform("all", lambda x: x["ratio"]).alias("ratios"))


def judge(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, verdict_col: str = "verdict"
) -> DataFrame:
    """docs with a struct column `verdict_col` (in place of one of that name): the base counts, base_failed, score and kept.

    Null and empty texts have no words and fail the base rules with a score of
    zero; repeated rows get the same verdict each; ids may be null; all other
    columns stay; an empty table stays empty.  Texts are read whole, however long.
    """
    ratios = durable(fit_ratios(docs, labels, id_col, text_col)).scalar()
    table = free_name("ratios", docs)
    text = F.coalesce(F.col(text_col), F.lit(""))

    # all of it is bound by let(): a filter on the verdict may be pushed into the scan's stage with its
    # whole expression, and must not make the words again for each of them
    def of_words(m: Column) -> Column:
        w = m.w

        def step(x: Column, i: Column) -> Column:
            pair = F.when(i > 0, F.get(m.r, _bucket(F.get(w, i - 1), x))).otherwise(0)
            return F.get(m.r, _bucket(x)) + pair

        total = F.aggregate(F.transform(w, step), F.lit(0).cast("long"), lambda a, x: a + x)
        score = total / F.greatest(2 * F.size(w) - 1, F.lit(1)) / UNITS
        counts = base_rules(m.t, m.p, w)
        return F.struct(*[c.alias(n) for n, c in counts.items()], score.alias("score"))

    def of_counts(j: Column) -> Column:
        fails = base_failed(j["n_words"], j["n_repeat_words"])
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        return F.struct(*[j[n].alias(n) for n in names], fails.alias("base_failed"), (~fails & (j["score"] >= threshold)).alias("kept"), j["score"].alias("score"))

    cut = F.struct(text.alias("t"), pieces_of(F.col(text_col)).alias("p"), F.col(table).alias("r"))
    bound = lambda m: let(F.struct(m.t.alias("t"), m.p.alias("p"), m.r.alias("r"), F.array_remove(m.p, "").alias("w")), of_words)
    return docs.withColumn(table, ratios).withColumn(verdict_col, let(let(cut, bound), of_counts)).drop(table)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose verdict is kept, with docs' own columns whatever their names."""
    verdict = free_name("verdict", docs)
    judged = judge(docs, labels, id_col, text_col, threshold, verdict)
    return judged.filter(F.col(verdict)["kept"]).select(*own_columns(docs))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"))
    return judged.select("doc_id", "verdict.*")
