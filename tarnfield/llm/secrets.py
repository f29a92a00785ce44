"""Secret scan: fixed patterns plus character Markov models, in DataFrame functions.

Base spans come from three patterns.  The method adds tokens that look random:
of two first-order character models one is counted from labelled random strings
(seeded, of the alphabets that keys are written in) and one from labelled
ordinary identifiers (the corpus's tokens that are put together from words, as
they are and in the ways that programs write names), and a token is a secret if
its mean log-likelihood ratio per transition reaches a threshold.  Counts of
ordinary identifiers cover every text; the model is a table of fixed size that a
scalar subquery hands to the scoring pass, which runs row by row.

Offsets are code points.  Pieces between matches come from split() and the
matches from regexp_extract_all() with the same pattern, so running lengths
give every match its place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfield.llm.common import durable, free_name, let, own_columns, read

#: Fixed patterns. The length limits of hex and access only ever drop whole maximal runs, so they stand in the patterns.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")
LEAST_VALUE = 8

#: Tokens that the models judge, their characters, and the least mean log ratio of a secret.
TOKEN = "[A-Za-z0-9+/_=-]{12,}"
#: Different characters of a judged token, so that rules and fillers are none.
LEAST_DISTINCT = 6
ORDINARY = "^[_/+=-]*+(?:[a-z]{3,}+|[A-Z][a-z]{2,}+|[A-Z]{3,}+)(?:[_/+=-]*+(?:[a-z]{3,}+|[A-Z][a-z]{2,}+))*+[_/+=-]*+$"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SIZE = len(ALPHABET) + 1  # and the start of a token
THRESHOLD = 0.5
#: Weight, in transitions, of what a character's frequency alone says about the one that follows.
PRIOR = 8.0
_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Alphabets of the labelled random strings, and how many of what length are drawn of each.
RANDOM_KINDS = {
    "base62": _UPPER + _LOWER + _DIGITS, "base64": _UPPER + _LOWER + _DIGITS + "+/", "base64url": _UPPER + _LOWER + _DIGITS + "-_", "base32": _UPPER + "234567",
    "lower": _LOWER, "lower and digits": _LOWER + _DIGITS, "upper and digits": _UPPER + _DIGITS, "hex": _DIGITS + "abcdef",
}
SAMPLES, SAMPLE_LENGTH, SEED = 1_000, 32, "random strings"
UNITS = 1_000_000

_SPAN_FIELDS = "struct<start: int, rank: int, end: int, word: string>"
_SPAN = f"array<{_SPAN_FIELDS}>"
#: Elements that one inner pass of running() appends to one array.
_PART = 256
_LAST = (1 << 31) - 1


def running(rows: Column, start: Column, state_type: str, step, out_type: str) -> Column:
    """All outputs of step(state, row) -> (next state, array of outputs) over the array rows, in order.

    An array that grows one by one is copied each time, so outputs are gathered
    in parts: time grows with the number of rows, not with its square.  rows is
    used more than once and should be bound by let().
    """
    kind = f"struct<state: {state_type}, out: array<{out_type}>>"
    parts = f"struct<state: {state_type}, out: array<array<{out_type}>>>"
    empty = lambda t: F.array().cast(f"array<{t}>")

    def add(acc: Column, row: Column) -> Column:
        after, out = step(acc["state"], row)
        return F.struct(after.alias("state"), F.concat(acc["out"], out).alias("out")).cast(kind)

    def part(acc: Column, at: Column) -> Column:
        done = F.aggregate(F.slice(rows, at + 1, F.lit(_PART)), F.struct(acc["state"].alias("state"), empty(out_type).alias("out")).cast(kind), add)
        return let(done, lambda d: F.struct(d["state"].alias("state"), F.concat(acc["out"], F.array(d["out"])).alias("out"))).cast(parts)

    starts = F.when(F.size(rows) > 0, F.sequence(F.lit(0), F.size(rows) - 1, F.lit(_PART))).otherwise(empty("int"))
    zero = F.struct(start.alias("state"), empty(f"array<{out_type}>").alias("out")).cast(parts)
    return F.flatten(F.aggregate(starts, zero, part, lambda acc: acc["out"]))


def _places(text: Column, pattern: str, rank: int, group: int = 0, least: int = 0) -> Column:
    """Spans of pattern's leftmost non-overlapping matches; word is the given group, and matches with a shorter one are dropped."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        a = at + F.length(x["p"])
        b = a + F.length(x["w"])
        one = F.array(F.struct(a.alias("start"), F.lit(rank).alias("rank"), b.alias("end"), x["g"].alias("word")))
        return b, F.when(F.length(x["g"]) >= least, one).otherwise(F.array().cast(_SPAN))

    rows = lambda m: F.arrays_zip(F.slice(m.pieces, F.lit(1), F.size(m.whole)).alias("p"), m.whole.alias("w"), m.inner.alias("g"))
    parts = F.struct(F.split(text, pattern).alias("pieces"), whole.alias("whole"), inner.alias("inner"))
    spans = let(let(parts, rows), lambda r: running(r, F.lit(0), "int", step, _SPAN_FIELDS))
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(_SPAN))


def base_spans(text: Column) -> tuple[Column, Column, Column]:
    return _places(text, ASSIGN, 0, 1, LEAST_VALUE), _places(text, ACCESS, 1), _places(text, HEX, 2)


def _end_mark(rank: int) -> Column:
    return F.array(F.struct(F.lit(_LAST).alias("start"), F.lit(rank).alias("rank"), F.lit(_LAST).alias("end"), F.lit("").alias("word"))).cast(_SPAN)


def _apart(tokens: Column, base: Column) -> Column:
    """The tokens (apart from each other, of the highest rank) that no base span overlaps; one pass over both by start.

    A token is held until the next one comes, and dropped if a base span begins inside it or reached over its start.
    """

    def step(state: Column, x: Column) -> tuple[Column, Column]:
        is_base, held, reach = x["rank"] < 3, state["held"], state["reach"]
        kept = F.when(is_base, F.when(held["end"] > x["start"], None).otherwise(held)).when(reach <= x["start"], x)
        after = F.struct(F.when(is_base, F.greatest(reach, x["end"])).otherwise(reach).alias("reach"), kept.alias("held"))
        return after, F.when(~is_base & held.isNotNull(), F.array(held)).otherwise(F.array().cast(_SPAN))

    state = f"struct<reach: int, held: {_SPAN_FIELDS}>"
    start = F.struct(F.lit(0).alias("reach"), F.lit(None).cast(_SPAN_FIELDS).alias("held"))
    both = F.sort_array(F.concat(base, tokens, _end_mark(3)))
    return F.when((F.size(tokens) == 0) | (F.size(base) == 0), tokens).otherwise(let(both, lambda r: running(r, start, state, step, _SPAN_FIELDS)))


def _cells(word: Column) -> Column:
    """Numbers of a token's transitions: previous character times SIZE plus character, the start counting as zero."""
    at = lambda c: F.instr(F.lit(ALPHABET), c)
    chars = F.filter(F.split(word, ""), lambda c: c != "")
    return let(chars, lambda w: F.transform(w, lambda c, i: F.when(i > 0, at(F.get(w, i - 1))).otherwise(0) * SIZE + at(c)))


def _found(docs: DataFrame, text_col: str) -> tuple[DataFrame, dict[str, str]]:
    """docs with helper columns, and their names: the base spans assign, access and hex, and tokens: judged tokens apart from them."""
    names = {n: free_name(n, docs) for n in ("whole_text", "assign", "access", "hex", "every_token", "tokens")}
    rows = docs.withColumn(names["whole_text"], F.coalesce(F.col(text_col), F.lit("")))
    text = F.col(names["whole_text"])
    spans = dict(zip(("assign", "access", "hex"), base_spans(text)))
    rows = rows.withColumns({names[n]: c for n, c in spans.items()} | {names["every_token"]: _places(text, TOKEN, 3)})
    base = F.concat(*[F.col(names[n]) for n in spans])
    several = lambda w: F.size(F.array_distinct(F.filter(F.split(w, ""), lambda c: c != ""))) >= LEAST_DISTINCT
    lettered = F.filter(names["every_token"], lambda x: x["word"].rlike("[A-Za-z]") & several(x["word"]))
    both = F.struct(lettered.alias("tokens"), base.alias("base"))
    return rows.withColumn(names["tokens"], let(both, lambda m: _apart(m["tokens"], m["base"]))), names


def _ordinary(x: Column) -> Column:
    """Whether a token is put together from words of three letters or more in one case or capitalised; random strings hardly ever are."""
    return x["word"].rlike(ORDINARY)


def written_names(word: Column) -> Column:
    """An ordinary token, and its parts of three to six letters as names: with low lines, in camel case, capitalised, as a path, with hyphens, in capitals, numbered; some others end in digits too."""
    parts = F.regexp_extract_all(F.lower(word), F.lit("[a-z]{3,6}"), F.lit(0))

    def names(p: Column) -> Column:
        number = F.pmod(F.xxhash64(word), F.lit(200))
        ending = F.when(number < 100, number.cast("string")).otherwise("")
        capitalised = F.transform(p, lambda x: F.initcap(x))
        snake = F.array_join(p, "_")
        camel = F.concat(F.get(p, 0), F.array_join(F.slice(capitalised, F.lit(2), F.size(p)), ""), ending)
        return F.array(word, F.concat(snake, ending), camel, F.array_join(capitalised, ""), F.array_join(p, "/"), F.array_join(p, "-"), F.upper(snake), F.concat_ws("_", F.get(p, 0), F.get(p, 1), number.cast("string")))

    return let(parts, names)


def random_samples(spark: SparkSession) -> DataFrame:
    """(word): SAMPLES labelled random strings of each of RANDOM_KINDS, always the same ones."""
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(a).alias("letters")) for k, a in RANDOM_KINDS.items()]))
    rows = spark.range(SAMPLES).select("id", kinds.alias("k")).select("id", "k.*")
    draw = lambda j: F.pmod(F.xxhash64(F.concat_ws(":", F.lit(SEED), "kind", F.col("id").cast("string"), j.cast("string"))), F.length("letters")).cast("int")
    letter = lambda j: F.substr("letters", draw(j) + 1, F.lit(1))
    return rows.select(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(SAMPLE_LENGTH)), letter), "").alias("word"))


def fit_ratios(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row: ratios, SIZE * SIZE integers, log(random / ordinary) of each transition in UNITS.

    Ordinary tokens of all texts count as often as they occur.  A transition's
    share is smoothed towards the frequency of its second character (raised by
    one half), so that rows with few samples do not look alike in both models;
    without any ordinary token all ratios are zero.
    """
    rows, names = _found(docs.select(text_col), text_col)
    ordinary = rows.select(F.explode(F.filter(names["tokens"], _ordinary)).alias("s")).groupBy(F.col("s.word").alias("word")).agg(F.count("*").alias("n"))
    words = ordinary.select(F.explode(written_names(F.col("word"))).alias("word"), F.col("n").alias("ordinary"), F.lit(0).cast("long").alias("random"))
    words = words.unionByName(random_samples(docs.sparkSession).select("word", F.lit(0).cast("long").alias("ordinary"), F.lit(1).cast("long").alias("random")))
    cells = words.filter("word <> ''").select(F.explode(_cells(F.col("word"))).alias("cell"), "random", "ordinary")
    counts = durable(cells.groupBy("cell").agg(F.sum("random").alias("random"), F.sum("ordinary").alias("ordinary")))

    every = counts.sparkSession.range(SIZE * SIZE).select(F.col("id").cast("int").alias("cell"))
    full = every.join(F.broadcast(counts), "cell", "left").na.fill(0, ["random", "ordinary"])  # SIZE * SIZE rows
    full = full.withColumns({"first": (F.col("cell") / SIZE).cast("int"), "second": F.col("cell") % SIZE})
    joined = full
    for by in ("first", "second"):  # SIZE rows each
        sums = full.groupBy(by).agg(F.sum("random").alias(f"random_{by}"), F.sum("ordinary").alias(f"ordinary_{by}"))
        joined = joined.join(F.broadcast(sums), by)
    whole = {n: counts.agg(F.coalesce(F.sum(n), F.lit(0))).scalar() for n in ("random", "ordinary")}
    joined = joined.withColumns({f"{n}_all": c for n, c in whole.items()})

    def share(n: str) -> Column:
        alone = (F.col(f"{n}_second") + 0.5) / (F.col(f"{n}_all") + 0.5 * SIZE)
        return (F.col(n) + PRIOR * alone) / (F.col(f"{n}_first") + PRIOR)

    ratio = F.round(F.log(share("random") / share("ordinary")) * UNITS).cast("long")
    listed = joined.agg(F.sort_array(F.collect_list(F.struct("cell", ratio.alias("ratio")))).alias("all"), F.sum("ordinary").alias("n"))
    return listed.select(F.transform("all", lambda x: F.when(F.col("n") > 0, x["ratio"]).otherwise(F.lit(0).cast("long"))).alias("ratios"))


def scan(docs: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, spans_col: str = "secrets") -> DataFrame:
    """docs with a column `spans_col` (in place of one of that name): spans {start, rank, end, word} by start and kind; rank counts KINDS.

    Null counts as the empty text; texts without a match have an empty list;
    repeated rows are scanned each; other columns stay as they are; an empty
    table stays empty; time grows with the number of matches of a text.
    """
    ratios = durable(fit_ratios(docs, text_col)).scalar()
    table = free_name("ratios", docs)
    rows, names = _found(docs.withColumn(table, ratios), text_col)

    def random_ones(m: Column) -> Column:
        def mean(x: Column) -> Column:
            total = F.aggregate(_cells(x["word"]), F.lit(0).cast("long"), lambda a, c: a + F.get(m.r, c))
            return total / F.length(x["word"]) / UNITS

        return F.filter(m.tokens, lambda x: mean(x) >= threshold)

    added = let(F.struct(F.col(table).alias("r"), F.col(names["tokens"]).alias("tokens")), random_ones)
    every = F.concat(*[F.col(names[n]) for n in ("assign", "access", "hex")], added)
    return rows.withColumn(free_name("found", rows), F.sort_array(every)).select(
        *[c for c, n in zip(own_columns(docs), docs.columns) if n.lower() != spans_col.lower()], F.col(free_name("found", rows)).alias(spans_col)
    )


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", threshold: float = THRESHOLD) -> DataFrame:
    """docs with every secret span of the text replaced by mark; overlapping spans give one mark.

    Null texts stay null and texts without a secret stay as they are; rows,
    their repeats and all other columns, whatever their names, stay too.
    """
    text, spans = F.col(text_col), free_name("secrets", docs)

    def step(now: Column, x: Column) -> tuple[Column, Column]:
        apart = x["start"] >= now["end"]
        joined = F.struct(now["start"].alias("start"), F.greatest(now["end"], x["end"]).alias("end"))
        after = F.when(apart, F.struct(x["start"].alias("start"), x["end"].alias("end"))).otherwise(joined)
        return after, F.when(apart & (now["end"] > 0), F.array(now)).otherwise(F.array().cast("array<struct<start: int, end: int>>"))

    def rebuilt(m: Column) -> Column:
        """Text around the spans m, which are in order and apart, cut in parts so that no cut reads the whole text."""

        def part(at: Column) -> Column:
            some = F.slice(m, at + 1, F.lit(_PART))
            before = F.when(at > 0, F.get(m, at - 1)["end"]).otherwise(0)
            own = F.struct(some.alias("s"), before.alias("a"), F.substr(text, before + 1, F.element_at(some, -1)["end"] - before).alias("t"))

            def cut(q: Column) -> Column:
                left = lambda i: F.when(i > 0, F.get(q["s"], i - 1)["end"]).otherwise(q["a"])
                return F.array_join(F.transform(q["s"], lambda x, i: F.concat(F.substr(q["t"], left(i) - q["a"] + 1, x["start"] - left(i)), F.lit(mark))), "")

            return let(own, cut)

        parts = F.transform(F.sequence(F.lit(0), F.size(m) - 1, F.lit(_PART)), part)
        return F.concat(F.array_join(parts, ""), F.substr(text, F.element_at(m, -1)["end"] + 1))

    scanned = scan(docs, text_col, threshold, spans)
    state = "struct<start: int, end: int>"
    start = F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"))
    whole = lambda rows: running(rows, start, state, step, state)
    new = F.when(F.size(spans) > 0, let(let(F.concat(spans, _end_mark(0)), whole), rebuilt)).otherwise(text)
    return scanned.withColumn(text_col, new).select(*own_columns(docs))


def span_text(spans: Column) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    one = lambda x: F.concat_ws(":", F.get(kinds, x["rank"]), x["start"].cast("string"), x["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    number = lambda rank: F.size(F.filter("secrets", lambda x: x["rank"] == rank)).cast("long")
    return found.select(
        "doc_id",
        number(0).alias("n_assign"),
        number(1).alias("n_access"),
        number(2).alias("n_hex"),
        F.sha2(span_text(F.filter("secrets", lambda x: x["rank"] < 3)), 256).alias("base_sha256"),
        span_text(F.col("secrets")).alias("spans"),
    )
