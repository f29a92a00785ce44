"""Benchmark decontamination by template canonicalisation, in DataFrame functions.

Numbers, names and units of a text are replaced by typed placeholders, so that
a question asked again with other values has the same template.  Windows of
template tokens are hashed and joined; a document leaks an item if at least
half of the item's windows occur in it and the values in their slots fit: along
one alignment an item's value meets the document value that it meets at most
places, and two names do not fall together.  A window that holds another value
is not counted, unless all its values are the item's own.  Equal numbers before
different words play different roles and may become different numbers.

Windows lie at every place of items and documents.  A window says little where
it holds fewer than two different words besides placeholders, or where its
template comes twice in its item (a table of numbers, a list): such *weak*
windows must occur word for word, so that no table meets every other one at all
places.  A document's window that comes again word for word counts at its first
place.  So a document has at most one row for each of its windows and each item
that holds it.

An item of fewer tokens than a window says too little wherever it stands: it is
leaked by a document that has it as a whole line, word for word.  Items of fewer
than LEAST_TOKENS tokens, such as single answers, are not judged at all;
unjudged_items() names them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnfield.llm.common import durable, free_name, own_columns, read, sized_broadcast

WINDOW = 8
COVERAGE = 0.5
#: Tokens of an item from which on it is judged.
LEAST_TOKENS = 3
#: Different words besides placeholders from which a window can be matched by its template.
LEAST_WORDS = 2

#: Units of measure and currencies that make a slot after a number.
UNITS = (
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers "
    "mg g kg lb lbs oz ounce ounces gram grams kilogram kilograms pound pounds ton tons ml l liter liters litre litres gallon gallons "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "percent pct usd eur dollar dollars euro euros cent cents degree degrees mph kmh w kw v hz mb gb tb"
).split()

_NUMBER, _NAME, _UNIT = "#n", "#p", "#u"


def tokens(text: Column) -> tuple[Column, Column]:
    """(raw, template) token arrays of equal length; a name is a capitalised word inside a sentence."""
    marked = F.replace(F.coalesce(text, F.lit("")), F.lit("\x01"), F.lit(" "))
    # every pattern starts with what is rare, so that most characters fail on one test
    marked = F.regexp_replace(marked, " (?<=[\\p{Ll}\\p{N},;:] )(?=\\p{Lu}\\p{Ll})", " \x01")
    other = "[^\\p{L}\\p{N}\x01]"
    plain = F.trim(F.regexp_replace(marked, f"{other}(?<![0-9][.,:/](?=[0-9])){other}*", " "))
    template = F.regexp_replace(plain, "\x01[^ ]+", _NAME)
    template = F.regexp_replace(template, "[0-9](?<![^ ].)[^ ]*", _NUMBER)
    template = F.regexp_replace(template, f"{_NUMBER} (?i:{'|'.join(UNITS)})(?= |$)", f"{_NUMBER} {_UNIT}")
    cut = lambda x: F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(x, " "))
    return cut(F.replace(plain, F.lit("\x01"), F.lit(""))), cut(F.lower(template))


def _hashes(template: Column, width: int) -> Column:
    """(pos, hash) of the template windows at every place."""
    last = F.size(template) - width
    return F.when(
        last >= 0,
        F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("pos"), F.xxhash64(F.slice(template, i + 1, width)).alias("hash"))),
    ).otherwise(F.array().cast("array<struct<pos: int, hash: bigint>>"))


def _lower(words: Column) -> Column:
    return F.transform(words, lambda x: F.lower(x))


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """item_id, width, places, hash, weak, braw, brole, btemplate: all windows of every item that has so many tokens.

    braw is in lower case; places are those of a window in its item, of which
    only weak ones have several.  An item is read three ways, since a document
    may hold it inside a sentence (its first word then looks like a name) or
    without capitals.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    inside = [F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0))) for x in tokens(F.concat(F.lit("a "), F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1 << 30)))]
    readings = F.array(*[F.struct(raw.alias("raw"), template.alias("template")) for raw, template in (tokens(text), inside, tokens(F.lower(text)))])
    rows = items.select(F.col(id_col).alias("item_id"), F.explode(readings).alias("x")).select("item_id", "x.*").filter(F.size("template") >= window)
    rows = rows.withColumn("raw", _lower(F.col("raw")))
    # what must meet one value only: a name or unit, a number with the word after it
    role = F.transform("template", lambda x, i: F.when(x == _NUMBER, F.concat_ws(" ", F.get("raw", i), F.get("raw", i + 1))).otherwise(F.get("raw", i)))
    rows = rows.withColumn("role", role).withColumn("width", F.lit(window))
    places = F.sequence(F.lit(0), F.size("template") - F.col("width"))
    rows = rows.withColumn("bpos", F.explode(places))
    piece = lambda c: F.slice(c, F.col("bpos") + 1, F.col("width"))
    rows = rows.select("item_id", "width", "bpos", F.xxhash64(piece("template")).alias("hash"), piece("raw").alias("braw"), piece("role").alias("brole"), piece("template").alias("btemplate"))
    rows = rows.groupBy("item_id", "width", "hash", "btemplate", "bpos", "braw").agg(F.min("brole").alias("brole"))
    again = rows.groupBy("item_id", "width", "hash", "btemplate").agg(F.countDistinct("bpos").alias("times"))
    words = F.array_distinct(F.filter("btemplate", lambda x: ~x.isin(_NUMBER, _NAME, _UNIT)))
    weak = (F.size(words) < LEAST_WORDS) | (F.col("times") > 1)
    rows = rows.join(again, ["item_id", "width", "hash", "btemplate"]).withColumn("weak", weak)
    return rows.groupBy("item_id", "width", "hash", "btemplate", "braw", "weak").agg(F.array_sort(F.collect_set("bpos")).alias("places"), F.min("brole").alias("brole"))


def _item_words(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, words): the tokens of each item in lower case."""
    return items.select(F.col(id_col).alias("item_id"), _lower(tokens(F.col(text_col))[0]).alias("words"))


def unjudged_items(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id of the items that no document is held to leak: those of fewer than LEAST_TOKENS tokens, null and empty ones among them."""
    return _item_words(items, id_col, text_col).filter(F.size("words") < LEAST_TOKENS).select("item_id")


def _whole_lines(rows: DataFrame, short: DataFrame) -> DataFrame:
    """(key, doc_id, item_id) of rows(key, doc_id, text) that have an item of short(item_id, words) as a whole line."""
    lines = rows.select("key", "doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line"))
    lines = lines.select("key", "doc_id", _lower(tokens(F.col("line"))[0]).alias("words"))
    asked = short.select("item_id", F.col("words").alias("own"))
    met = lines.join(sized_broadcast(asked), F.xxhash64("words") == F.xxhash64("own")).filter(F.col("words") == F.col("own"))
    return met.select("key", "doc_id", "item_id").distinct()


def _key(id_col: str, text_col: str) -> Column:
    """One number for an id and a text; rows that repeat both share it."""
    return F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(id_col).isNull().cast("string"), F.coalesce(F.col(text_col), F.lit("")))


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    coverage: float = COVERAGE,
) -> DataFrame:
    """key, doc_id, item_id, n_windows, n_found, coverage, reparameterised for each document and item that it leaks.

    Null and empty texts leak nothing, and items of fewer than LEAST_TOKENS
    tokens, null and empty ones too, are never leaked; rows that repeat an id and a text give one result; items that
    repeat an id count as one with the windows of both.  An empty benchmark or
    an empty table gives an empty result.  Texts are read whole, however long;
    other columns of docs and items are not looked at.
    """
    bench = durable(item_windows(items, item_id_col, item_text_col, window))
    widths = [r["width"] for r in bench.select("width").distinct().collect()]  # at most `window` numbers
    rows = docs.select(_key(id_col, text_col).alias("key"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    _, template = tokens(F.col("text"))
    sketch = rows.select("key", template.alias("template"))
    none = F.array().cast("array<struct<pos: int, hash: bigint>>")
    probes = sketch.select("key", F.explode(F.concat(none, *[_hashes(F.col("template"), w) for w in widths])).alias("p")).select("key", "p.hash")
    suspects = durable(probes.join(sized_broadcast(durable(bench.select("hash").distinct())), "hash", "left_semi").select("key").distinct())

    near = rows.join(sized_broadcast(suspects), "key", "left_semi").dropDuplicates(["key"])
    raw, template = tokens(F.col("text"))
    near = near.select("key", "doc_id", _lower(raw).alias("raw"), template.alias("template"))
    wide = "array<struct<width: int, pos: int, hash: bigint>>"
    of_width = lambda w: F.transform(_hashes(F.col("template"), w), lambda x: F.struct(F.lit(w).alias("width"), x["pos"].alias("pos"), x["hash"].alias("hash")))
    every = [of_width(w) for w in widths]
    places = near.select("key", "doc_id", "raw", "template", F.explode(F.concat(F.array().cast(wide), *every)).alias("p"))
    piece = lambda c: F.slice(c, F.col("p.pos") + 1, F.col("p.width"))
    places = places.select("key", "doc_id", F.col("p.width").alias("width"), F.col("p.pos").alias("pos"), F.col("p.hash").alias("hash"), piece("raw").alias("raw"), piece("template").alias("template"))
    # a weak window is met by its words: the table of windows has one row for a template, or one for each wording of it
    whole = bench.withColumn("wording", F.when(F.col("weak"), F.xxhash64("braw")).otherwise(F.lit(0).cast("long")))
    asked = places.withColumn("wording", F.explode(F.array(F.lit(0).cast("long"), F.xxhash64("raw"))))
    met = asked.join(sized_broadcast(durable(whole)), ["width", "hash", "wording"]).filter("template = btemplate and (not weak or raw = braw)")
    alike = ["key", "doc_id", "item_id", "weak", "places", "braw", "brole", "template", "raw"]
    first = durable(met.groupBy(*alike).agg(F.min("pos").alias("pos")))
    strong = first.filter("not weak").withColumn("bpos", F.get("places", 0))
    found = strong.select("key", "doc_id", "item_id", "bpos", (F.col("pos") - F.col("bpos")).alias("shift"), "raw", "braw", "brole", "template")
    zipped = F.arrays_zip(F.col("template").alias("kind"), F.col("brole").alias("item"), F.col("braw").alias("own"), F.col("raw").alias("doc"))
    placed = F.transform(zipped, lambda x, i: F.struct((F.col("bpos") + i).alias("at"), x["kind"].alias("kind"), x["item"].alias("item"), x["own"].alias("own"), x["doc"].alias("doc")))
    found = found.withColumn("slots", F.filter(placed, lambda x: x["kind"].isin(_NUMBER, _NAME, _UNIT)))
    found = found.withColumn("verbatim", F.forall("slots", lambda x: x["own"] == x["doc"]))
    window_of = ["key", "item_id", "shift", "bpos", "tag"]
    found = durable(found.select("doc_id", "key", "item_id", "shift", "bpos", F.xxhash64("raw", "braw").alias("tag"), "slots", "verbatim"))

    # slots: along one alignment (shift) a value of the item goes with what it meets at most places, its own value among equals
    slots = found.select(*window_of, "verbatim", F.explode("slots").alias("s")).select(*window_of, "verbatim", "s.*")
    pair = ["key", "item_id", "shift", "kind", "item", "doc"]
    pairs = slots.groupBy(*pair).agg((2 * F.countDistinct("at") + F.max((F.col("own") == F.col("doc")).cast("int"))).alias("weight"))
    by_item, by_doc = (Window.partitionBy("key", "item_id", "shift", "kind", c) for c in ("item", "doc"))
    for name, by in (("of_item", by_item), ("of_doc", by_doc)):
        pairs = pairs.withColumn("best", F.max("weight").over(by)).withColumn(name, (F.col("weight") == F.col("best")) & (F.sum((F.col("weight") == F.col("best")).cast("int")).over(by) == 1))
    clash = pairs.filter(~F.col("of_item") | (F.col("kind") == _NAME) & ~F.col("of_doc")).select(*pair)
    broken = slots.filter("not verbatim").join(clash, pair, "left_semi").select(*window_of).distinct()
    changed = slots.filter("own <> doc").select("key", "item_id", F.lit(True).alias("changed")).distinct()

    total = bench.select("item_id", F.explode("places").alias("bpos")).groupBy("item_id").agg(F.countDistinct("bpos").alias("n_windows"))
    good = found.join(broken, window_of, "left_anti").select("key", "doc_id", "item_id", "bpos")
    good = good.union(first.filter("weak").select("key", "doc_id", "item_id", F.explode("places")))
    counted = good.groupBy("key", "doc_id", "item_id").agg(F.countDistinct("bpos").alias("n_found"))
    scored = counted.join(sized_broadcast(durable(total)), "item_id").join(changed, ["key", "item_id"], "left")
    share = F.col("n_found") / F.col("n_windows")
    leaks = scored.filter(share >= coverage).select(
        "key", "doc_id", "item_id", "n_windows", "n_found", F.round(share, 6).alias("coverage"), F.coalesce("changed", F.lit(False)).alias("reparameterised")
    )
    short = _item_words(items, item_id_col, item_text_col).filter((F.size("words") >= LEAST_TOKENS) & (F.size("words") < window)).filter("item_id is not null")
    short = durable(short)
    if short.isEmpty():
        return leaks
    one = F.lit(1).cast("long")
    lines = _whole_lines(rows, short).select("key", "doc_id", "item_id", one.alias("n_windows"), one.alias("n_found"), F.lit(1.0).alias("coverage"), F.lit(False).alias("reparameterised"))
    return leaks.unionByName(lines)


def remove_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns kept whatever their names, that leak no item; rows with null or empty texts and repeats stay."""
    leak, own = free_name("leak", docs), free_name("own_key", docs)
    leaks = durable(find_leaks(docs, items, id_col, text_col).select(F.col("key").alias(leak)).distinct())
    marked = docs.withColumn(own, _key(id_col, text_col))
    return marked.join(sized_broadcast(leaks), F.col(own) == F.col(leak), "left_anti").select(*own_columns(docs))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("key")
