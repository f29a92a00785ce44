"""Index tables of a chunked corpus: postings of two fields, structural terms, and statistics.

A chunk's content is its path and text; its metadata is what its whole file has
(path, module, imports and calls) and its own symbols.  The file's part is kept
once for a file, however many chunks it has; a chunk's postings hold its content
and its own symbols, and how often its file has the same term, so that scores
add up.

Tables lie in buckets by file_no and part (at most PART chunks of a file), so
that scores are summed up, and the best chunks of a query chosen, where the
postings lie.  file_no counts files in the order of their paths, so that order
is a comparison of numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfield.functions.paths import is_test_path, path_parts
from tarnfield.functions.text import let
from tarnfield.functions.tokens import tokenize
from tarnfield.operators.facts import FACTS, chunk_symbols, structural_terms, symbol_words
from tarnfield.sources.scratch import durable, durable_buckets, sized_broadcast

CHUNK = ["corpus_id", "file_path", "chunk_no"]
EPSILON = 0.25
#: A user's own tokens, or tokenize() with other options by functools.partial.
Tokenizer = Callable[[Column], Column]

#: A line that begins with class, def or async def, and the name after it.
SYMBOL_LINE = "(?md)^\\s*(class|def|async\\s+def)\\s+([A-Za-z_][A-Za-z_0-9]*)"


#: Chunks of a file that lie together; a larger file is spread over several parts.
PART = 4096
PLACE = ["file_no", "part", "chunk_no"]
TEXT = "text"
#: Postings of a bucket lie in the order of bands, hash ranges of corpus, kind and term, in pages of so many rows; a search reads the pages of its terms' bands.
BANDS = 1 << 14
PAGE_ROWS = 2048


@dataclass(frozen=True)
class Index:
    """chunks: keys, lines, place and lengths of each chunk; family stands for the file_key.

    postings: by kind and term, sorted by band in each bucket, or made of counts and others where they are asked for.  Of kind TEXT are content frequency of each term
    of a chunk, its frequency in the chunk's own symbols (own_tf) and in what all
    of its file has (file_tf); the latter stands once for each part of a file,
    in a row without chunk_no.  Other kinds are structural terms, of chunks and
    in such rows of files.  parts: the chunks of each part with their lengths;
    terms: df and idf of both fields; corpora: size, mean lengths, and the most
    parts that a file_key has.  counts: each chunk's postings of kind TEXT as an
    array; others: all other postings.
    """

    chunks: DataFrame
    postings: DataFrame
    parts: DataFrame
    terms: DataFrame
    corpora: DataFrame
    counts: DataFrame
    others: DataFrame

    def postings_of(self, places: DataFrame) -> DataFrame:
        """The postings of few chunks, given by place, and of their files' parts."""
        places = durable(places.select(*PLACE).distinct())
        few, parts = sized_broadcast(places), sized_broadcast(durable(places.select(*PLACE[:2]).distinct()))
        own = self.counts.join(few, PLACE, "left_semi")
        return chunk_postings(own).unionByName(self.others.join(parts, PLACE[:2], "left_semi"), allowMissingColumns=True)

    def tables(self) -> dict[str, DataFrame]:
        return dict(vars(self))


def band() -> Column:
    """The band of a term of a kind in a corpus."""
    return F.pmod(F.xxhash64("corpus_id", "kind", "term"), F.lit(BANDS)).cast("int").alias("band")


def in_path_order(files: DataFrame) -> DataFrame:
    """files with file_no, numbers that grow with corpus and path (by its parts); store what is made of it."""
    order = ["corpus_id", path_parts(F.col("file_path")), "file_path"]
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("file_no", F.monotonically_increasing_id())


def term_counts(content: Column, metadata: Column) -> Column:
    """(term, content_tf, metadata_tf) of the distinct terms of two token arrays, by one sort."""
    tagged = lambda tokens, f: F.transform(tokens, lambda t: F.struct(t.alias("t"), F.lit(f).alias("f")))

    def of_sorted(s: Column) -> Column:
        starts = F.array_compact(F.transform(s, lambda x, i: F.when((i == 0) | (F.get(s, i - 1)["t"] != x["t"]), i)))

        def of_starts(b: Column) -> Column:
            def one(at: Column, k: Column) -> Column:
                size = F.coalesce(F.get(b, k + 1), F.size(s)) - at
                n = F.when(size == 1, F.get(s, at)["f"]).otherwise(F.size(F.filter(F.slice(s, at + 1, size), lambda x: x["f"] == 1)))
                return F.struct(F.get(s, at)["t"].alias("term"), (size - n).cast("long").alias("content_tf"), n.cast("long").alias("metadata_tf"))

            return F.transform(b, one)

        return let(starts, of_starts)

    return let(F.sort_array(F.concat(tagged(content, 0), tagged(metadata, 1))), of_sorted)


#: A posting of kind TEXT, which has the number 0, in a chunk's array of counts.
_COUNT = "struct<kind_no: int, term: string, content_tf: bigint, own_tf: bigint, file_tf: bigint>"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with token lists content and own, and file_counts(term, tf): the lists become their lengths and one array of counts of distinct terms."""
    for batch in batches:
        lists = [batch.column(n) for n in ("content", "own", "file_counts")]
        sizes = [pc.fill_null(pc.list_value_length(x), 0).to_numpy() for x in lists]
        tokens = [lists[0].flatten(), lists[1].flatten(), lists[2].flatten().field("term")]
        known = pa.concat_arrays(tokens).dictionary_encode()
        width, n = max(len(known.dictionary), 1), batch.num_rows
        key = np.concatenate([np.repeat(np.arange(n), x) for x in sizes]) * width + known.indices.to_numpy()
        content, own, in_file = np.split(key, np.cumsum([len(tokens[0]), len(tokens[1])]))
        distinct, at = np.unique(np.concatenate([content, own]), return_inverse=True)
        tf = [np.bincount(at[: len(content)], minlength=len(distinct)), np.bincount(at[len(content) :], minlength=len(distinct)), np.zeros(len(distinct), np.int64)]
        if len(in_file) and len(distinct):
            spot = np.minimum(np.searchsorted(distinct, in_file), len(distinct) - 1)
            met = distinct[spot] == in_file
            tf[2][spot[met]] = lists[2].flatten().field("tf").to_numpy()[met]
        row, code = np.divmod(distinct, width)
        counts = [pa.array(np.zeros(len(distinct), np.int32)), known.dictionary.take(pa.array(code)), *map(pa.array, tf)]
        counts = pa.StructArray.from_arrays(counts, ["kind_no", "term", "content_tf", "own_tf", "file_tf"])
        counts = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)), pa.int32()), counts)
        file_dl = pc.fill_null(batch.column("file_dl"), 0).to_numpy()
        dl = [pa.array(sizes[0], pa.int32()), pa.array(sizes[1] + file_dl, pa.int32())]
        kept = [f.name for f in batch.schema if f.name not in ("content", "own", "file_counts", "file_dl")]
        yield pa.RecordBatch.from_arrays([*map(batch.column, kept), *dl, counts], [*kept, "content_dl", "metadata_dl", "counts"])


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(corpus_id, term, content_df, metadata_df) of a batch of chunks with arrays of their distinct terms and frequencies."""
    for batch in batches:
        chunk, flat = pc.list_parent_indices(batch.column("counts")), batch.column("counts").flatten()
        term, content, own, in_file = (flat.field(n) for n in ("term", "content_tf", "own_tf", "file_tf"))
        alone = pc.and_(pc.greater(own, 0), pc.equal(in_file, 0))
        rows = {"corpus_id": batch.column("corpus_id").take(chunk), "term": term, "content_df": pc.greater(content, 0).cast(pa.int64()), "metadata_df": alone.cast(pa.int64())}
        found = pa.table(rows).group_by(["corpus_id", "term"], use_threads=False).aggregate([("content_df", "sum"), ("metadata_df", "sum")])
        yield from found.rename_columns(list(rows)).combine_chunks().to_batches()


def chunk_postings(counts: DataFrame) -> DataFrame:
    """Postings of kind TEXT of chunks with their counts."""
    about = ["corpus_id", *PLACE, "family", "is_test", "content_dl", "metadata_dl"]
    return counts.select(*about, F.inline("counts")).withColumn("kind", F.lit(TEXT)).drop("kind_no")


def content_tokens(tokenizer: Tokenizer = tokenize) -> Column:
    """Tokens of a chunk's path and text."""
    return F.concat(tokenizer(F.col("file_path")), tokenizer(F.col("text")))


def file_metadata() -> Column:
    """What all chunks of a file share of its metadata, from its facts."""
    key = F.col("file_key")
    return F.concat_ws(
        " ", key, F.translate(key, "/.", "  "), F.lit("module"), "module", F.lit("filetree"), F.array_join("directories", " "), F.lit("symbols imports"),
        F.array_join("imports", " "), F.lit("calls"), F.array_join("calls", " "),
    )


def symbol_lines() -> Column:
    """Names on a chunk's lines that begin with class or def."""
    return F.array_join(F.regexp_extract_all("text", F.lit(SYMBOL_LINE), F.lit(2)), " ")


def symbols_of(chunks: DataFrame, facts: DataFrame) -> DataFrame:
    """(chunk keys, symbols, words) of the chunks of files that have symbols, of stored facts."""
    path = ["corpus_id", "file_path"]
    named = sized_broadcast(facts.filter(F.size("symbols") > 0).select(*path))
    keys = chunks.select(*CHUNK, "start_line", "end_line").join(named, path, "left_semi")
    symbols = chunk_symbols(keys, facts).filter((F.size("symbols") > 0) | (F.size("first_names") > 0))
    return symbols.select(*CHUNK, "symbols", symbol_words().alias("words"))


def build(chunks: DataFrame, facts: DataFrame | None, tokenizer: Tokenizer = tokenize, lookup: bool = True) -> Index:
    """Index of stored tables chunks(..., file_no) and facts; without facts the metadata field has path and symbol lines only, and there is no structure.

    Postings sorted by band, by which small batches find theirs, are only stored for lookup.
    """
    spark = chunks.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = ["corpus_id", "file_path"]
    if facts is None:
        facts = spark.createDataFrame([], FACTS)
    known = durable(facts.repartition(n, *path).dropDuplicates(path))
    file_tokens = known.select(*path, tokenizer(file_metadata()).alias("tokens"))
    by_file = durable(file_tokens.select(*path, F.size("tokens").alias("file_dl"), F.transform(term_counts(F.col("tokens"), F.array().cast("array<string>")), lambda x: F.struct(x["term"].alias("term"), x["content_tf"].alias("tf"))).alias("counts")))
    symbols = durable(symbols_of(chunks, facts))

    rows = chunks.withColumns({"part": F.shiftright("chunk_no", 12), "family": F.xxhash64("corpus_id", "file_key"), "is_test": is_test_path(F.col("file_path"))})
    rows = rows.join(sized_broadcast(symbols.select(*CHUNK, "words")), CHUNK, "left")
    keys = [*path, *PLACE, "family", "is_test", "start_line", "end_line"]
    # texts move once, to their parts; what their files have comes to them there, so that no posting has to be joined
    of_path = tokenizer(F.col("file_path")).alias("path_tokens")
    placed = durable(rows.select(*path, "file_no", "part").distinct().join(by_file, path, "left").select("file_no", "part", "file_dl", F.col("counts").alias("file_counts"), of_path))
    rows = rows.repartition(n, "file_no", "part").join(placed.hint("shuffle_hash"), ["file_no", "part"], "left")
    rows = rows.select(*keys, "file_dl", "file_counts", F.concat("path_tokens", tokenizer(F.col("text"))).alias("content"), tokenizer(F.concat_ws(" ", symbol_lines(), "words")).alias("own"))
    kept = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keys)
    counted = durable_buckets([rows.mapInArrow(_counted, f"{kept}, content_dl int, metadata_dl int, counts array<{_COUNT}>")], n, "file_no", "part")
    table = counted.drop("counts")

    sized = F.struct("chunk_no", "content_dl", "metadata_dl")
    parts = counted.groupBy(*path, "file_no", "part", "family", "is_test").agg(F.count("*").alias("n_chunks"), F.collect_list(sized).alias("chunks"))  # at most PART
    parts = durable_buckets([parts], n, "file_no", "part")
    of_files = durable(parts.join(by_file.select(*path, "counts"), path).select("corpus_id", "file_no", "part", "family", "is_test", "n_chunks", F.inline("counts")))
    own = chunk_postings(counted)

    named = F.concat(F.transform("symbols", lambda s: s["signature"]), F.transform("symbols", lambda s: s["name"]))
    every_term = lambda c: F.array_distinct(F.flatten(F.transform(c, structural_terms)))
    structure = symbols.join(table.select(*CHUNK, *PLACE[:2], "family", "is_test"), CHUNK)
    structure = structure.select("corpus_id", *PLACE, "family", "is_test", F.lit("signature").alias("kind"), F.explode(every_term(named)).alias("term"))
    kinds = {"calls": F.col("calls"), "imports": F.col("imports"), "tree": F.concat(F.array("module"), "directories")}
    by_kind = F.explode(F.map_from_arrays(F.array(*map(F.lit, kinds)), F.array(*kinds.values()))).alias("kind", "names")
    file_structure = known.select(*path, by_kind).join(parts, path).select("corpus_id", "file_no", "part", "family", "is_test", "kind", F.explode(every_term(F.col("names"))).alias("term"))
    whole = of_files.select(*[c for c in of_files.columns if c not in ("n_chunks", "tf")], F.lit(TEXT).alias("kind"), F.col("tf").alias("file_tf"))
    others = own.limit(0)
    for more in (whole, structure, file_structure):
        others = others.unionByName(more, allowMissingColumns=True)
    # the chunks' postings lie in their buckets already; only the others move
    others = durable_buckets([others.repartition(n, "file_no", "part").withColumn("band", band())], n, "file_no", "part")
    if lookup:
        postings = durable_buckets([own.withColumn("band", band()), others], n, "file_no", "part", sort=["band"], page_rows=PAGE_ROWS)
    else:
        postings = own.withColumn("band", band()).unionByName(others)

    lengths = counted.groupBy("corpus_id").agg(F.count("*").alias("n"), F.avg("content_dl").alias("content_avgdl"), F.avg("metadata_dl").alias("metadata_avgdl"))
    widest = counted.groupBy("corpus_id", "family").agg(F.countDistinct("file_no", "part").alias("m")).groupBy("corpus_id").agg(F.max("m").alias("most_parts"))
    corpora = durable(lengths.join(widest, "corpus_id"))
    df = counted.select("corpus_id", "counts").mapInArrow(_document_counts, "corpus_id string, term string, content_df bigint, metadata_df bigint")
    by_files = of_files.groupBy("corpus_id", "term").agg(F.lit(0).cast("long").alias("content_df"), F.sum("n_chunks").alias("metadata_df"))
    df = durable(df.unionByName(by_files).groupBy("corpus_id", "term").agg(F.sum("content_df").alias("content_df"), F.sum("metadata_df").alias("metadata_df")))
    return Index(table, postings, parts.select("file_no", "part", "chunks"), durable(term_stats(df, corpora)), corpora, counted, others)


FIELDS = ("content", "metadata")


def content_df(chunks: DataFrame, tokenizer: Tokenizer = tokenize) -> DataFrame:
    """(corpus_id, term, content_df): the chunks with a term, added up where the chunks are made, so that only terms with sums are moved."""
    terms = chunks.select("corpus_id", F.explode(F.array_distinct(content_tokens(tokenizer))).alias("term"))
    return terms.groupBy("corpus_id", "term").agg(F.count("*").alias("content_df"))


def metadata_df(chunks: DataFrame, facts: DataFrame, tokenizer: Tokenizer = tokenize) -> DataFrame:
    """(corpus_id, term, metadata_df) of chunks and stored facts: a file's terms count for all of its chunks, a chunk's own ones where its file lacks them.

    Keys, names of symbols and sums are moved, no texts.
    """
    path = ["corpus_id", "file_path"]
    shared = facts.dropDuplicates(path).select(*path, F.array_distinct(tokenizer(file_metadata())).alias("shared"))
    counts = chunks.groupBy(*path).agg(F.count("*").alias("n_chunks"))
    of_files = shared.join(counts, path).select("corpus_id", F.explode("shared").alias("term"), "n_chunks").groupBy("corpus_id", "term").agg(F.sum("n_chunks").alias("metadata_df"))
    symbols = symbols_of(chunks, facts).select(*CHUNK, "words")
    own = chunks.select(*CHUNK, symbol_lines().alias("lines")).filter("lines <> ''").join(symbols, CHUNK, "full")
    own = own.select(*path, tokenizer(F.concat_ws(" ", "lines", "words")).alias("own")).join(shared, path, "left")
    alone = F.array_except("own", F.coalesce("shared", F.array().cast("array<string>")))
    of_chunks = own.select("corpus_id", F.explode(alone).alias("term")).groupBy("corpus_id", "term").agg(F.count("*").alias("metadata_df"))
    return of_files.unionByName(of_chunks).groupBy("corpus_id", "term").agg(F.sum("metadata_df").alias("metadata_df"))


def statistics(chunks: DataFrame, facts: DataFrame | None, tokenizer: Tokenizer = tokenize) -> DataFrame:
    """(corpus_id, term, and df and idf of both fields) as in an index's terms, without its postings: of the content field if facts is None, else of the metadata field."""
    df = content_df(chunks, tokenizer) if facts is None else metadata_df(chunks, facts, tokenizer)
    df = durable(df.withColumns({f"{f}_df": F.lit(0).cast("long") for f in FIELDS if f"{f}_df" not in df.columns}))
    return term_stats(df, durable(chunks.groupBy("corpus_id").agg(F.count("*").alias("n"))))


def term_stats(df: DataFrame, corpora: DataFrame) -> DataFrame:
    """(corpus_id, term, and df and idf of both fields) of stored tables: a negative idf becomes EPSILON times the mean over all terms of the field, taken before."""
    raw = df.join(sized_broadcast(corpora.select("corpus_id", "n")), "corpus_id")
    weight = lambda f: F.when(F.col(f"{f}_df") > 0, F.log(F.col("n") - F.col(f"{f}_df") + 0.5) - F.log(F.col(f"{f}_df") + 0.5))
    raw = raw.withColumns({f"{f}_raw": weight(f) for f in FIELDS})
    means = durable(raw.groupBy("corpus_id").agg(*[F.avg(f"{f}_raw").alias(f"{f}_mean") for f in FIELDS]))
    idf = lambda f: F.when(F.col(f"{f}_raw") < 0, EPSILON * F.col(f"{f}_mean")).otherwise(F.col(f"{f}_raw")).alias(f"{f}_idf")
    return raw.join(sized_broadcast(means), "corpus_id").select("corpus_id", "term", *[c for f in FIELDS for c in (F.col(f"{f}_df"), idf(f))])
