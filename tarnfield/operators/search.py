"""Hybrid search: two BM25 fields, token coverage and code structure, for many queries at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnfield.functions.tokens import TEST_WORDS, has_any, tokenize
from tarnfield.operators import blocks
from tarnfield.operators.index import FIELDS, PLACE, TEXT, Index, Tokenizer, band
from tarnfield.sources.scratch import durable, sized_broadcast

K1, B = 1.5, 0.75
WEIGHTS = {"content": 0.50, "metadata": 0.30, "overlap": 0.10, "structure": 0.10}
#: Query words that ask for a kind of structure, and what a match is worth.
INTENTS = {
    "calls": (("call", "caller", "callee"), 1.0),
    "imports": (("import", "from"), 1.0),
    "signature": (("signature", "function", "method", "def", "class"), 1.0),
    "tree": (("filetree", "tree", "path", "module"), 0.5),
}
QUERY = ["query_id", "corpus_id"]
ORDER = ["file_no", "chunk_no"]
#: Parts in which the first rows of a table are found before they are compared with each other.
_PARTS = 64
#: Ranges of bands in a filter of postings, and the bands from which on there is no filter.
_RANGES = 64
_MOST_BANDS = 4 * _RANGES


def query_terms(queries: DataFrame, tokenizer: Tokenizer = tokenize) -> DataFrame:
    """(query_id, corpus_id, term, qtf, n_terms, intents, asks_tests) of queries(query_id, corpus_id, query): one row for each distinct token."""
    # alone in an explode, so that the columns over them do not make the tokens anew
    bags = queries.select(*QUERY, F.explode(F.array(tokenizer(F.col("query")))).alias("tokens"))
    asked = lambda words: has_any(F.col("tokens"), words)
    intents = F.array_compact(F.array(*[F.when(asked(words), k) for k, (words, _) in INTENTS.items()]))
    bags = bags.withColumns({"intents": intents, "asks_tests": asked(TEST_WORDS), "n_terms": F.size(F.array_distinct("tokens"))})
    rows = bags.select(*QUERY, "intents", "asks_tests", "n_terms", F.explode("tokens").alias("term"))
    return rows.groupBy(*QUERY, "intents", "asks_tests", "n_terms", "term").agg(F.count("*").cast("int").alias("qtf"))


def bm25(tf: Column, dl: Column, avgdl: Column, idf: Column, qtf: Column) -> Column:
    return qtf * idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def _weighted(index: Index, terms: DataFrame) -> DataFrame:
    """(query_id, corpus_id, kind, term, qtf, and idf and mean length of both fields) of the query terms that the index has, and of the structural terms that are asked for; stored."""
    known = index.terms.join(sized_broadcast(index.corpora), "corpus_id")
    stats = [f"{f}_{x}" for f in FIELDS for x in ("idf", "avgdl")]
    words = terms.join(known.select("corpus_id", "term", *stats), ["corpus_id", "term"]).select(*QUERY, F.lit(TEXT).alias("kind"), "term", "qtf", *stats)
    kinds = terms.filter(F.size("intents") > 0).select(*QUERY, F.explode("intents").alias("kind"), "term")
    return durable(words.unionByName(kinds, allowMissingColumns=True))


def _part(f: str, tf: Column) -> Column:
    """What a frequency in a field adds to the field's score."""
    return F.when(tf > 0, bm25(tf, F.col(f"{f}_dl"), F.col(f"{f}_avgdl"), F.col(f"{f}_idf"), F.col("qtf"))).otherwise(0.0)


def _ranges(bands: Sequence[int], most: int = _RANGES) -> list[tuple[int, int]]:
    """At most so many ranges that hold all of the sorted bands; the widest gaps stay out of them."""
    gaps = sorted(range(1, len(bands)), key=lambda i: bands[i - 1] - bands[i])[: most - 1]
    cuts = [0, *sorted(gaps), len(bands)]
    return [(bands[a], bands[b - 1]) for a, b in pairwise(cuts) if a < b]


def asked_bands(words: DataFrame) -> Column:
    """Whether a posting is in a band of stored words, as a filter that Parquet's page ranges answer; at most BANDS numbers come to the driver.

    A batch of so many bands that ranges would hold most postings is not filtered: the join with its words alone is cheaper.
    """
    return _in_ranges(_bands(words))


def _bands(words: DataFrame) -> list[int]:
    return sorted(r["band"] for r in words.select(band()).distinct().collect())


def _in_ranges(bands: Sequence[int]) -> Column:
    if len(bands) > _MOST_BANDS:
        return F.lit(True)
    return reduce(Column.__or__, [F.col("band").between(a, b) for a, b in _ranges(bands)], F.lit(False))


def content_scores(index: Index, terms: DataFrame) -> DataFrame:
    """(query_id, corpus_id, place, family, score): BM25 of the content field alone, for chunks that share a term there."""
    words = durable(_weighted(index, terms).filter(F.col("kind") == TEXT))
    hits = index.postings.filter(asked_bands(words) & (F.col("kind") == TEXT) & (F.col("content_tf") > 0)).join(sized_broadcast(words), ["corpus_id", "kind", "term"])
    return hits.groupBy(*QUERY, *PLACE, "family").agg(F.sum(_part("content", F.col("content_tf"))).alias("score"))


@dataclass(frozen=True)
class Asked:
    """Stored tables of a batch of queries: weighted terms by kind, and what a query is like; the filter of the terms' bands, and whether they are too many for one."""

    words: DataFrame
    about: DataFrame
    bands: Column
    many: bool = True

    @staticmethod
    def of(index: Index, terms: DataFrame) -> Asked:
        terms = durable(terms)
        words = _weighted(index, terms)
        bands = _bands(words)
        return Asked(words, durable(terms.select("query_id", "n_terms", "asks_tests").distinct()), _in_ranges(bands), len(bands) > _MOST_BANDS)


def field_sums(index: Index, asked: Asked, within: DataFrame | None = None) -> DataFrame:
    """(query_id, corpus_id, place, family, is_test, content, metadata, shared, structure) of the chunks that share a token or a structural term with a query.

    All that is summed up for a chunk lies in one bucket, so nothing but the
    queries' terms is moved.  What a file has counts for each of its chunks; a
    chunk's own posting of such a term adds what the term's higher frequency
    makes.  within(query_id, place), a small stored table, restricts the pairs.
    """
    if within is None:
        hits = _spread(index.parts, index.postings.filter(asked.bands).join(sized_broadcast(asked.words), ["corpus_id", "kind", "term"]))
    else:
        few = sized_broadcast(durable(within.select("file_no", "part").distinct()))
        hits = _met(index.parts.join(few, ["file_no", "part"], "left_semi"), index.postings_of(within), asked.words, within)
    values = _values()
    has = {k: F.max(F.when(F.col("kind") == k, 1.0).otherwise(0.0)) for k in INTENTS}
    sums = hits.select(*QUERY, *PLACE, "family", "is_test", "kind", *[v.alias(n) for n, v in values.items()])
    sums = sums.groupBy(*QUERY, *PLACE, "family", "is_test").agg(*[F.sum(n).alias(n) for n in values], *[c.alias(f"has_{k}") for k, c in has.items()])
    weight = sum((F.col(f"has_{k}") * INTENTS[k][1] for k in INTENTS), F.lit(0.0))
    return sums.select(*QUERY, *PLACE, "family", "is_test", *FIELDS, "shared", (F.least(weight, F.lit(1.5)) / 1.5).alias("structure"))


def _met(parts: DataFrame, postings: DataFrame, words: DataFrame, within: DataFrame) -> DataFrame:
    """Postings of the chunks in within(query_id, place) that meet words of the chunk's own queries."""
    known = words.select("corpus_id", "kind", "term").distinct()
    hits = _spread(parts, postings.join(sized_broadcast(durable(known)), ["corpus_id", "kind", "term"], "left_semi"))
    hits = hits.join(sized_broadcast(durable(within.select("query_id", *PLACE).distinct())), PLACE)
    return hits.join(sized_broadcast(words), [*QUERY, "kind", "term"])


def _spread(parts: DataFrame, hits: DataFrame) -> DataFrame:
    """hits with a row of a whole file as one for each of its chunks."""
    # a row of a whole file becomes one for each of its chunks
    spots = parts.select(F.col("file_no").alias("of_file"), F.col("part").alias("of_part"), "chunks")
    of_file = (F.col("file_no") == F.col("of_file")) & (F.col("part") == F.col("of_part")) & F.col("chunk_no").isNull()
    itself = F.array(F.struct("chunk_no", "content_dl", "metadata_dl"))
    hits = hits.join(sized_broadcast(spots), of_file, "left").withColumn("at", F.explode(F.coalesce("chunks", itself)))
    hits = hits.withColumns({c: F.col(f"at.{c}") for c in ("chunk_no", "content_dl", "metadata_dl")})
    return hits


def _values() -> dict[str, Column]:
    """What a posting adds to a pair's content, metadata and shared."""
    is_text, tf = F.col("kind") == TEXT, {c: F.coalesce(c, F.lit(0)) for c in ("content_tf", "own_tf", "file_tf")}
    whole = F.col("content_tf").isNull()
    metadata = F.when(whole, _part("metadata", tf["file_tf"])).otherwise(_part("metadata", tf["own_tf"] + tf["file_tf"]) - _part("metadata", tf["file_tf"]))
    return {
        "content": F.when(is_text, _part("content", tf["content_tf"])).otherwise(0.0),
        "metadata": F.when(is_text, metadata).otherwise(0.0),
        "shared": F.when(is_text & (whole | (tf["file_tf"] == 0)), 1).otherwise(0).cast("long"),
    }


def highest(sums: DataFrame) -> DataFrame:
    """(query_id, top_content, top_metadata), stored: a query's highest sums scale all of its scores."""
    return durable(sums.groupBy("query_id").agg(*[F.max(f).alias(f"top_{f}") for f in FIELDS]))


def fused(sums: DataFrame, tops: DataFrame, about: DataFrame) -> DataFrame:
    """(query_id, corpus_id, place, family, score) of field_sums(): chunks that are not there score zero."""
    rows = sums.join(sized_broadcast(tops), "query_id").join(sized_broadcast(about), "query_id")
    rel = lambda f: F.when(F.col(f"top_{f}") <= 0, 0.0).otherwise(F.col(f) / F.col(f"top_{f}"))
    raw = (
        WEIGHTS["content"] * rel("content")
        + WEIGHTS["metadata"] * rel("metadata")
        + WEIGHTS["overlap"] * F.col("shared") / F.col("n_terms")
        + WEIGHTS["structure"] * F.col("structure")
    )
    role = F.when(F.col("is_test"), F.when(F.col("asks_tests"), 1.05).otherwise(0.85)).otherwise(1.0)
    return rows.select(*QUERY, *PLACE, "family", (raw * role).alias("score"))


def placed(index: Index, scores: DataFrame) -> DataFrame:
    """scores(place, ...) of few chunks with the chunks' keys and lines."""
    return index.chunks.select(*PLACE, "file_path", "start_line", "end_line").join(sized_broadcast(scores), PLACE)


def top_k(scored: DataFrame, k: int, diverse: bool = True, most_parts: int = 1) -> DataFrame:
    """The first k rows of each query with `rank`: the best chunk of each family (file key) first, the others after; ties in the order of file_no and chunk_no.

    What can be among them is chosen where the rows lie: of each part of a file
    its k best, and of a task's rows for a query as many as k families of
    most_parts parts can push back.
    """
    k = max(k, 0)
    order = [F.round("score", 9).desc(), *ORDER]
    if diverse:
        in_part = F.row_number().over(Window.partitionBy("query_id", "file_no", "part").orderBy(*order))
        few = scored.withColumn("again", in_part).filter(F.col("again") <= k)
        spare = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("again") > 1, *order))
        few = few.withColumn("i", spare).filter(F.col("i") <= k * most_parts + k).drop("i")
        in_family = F.row_number().over(Window.partitionBy("query_id", "family").orderBy(*order))
        scored = few.withColumn("again", in_family)
        order = [F.col("again") > 1, *order]
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k).drop("again")


def fillers(needy: DataFrame, matched: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """(query_id, corpus_id, place, family, score = 0): chunks without a match that can get into the first k of needy(query_id, corpus_id).

    Those are the first one of each of the first files in order, k more than the
    query has matches in, and in a corpus of fewer than k files the first chunks
    in order.  matched(query_id, place) holds all chunks that the queries match.
    """
    counts = matched.groupBy("query_id").agg(F.countDistinct("file_no").alias("files"), F.count("*").alias("rows"))
    needy = durable(needy.select(*QUERY).join(counts, "query_id", "left").na.fill(0, ["files", "rows"]))
    limit = needy.agg(F.max("files").alias("f"), F.max("rows").alias("r")).first()
    if limit["f"] is None:
        return matched.select("query_id", *PLACE).limit(0).join(needy.select(*QUERY), "query_id").join(chunks.select(*PLACE, "family"), PLACE).withColumn("score", F.lit(0.0))
    files = chunks.groupBy("corpus_id", "file_no").agg(F.count("*").alias("n_chunks"))
    first = _first(files, ["corpus_id"], ["file_no"], k + limit["f"])
    wanted = needy.select(*QUERY, F.explode(F.sequence(F.lit(1), (F.col("files") + k).cast("int"))).alias("at"))
    # a file's chunks count from zero, so the matched ones that stand where they would if there were no gap lie before the first gap
    run = F.row_number().over(Window.partitionBy("query_id", "file_no").orderBy("chunk_no")) - 1
    gaps = matched.withColumn("run", run).groupBy("query_id", "file_no").agg(F.sum((F.col("chunk_no") == F.col("run")).cast("int")).alias("gap"))
    one = wanted.join(first, ["corpus_id", "at"]).join(gaps, ["query_id", "file_no"], "left").na.fill(0, ["gap"]).filter(F.col("gap") < F.col("n_chunks"))
    one = one.select(*QUERY, "file_no", F.col("gap").cast("int").alias("chunk_no"))
    few = files.groupBy("corpus_id").agg(F.count("*").alias("n_files")).filter(F.col("n_files") < k).select("corpus_id")
    head = _first(chunks.select("corpus_id", "file_no", "chunk_no").join(few, "corpus_id", "left_semi"), ["corpus_id"], ORDER, k + limit["r"])
    more = needy.join(few, "corpus_id", "left_semi").select(*QUERY, F.explode(F.sequence(F.lit(1), (F.col("rows") + k).cast("int"))).alias("at"))
    more = more.join(head, ["corpus_id", "at"]).join(matched.select("query_id", "file_no", "chunk_no"), ["query_id", "file_no", "chunk_no"], "left_anti")
    every = one.unionByName(more.select(*one.columns)).distinct()
    return every.join(chunks.select(*PLACE, "family"), ["file_no", "chunk_no"]).select(*QUERY, *PLACE, "family", F.lit(0.0).alias("score"))


def _first(rows: DataFrame, by: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The first n rows of each group with their number `at`: those of parts of a group first, so that no task sorts a whole one."""
    part = F.pmod(F.xxhash64(*rows.columns), F.lit(_PARTS))
    few = rows.withColumn("slice", part).withColumn("at", F.row_number().over(Window.partitionBy(*by, "slice").orderBy(*order))).filter(F.col("at") <= n)
    return few.drop("slice").withColumn("at", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("at") <= n)


@dataclass(frozen=True)
class Ranking:
    """The first rows of each query, and what scores any other chunk alike."""

    best: DataFrame
    asked: Asked
    tops: DataFrame

    def scores_of(self, index: Index, within: DataFrame) -> DataFrame:
        """(query_id, place, score) of the chunks in within(place) that match a query."""
        return fused(field_sums(index, self.asked, within), self.tops, self.asked.about)


_KINDS = list(INTENTS)


#: Bands of terms by which blocks leave out what no query asks for.
_BLOCK_BANDS = 1 << 18


def _kind_no() -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, _KINDS)), F.col("kind")), F.lit(0)).cast("int")


def _with_ids(terms: DataFrame) -> DataFrame:
    """terms(corpus_id, kind, term, ...) with kind_no and id, 64 bits that stand for a term of a kind in a corpus: all are numbered alike without a table of them."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = blocks.term_ids(blocks.hashed(batch.column("corpus_id")), batch.column("kind_no").to_numpy(), batch.column("term"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids)], [*batch.schema.names, "id"])

    rows = terms.withColumn("kind_no", _kind_no())
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(number, f"{schema}, id bigint")


def numbered(asked: Asked) -> DataFrame:
    """The words of the queries with the numbers of their terms; stored."""
    return durable(_with_ids(asked.words))


def _numbered_terms(asked: Asked) -> DataFrame:
    """The distinct terms of all queries with a number and a frequency of one; stored."""
    stats = [f"{f}_{x}" for f in FIELDS for x in ("idf", "avgdl")]
    return durable(_with_ids(asked.words.select("corpus_id", "kind", "term", *stats).distinct()).withColumn("qtf", F.lit(1)))


def _chunk_counts(index: Index) -> DataFrame:
    """Counts of each chunk in three arrays: its own, and its others (of_chunk) and those of its file (of_file), which come to it in their buckets."""
    others = index.others.withColumn("kind_no", _kind_no())
    one = index.counts.schema["counts"].dataType.elementType.names
    listed = others.groupBy(*PLACE).agg(F.collect_list(F.struct(*one)).alias("x"))
    # by parts, in whose buckets all of it lies
    own, shared = F.col("chunk_no").isNotNull(), F.col("chunk_no").isNull()
    by_chunk = F.map_from_entries(F.collect_list(F.when(own, F.struct("chunk_no", "x")))).alias("by_chunk")
    of_parts = listed.groupBy(*PLACE[:2]).agg(by_chunk, F.first(F.when(shared, F.col("x")), ignorenulls=True).alias("of_file"))
    rows = index.counts.join(of_parts.hint("shuffle_hash"), PLACE[:2], "left").withColumn("of_chunk", F.try_element_at("by_chunk", F.col("chunk_no")))
    return rows.select("corpus_id", *PLACE, "family", "is_test", "content_dl", "metadata_dl", "counts", "of_chunk", "of_file")


def _chunk_hits(index: Index, terms: DataFrame) -> DataFrame:
    """Postings of the numbered terms for each chunk, its own and its files', one behind the other as long as terms are broadcast."""
    rows = _chunk_counts(index)
    none = F.array().cast(index.counts.schema["counts"].dataType)
    every = F.concat("counts", F.coalesce("of_chunk", none), F.coalesce("of_file", none))
    return rows.select(*rows.columns[:-3], F.inline(every)).join(terms, ["corpus_id", "kind_no", "term"])


def _wanted(words: DataFrame) -> np.ndarray:
    """Which of _BLOCK_BANDS bands have terms of the numbered words; so many bits come to the driver."""
    band = F.pmod("id", F.lit(_BLOCK_BANDS)) + 1
    parts = words.select(band.alias("b")).groupBy(F.bitmap_bucket_number("b").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("bits"))
    wanted = np.zeros(_BLOCK_BANDS, bool)
    for r in parts.collect():
        bits = np.unpackbits(np.frombuffer(r["bits"], np.uint8), bitorder="little")
        wanted[(r["part"] - 1) * len(bits) :][: len(bits)] = bits
    return wanted


def chunk_blocks(index: Index, asked: Asked, words: DataFrame) -> DataFrame:
    """Stored blocks of chunks with what the asked terms weigh there but for their idf; of few terms the postings are looked up, else the counts of all chunks are read in order.

    Terms go by their numbers, so that no table of them is joined, however many they are.
    """
    if asked.many:
        rows = _chunk_counts(index).join(sized_broadcast(index.corpora.select("corpus_id", "content_avgdl", "metadata_avgdl")), "corpus_id")
        rows = rows.select("corpus_id", *PLACE, "family", "is_test", "content_dl", "metadata_dl", "content_avgdl", "metadata_avgdl", "counts", "of_chunk", "of_file")
        return durable(blocks.packed_counts(rows, blocks.CHUNKS, _wanted(words), K1, B))
    terms = _numbered_terms(asked).withColumns({f"{f}_idf": F.lit(1.0) for f in FIELDS})
    hits = _spread(index.parts, index.postings.filter(asked.bands).join(sized_broadcast(terms), ["corpus_id", "kind", "term"]))
    values = _values() | {"shared": _values()["shared"].cast("tinyint")}
    rows = hits.select("corpus_id", *PLACE, "family", "is_test", "id", F.col("kind_no").cast("tinyint").alias("kind"), *[v.alias(n) for n, v in values.items()])
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a chunk's terms do not lie together
    return durable(blocks.packed_terms(rows.repartition(n, *PLACE[:2]).sortWithinPartitions(*PLACE), blocks.CHUNKS, PLACE))


def query_blocks(words: DataFrame, about: DataFrame) -> DataFrame:
    """Stored blocks of the queries of about(query_id, ...) with their numbered words and what they are worth; those of a corpus lie together."""
    own = words.join(sized_broadcast(about), "query_id")
    idf = [F.coalesce(f"{f}_idf", F.lit(0.0)).alias(f"{f}_idf") for f in FIELDS]
    plain = F.coalesce(F.least(*[f"{f}_idf" for f in FIELDS]), F.lit(1.0)) > 0
    own = own.select(
        *QUERY, *[c for c in about.columns if c != "query_id"], "id", F.col("kind_no").cast("tinyint").alias("kind"),
        F.coalesce("qtf", F.lit(1)).alias("qtf"), *idf, plain.cast("tinyint").alias("plain"),
    )
    order = ["corpus_id", "query_id"]
    own = own.repartitionByRange(max(1, -(-about.count() // blocks.QUERIES)), *order).sortWithinPartitions(*order)
    return durable(blocks.packed_terms(own, blocks.QUERIES, QUERY))


def _over_blocks(queries: DataFrame, chunks: DataFrame, gather: Callable[[blocks.Block], _Tops | _Best], schema: str) -> DataFrame:
    """What gather gathers for a block of queries from the blocks of chunks of its corpora, as rows: at most once for each task that has the block."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None  # a block of queries meets many blocks of chunks
        for batch in batches:
            for q, c in zip(*batch.columns):
                if last is None or not last.equals(q.as_buffer()):
                    if own is not None:
                        yield own.rows()
                    last = pa.py_buffer(q.as_py())
                    own = gather(blocks.Block.loaded(last.to_pybytes()))
                own.add(blocks.Block.loaded(c.as_buffer()))
        if own is not None:
            yield own.rows()

    # each block of queries meets all chunks of a task before the next one
    met = queries.select(F.col("corpora").alias("of_q"), F.col("block").alias("q")).hint("shuffle_replicate_nl").crossJoin(chunks.select(F.col("corpora").alias("of_c"), F.col("block").alias("c")))
    return met.filter(F.arrays_overlap("of_q", "of_c")).select("q", "c").mapInArrow(score, schema)


_WORTH = [INTENTS[k][1] for k in _KINDS]
#: Terms of a query, on average, up to which bounds are asked before products are made.
_SHORT = 64


def _is_short(q: blocks.Block) -> bool:
    return len(q.terms["at"]) <= _SHORT * len(q) and bool(q.terms["plain"].all())


class _Tops:
    """The highest content and metadata of each query of a block, and metadata and role of the chunk with the highest content."""

    def __init__(self, q: blocks.Block) -> None:
        self.q, self.top, self.short = q, np.full((2, len(q)), -np.inf), _is_short(q)
        self.there = np.zeros((2, len(q)))

    def add(self, c: blocks.Block) -> None:
        at, q = np.arange(len(self.q)), self.q
        if self.short:
            most = np.stack(blocks.bounds(q, c)) * (1 + 1e-9)
            at = np.flatnonzero((most > self.top).any(axis=0))
            q = q.some(at) if len(at) < len(q) else q
        if not len(at):
            return
        found = blocks.fields(q, c)
        if found is None:
            *found, _, _, matches = blocks.sums(q, c, _WORTH)
            some, top = matches.any(axis=1), [np.where(matches, x, -np.inf).max(axis=1) for x in found]
        else:
            top = [x.max(axis=1) for x in found]
            some = np.maximum(*top) > 0
            if not some.all() and (weight := blocks.structure(q, c, _WORTH)) is not None:
                some |= (weight > 0).any(axis=1)
            new = np.flatnonzero(top[0] > self.top[0, at])
            j = found[0][new].argmax(axis=1)
            self.there[:, at[new]] = found[1][new, j], _role(q, c)[new, j]
        self.top[:, at] = np.maximum(self.top[:, at], np.where(some, top, -np.inf))

    def rows(self) -> pa.RecordBatch:
        some = np.flatnonzero(np.isfinite(self.top[0]))
        return pa.RecordBatch.from_arrays([self.q.rows.column("query_id").take(pa.array(some)), *[pa.array(x[some]) for x in (*self.top, *self.there)]], ["query_id", *FIELDS, *_THERE])


#: What _Tops gives besides the highest sums: of the chunk with the highest content its metadata and its role, or 0 if that is not known.
_THERE = ("there", "role")


def _role(q: blocks.Block, c: blocks.Block) -> np.ndarray:
    return np.where(c.of("is_test"), np.where(q.of("asks_tests"), 1.05, 0.85)[:, None], 1.0)


def _floors(seen: DataFrame) -> DataFrame:
    """(query_id, floor): what the chunk with a query's highest content scores at least, in units of ranking keys."""
    best = seen.groupBy("query_id").agg(F.max("metadata").alias("top"), F.max_by(F.struct(*_THERE), F.struct("content", *_THERE)).alias("x"))
    score = (WEIGHTS["content"] + WEIGHTS["metadata"] * F.when(F.col("top") > 0, F.col("x.there") / F.col("top")).otherwise(0.0)) * F.col("x.role")
    return best.select("query_id", (F.floor(score * 1e9) - 2).cast("long").alias("floor"))


#: Pairs for each query above which the first ones of a block are found before they meet those of others.
_FEW = 16


class _Best:
    """The chunks that can be among the first k of each query of a block, with their scores; what cannot is left out as soon as k better families are known."""

    def __init__(self, q: blocks.Block, k: int, diverse: bool = True) -> None:
        self.q, self.k, self.diverse, self.short = q, k, diverse, _is_short(q)
        self.least = q.of("floor").copy() if "floor" in q.rows.schema.names else np.full(len(q), blocks.NONE)
        self.floor, self.found = self.least, None

    def add(self, c: blocks.Block) -> None:
        at, q = np.arange(len(self.q)), self.q
        if self.found is None:
            self.found = {"at": at[:0], "score": np.zeros(0), "key": self.floor[:0]} | {n: c.of(n)[:0] for n in (*PLACE, "family")}
        if self.short and (self.floor > blocks.NONE).any():
            at = np.flatnonzero(self._key(self._bound(c)) + 1 >= self.floor)
            q = q.some(at) if len(at) < len(q) else q
        if not len(at):
            return
        i, j, score = self._scored(q, c, self.floor[at])
        new = {"at": at[i], "score": score, "key": self._key(score)} | {n: c.of(n)[j] for n in (*PLACE, "family")}
        some = new["key"] >= self.floor[new["at"]]
        if some.any():
            own = {n: np.concatenate([x, new[n][some]]) for n, x in self.found.items()}
            keep, floor = blocks.first_rows(own["at"], own["key"], [own[n] for n in ORDER], own["family"] if self.diverse else None, self.k, len(self.q))
            self.floor = np.maximum(floor, self.least)
            self.found = {n: x[keep] for n, x in own.items()}

    @staticmethod
    def _key(score: np.ndarray) -> np.ndarray:
        return np.rint(score * 1e9).astype(np.int64)

    @staticmethod
    def _raw(q: blocks.Block, content: np.ndarray, metadata: np.ndarray) -> np.ndarray:
        scale = lambda f: np.where((top := q.of(f"top_{f}")) > 0, WEIGHTS[f] / np.where(top > 0, top, 1), 0.0)
        wide = content.ndim > 1
        of = lambda f: scale(f)[:, None] if wide else scale(f)
        return of("content") * content + of("metadata") * metadata

    def _bound(self, c: blocks.Block) -> np.ndarray:
        kinds = WEIGHTS["structure"] if (self.q.terms["kind"] > 0).any() and (c.terms["kind"] > 0).any() else 0.0
        return (self._raw(self.q, *blocks.bounds(self.q, c)) + WEIGHTS["overlap"] + kinds) * 1.05

    def _scored(self, q: blocks.Block, c: blocks.Block, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, columns and scores of the pairs that can be among the first; the floors are the keys that they have to reach."""
        content, metadata, shared, structure, matches = blocks.sums(q, c, _WORTH)
        score = self._raw(q, content, metadata) + WEIGHTS["overlap"] * shared / q.of("n_terms")[:, None] + WEIGHTS["structure"] * structure
        return self._first(score * _role(q, c), matches, c, floor)

    def _first(self, score: np.ndarray, matches: np.ndarray, c: blocks.Block, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs that reach their floors; if those are many, only what can be among the first of this block."""
        matches = matches & (score * 1e9 + 1 >= floor[:, None])
        i, j = np.nonzero(matches)
        if len(i) > _FEW * len(score):
            place, family = np.argsort(np.lexsort((c.of("chunk_no"), c.of("file_no")))), c.of("family") if self.diverse else np.arange(len(c))
            i, j = blocks.best_places(score, matches, family, place, self.k)
        return i, j, score[i, j]

    def rows(self) -> pa.RecordBatch:
        found = self.found
        own = [self.q.rows.column(n).take(pa.array(found["at"])) for n in QUERY]
        return pa.RecordBatch.from_arrays([*own, *[pa.array(found[n]) for n in (*PLACE, "family")], pa.array(found["score"])], [*QUERY, *PLACE, "family", "score"])


class _BestContent(_Best):
    """The same by the content field alone, each chunk for itself."""

    def _bound(self, c: blocks.Block) -> np.ndarray:
        return blocks.bounds(self.q, c)[0]

    def _scored(self, q: blocks.Block, c: blocks.Block, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        asked, own = q.kind(0), c.kind(0)
        own = {n: own[n][own["content"] > 0] for n in ("at", "id", "content")}
        score, shared = blocks._products((asked["at"], asked["id"], [blocks.worth(asked, "content"), np.ones(len(asked["at"]))]), (own["at"], own["id"], [own["content"], np.ones(len(own["at"]))]), (len(q), len(c)))
        return self._first(score, shared > 0.5, c, floor)


def _best_schema(index: Index, asked: Asked) -> str:
    place = ", ".join(f"{c} {index.postings.schema[c].dataType.simpleString()}" for c in (*PLACE, "family"))
    return f"query_id {asked.words.schema['query_id'].dataType.simpleString()}, corpus_id string, {place}, score double"


def rank_content(index: Index, queries: DataFrame, k: int, tokenizer: Tokenizer = tokenize) -> DataFrame:
    """The first k of content_scores() for each query, with rank, by blocks and without rows of all pairs."""
    k, asked = max(k, 1), Asked.of(index, query_terms(queries, tokenizer))
    words = numbered(asked)
    few = _over_blocks(query_blocks(words, asked.about), chunk_blocks(index, asked, words), lambda q: _BestContent(q, k, False), _best_schema(index, asked))
    return top_k(durable(few), k, diverse=False)


def rank_queries(index: Index, queries: DataFrame, k: int, tokenizer: Tokenizer = tokenize) -> Ranking:
    """Hybrid ranking with file diversity. Sums are made twice, for the highest ones and for the ranking, rather than stored for all pairs."""
    asked = Asked.of(index, query_terms(queries, tokenizer))
    words = numbered(asked)
    chunks, kind, most = chunk_blocks(index, asked, words), asked.words.schema["query_id"].dataType.simpleString(), max(k, 1)
    seen = durable(_over_blocks(query_blocks(words, asked.about), chunks, _Tops, f"query_id {kind}, content double, metadata double, there double, role double"))
    tops = highest(seen)
    scaled = asked.about.join(sized_broadcast(tops), "query_id")
    if most == 1:  # the first row of a query scores no less than the chunk with its highest content, whichever task has it
        scaled = scaled.join(sized_broadcast(durable(_floors(seen))), "query_id")
    scaled = durable(scaled)
    few = durable(_over_blocks(query_blocks(words, scaled), chunks, lambda q: _Best(q, most), _best_schema(index, asked)))
    most = index.corpora.agg(F.max("most_parts")).first()[0] or 1
    best = durable(top_k(few, k, most_parts=most))
    # queries with fewer than k files of positive score also get chunks that score zero
    good = best.filter("score > 0").groupBy("query_id").agg(F.countDistinct("family").alias("good"))
    needy = durable(queries.select(*QUERY).join(good, "query_id", "left").filter(F.coalesce("good", F.lit(0)) < k))
    if not needy.isEmpty():
        only = lambda df: df.join(sized_broadcast(needy.select("query_id")), "query_id", "left_semi")
        few = Asked(durable(only(asked.words)), asked.about, asked.bands, asked.many)
        scored = durable(fused(field_sums(index, few), tops, asked.about))
        every = scored.unionByName(fillers(needy, scored.select("query_id", *PLACE), index.chunks, k).select(*scored.columns))
        rest = best.join(sized_broadcast(needy.select("query_id")), "query_id", "left_anti")
        best = durable(rest.unionByName(top_k(every, k, most_parts=most)))
    return Ranking(best, asked, tops)


def search(index: Index, queries: DataFrame, k: int = 5, tokenizer: Tokenizer = tokenize) -> DataFrame:
    """results(query_id, rank, chunk keys, place, score, source) of the hybrid ranking with file diversity."""
    return placed(index, rank_queries(index, queries, k, tokenizer).best).withColumn("source", F.lit("hybrid"))
