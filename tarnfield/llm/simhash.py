"""SimHash near-duplicate detection with Golay-code fuzzy keys.

Fingerprint: 64 bits by majority over the XXH64 (seed 42) hashes of a text's
3-word shingles, repeats included.  Fingerprints that differ in at most three
bits are linked; a component is everything reachable over links.

Keys: a fingerprint is cut into segments of 22, 21 and 21 bits, each padded to
a word of the perfect binary Golay code [23,12,7].  A word's *primary* index is
its decoded codeword's message; its *probe* indices are the messages of all
codewords within distance four (one, or six when the word lies at distance
three).  Two words at distance <= 1 always have primary(x) in probe(y).
Three errors over three segments leave one of two cases:

* some segment is exact and another has at most one error: key = exact segment
  and Golay index (34 bits, six ordered pairs of segments);
* each segment has exactly one error: key = Golay indices of the first two, an
  exact half of the third, and the three parities, which must all flip.

Buckets of at most `bucket_limit` fingerprints are joined and verified.  The
fingerprints of larger buckets go through an exact path whose work is linear in
their number: x and y differ in <= 3 bits if and only if some z lies within one
bit of one and within two bits of the other, so every z is a star whose centre
is a fingerprint within one bit of it, and no pairs are formed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfield.llm.common import durable, forget, free_name, own_columns, read, sized_broadcast
from tarnfield.llm.components import connected_components

#: Fixed values of the code and of the cut: x^11+x^9+x^7+x^6+x^5+x+1, and (shift, width) by segment.
GENERATOR = 0b101011100011
SEGMENTS = ((42, 22), (21, 21), (0, 21))

LINK_BITS = 3
#: Fingerprints of one task that makes keys; one of so many is looked at to find large buckets, which have at least so many in that share.
FPS_PER_TASK = 50_000
SAMPLED, LEAST_SAMPLED = 64, 64


# ---------------------------------------------------------------- fingerprints


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit SimHash of one text; 0 where it has no word."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z and the six separators count
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))
    width = min(3, len(words))
    digest = xxhash.xxh64_intdigest
    total, n = np.zeros(64, np.int64), len(words) - width + 1
    for at in range(0, n, 8192):
        some = slice(at, min(n, at + 8192))
        spans = zip(starts[some].tolist(), (ends[width - 1 :][some] - 1).tolist())
        hashes = np.array([digest(joined[a:b], 42) for a, b in spans], dtype=">u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, mark): fp is the fingerprint as a signed long, mark a hash of the text. Every row stays, with null ids and repeats too; ids are whole numbers, and others count as null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t) for t in b.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64)), b.column(2)], ["doc_id", "fp", "mark"])

    narrow = docs.select(F.col(id_col).try_cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), _mark(text_col).alias("mark"))
    return narrow.mapInArrow(run, "doc_id long, fp long, mark long")


def _mark(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


# ---------------------------------------------------------------- Golay keys


@cache
def _code() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """syndromes of all 23-bit words; by syndrome, the coset leader; by syndrome, up to six errors of weight <= 4 (padded with -1)."""
    shifted = np.arange(1 << 23, dtype=np.int32)
    for bit in range(22, 10, -1):
        shifted ^= np.where(shifted >> bit & 1, GENERATOR << (bit - 11), 0).astype(np.int32)
    syndrome = shifted.astype(np.int16)
    leader = np.zeros(2048, np.int32)
    near: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(5):
        for bits in combinations(range(23), weight):
            error = sum(1 << b for b in bits)
            s = int(syndrome[error])
            if weight <= 3:
                leader[s] = error
            near[s].append(error)
    table = np.full((2048, 6), -1, np.int32)
    for s, errors in enumerate(near):
        table[s, : len(errors)] = errors
    return syndrome, leader, table


def primary_index(words: np.ndarray) -> np.ndarray:
    """Message (12 bits) of each word's decoded codeword."""
    syndrome, leader, _ = _code()
    return (words ^ leader[syndrome[words]]) >> 11


def probe_indices(words: np.ndarray) -> np.ndarray:
    """Messages of all codewords within distance four, six columns, -1 where there are fewer."""
    syndrome, _, near = _code()
    errors = near[syndrome[words]]
    return np.where(errors < 0, -1, (words[:, None] ^ errors) >> 11)


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position in fps, key, is_probe) of every key of unsigned fingerprints."""
    segs = [((fps >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64) for shift, width in SEGMENTS]
    first, more = [primary_index(s) for s in segs], [probe_indices(s) for s in segs]
    ids = np.arange(len(fps))
    rows: list[tuple[np.ndarray, np.ndarray, bool]] = []
    for kind, (a, b) in enumerate((a, b) for a in range(3) for b in range(3) if a != b):
        exact = np.int64(kind) << 40 | segs[a] << 12
        rows.append((ids, exact | first[b], False))
        for column in more[b].T:
            ok = column >= 0
            rows.append((ids[ok], (exact | column)[ok], True))
    parity = [np.bitwise_count(s.astype(np.uint64)).astype(np.int64) & 1 for s in segs]
    odd = parity[0] << 2 | parity[1] << 1 | parity[2]
    for half, (shift, width) in enumerate(((0, 10), (10, 11))):
        part = np.int64(6 + half) << 40 | (segs[2] >> shift & (1 << width) - 1) << 27
        rows.append((ids, part | odd << 24 | first[0] << 12 | first[1], False))
        for one in more[0].T:
            for two in more[1].T:
                ok = (one >= 0) & (two >= 0)
                rows.append((ids[ok], (part | (odd ^ 7) << 24 | one << 12 | two)[ok], True))
    return np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]), np.repeat([r[2] for r in rows], [len(r[0]) for r in rows])


# ---------------------------------------------------------------- links


def golay_keys(fps: DataFrame) -> DataFrame:
    """(fp, key, probe) for distinct fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = b.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(values), 2000):
                some = values[at : at + 2000]
                where, key, probe = keys_of(some.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(some[where]), pa.array(key), pa.array(probe)], ["fp", "key", "probe"])

    return fps.select("fp").mapInArrow(run, "fp long, key long, probe boolean")


def _groups(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Runs of equal first column from sorted batches: ("whole", key, fps, flags) of at most limit rows, else ("part", ...) pieces."""
    held: list[np.ndarray] | None = None
    large = None  # key of a run that is already known to be over the limit
    for b in batches:
        new = [b.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        if not len(new[0]):
            continue
        cols = new if held is None else [np.concatenate(x) for x in zip(held, new)]
        key = cols[0]
        last = int(np.searchsorted(key, key[-1]))  # the last run may go on
        done, held = [c[:last] for c in cols], [c[last:] for c in cols]
        if large is not None and len(done[0]):
            end = int(np.searchsorted(done[0], large, side="right"))
            if end:
                yield "part", done[1][:end], done[2][:end]
                done = [c[end:] for c in done]
            large = None
        yield from _whole(done, limit)
        if large == held[0][0] or len(held[0]) > limit:
            large = held[0][0]
            yield "part", held[1], held[2]
            held = None
        else:
            large = None
    if held is not None:
        yield from _whole(held, limit)


def _whole(cols: list[np.ndarray], limit: int) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    key, fp, flag = cols
    if not len(key):
        return
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    ends = np.append(starts[1:], len(key))
    mixed = np.minimum.reduceat(fp, starts) != np.maximum.reduceat(fp, starts)
    for a, b in zip(starts[mixed].tolist(), ends[mixed].tolist()):
        yield "whole" if b - a <= limit else "part", fp[a:b], flag[a:b]


def bucket_links(keys: DataFrame, bucket_limit: int = 128) -> DataFrame:
    """(a, b): verified links of buckets of up to bucket_limit rows; (a, null): a member of a larger bucket.

    One shuffle by key; each task streams its sorted rows and holds one bucket at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, fp, probe in _groups(batches, bucket_limit):
            if kind == "part":
                a = np.unique(fp)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.nulls(len(a), pa.int64())], ["a", "b"])
            elif probe.any() and not probe.all():
                x, y = fp[~probe], fp[probe]
                near = np.bitwise_count(x.view(np.uint64)[:, None] ^ y.view(np.uint64)) <= LINK_BITS
                i, j = np.nonzero(near & (x[:, None] != y))
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(x[i]), pa.array(y[j])], ["a", "b"])

    return keys.select("key", "fp", "probe").repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def star_links(fps: DataFrame) -> DataFrame:
    """(a, b): links that connect the same fingerprints as all pairs within three bits, 2081 rows for each fingerprint.

    Fingerprints within one bit of z come first in z's run, so the first row is the centre if there is one.
    """
    one = np.array([0, *(1 << b for b in range(64))], dtype=np.uint64)
    two = np.array([1 << a | 1 << b for a, b in combinations(range(64), 2)], dtype=np.uint64)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = np.concatenate([one, two])
        far = np.repeat([False, True], [len(one), len(two)])
        for b in batches:
            values = b.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(values), 16):
                some = values[at : at + 16]
                z = (some.view(np.uint64)[:, None] ^ masks).ravel().view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(z), pa.array(np.repeat(some, len(masks))), pa.array(np.tile(far, len(some)))], ["z", "fp", "far"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z_now, centre = None, None
        for b in batches:
            z, fp, far = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if not len(z):
                continue
            starts = np.flatnonzero(np.concatenate(([True], z[1:] != z[:-1])))
            hub, has = fp[starts].copy(), ~far[starts]
            if z_now is not None and z[0] == z_now:
                hub[0], has[0] = (centre if centre is not None else 0), centre is not None
            sizes = np.diff(np.append(starts, len(z)))
            a, ok = np.repeat(hub, sizes), np.repeat(has, sizes)
            ok &= a != fp
            z_now, centre = z[-1], (hub[-1] if has[-1] else None)
            yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(fp[ok])], ["a", "b"])

    spread_out = fps.select("fp").mapInArrow(spread, "z long, fp long, far boolean")
    return spread_out.repartition("z").sortWithinPartitions("z", "far", "fp").mapInArrow(gather, "a long, b long")


def _crowded_keys(fps: DataFrame) -> DataFrame:
    """Keys of buckets that a sample shows to be large: their members need no sorting to be known as crowded.

    Which keys are found changes how the work is shared, never the links.
    """
    sample = fps.filter(F.pmod(F.xxhash64("fp"), F.lit(SAMPLED)) == 0)
    return golay_keys(sample).groupBy("key").count().filter(F.col("count") >= LEAST_SAMPLED).select(F.col("key").alias("large"))


def near_duplicate_classes(prints: DataFrame, bucket_limit: int = 128) -> DataFrame:
    """(fp, rep, component_id, head) for the distinct fingerprints of prints(doc_id, fp).

    rep and component_id are the smallest doc_id with that fingerprint and in
    that component; null only where every such id is null.  head tells one
    fingerprint of each component: the one with component_id, and where that is
    null the smallest.
    """
    reps = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    width = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = reps.select("fp").repartition(max(width, reps.count() // FPS_PER_TASK))  # few files, many keys each
    large = durable(_crowded_keys(reps))
    keys = golay_keys(spread).join(sized_broadcast(large), F.col("key") == F.col("large"), "left")
    in_large = keys.filter("large is not null").select(F.col("fp").alias("a"), F.lit(None).cast("long").alias("b"))
    found = durable(bucket_links(keys.filter("large is null"), bucket_limit).union(in_large).distinct())
    crowded = found.filter("b is null").select(F.col("a").alias("fp"))
    links = found.filter("b is not null").union(star_links(crowded).distinct())
    linked = connected_components(links).withColumnRenamed("node", "fp").join(reps, "fp")
    lowest = linked.groupBy("component").agg(F.min("rep").alias("low"))
    linked = linked.join(lowest, "component").select("fp", "low", "component")
    rows = reps.join(linked, "fp", "left").withColumn("component_id", F.coalesce("low", "rep"))
    head = F.when(F.col("component_id").isNull(), F.col("fp") == F.coalesce("component", "fp")).otherwise(F.col("rep").eqNullSafe(F.col("component_id")))
    done = durable(rows.select("fp", "rep", "component_id", head.alias("head")))
    forget(found, large)
    return done


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_limit: int = 128) -> DataFrame:
    """doc_id, fingerprint, component_id for every row of docs.

    Null and empty texts have fingerprint zero and are linked like any other;
    rows with a null id are linked but name no component; repeated rows come
    out repeated; an empty table gives an empty result.
    """
    prints = durable(with_fingerprints(docs, id_col, text_col))
    classes = near_duplicate_classes(prints, bucket_limit)
    return prints.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_limit: int = 128) -> DataFrame:
    """The rows of docs, all columns kept, with one document of each near-duplicate component: the smallest id.

    Ids that are null count as larger than any other; where a component has no
    id at all, one row of its smallest fingerprint stays.  Of rows that repeat
    that id (or have none) and that fingerprint one stays.  Null texts count as
    empty; an empty table stays empty.  What stays is decided on ids,
    fingerprints and hashes of texts; the texts move once, to be joined with it.
    """
    prints = durable(with_fingerprints(docs, id_col, text_col))
    heads = near_duplicate_classes(prints, bucket_limit).filter("head").select("fp", "rep")
    same = (prints["fp"] == heads["fp"]) & prints["doc_id"].eqNullSafe(heads["rep"])
    chosen = prints.join(heads, same, "left_semi").groupBy("doc_id", "fp").agg(F.min("mark").alias("mark"))
    id_name, mark_name = free_name("kept_id", docs), free_name("kept_mark", docs)
    keep = chosen.select(F.col("doc_id").alias(id_name), F.col("mark").alias(mark_name))
    own_id, own_mark = free_name("own_id", docs), free_name("own_mark", docs)
    marked = docs.withColumns({own_id: F.col(id_col).try_cast("long"), own_mark: _mark(text_col)})
    kept = marked.join(keep, F.col(own_id).eqNullSafe(F.col(id_name)) & (F.col(own_mark) == F.col(mark_name)), "left_semi")
    return kept.dropDuplicates([own_id, own_mark]).select(*own_columns(docs))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
