"""Removal of repeated passages, by two-stage suffix sorting.

A byte goes if a string of LENGTH bytes that covers it also starts somewhere
else, in any text.  Texts are cut so that Spark can deal the work out and still
every two equal strings of that length meet:

* Each window of LENGTH bytes has an anchor, the GRAM bytes in it of smallest
  hash, the last of equal ones.  Equal windows have equal anchors in the same
  place.  A segment is what the neighbouring windows of one anchor cover; only
  its anchor's hash, its own hash and its places leave the text.
* Equal segments are counted, in each task before the shuffle, so passages that
  any number of texts share shrink to one row.  All windows of a segment that
  occurs twice are repeated.
* Different segments with one anchor may still share windows.  One copy of each
  is fetched and suffixes are sorted: in a block of bounded size, those smaller
  than their successors are sorted directly, the others are induced from them
  by a scan over the buckets of first bytes, and common prefixes of neighbours
  tell which windows are repeated.
* The segments of a very frequent anchor are spread over several blocks.  Each
  block sorts its part; what it leaves single is then compared between blocks by
  a 128-bit hash of each different window, one row a block.

Hashes that stand for content have 128 bits, those of anchors 64; a collision of
the latter only brings segments into one block that have nothing in common.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfield.llm.common import durable, read

LENGTH = 200
#: Bytes of an anchor: a power of two.
GRAM = 32
#: Bytes of segments in a block, about; an anchor with more is spread over several blocks.
BLOCK_BYTES = 1 << 20
#: Windows that are looked at in one step, and bytes of texts that are cut together.
_STEP = 1 << 18
_TOGETHER = 1 << 19
#: A byte that no UTF-8 text holds.
_BETWEEN = 0xFF
_PLACE = (1 << 24) - 1


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_CODES = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def gram_hashes(text: np.ndarray, size: int = GRAM) -> np.ndarray:
    """64-bit hash of each run of size bytes, size a power of two."""
    h, width = _BYTE_CODES[text], 1
    while width < size:
        h = h[:-width] * np.uint64(0x9E3779B97F4A7C15 + 2 * width) + h[width:]
        width *= 2
    return _mixed(h)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each width neighbouring values."""
    least, have = values, 1
    while 2 * have <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    n = len(values) - width + 1
    return np.minimum(least[:n], least[width - have : width - have + n])


def anchors(text: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """For each window of length bytes, the place of its anchor and the anchor's hash."""
    h = gram_hashes(text, gram)
    n = len(h) - (length - gram)
    # the order is that of the hash's upper 40 bits, then of later places; places are told apart within one step only
    keys = (h & ~np.uint64(_PLACE)) | (np.uint64(_PLACE) - np.arange(len(h), dtype=np.uint64))
    place = _PLACE - (sliding_least(keys, length - gram + 1)[:n] & np.uint64(_PLACE)).astype(np.int64)
    return place, h[place].view(np.int64)


def segments_of(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text number, anchor hash, own hash, first window, further windows) of all segments of texts, which are cut together."""
    whole = b"".join(texts)
    data = np.frombuffer(whole, np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    starts = ends - np.array([len(t) for t in texts])
    found: list[list[np.ndarray]] = []
    for step in range(0, max(0, len(data) - length + 1), _STEP):
        place, code = anchors(data[step : step + _STEP + length - 1], length, gram)
        at = np.arange(step, step + len(place))
        owner = np.searchsorted(ends, at, side="right")
        inside = at + length <= ends[owner]  # windows over the end of a text are none
        new = np.ones(len(at), bool)
        new[1:] = (place[1:] != place[:-1]) | (owner[1:] != owner[:-1]) | ~inside[:-1]
        first = np.flatnonzero(new & inside)
        # a segment ends before the next one or before the first window that crosses an end
        last = np.flatnonzero(inside & np.append(new[1:] | ~inside[1:], True))
        found.append([owner[first], code[first], at[first], at[last] - at[first]])
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    owner, code, at, more = (np.concatenate(x) for x in zip(*found))
    digest, view = xxhash.xxh3_64_intdigest, memoryview(whole)
    own = np.array([digest(view[a:b]) for a, b in zip(at.tolist(), (at + more + length).tolist())], np.uint64).view(np.int64)
    return owner, code, own, at - starts[owner], more


_SEGMENTS = "uid long, anchor long, own long, more int, places array<int>"


def cut(texts: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(uid, anchor, own, more, places) of texts(uid, body): each different segment of a text once, with the places where it starts."""

    def rows(uids: list[int], bodies: list[bytes]) -> pa.RecordBatch:
        owner, code, own, at, more = segments_of(bodies, length, gram)
        order = np.lexsort((at, own, code, owner))
        owner, code, own, at, more = (x[order] for x in (owner, code, own, at, more))
        new = np.ones(len(owner), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (code[1:] != code[:-1]) | (own[1:] != own[:-1])
        first = np.flatnonzero(new)
        places = pa.ListArray.from_arrays(pa.array(np.append(first, len(owner)), pa.int32()), pa.array(at, pa.int32()))
        ids = np.array(uids, np.int64)[owner[first]]
        return pa.RecordBatch.from_arrays(
            [pa.array(ids), pa.array(code[first]), pa.array(own[first]), pa.array(more[first], pa.int32()), places], ["uid", "anchor", "own", "more", "places"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uids: list[int] = []
        bodies: list[bytes] = []
        size = 0
        for b in batches:
            for uid, body in zip(b.column(0).to_pylist(), b.column(1)):
                text = body.as_py()
                if len(text) < length:
                    continue
                uids.append(uid)
                bodies.append(text)
                size += len(text)
                if size >= _TOGETHER:
                    yield rows(uids, bodies)
                    uids, bodies, size = [], [], 0
        if uids:
            yield rows(uids, bodies)

    return texts.select("uid", "body").mapInArrow(run, _SEGMENTS)


def suffix_order(text: np.ndarray, wanted: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """The wanted places of text, and those they are induced from, in the order of the first depth bytes of their suffixes.

    A suffix is smaller than its successor if the byte after its first run of
    equal bytes is the larger one; those are sorted directly.  A larger one
    starts with a run of its byte c and goes on with a suffix that begins with a
    smaller byte; so, bucket by bucket of c, such suffixes follow from the length
    of that run and the rank of what comes after it, which an earlier bucket has.
    In its bucket a larger suffix stands before all smaller ones.
    """
    n = len(text)
    edges = np.append(np.flatnonzero(text[1:] != text[:-1]) + 1, n)
    after = np.repeat(edges, np.diff(edges, prepend=0))  # where the run of equal bytes that holds a place ends
    following = np.append(text, np.uint8(0)).astype(np.int16)
    following[n] = -1  # the end is smaller than any byte
    larger = following[after] < following[:n]
    needed = np.zeros(n + 1, bool)
    fresh = wanted
    while len(fresh):
        needed[fresh] = True
        fresh = np.unique(after[fresh[larger[fresh]]])
        fresh = fresh[(fresh < n) & ~needed[fresh]]
    places = np.flatnonzero(needed[:n])
    direct = places[~larger[places]]
    padded = np.concatenate([text, np.zeros(depth, np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, depth)[direct]
    direct = direct[np.argsort(np.ascontiguousarray(rows).view(f"S{depth}").ravel(), kind="stable")]
    induced = places[larger[places]]
    rank = np.full(n + 1, -1, np.int64)
    by_byte = lambda some: np.split(some, np.cumsum(np.bincount(text[some], minlength=256))[:-1])
    induced = induced[np.argsort(text[induced], kind="stable")]
    order, ranked = [], 0
    for left, right in zip(by_byte(induced), by_byte(direct)):
        end = after[left]
        left = left[np.lexsort((rank[end], end - left))]
        bucket = np.concatenate([left, right])
        rank[bucket] = np.arange(ranked, ranked + len(bucket))
        ranked += len(bucket)
        order.append(bucket)
    return np.concatenate(order)


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """For each neighbours in order, how many first bytes they share, depth at most; depth is a multiple of eight."""
    padded = np.concatenate([text, np.zeros(depth + 8, np.uint8)])
    words = np.ndarray((len(padded) - 7,), ">u8", padded.data, strides=(1,)).astype(np.uint64)
    shared = np.zeros(max(0, len(order) - 1), np.int64)
    at = np.arange(len(shared))
    for k in range(0, depth, 8):
        differ = words[order[at] + k] ^ words[order[at + 1] + k]
        equal = differ == 0
        unlike = differ[~equal]
        bits = np.zeros(len(unlike), np.int64)  # leading zero bits of the difference, by halves
        for half in (32, 16, 8):
            free = unlike < (np.uint64(1) << np.uint64(64 - half))
            bits[free] += half
            unlike = np.where(free, unlike << np.uint64(half), unlike)
        shared[at[~equal]] = k + bits // 8
        at = at[equal]
        if not len(at):
            break
    shared[at] = depth
    return shared


_MARKS = "anchor long, own long, first int, last int, window binary"


def sort_block(key, table: pa.Table, length: int = LENGTH) -> pa.Table:
    """Marks of the segments (anchor, own, n, more, spread, content) of a block.

    Marks without `window` are ranges of windows that are repeated, of segments
    that occur once.  Of spread anchors every different window of the block gives
    one mark with its hash: with its place if it is undecided, without if it is
    known to be repeated.
    """
    contents = [x.as_py() for x in table.column("content").combine_chunks()] if table.num_rows else []
    more = table.column("more").to_numpy().astype(np.int64)
    once, spread = table.column("n").to_numpy() == 1, table.column("spread").to_numpy(zero_copy_only=False).astype(bool)
    between = bytes([_BETWEEN])
    text = np.frombuffer(between.join(contents) + between, np.uint8)
    starts = np.cumsum([0] + [len(c) + 1 for c in contents])[:-1]
    windows = more + 1
    segment = np.repeat(np.arange(len(contents)), windows)
    offset = np.arange(len(segment)) - np.repeat(np.cumsum(windows) - windows, windows)
    order = suffix_order(text, starts[segment] + offset, length)
    alike = common_prefixes(text, order, length) >= length
    group = np.zeros(len(order), np.int64)
    group[1:] = np.cumsum(~alike)
    twice = np.bincount(group) > 1
    group_of = np.full(len(text), -1, np.int64)
    group_of[order] = group
    mine = group_of[starts[segment] + offset]
    repeated = twice[mine]
    shown = repeated & once[segment]
    edge = np.ones(len(shown), bool)
    edge[1:] = (shown[1:] != shown[:-1]) | (segment[1:] != segment[:-1])
    first = np.flatnonzero(edge)
    last = np.append(first[1:], len(shown)) - 1
    first, last = first[shown[first]], last[shown[first]]
    rows = [(segment[first], offset[first], offset[last], [None] * len(first))]
    part = np.flatnonzero(spread[segment])
    if len(part):
        _, one = np.unique(mine[part], return_index=True)  # one row for each different window
        chosen = part[one]
        known = repeated[chosen] | ~once[segment[chosen]]
        digest = [xxhash.xxh3_128_digest(contents[s][o : o + length]) for s, o in zip(segment[chosen].tolist(), offset[chosen].tolist())]
        at = np.where(known, -1, offset[chosen])
        rows.append((segment[chosen], at, at, digest))
    which = np.concatenate([r[0] for r in rows])
    column = lambda name: table.column(name).to_numpy()[which]
    return pa.table(
        [pa.array(column("anchor")), pa.array(column("own")), pa.array(np.concatenate([r[1] for r in rows]), pa.int32()),
         pa.array(np.concatenate([r[2] for r in rows]), pa.int32()), pa.array([x for r in rows for x in r[3]], pa.binary())],
        ["anchor", "own", "first", "last", "window"],
    )


def repeated_ranges(texts: DataFrame, segments: DataFrame, length: int = LENGTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(anchor, own, first, last): ranges of repeated windows in the segments of stored tables texts and segments."""
    counted = durable(
        segments.groupBy("anchor", "own").agg(
            F.sum(F.size("places").cast("long")).alias("n"), F.first("more").alias("more"), F.min("uid").alias("uid"), F.min_by(F.get("places", 0), "uid").alias("place")
        )
    )
    size = (F.col("more") + length).cast("long")
    several = durable(counted.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum(size).alias("bytes")).filter("kinds > 1"))
    total = several.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    blocks = total // block_bytes + 1
    parts = F.ceil(F.col("bytes") / block_bytes)
    places = counted.join(several.select("anchor", parts.alias("parts")), "anchor")
    places = places.withColumn("block", F.pmod(F.xxhash64("anchor", F.pmod("own", "parts")), F.lit(blocks)))
    content = F.substring(F.col("body"), F.col("place") + 1, F.col("more") + length)
    fetched = places.join(texts.select("uid", "body"), "uid").select("block", "anchor", "own", "n", "more", (F.col("parts") > 1).alias("spread"), content.alias("content"))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        return sort_block(key, table, length)

    marks = durable(fetched.groupBy("block").applyInArrow(run, _MARKS))
    known = counted.filter("n > 1").select("anchor", "own", F.lit(0).alias("first"), F.col("more").alias("last"))
    inside = marks.filter("window is null").select("anchor", "own", "first", "last")
    across = marks.filter("window is not null")
    both = across.groupBy("window").agg(F.count("*").alias("m")).filter("m > 1").select("window")
    between = across.filter("first >= 0").join(both, "window").select("anchor", "own", "first", "last")
    return known.unionByName(inside).unionByName(between)


def covered(starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    """Ranges joined where they overlap or touch, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(starts, ends)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(uid, doc_id, body, starts, ends) of every row: its UTF-8 bytes, and ranges of bytes that repeated strings cover, null where there are none."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("body"))
    texts = durable(narrow.withColumn("uid", F.monotonically_increasing_id()), "zstd")
    segments = durable(cut(texts, length))
    ranges = durable(repeated_ranges(texts, segments, length, block_bytes))
    hits = segments.join(ranges, ["anchor", "own"]).select("uid", F.explode("places").alias("place"), "first", "last")
    spans = hits.select("uid", (F.col("place") + F.col("first")).alias("a"), (F.col("place") + F.col("last") + length).alias("b"))
    listed = spans.groupBy("uid").agg(F.collect_list("a").alias("starts"), F.collect_list("b").alias("ends"))
    return texts.join(listed, "uid", "left")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) of every row; length is a multiple of eight, larger than GRAM.

    All copies of a repeated string go, the first one too.  Null texts count as
    empty; texts of fewer than length bytes lose nothing; rows that repeat a
    text of length bytes or more lose all of it; texts are taken whole, however
    long; ids may be null, repeated and of any type; an empty table stays empty;
    other columns are not looked at.  What is kept is bytes, since a cut may
    fall inside a character.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, sizes, removed, numbers = [], [], [], []
            for body, starts, ends in zip(b.column(1), b.column(2), b.column(3)):
                text = body.as_py()
                spans = covered(starts.as_py() or [], ends.as_py() or [])
                edges = [0, *(x for s in spans for x in s), len(text)]
                rest = b"".join(text[x:y] for x, y in zip(edges[::2], edges[1::2]))
                kept.append(rest)
                sizes.append(len(text))
                removed.append(len(text) - len(rest))
                numbers.append(len(spans))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(x, pa.int64()) for x in (sizes, removed, numbers)), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
            )

    rows = repeated_spans(docs, id_col, text_col, length, block_bytes).select("doc_id", "body", "starts", "ends")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def op12_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP12_SQL = f"""with docs as (select doc_id, encode(coalesce(text, '')) as body from documents), sized as (select doc_id, body, octet_length(body) as n from docs),
windows as (select doc_id, pos, md5(array_slice(body, pos + 1, pos + {LENGTH})) as m from (select doc_id, body, unnest(range(0, n - {LENGTH - 1})) as pos from sized)),
twice as (select m from windows group by 1 having count(*) > 1), hits as (select doc_id, pos from windows join twice using (m)),
marked as (select doc_id, pos, case when pos <= lag(pos) over (partition by doc_id order by pos) + {LENGTH} then 0 else 1 end as new from hits),
numbered as (select doc_id, pos, sum(new) over (partition by doc_id order by pos) as span from marked),
spans as (select doc_id, span, min(pos) as a, max(pos) + {LENGTH} as b from numbered group by 1, 2),
gaps as (select doc_id, body, coalesce(lag(b) over (partition by doc_id order by a), 0) as x, a as y from spans join sized using (doc_id)
  union all select doc_id, body, coalesce(b, 0), n from sized left join (select doc_id, max(b) as b from spans group by 1) using (doc_id)),
kept as (select doc_id, string_agg(hex(array_slice(body, x + 1, y)), '' order by x) as h from gaps where y > x group by 1),
totals as (select doc_id, sum(b - a) as removed, count(*) as n_spans from spans group by 1)
select doc_id, n as n_bytes, cast(coalesce(removed, 0) as bigint) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(h, ''))) as kept_sha256
from sized left join totals using (doc_id) left join kept using (doc_id)"""
