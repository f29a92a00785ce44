"""Scores of many queries: blocks of chunks meet blocks of queries, and each pair of blocks is a few matrix products.

A field's score is linear in the query's frequencies, so a posting's weight is
the same for all queries; rows for single pairs of query and chunk are only
made of a block's best ones.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNKS, QUERIES = 1024, 512
#: Pairs of a term's queries and chunks from which on a dense product costs less than adding them one by one.
_DENSE = 3500
#: Products that are added one by one at once.
_AT_ONCE = 1 << 20
#: Terms whose dense products are made at once.
_WIDE = 1024
#: Terms that a block of chunks has at most, if it has more than one chunk.
TERMS = 1 << 18


def packed(rows: DataFrame, most: int) -> DataFrame:
    """One row `name` for each group of at most most rows that lie together, as an array of structs."""
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = pa.StructArray.from_arrays(batch.columns, fields=list(batch.schema))
            for at in range(0, len(own), most):
                part = own.slice(at, most)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays([0, len(part)], pa.concat_arrays([part]))], ["rows"])

    return rows.mapInArrow(gather, f"rows array<{rows.schema.simpleString()}>")


@dataclass(frozen=True)
class Block:
    """rows, and the columns of their terms in the order of ids; `at` is a term's row."""

    rows: pa.RecordBatch
    terms: dict[str, np.ndarray]

    def __len__(self) -> int:
        return self.rows.num_rows

    def of(self, name: str) -> np.ndarray:
        return self.rows.column(name).to_numpy(zero_copy_only=False)

    @cached_property
    def _kinds(self) -> dict[int, dict[str, np.ndarray]]:
        return {}

    def kind(self, k: int) -> dict[str, np.ndarray]:
        if k not in self._kinds:
            own = self.terms["kind"] == k
            self._kinds[k] = self.terms if own.all() else {n: x[own] for n, x in self.terms.items()}
        return self._kinds[k]

    def some(self, at: np.ndarray) -> Block:
        """The block of some of the rows."""
        place = np.full(len(self), -1, np.int32)
        place[at] = np.arange(len(at), dtype=np.int32)
        own = place[self.terms["at"]] >= 0
        return Block(self.rows.take(pa.array(at)), {n: x[own] if n != "at" else place[x[own]] for n, x in self.terms.items()})

    def stored(self) -> bytes:
        """Both tables in Arrow's stream format, one behind the other; packed, since many blocks wait in a task's batch."""
        sink = pa.BufferOutputStream()
        for part in (self.rows, pa.RecordBatch.from_arrays(list(map(pa.array, self.terms.values())), list(self.terms))):
            with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
                out.write_batch(part)
        return sink.getvalue().to_pybytes()

    @staticmethod
    def loaded(data: bytes) -> Block:
        source = pa.BufferReader(data)
        rows, terms = _read(source), _read(source)
        return Block(rows, {f.name: terms.column(f.name).to_numpy() for f in terms.schema})


def _read(source: pa.BufferReader) -> pa.RecordBatch:
    """The batch of a stream that another one may follow."""
    with pa.ipc.open_stream(source) as stream:
        return stream.read_all().to_batches()[0]


#: Rows of terms that are taken together where blocks are cut.
_TOGETHER = 100_000


def packed_terms(terms: DataFrame, most: int, key: Sequence[str]) -> DataFrame:
    """One row (corpora, block), a stored Block, for each group of at most most rows; terms(key, corpus_id, about, id, kind, ...) has a row for each term of them, those of a key one behind the other.

    The columns up to id are the rows' own.
    """
    about = terms.columns[: terms.columns.index("id")]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for made in cut(batches, most, key, about):
            yield _row(made)

    return terms.mapInArrow(pack, STORED)


#: What a stored Block is in a table: it and the corpora of its rows.
STORED = "corpora array<string>, block binary"


def _row(made: Block) -> pa.RecordBatch:
    corpora = pc.unique(made.rows.column("corpus_id")).cast(pa.string())
    return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays([0, len(corpora)], corpora), pa.array([made.stored()], pa.binary())], ["corpora", "block"])


def hashed(texts: pa.Array) -> np.ndarray:
    """64 bits for each text."""
    codes = texts.dictionary_encode()
    return pd.util.hash_array(codes.dictionary.to_numpy(zero_copy_only=False).astype(object), categorize=False)[codes.indices.to_numpy()]


def term_ids(corpora: np.ndarray, kind: np.ndarray, terms: pa.Array) -> np.ndarray:
    """Numbers of terms of a kind in a corpus, whose hashed() texts are given; two of a million differing terms get the same with a chance of about 3e-8."""
    mixed = hashed(terms) * np.uint64(0x9E3779B97F4A7C15) + corpora * np.uint64(0xC2B2AE3D27D4EB4F) + kind.astype(np.uint64) * np.uint64(0x165667B19E3779F9)
    return (mixed ^ (mixed >> np.uint64(29))).view(np.int64)


def weight(tf: np.ndarray, dl: np.ndarray, average: np.ndarray, k1: float, b: float) -> np.ndarray:
    """What a frequency in a row of a length is worth in BM25, without the term's own idf."""
    with np.errstate(all="ignore"):
        return np.where(tf > 0, tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / average)), 0.0)


def packed_counts(rows: DataFrame, most: int, wanted: np.ndarray, k1: float, b: float) -> DataFrame:
    """Rows (corpora, block) as of packed_terms(), of rows(corpus_id, ..., content_dl, metadata_dl, content_avgdl, metadata_avgdl, counts, of_chunk, of_file).

    The last three hold (kind_no, term, content_tf, own_tf, file_tf); terms whose number, modulo the length of wanted, is not wanted are left out.
    A block has rows of one corpus, as they come, and at most TERMS terms if it has more than one row.
    """
    about = rows.columns[: rows.columns.index("content_dl")]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.take(pc.sort_indices(batch.column("corpus_id"))) if len(pc.unique(batch.column("corpus_id"))) > 1 else batch
            yield from map(_row, _weighed(batch, about, most, wanted, k1, b))

    return rows.mapInArrow(pack, STORED)


def _weighed(batch: pa.RecordBatch, about: Sequence[str], most: int, wanted: np.ndarray, k1: float, b: float) -> Iterator[Block]:
    """Blocks of the rows of a batch, those of a corpus one behind the other."""
    lists, n = [batch.column(n) for n in ("counts", "of_chunk", "of_file")], batch.num_rows
    at = np.concatenate([np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(x), 0).to_numpy()) for x in lists])
    flat = [x.flatten() for x in lists]
    own = {x: pa.concat_arrays([f.field(x) for f in flat]) for x in ("kind_no", "term", "content_tf", "own_tf", "file_tf")}
    kind = own["kind_no"].to_numpy().astype(np.int8)
    ids = term_ids(hashed(batch.column("corpus_id"))[at], kind, own["term"])
    keep = np.flatnonzero(wanted[ids & (len(wanted) - 1)])
    keep = keep[np.argsort(at[keep].astype(np.int16) if n < 1 << 15 else at[keep], kind="stable")]
    at, whole, ids, kind = at[keep], own["content_tf"].is_null().to_numpy(zero_copy_only=False)[keep], ids[keep], kind[keep]
    content, mine, in_file = (pc.fill_null(own[x], 0).to_numpy()[keep] for x in ("content_tf", "own_tf", "file_tf"))
    of = lambda x: pc.fill_null(batch.column(x), 0).to_numpy()[at].astype(float)
    text, held = kind == 0, lambda tf: weight(tf, of("metadata_dl"), of("metadata_avgdl"), k1, b)
    metadata = held(np.where(whole, in_file, mine + in_file)) - np.where(whole, 0.0, held(in_file))
    terms = {
        "id": ids, "kind": kind, "content": np.where(text, weight(content, of("content_dl"), of("content_avgdl"), k1, b), 0.0),
        "metadata": np.where(text, metadata, 0.0), "shared": (text & (whole | (in_file == 0))).astype(np.int8),
    }
    ends, rows = np.searchsorted(at, np.arange(n), side="right"), batch.select(about)
    corpus = pc.dictionary_encode(batch.column("corpus_id")).indices.to_numpy()
    begin = 0
    while begin < n:
        first = ends[begin - 1] if begin else 0
        end = max(begin + 1, min(begin + most, np.searchsorted(ends, first + TERMS, side="right"), begin + np.searchsorted(corpus[begin:], corpus[begin], side="right")))
        some = slice(first, ends[end - 1])
        order = np.argsort(ids[some], kind="stable")
        yield Block(rows.slice(begin, end - begin), {"at": (at[some] - begin).astype(np.int32)[order]} | {k: x[some][order] for k, x in terms.items()})
        begin = end


def cut(batches: Iterator[pa.RecordBatch], most: int, key: Sequence[str], about: Sequence[str], together: int = _TOGETHER) -> Iterator[Block]:
    """Blocks of at most most rows of the terms in batches, in which those of a key lie one behind the other; about are the rows' own columns."""
    held, n = [], 0
    for batch in batches:
        held, n = [*held, batch], n + batch.num_rows
        if n > together:
            done, rest = _cut(held, most, key, about, False)
            yield from done
            held, n = [rest], 0
    if sum(b.num_rows for b in held):
        yield from _cut(held, most, key, about, True)[0]


def _cut(held: Sequence[pa.RecordBatch], most: int, key: Sequence[str], about: Sequence[str], last: bool) -> tuple[list[Block], pa.RecordBatch]:
    """Full blocks, and what more rows may follow; the last time all blocks."""
    whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    new = [pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False) for c in map(whole.column, key)]
    starts = np.r_[0, np.flatnonzero(np.logical_or.reduce(new)) + 1]
    full = len(starts) if last else (len(starts) - 1) // most * most
    ends, out = np.r_[starts[1:], whole.num_rows], []
    for at in range(0, full, most):
        own = starts[at : min(at + most, full)]
        some = whole.slice(own[0], ends[at + len(own) - 1] - own[0])
        out.append(_block(some, own - own[0], about))
    return out, whole.slice(starts[full] if full < len(starts) else whole.num_rows)


def _block(some: pa.RecordBatch, starts: np.ndarray, about: Sequence[str]) -> Block:
    at = np.repeat(np.arange(len(starts), dtype=np.int32), np.diff(np.r_[starts, some.num_rows]))
    order = np.argsort(some.column("id").to_numpy(), kind="stable")
    own = {n: some.column(n).to_numpy()[order] for n in some.schema.names if n not in about}
    return Block(some.select(about).take(pa.array(starts)), {"at": at[order]} | own)


def _entries(rows: pa.StructArray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The row of each term, and the terms' fields, in the order of their ids."""
    terms = rows.field("terms")
    flat = terms.flatten()
    at = np.repeat(np.arange(len(rows)), np.diff(terms.offsets.to_numpy()))
    own = {f.name: flat.field(f.name).to_numpy(zero_copy_only=False) for f in flat.type}
    order = np.argsort(own["id"], kind="stable")
    return at[order], {k: v[order] for k, v in own.items()}


def _product(q: tuple[np.ndarray, ...], c: tuple[np.ndarray, ...], shape: tuple[int, int]) -> np.ndarray:
    """Sums over common ids of a query's value times a chunk's; q and c are row, id and value, sorted by id; values of a row's repeated ids add up."""
    return _products((q[0], q[1], [q[2]]), (c[0], c[1], [c[2]]), shape)[0]


def _groups(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ones of sorted ids, where each begins, and how often it is there."""
    first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    return ids[first], first, np.diff(np.r_[first, len(ids)])


def _spans(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of spans, one span behind the other."""
    return np.arange(size.sum()) + np.repeat(first - (np.cumsum(size) - size), size)


def _products(q: tuple, c: tuple, shape: tuple[int, int]) -> list[np.ndarray]:
    """_product() of several values on the same rows and ids, whose places are found once."""
    pairs = range(len(q[2]))
    if not len(c[1]) or not len(q[1]):
        return [np.zeros(shape) for _ in pairs]
    asked, q_first, q_count = _groups(q[1])
    ids, first, count = _groups(c[1])
    spot = np.minimum(np.searchsorted(asked, ids), len(asked) - 1)
    known = asked[spot] == ids
    first, count, q_first, q_count = first[known], count[known], q_first[spot[known]], q_count[spot[known]]
    many = q_count * count > _DENSE
    few = ~many
    out = [np.zeros(shape[0] * shape[1]) for _ in pairs]
    left, size, start = _spans(q_first[few], q_count[few]), np.repeat(count[few], q_count[few]), np.repeat(first[few], q_count[few])
    row, values, met = q[0][left].astype(np.int64) * shape[1], [v[left] for v in q[2]], np.cumsum(size)
    # so many single products at once that they take little memory
    steps = np.searchsorted(met, np.arange(0, met[-1] if len(met) else 0, _AT_ONCE), side="right")
    for begin, end in zip(steps, [*steps[1:], len(met)]):
        own = size[begin:end]
        at = _spans(start[begin:end], own)
        cell = np.repeat(row[begin:end], own) + c[0][at]
        for i in pairs:
            out[i] += np.bincount(cell, np.repeat(values[i][begin:end], own) * c[2][i][at], len(out[i]))
    out, dense = [x.reshape(shape) for x in out], np.flatnonzero(many)
    for begin in range(0, len(dense), _WIDE):
        part = dense[begin : begin + _WIDE]
        wide, column = len(part), np.arange(len(part))
        left, right = _spans(q_first[part], q_count[part]), _spans(first[part], count[part])
        left_cell = q[0][left].astype(np.int64) * wide + np.repeat(column, q_count[part])
        right_cell = np.repeat(column, count[part]) * shape[1] + c[0][right]
        for i in pairs:
            own = np.bincount(left_cell, q[2][i][left], shape[0] * wide).reshape(shape[0], wide)
            out[i] += own @ np.bincount(right_cell, c[2][i][right], wide * shape[1]).reshape(wide, shape[1])
    return out


def worth(asked: dict[str, np.ndarray], name: str) -> np.ndarray:
    """What a query's terms are worth in a field, in which their weights at a chunk do not have it."""
    return asked["qtf"] * asked[f"{name}_idf"] if f"{name}_idf" in asked else asked["qtf"].astype(float)


def fields(q: Block, c: Block) -> tuple[np.ndarray, np.ndarray] | None:
    """content and metadata of all pairs, as sums() has them, where no shared term is worth nothing in both, so that a pair shares one if either is above zero; else None."""
    asked, own = q.kind(0), c.kind(0)
    if not asked.get("plain", np.ones(1, bool)).all() or (np.minimum(own["content"], own["metadata"]) < 0).any() or (own["content"] + own["metadata"] <= 0)[own["shared"] > 0].any():
        return None
    return _field("content", asked, own, (len(q), len(c))), _field("metadata", asked, own, (len(q), len(c)))


def _field(name: str, asked: dict[str, np.ndarray], own: dict[str, np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    some = own[name] != 0
    own = own if some.all() else {n: own[n][some] for n in ("at", "id", name)}
    return _product((asked["at"], asked["id"], worth(asked, name)), (own["at"], own["id"], own[name]), shape)


def structure(q: Block, c: Block, kinds: Sequence[float]) -> np.ndarray | None:
    """What the kinds of terms that pairs share are worth together, or None if no pair can share one."""
    weight, shape = None, (len(q), len(c))
    for k, own in enumerate(kinds, 1):
        left, right = q.kind(k), c.kind(k)
        if len(left["at"]) and len(right["at"]):
            found = own * (_product((left["at"], left["id"], np.ones(len(left["at"]))), (right["at"], right["id"], np.ones(len(right["at"]))), shape) > 0)
            weight = found if weight is None else weight + found
    return weight


def sums(q: Block, c: Block, kinds: Sequence[float]) -> tuple[np.ndarray, ...]:
    """content, metadata, shared and structure of all pairs, and which of them match; kind 0 is text, others are worth what kinds says."""
    shape, asked, own = (len(q), len(c)), q.kind(0), c.kind(0)
    once = np.ones(len(asked["at"]))
    content, shared = _products((asked["at"], asked["id"], [worth(asked, "content"), once]), (own["at"], own["id"], [own["content"], own["shared"].astype(float)]), shape)
    shared, weight = np.rint(shared), structure(q, c, kinds)
    weight = np.zeros(shape) if weight is None else weight
    return content, _field("metadata", asked, own, shape), shared, np.minimum(weight, 1.5) / 1.5, (shared > 0) | (weight > 0)


def shared_terms(q: pa.StructArray, c: pa.StructArray) -> np.ndarray:
    """How many terms each pair of rows shares; terms have ids only."""
    listed = lambda rows: (lambda at, own: (at, own["id"], np.ones(len(at))))(*_entries(rows))
    return np.rint(_product(listed(q), listed(c), (len(q), len(c)))).astype(np.int64)


def best_places(score: np.ndarray, matches: np.ndarray, family: np.ndarray, place: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's k best, and of the best of its k best families; among equals the earlier place.

    More cannot be among the first k of all blocks: a family that is beaten in a block by k others is so everywhere,
    and of the chunks that are not their family's best no more than k count.
    """
    n = score.shape[1]
    key = np.where(matches, np.rint(score * 1e9).astype(np.int64) * n + (n - 1 - place), np.iinfo(np.int64).min)
    order = np.argsort(family, kind="stable")
    first = np.flatnonzero(np.r_[True, np.diff(family[order]) != 0])
    heads = np.maximum.reduceat(key[:, order], first, axis=1)
    least = lambda x: np.partition(x, x.shape[1] - min(k, x.shape[1]), axis=1)[:, [x.shape[1] - min(k, x.shape[1])]]
    own_head = np.empty_like(key)
    own_head[:, order] = np.repeat(heads, np.diff(np.r_[first, n]), axis=1)
    return np.nonzero(matches & ((key >= least(key)) | ((key == own_head) & (key >= least(heads)))))


def bounds(q: Block, c: Block) -> list[np.ndarray]:
    """What content and metadata of a query can be at most at any of the chunks, if no weight is below zero: sums of each term's highest ones."""
    asked, own = q.kind(0), c.kind(0)
    if not len(asked["at"]) or not len(own["at"]):
        return [np.zeros(len(q))] * 2
    ids, first, _ = _groups(own["id"])
    spot = np.minimum(np.searchsorted(ids, asked["id"]), len(ids) - 1)
    known = ids[spot] == asked["id"]
    out = []
    for name in ("content", "metadata"):
        # a chunk has a term's weight in at most two parts, of which one counts as shared
        top = sum(np.maximum.reduceat(np.where((own["shared"] > 0) == part, own[name], 0.0), first) for part in (True, False))
        out.append(np.bincount(asked["at"][known], worth(asked, name)[known] * top[spot[known]], len(q)))
    return out


#: Below every key.
NONE = np.iinfo(np.int64).min


def first_rows(at: np.ndarray, key: np.ndarray, place: Sequence[np.ndarray], family: np.ndarray | None, k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows can be among the first k of their query (at, below n), as best_places() has it, and the key of each query's k-th best family, or NONE where it has fewer.

    Without family each row stands alone.
    """
    order = np.lexsort((*reversed(place), -key, at))
    rank = lambda own: np.arange(len(own)) - np.searchsorted(own, own)
    keep = rank(at[order]) < k
    head = np.ones(len(order), bool)
    if family is not None:
        by_family = np.lexsort((family[order], at[order]))  # stable, so the best of a family stays first
        a, f = at[order][by_family], family[order][by_family]
        head[by_family] = np.r_[True, (a[1:] != a[:-1]) | (f[1:] != f[:-1])][: len(order)]
    heads = order[head]
    spot = rank(at[heads])
    keep[np.flatnonzero(head)[spot < k]] = True
    floor = np.full(n, NONE)
    last = heads[spot == k - 1]
    floor[at[last]] = key[last]
    return order[keep], floor
