"""Subword encoding with seeded merge dropout, and decoding.

Segmentation follows the merge-type model of a SentencePiece file: the best
scored candidate merge is taken first, the leftmost among equals, until none is
left.  With dropout each candidate is skipped for good when a keyed hash of
(seed, document, number of the chunk in the text, place of the merge) falls
below the rate, so every occurrence of a word is segmented by its own draws,
yet can be repeated.  With rate zero the ids equal the library's.

Chunks (a run of word marks and what follows) never merge with each other.
A chunk of many characters (text without blanks) keeps its agenda in a heap, so
time grows little faster than its length; all others go as follows.  What is cached of a chunk holds no draw: the merges that are taken when none of
them is skipped, and for each of these what follows when it is.  An occurrence
only compares its own hashes with the merges on its way.  What is missing, and
chunks too long for that, is segmented all at once with numpy, chunks of similar
length as the rows of a table: every step applies one merge in every unfinished row.

Decoding joins the pieces' bytes and is lossless for every text, also where it
holds the word mark itself, which is always written as bytes.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tarnfield.llm.common import read

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
RATE = 0.1
SEED = 7

MARK = "▁"
_NEVER = np.iinfo(np.int32).max
#: Bounds on memory only: what is dropped is worked out again.
_CACHE_LIMIT = 500_000
_CACHE_SLOTS = 6_000_000
#: Characters of a chunk beyond which every occurrence is segmented from the start (below 256), and beyond which a heap holds the agenda.
_LONG = 24
_WIDE = 400
#: Widths of the tables that chunks are put in.
_WIDTHS = (4, 8, 12, 17, 24, 60, 150, _WIDE)
_MASK = (1 << 64) - 1
_DOCS_AT_ONCE = 256


class Pieces:
    """Merge table and bytes of one model."""

    def __init__(self, path: str):
        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.vocab_size()
        plain = [i for i in range(n) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))]
        self.ids = {lib.id_to_piece(i): i for i in plain}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece goes over a word mark; chunks would not be independent")
        self.byte_ids = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.content = [b""] * n
        for p, i in self.ids.items():
            self.content[i] = p.replace(MARK, " ").encode()
        for b, i in enumerate(self.byte_ids):
            self.content[i] = bytes([b])
        cut = "" if any("\n" in p for p in self.ids) else "\\n"
        self.chunks = re.compile(f"{MARK}*[^{MARK}{cut}]+|{MARK}+|\\n")

        # characters that only occur inside pieces are symbols too, with ids from n on
        self.symbols = dict(self.ids)
        for c in sorted({c for p in self.ids for c in p} - self.ids.keys()):
            self.symbols[c] = n + len(self.symbols) - len(self.ids)
        self.n, self.span = n, n + len(self.symbols) - len(self.ids) + 1
        self.of_char = np.full(0x110000, self.span - 1, np.int32)  # by code point; unknown ones get the last symbol
        for p, i in self.symbols.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        scores = {i: lib.get_score(i) for i in plain}
        order = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        pairs = {
            self.symbols[p[:k]] * self.span + self.symbols[p[k:]]: (i, order[scores[i]])
            for p, i in self.ids.items()
            for k in range(1, len(p))
            if p[:k] in self.symbols and p[k:] in self.symbols
        }
        self.pairs = pairs
        self._tabulate(pairs)
        self.sizes = np.array([len(x) for x in self.content])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(self.content), np.uint8)

    def _tabulate(self, pairs: dict[int, tuple[int, int]]) -> None:
        """Open addressing over a power of two, at most an eighth full."""
        self.bits = max(10, (8 * len(pairs)).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.made, self.rank = np.zeros(size, np.int32), np.full(size, _NEVER, np.int32)
        keys = np.fromiter(pairs, np.int64, len(pairs))
        for key, at, (piece, rank) in zip(keys.tolist(), self._slot(keys).tolist(), pairs.values()):
            while self.keys[at] >= 0:
                at = (at + 1) & (size - 1)
            self.keys[at], self.made[at], self.rank[at] = key, piece, rank

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, piece made) of each pair of symbols; rank _NEVER where they do not merge."""
        keys = left.astype(np.int64) * self.span + right
        at = self._slot(keys)
        seen = self.keys[at]
        hit = seen == keys
        rest = np.flatnonzero(~hit & (seen >= 0))  # few: the table is sparse
        while len(rest):
            at[rest] = (at[rest] + 1) & (len(self.keys) - 1)
            seen = self.keys[at[rest]]
            found = seen == keys[rest]
            hit[rest[found]] = True
            rest = rest[~found & (seen >= 0)]
        return np.where(hit, self.rank[at], _NEVER), np.where(hit, self.made[at], 0)

    def segment(self, chunks: list[str], keys: np.ndarray, rate: float) -> list[list[int]]:
        """Ids of each chunk; keys are the chunks' 64-bit dropout keys."""
        floor = _floor(rate)
        short = np.array([k for k, c in enumerate(chunks) if len(c) <= _WIDE], np.int64)
        own = keys[short]
        skip = lambda word, a, b, c: _mix(own[word] ^ _mix(_place(a, b, c))) < floor
        done: list[list[int] | None] = [None] * len(chunks)
        flat, sizes, _, _ = self.agenda([chunks[k] for k in short.tolist()], skip if rate > 0 else None)
        ends, ids = np.cumsum(sizes).tolist(), flat.tolist()
        for k, a, b in zip(short.tolist(), [0, *ends], ends):
            done[k] = ids[a:b]
        return [self.wide(c, int(keys[k]), int(floor) if rate > 0 else 0) if x is None else x for k, (c, x) in enumerate(zip(chunks, done))]

    def wide(self, chunk: str, key: int, floor: int) -> list[int]:
        """Ids of one chunk of any length: candidates wait in a heap by rank and place, and stale ones are passed over."""
        sym = self.of_char[np.frombuffer(chunk.encode("utf-32-le"), np.uint32)].tolist()
        n, pairs, span = len(sym), self.pairs, self.span
        end, last = list(range(1, n + 1)), list(range(-1, n))
        heap: list[tuple[int, int, int, int, int]] = []

        def consider(a: int, b: int) -> None:
            if a >= 0 and b < n and (found := pairs.get(sym[a] * span + sym[b])) and not (floor and _one_mix(key ^ _one_mix(_one_place(a, b, end[b]))) < floor):
                heap.append((found[1], a, b, end[b], found[0]))

        for a in range(n - 1):
            consider(a, a + 1)
        heapify(heap)
        while heap:
            _, a, b, c, made = heappop(heap)
            if sym[a] < 0 or end[a] != b or sym[b] < 0 or end[b] != c:
                continue
            sym[a], sym[b], end[a], last[c] = made, -1, c, a
            for x, y in ((last[a], a), (a, c)):
                before = len(heap)
                consider(x, y)
                if len(heap) > before:
                    heappush(heap, heap.pop())
        out: list[int] = []
        at = 0
        while at < n:
            out += (sym[at],) if sym[at] < self.n else [self.byte_ids[x] for x in chunk[at : end[at]].encode()]
            at = end[at]
        return out

    def agenda(self, chunks: list[str], skip: Callable[..., np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of chunks of up to _WIDE characters, all ids in a row, how many each has, and (chunk, place) of the merges done, by chunk in their order.

        skip(chunk, start, middle, end) tells which candidates are left out.
        """
        lengths = np.array([len(c) for c in chunks], np.int64)
        table = np.searchsorted(_WIDTHS, lengths)
        merged: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]
        parts, order = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        sizes = np.zeros(len(chunks), np.int64)
        for k in np.unique(table).tolist():
            own = np.flatnonzero(table == k)
            flat, sizes[own] = self._sweep(own, [chunks[i] for i in own.tolist()], lengths[own], _WIDTHS[k], skip, merged)
            parts.append(flat)
            order.append(own)
        of, place = (np.concatenate(x) for x in zip(*merged))
        by_chunk = np.argsort(of, kind="stable")
        # the tables' chunks back into the order of chunks
        listed, at = np.concatenate(order), np.zeros(len(chunks), np.int64)
        at[listed] = np.cumsum(sizes[listed]) - sizes[listed]
        return np.concatenate(parts)[_ranges(at, sizes)], sizes, of[by_chunk], place[by_chunk]

    def _sweep(
        self, own: np.ndarray, chunks: list[str], lengths: np.ndarray, width: int, skip: Callable[..., np.ndarray] | None, merged: list[tuple[np.ndarray, np.ndarray]]
    ) -> tuple[np.ndarray, np.ndarray]:
        """(ids in a row, how many each chunk has); the merges done go to merged. A node is known by its first column, -1 marks columns inside nodes."""
        n = len(chunks)
        chars = np.frombuffer("".join([c.ljust(width, "\0") for c in chunks]).encode("utf-32-le"), np.uint32).reshape(n, width)
        column = np.arange(width, dtype=np.int64)
        sym = np.where(column < lengths[:, None], self.of_char[chars], -1)
        # flat positions: row * width + column
        sym, base = sym.ravel(), np.arange(n, dtype=np.int64) * width
        after = np.tile(column + 1, n)  # where the next node starts; also the end of this one
        before = np.tile(column - 1, n)
        rank, made = np.full(n * width, _NEVER, np.int32), np.zeros(n * width, np.int32)

        def consider(row: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
            """Candidate merges of the nodes at columns a and b."""
            x, y = base[row] + a, base[row] + b
            found, piece = self.lookup(sym[x], sym[y])
            if skip:
                live = np.flatnonzero(found < _NEVER)
                found[live[skip(own[row[live]], a[live], b[live], after[y[live]])]] = _NEVER
            rank[x], made[x] = found, piece

        row, a = np.nonzero(column[:-1] + 1 < lengths[:, None])
        consider(row, a, a + 1)
        rows = np.arange(n)
        while len(rows):
            some = rank.reshape(n, width)[rows]
            a = some.argmin(axis=1)
            go = some[np.arange(len(rows)), a] < _NEVER
            rows, a = rows[go], a[go]
            x = base[rows] + a
            b = after[x]
            y = base[rows] + b
            c = after[y]
            merged.append((own[rows], _place(a, b, c)))
            sym[x], after[x], rank[x] = made[x], c, _NEVER
            sym[y], rank[y] = -1, _NEVER
            right = np.flatnonzero(c < lengths[rows])
            before[base[rows[right]] + c[right]] = a[right]
            left = np.flatnonzero(before[x] >= 0)
            consider(np.concatenate([rows[right], rows[left]]), np.concatenate([a[right], before[x[left]]]), np.concatenate([c[right], a[left]]))
        there = np.flatnonzero(sym >= 0)
        ids, counts = sym[there], np.bincount(there // width, minlength=n)
        odd = np.flatnonzero(ids >= self.n)
        if not len(odd):
            return ids, counts
        # symbols that are no piece are written as bytes
        texts = [chunks[x // width][x % width : after[x]].encode() for x in there[odd].tolist()]
        wide = np.ones(len(ids), np.int64)
        wide[odd] = [len(t) for t in texts]
        out = np.repeat(ids, wide)
        starts = np.cumsum(wide) - wide
        out[_ranges(starts[odd], wide[odd])] = [self.byte_ids[x] for t in texts for x in t]
        return out, np.bincount(there // width, weights=wide, minlength=n).astype(np.int64)


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of the splitmix64 generator."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _place(start: np.ndarray, middle: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (start << 42 | middle << 21 | end).astype(np.uint64)


def _one_mix(x: int) -> int:
    """_mix() of one number."""
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & _MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & _MASK
    return x ^ x >> 31


def _one_place(start: int, middle: int, end: int) -> int:
    """_place() of one merge; what does not fit in 21 bits is mixed in."""
    low = (1 << 21) - 1
    high = (start >> 21) << 42 | (middle >> 21) << 21 | end >> 21
    return ((start & low) << 42 | (middle & low) << 21 | end & low) ^ _one_mix(high & _MASK)


def _floor(rate: float) -> np.uint64:
    """Hashes below it skip."""
    return np.uint64(min(rate, 1.0) * float(2**64 - 2**11))


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], ..., starts[0] + sizes[0] - 1, starts[1], ..."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


class _Rows:
    """An array that grows at its end."""

    def __init__(self, kind: type):
        self.n, self.all = 0, np.zeros(1024, kind)

    def add(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.all):
            self.all = np.concatenate([self.all[: self.n], np.zeros(self.n + 2 * len(more), self.all.dtype)])
        self.all[self.n : self.n + len(more)] = more
        self.n += len(more)


@lru_cache(maxsize=2)
def pieces_of_model(path: str) -> Pieces:
    return Pieces(path)


class Encoder:
    """Encodes texts; it caches nodes, each a chunk with the merges left out so far, and the merges done if no other is left out."""

    def __init__(self, path: str = MODEL, rate: float = RATE, seed: int = SEED):
        self.pieces, self.rate, self.seed = pieces_of_model(path), rate, seed
        self.floor = _floor(rate)
        self._clear()

    def _clear(self) -> None:
        self.chunks: list[str] = []
        self.left_out: list[tuple[int, ...]] = []
        self.ids, self.id_at, self.n_ids = _Rows(np.int32), _Rows(np.int64), _Rows(np.int64)
        # slots: the merges of all nodes that are still to be drawn for, and the node that follows if the merge is left out
        self.slot_at, self.n_slots, self.past = _Rows(np.int64), _Rows(np.int64), _Rows(np.int64)
        self.place, self.drawn, self.next, self.owner = _Rows(np.uint64), _Rows(np.uint64), _Rows(np.int64), _Rows(np.int64)
        mark = np.array([self.pieces.byte_ids[b] for b in MARK.encode()], np.int32)
        self._store([""], [()], mark, np.array([len(mark)]))
        self.known: dict[str | None, int] = {None: 0}  # the word mark inside a text

    def _store(self, chunks: list[str], left_out: list[tuple[int, ...]], flat: np.ndarray, sizes: np.ndarray) -> None:
        """New nodes without slots; flat holds their ids in a row."""
        self.chunks += chunks
        self.left_out += left_out
        self.id_at.add(self.ids.n + np.cumsum(sizes) - sizes)
        self.n_ids.add(sizes)
        self.ids.add(flat)
        for rows in (self.slot_at, self.n_slots, self.past):
            rows.add(np.zeros(len(chunks), np.int64))

    def _grow(self, chunks: list[str], left_out: list[tuple[int, ...]], past: np.ndarray) -> int:
        """The first of new nodes, whose first `past` merges are known to be done."""
        first, skip = len(self.chunks), None
        if any(left_out):
            out = np.sort(np.array([k << 24 | (x >> 42) << 16 | (x >> 21 & 255) << 8 | x & 255 for k, own in enumerate(left_out) for x in own]))

            def skip(word: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
                at = word << 24 | a << 16 | b << 8 | c
                return out[np.minimum(np.searchsorted(out, at), len(out) - 1)] == at

        flat, sizes, of, place = self.pieces.agenda(chunks, skip)
        self._store(chunks, left_out, flat, sizes)
        if self.rate > 0:
            counts = np.bincount(of, minlength=len(chunks))
            rest = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts) >= past[of]
            of, place, counts = of[rest], place[rest], counts - past
            self.slot_at.all[first : first + len(chunks)] = self.place.n + np.cumsum(counts) - counts
            self.n_slots.all[first : first + len(chunks)] = counts
            self.past.all[first : first + len(chunks)] = past
            self.place.add(place)
            self.drawn.add(_mix(place))
            self.owner.add(first + of)
            self.next.add(np.full(len(of), -1))
        return first

    def _leave_out(self, slots: np.ndarray) -> None:
        """Nodes for these merges left out."""
        owners = self.owner.all[slots]
        past = self.past.all[owners] + slots - self.slot_at.all[owners]
        out = [(*self.left_out[o], x) for o, x in zip(owners.tolist(), self.place.all[slots].tolist())]
        first = self._grow([self.chunks[o] for o in owners.tolist()], out, past)
        self.next.all[slots] = first + np.arange(len(slots))

    def flat(self, texts: list[str | None], doc_ids: Iterable[int | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin, with the end."""
        if len(self.chunks) > _CACHE_LIMIT or self.place.n + self.ids.n > _CACHE_SLOTS:
            self._clear()
        chunks: list[str | None] = []
        ends = [0]
        for text in texts:
            for k, part in enumerate((" " + text).split(MARK) if text else ()):
                if k:
                    chunks.append(None)
                chunks += self.pieces.chunks.findall(part.replace(" ", MARK))
            ends.append(len(chunks))
        if not chunks:
            return np.zeros(0, np.int32), np.zeros(len(ends), np.int64)
        known, limit = self.known, _LONG if self.rate > 0 else _WIDE
        node = np.fromiter(map(known.get, chunks, repeat(-1)), np.int64, len(chunks))
        missing = np.flatnonzero(node < 0)
        unknown = [chunks[k] for k in missing.tolist()]
        new = [c for c in dict.fromkeys(unknown) if len(c) <= limit]
        if new:
            first = self._grow(new, [()] * len(new), np.zeros(len(new), np.int64))
            known.update(zip(new, range(first, first + len(new))))
            node[missing] = np.fromiter(map(known.get, unknown, repeat(-1)), np.int64, len(unknown))
        if self.rate > 0 or (node < 0).any():
            sizes = np.diff(ends)
            of_doc = np.array([xxhash.xxh64_intdigest(str(i), self.seed) for i in doc_ids], np.uint64)
            number = np.arange(len(chunks)) - np.repeat(ends[:-1], sizes)
            keys = _mix(np.repeat(of_doc, sizes) ^ _mix(number.astype(np.uint64) + np.uint64(1)))
            direct = np.flatnonzero(node < 0)
            if len(direct):
                first, own = len(self.chunks), [chunks[k] for k in direct.tolist()]
                found = self.pieces.segment(own, keys[direct], self.rate)
                counts = np.array([len(x) for x in found])
                self._store([""] * len(own), [()] * len(own), np.fromiter(chain.from_iterable(found), np.int32, int(counts.sum())), counts)
                node[direct] = first + np.arange(len(own))
            self._walk(node, keys)
        sizes = self.n_ids.all[node]
        return self.ids.all[_ranges(self.id_at.all[node], sizes)], np.concatenate([[0], np.cumsum(sizes)])[ends]

    def _walk(self, node: np.ndarray, keys: np.ndarray) -> None:
        """Moves each occurrence to the node that its draws lead to."""
        todo = np.flatnonzero(self.n_slots.all[node])
        while len(todo):
            sizes = self.n_slots.all[node[todo]]
            slots = _ranges(self.slot_at.all[node[todo]], sizes)
            hits = np.flatnonzero(_mix(np.repeat(keys[todo], sizes) ^ self.drawn.all[slots]) < self.floor)
            who = np.searchsorted(np.cumsum(sizes), hits, "right")
            lead = np.diff(who, prepend=-1) > 0  # the first merge left out of each
            slots, todo = slots[hits[lead]], todo[who[lead]]
            missing = np.unique(slots[self.next.all[slots] < 0])
            if len(missing):
                self._leave_out(missing)
            node[todo] = self.next.all[slots]
            todo = todo[self.n_slots.all[node[todo]] > 0]

    def encode(self, texts: list[str | None], doc_ids: Iterable[int | None]) -> list[list[int]]:
        flat, ends = self.flat(texts, doc_ids)
        ids = flat.tolist()
        return [ids[x:y] for x, y in zip(ends.tolist(), ends[1:].tolist())]

    def decode(self, ids: Iterable[int]) -> str:
        ids = np.fromiter(ids, np.int64)
        return self.decode_flat(ids, np.array([0, len(ids)]))[0]

    def decode_flat(self, flat: np.ndarray, ends: np.ndarray) -> list[str]:
        """The texts whose ids stand in a row, each from ends[k] to ends[k + 1]."""
        p = self.pieces
        sizes = p.sizes[flat]
        data = p.bytes[_ranges(p.starts[flat], sizes)].tobytes()
        at = np.concatenate([[0], np.cumsum(sizes)])[ends].tolist()
        return [data[x:y].decode("utf-8", "replace")[1:] for x, y in zip(at, at[1:])]


@lru_cache(maxsize=1)
def encoder_of(model: str, rate: float, seed: int) -> Encoder:
    """One for all tasks of a worker, whose results do not depend on what is cached."""
    return Encoder(model, rate, seed)


def encode(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, rate: float = RATE, seed: int = SEED
) -> DataFrame:
    """doc_id, text, ids of every row. Null and empty texts have no ids; doc_id may be of any type, and null ones count as one document key; repeated rows get equal ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(model, rate, seed)
        for whole in batches:
            for at in range(0, whole.num_rows, _DOCS_AT_ONCE):
                b = whole.slice(at, _DOCS_AT_ONCE)
                flat, ends = encoder.flat(b.column(1).to_pylist(), b.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))], ["doc_id", "text", "ids"])

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"doc_id {kind}, text string, ids array<int>")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """encoded with a column `decoded`: the text that its ids stand for; null ids decode to null."""
    names = encoded.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Encoder(model, 0.0)
        for b in batches:
            ids = b.column(names.index("ids"))
            ends = np.cumsum([0, *(n or 0 for n in ids.value_lengths().to_pylist())])
            found = decoder.decode_flat(ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64), ends)
            texts = [t if ok else None for t, ok in zip(found, ids.is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*names, "decoded"])

    return encoded.mapInArrow(run, StructType([*encoded.schema, StructField("decoded", StringType())]))


def round_trip(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, rate: float = RATE, seed: int = SEED
) -> DataFrame:
    """doc_id, ids, n_pieces, ids_hash (XXH64 over the ids) and lossless of every row.

    Null and empty texts have no ids; doc_id may be of any type, and null ones
    count as one document key; repeated rows get equal ids; texts are read whole, however long; other
    columns of docs are not looked at; an empty table stays empty.  encode() and
    decode() in one pass: texts do not leave the worker again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder_of(model, rate, seed)
        for whole in batches:
            for at in range(0, whole.num_rows, _DOCS_AT_ONCE):
                b = whole.slice(at, _DOCS_AT_ONCE)
                texts = b.column(1).to_pylist()
                flat, ends = coder.flat(texts, b.column(0).to_pylist())
                flat, ends = flat.astype("<i4"), ends.astype(np.int32)
                same = [x == (t or "") for x, t in zip(coder.decode_flat(flat, ends), texts)]
                marks = [xxhash.xxh64_hexdigest(flat[x:y].tobytes()) for x, y in zip(ends.tolist(), ends[1:].tolist())]
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
                columns = [b.column(0), ids, pa.array(np.diff(ends)), pa.array(marks, pa.string()), pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "n_pieces", "ids_hash", "lossless"])

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"doc_id {kind}, ids array<int>, n_pieces int, ids_hash string, lossless boolean")


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read(spark, sf_dir, "documents"))
