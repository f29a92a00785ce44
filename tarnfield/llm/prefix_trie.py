"""Prefix trie of conversations, built as a burst trie.

A turn is known by a hash of its role and text and by the text's length, so a
conversation is one row with a path of 20 bytes a turn; texts stay behind.
Equal paths are counted first, so any number of copies is one suffix.

Suffixes lie in containers under trie heads, at first all of them under the
root.  A container of too many bytes bursts: its head goes down to where its
suffixes part, and they are dealt into containers by the next turn's id.  What
remains is small; containers are sorted and swept into nodes, one after the
other in each task, and the burst heads get their totals from the containers
below, level by level.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfield.llm.common import durable, read, sized_broadcast
from tarnfield.llm.resampling import CRC_SQL, crc_sql

#: Bytes of a turn in a path: 16 of its hash and 4 of its length.
STEP = 20
#: Bytes of suffixes from which on a container bursts.
CONTAINER_BYTES = 1 << 20
#: Ids that are joined before a group's hash is taken.
ID_CHUNK = 4096
SHARED_TURNS = 6
_ID, _PATH = "conv_id", "path"


def numbered_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, no, turn_id, n_chars) of turns(conv_id, turn, role, text): no counts a conversation's turns from zero.

    The order is that of turn, null first, then of the turn's id.  Numbers come
    from a range partitioning by conversation and order, with running counts, so
    that no task needs all turns of a conversation.
    """
    spark = turns.sparkSession
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    role, text = some("role"), some("text")
    key = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    rows = turns.select(F.col(_ID).cast("long").alias(_ID), "turn", key.alias("turn_id"), F.length(text).alias("n_chars")).filter(F.col(_ID).isNotNull())
    order = [F.asc(_ID), F.asc_nulls_first("turn"), F.asc("turn_id")]
    dealt = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    placed = durable(dealt.select(_ID, "turn_id", "n_chars", F.monotonically_increasing_id().alias("at")))
    part = F.shiftright("at", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()  # a row for each range
    before, starts = 0, []
    for r in sorted(sizes, key=lambda r: r["part"]):
        starts.append((r["part"], before))
        before += r["n"]
    offsets = spark.createDataFrame(starts, "part long, before long")
    spot = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    rows = placed.withColumn("part", part).join(F.broadcast(offsets), "part").select(_ID, "turn_id", "n_chars", spot.alias("spot"))
    first = rows.groupBy(_ID).agg(F.min("spot").alias("first"))
    return rows.join(first, _ID).select(_ID, (F.col("spot") - F.col("first")).alias("no"), "turn_id", "n_chars")


def _path(rows: Column) -> Column:
    """Array of (no, turn_id, n_chars) in order as bytes."""
    one = lambda x: F.concat(x["turn_id"], F.unhex(F.lpad(F.hex(x["n_chars"]), 8, "0")))
    return F.aggregate(F.transform(F.sort_array(rows), one), F.lit(b""), lambda a, x: F.concat(a, x))


def paths_of(numbered: DataFrame) -> DataFrame:
    """(conv_id, path) of every conversation, 20 bytes a turn."""
    listed = numbered.groupBy(_ID).agg(F.collect_list(F.struct("no", "turn_id", "n_chars")).alias("rows"))
    return listed.select(_ID, _path(F.col("rows")).alias(_PATH))


def with_shared_openings(paths: DataFrame) -> DataFrame:
    """(conv_id, path) where conversation c opens with the first h turns of c - c % 100, and goes on with its own turns after its first h; h is crc32 of c modulo 6."""
    h = F.crc32(F.col(_ID).cast("string")) % SHARED_TURNS
    rows = paths.withColumns({"h": h.cast("int"), "base": F.col(_ID) - F.col(_ID) % 100})
    bases = paths.filter(F.col(_ID) % 100 == 0).select(F.col(_ID).alias("base"), F.substring(F.col(_PATH), 1, STEP * (SHARED_TURNS - 1)).alias("opening"))
    joined = rows.join(bases, "base", "left")
    opening = F.substring(F.coalesce("opening", F.lit(b"")), F.lit(1), F.col("h") * STEP)
    rest = F.substring(F.col(_PATH), F.col("h") * STEP + 1, F.length(_PATH))
    return joined.select(_ID, F.concat(opening, rest).alias(_PATH))


def _turns(path: Column) -> Column:
    return (F.length(path) / STEP).cast("int")


def _chars(path: Column, depth: Column) -> Column:
    """Length of the last text of the path's node of that depth."""
    return F.conv(F.hex(F.substring(path, STEP * depth - 3, F.lit(4))), 16, 10).cast("long")


def _head(path: Column, depth: Column) -> Column:
    return F.md5(F.substring(path, F.lit(1), STEP * depth))


def _common(a: Column, b: Column, depth: Column) -> Column:
    """Turns that two paths share; they share depth at least."""
    least = F.least(_turns(a), _turns(b))
    turn = lambda p, i: F.substring(p, STEP * i + 1, F.lit(STEP))
    parts = F.filter(F.sequence(depth, least), lambda i: (i >= least) | (turn(a, i) != turn(b, i)))
    return F.get(parts, 0)


_NODE = "conv_id long, depth int, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved long, ends long"


class _Node:
    """An open node of a sweep; kids are the finished nodes right below it."""

    __slots__ = ("chars", "conv", "convs", "depth", "ends", "kids", "leaves", "saved")

    def __init__(self, depth: int, chars: int):
        self.depth, self.chars = depth, chars
        self.conv, self.convs, self.leaves, self.saved, self.ends = None, 0, 0, 0, None
        self.kids: list[tuple] = []


def sweep(rows: Iterator[tuple], at_once: int = 20_000) -> Iterator[list[tuple]]:
    """Nodes of sorted containers, in lists: rows are (head, above, depth, path, conv_id, n) by head and path.

    A node is (head, above, is_head, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved, ends);
    the heads' own parents are not known here.  Open nodes and their finished children are all that is held.
    """
    stack: list[_Node] = []
    done: list[tuple] = []
    now, last, above = None, b"", None

    def close(node: _Node) -> None:
        node.leaves = node.leaves or 1
        node.saved += (node.convs - 1) * node.chars
        for kid in node.kids:
            done.append((now, above, False, kid[0], kid[1], node.conv, *kid[2:]))
        own = (node.conv, node.depth, node.convs, len(node.kids), node.leaves, node.saved, node.ends)
        node.kids = []
        if not stack:
            done.append((now, above, True, own[0], own[1], None, *own[2:]))
            return
        up = stack[-1]
        up.convs += node.convs
        up.leaves += node.leaves
        up.saved += node.saved
        up.conv = node.conv if up.conv is None else min(up.conv, node.conv)
        up.kids.append(own)

    def back_to(depth: int) -> None:
        while stack and stack[-1].depth > depth:
            close(stack.pop())

    chars = lambda path, depth: int.from_bytes(path[STEP * depth - 4 : STEP * depth]) if depth else 0
    for head, over, depth, path, conv, n in rows:
        if head != now:
            back_to(-1)
            now, above = head, over
            stack.append(_Node(depth, chars(path, depth)))
            last = path[: STEP * depth]
        shared, most = depth, min(len(path), len(last)) // STEP
        while shared < most and path[STEP * shared : STEP * shared + STEP] == last[STEP * shared : STEP * shared + STEP]:
            shared += 1
        back_to(shared)
        for d in range(shared + 1, len(path) // STEP + 1):
            stack.append(_Node(d, chars(path, d)))
        node = stack[-1]
        node.convs += n
        node.conv = conv if node.conv is None else min(node.conv, conv)
        node.ends = conv
        last = path
        if len(done) >= at_once:
            yield done
            done = []
    back_to(-1)
    if done:
        yield done


def _swept(containers: DataFrame) -> DataFrame:
    """Nodes of all containers(head, above, depth, path, conv_id, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["head", "above", "is_head", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "ends"]
        kinds = [pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int32(), *[pa.int64()] * 6]
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        for nodes in sweep(rows):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*nodes), kinds)], names)

    n = int(containers.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = containers.select("head", "above", "depth", _PATH, _ID, "n").repartition(n, "head").sortWithinPartitions("head", _PATH)
    return dealt.mapInArrow(run, f"head string, above string, is_head boolean, {_NODE}")


def trie(paths: DataFrame, container_bytes: int = CONTAINER_BYTES) -> DataFrame:
    """Nodes of paths(conv_id, path): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved, ends.

    ends is the smallest conversation that ends at the node, null if none does.
    Rounds are as many as bursts lie above each other.
    """
    spark = paths.sparkSession
    distinct = paths.groupBy(_PATH).agg(F.min(_ID).alias(_ID), F.count("*").alias("n"))
    root = distinct.select(F.md5(F.lit("")).alias("head"), F.lit(None).cast("string").alias("above"), F.lit(0).alias("depth"), _PATH, _ID, "n")
    active = durable(root)
    settled, bursts = [], []
    while True:
        size = F.sum(F.length(_PATH) - STEP * F.col("depth") + 64)
        sizes = active.groupBy("head", "above", "depth").agg(size.alias("bytes"), F.count("*").alias("kinds"), F.min(_PATH).alias("a"), F.max(_PATH).alias("b"))
        over = sizes.filter((F.col("bytes") > container_bytes) & (F.col("kinds") > 1))
        over = durable(over.select("head", "above", "depth", "a", _common(F.col("a"), F.col("b"), F.col("depth")).alias("fork")))
        if over.isEmpty():
            settled.append(active)
            break
        marked = active.join(sized_broadcast(over.select("head", "fork")), "head", "left")
        settled.append(marked.filter("fork is null").drop("fork"))
        at_fork = _turns(F.col(_PATH)) == F.col("fork")
        inside = durable(marked.filter("fork is not null"))
        bursts.append((over, inside.filter(at_fork).select(F.col("head").alias("above"), _ID, "n")))
        deeper = F.col("fork") + 1
        active = durable(inside.filter(~at_fork).select(_head(F.col(_PATH), deeper).alias("head"), F.col("head").alias("above"), deeper.alias("depth"), _PATH, _ID, "n"))
    containers = settled[0]
    for more in settled[1:]:
        containers = containers.unionByName(more)
    swept = durable(_swept(containers))

    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "ends"]
    nodes = [swept.filter("not is_head").select(*names)]
    heads = swept.filter("is_head")
    below = heads  # heads whose parents are burst heads of any level
    for over, ending in reversed(bursts):
        # totals of the burst heads of this level at their forks, from all heads right below them
        mine = over.select(F.col("head").alias("above"), F.col("above").alias("over"), "depth", "fork", "a")
        kids = below.groupBy("above").agg(*[F.sum(c).alias(c) for c in ("n_convs", "n_leaves", "saved")], F.min("conv_id").alias("conv_id"), F.count("*").alias("n_children"))
        ended = ending.select("above", F.col(_ID).alias("ends"), F.col("n").alias("n_ends"))
        total = mine.join(kids, "above").join(ended, "above", "left")
        total = durable(
            total.select(
                "above", "over", "depth", "fork", "a", "n_children", "n_leaves", "ends", (F.col("n_convs") + F.coalesce("n_ends", F.lit(0))).alias("n_convs"),
                F.col("saved").alias("below"), F.least("conv_id", "ends").alias("conv_id"),
            )
        )
        parents = total.select("above", F.col("conv_id").alias("parent"))
        nodes.append(below.join(parents, "above").select(*[F.col("parent").alias("parent_conv_id") if c == "parent_conv_id" else F.col(c) for c in names]))
        # nodes from the fork up to the head: the only child of one another, with one set of members
        lengths = F.transform(F.sequence("depth", "fork"), lambda d: F.when(d > 0, _chars(F.col("a"), d)).otherwise(0))
        line = total.withColumn("lengths", lengths).select("*", F.explode(F.sequence("depth", "fork")).alias("d"))
        above_fork = F.aggregate(F.slice("lengths", F.col("d") - F.col("depth") + 1, F.col("fork") - F.col("d") + 1), F.lit(0).cast("long"), lambda x, y: x + y)
        is_fork = F.col("d") == F.col("fork")
        line = durable(
            line.select(
                F.col("above").alias("head"), F.col("over").alias("above"), (F.col("d") == F.col("depth")).alias("is_head"), "conv_id", F.col("d").alias("depth"),
                F.col("conv_id").alias("parent_conv_id"), "n_convs", F.when(is_fork, F.col("n_children")).otherwise(1).cast("long").alias("n_children"), "n_leaves",
                (F.col("below") + (F.col("n_convs") - 1) * above_fork).alias("saved"), F.when(is_fork, F.col("ends")).alias("ends"),
            )
        )
        nodes.append(line.filter("not is_head").select(*names))
        done = total.select("above")
        below = below.join(done, "above", "left_anti").unionByName(line.filter("is_head").select(*below.columns))
    nodes.append(below.withColumn("parent_conv_id", F.lit(None).cast("long")).select(*names))
    out = nodes[0]
    for more in nodes[1:]:
        out = out.unionByName(more)
    return out


def ends_hashes(paths: DataFrame) -> DataFrame:
    """(ends, ends_sha256): of the conversations with one path, the smallest and the SHA-256 of all their ids, ascending and comma-joined.

    Ids are sorted in ranges and joined to chunks there; the chunks of a path are
    then hashed in order as a stream, so memory does not depend on their number.
    """
    spark = paths.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = paths.select(F.md5(_PATH).alias("p"), _ID)

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids = None, []
        done: list[tuple] = []
        for b in batches:
            for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if p != now or len(ids) >= ID_CHUNK:
                    if ids:
                        done.append((now, ids[0], ",".join(map(str, ids))))
                    now, ids = p, []
                ids.append(c)
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip(("p", "first", "ids"), d)) for d in done])
                done = []
        if ids:
            yield pa.RecordBatch.from_pylist([{"p": now, "first": ids[0], "ids": ",".join(map(str, ids))}])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first, digest = None, None, None
        kind = pa.schema([("ends", pa.int64()), ("ends_sha256", pa.string())])
        for b in batches:
            done = []
            for p, c, ids in zip(*(x.to_pylist() for x in b.columns)):
                if p == now:
                    digest.update(b"," + ids.encode())
                    continue
                if now is not None:
                    done.append({"ends": first, "ends_sha256": digest.hexdigest()})
                now, first, digest = p, c, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_pylist(done, kind)
        if now is not None:
            yield pa.RecordBatch.from_pylist([{"ends": first, "ends_sha256": digest.hexdigest()}], kind)

    order = ["p", _ID]
    chunks = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(chunked, "p string, first long, ids string")
    return chunks.repartition(n, "p").sortWithinPartitions("p", "first").mapInArrow(hashed, "ends long, ends_sha256 string")


def prefix_trie(paths: DataFrame, container_bytes: int = CONTAINER_BYTES) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node of stored paths(conv_id, path).

    Conversations are unique by conv_id; one without turns is a member of the
    root alone; an empty table has no node.
    """
    nodes = trie(paths, container_bytes).join(ends_hashes(paths), "ends", "left")
    nothing = hashlib.sha256(b"").hexdigest()
    long = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves"]
    return nodes.select(*[F.col(c).cast("long").alias(c) for c in long], F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))


def shared_prefixes(turns: DataFrame, container_bytes: int = CONTAINER_BYTES) -> DataFrame:
    """prefix_trie() of turns(conv_id, turn, role, text) whose conversations open as with_shared_openings() says.

    Null role or text count as empty; a null turn comes first; turns of one
    number stand in the order of a hash of role and text; repeated rows are turns
    of their own; rows without a conv_id belong to no conversation and are left
    out; c - c % 100 has the sign of c; texts are hashed whole, however long; a conversation's turns (20 bytes
    each) are one row; an empty table gives no node; other columns are not
    looked at.
    """
    return prefix_trie(durable(with_shared_openings(durable(paths_of(numbered_turns(turns))))), container_bytes)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_prefixes(read(spark, sf_dir, "conversations"))


_TURN = "coalesce(role, '') || chr(0) || coalesce(text, '')"
OP13_SQL = f"""with {CRC_SQL}, own as (select conv_id, row_number() over (partition by conv_id order by turn nulls first) as no, {_TURN} as t, length(coalesce(text, '')) as chars from conversations),
convs as (select conv_id, {crc_sql('cast(conv_id as varchar)')} % {SHARED_TURNS} as h from (select distinct conv_id from conversations), crc_table),
opening as (select c.conv_id, o.no, o.t, o.chars from convs c join own o on o.conv_id = c.conv_id - c.conv_id % 100 and o.no <= c.h),
opened as (select conv_id, h, (select count(*) from opening o where o.conv_id = convs.conv_id) as m from convs),
rebuilt as (select * from opening union all select conv_id, m + no - h, t, chars from own join opened using (conv_id) where no > h),
turns as (select conv_id, no, t, chars, md5(string_agg(md5(t), '') over (partition by conv_id order by no)) as prefix, count(*) over (partition by conv_id) as n from rebuilt),
steps as (select conv_id, no as depth, prefix, chars, n, coalesce(lag(prefix) over (partition by conv_id order by no), '') as above from turns
  union all select conv_id, 0, '', 0, coalesce((select max(n) from turns t where t.conv_id = convs.conv_id), 0), null from convs),
nodes as (select prefix, any_value(depth) as depth, any_value(above) as above, any_value(chars) as chars, min(conv_id) as conv_id, count(*) as n_convs from steps group by 1),
kids as (select above as prefix, count(*) as n_children from nodes where above is not null group by 1),
ends as (select prefix, string_agg(cast(conv_id as varchar), ',' order by conv_id) as ids from steps where depth = n group by 1),
own_value as (select conv_id, depth, (n_convs - 1) * chars as value, coalesce(n_children, 0) = 0 as leaf from nodes left join kids using (prefix)),
summed as (select s.prefix, sum(v.value) as saved, count(*) filter (where v.leaf) as n_leaves from steps s join own_value v on v.conv_id = s.conv_id and v.depth >= s.depth group by 1)
select n.conv_id, cast(n.depth as bigint) as depth, p.conv_id as parent_conv_id, n.n_convs, coalesce(n_children, 0) as n_children, n_leaves, cast(saved as bigint) as saved_tokens,
  sha256(coalesce(ids, '')) as ends_sha256
from nodes n left join nodes p on p.prefix = n.above left join kids k on k.prefix = n.prefix left join ends e on e.prefix = n.prefix join summed s on s.prefix = n.prefix"""
