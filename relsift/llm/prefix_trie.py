"""The trie of all prefixes of conversations, by vertical bitmaps.

A conversation is a sequence of turns (role, text); each distinct sequence of the first
``d`` turns of any conversation is a node of depth ``d``, the root being the empty one.

1. Turns get their position by a skew-safe rank, a digest of position, role and text, and
   their words. A prefix is known by the xor of its turns' 128-bit digests, which any run
   of turns can add to on its own; so a very long conversation is cut into segments of
   ``segment`` turns that know the digest they start from.
2. Segments are range-sorted by start and first turns, so that conversations with one
   beginning mostly meet and a hot beginning spreads over many shards, and cut into
   shards of bounded size. A shard's index takes each (position, turn) to a bitset of its
   conversations, in id order. Depth first, the intersections of a node's bitset with the
   postings of the next position are its children; popcounts are member numbers, the
   lowest bit is the smallest member, and those that end here make the end list.
3. Shard nodes with one digest are one node: members add up, the smallest id stays.
   A node belongs to the shard that holds its smallest member, so each is counted once
   in sums over subtrees: a shard adds up what it owns below each of its nodes (nodes in
   preorder, a subtree is a range), with what its conversations own in later segments,
   and the shards' sums are added.

Nothing is grouped by conversation, node or shard without a bound: segments and shards
have fixed sizes, the rest are aggregates and joins on digests.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.skew import rank_within
from .common import WORD_PATTERN, written

#: Turns of a segment, and segments and turns of a shard.
SEGMENT = 1_024
SHARD_SEGMENTS = 1_024
SHARD_TURNS = 65_536
#: Ids are joined to one text by ranges of this many ids before the end lists are hashed.
ID_RANGE_BITS = 12

_NODE = ("shard long, idx int, upto int, band int, depth long, p1 long, p2 long, q1 long, q2 long, "
         "conv_id long, n long, words long, ends array<long>, onward array<long>")
KEY = ["depth", "p1", "p2"]


def turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, pos, words, d1, d2`` of every turn with a ``conv_id``: position from 1
    in order of ``turn`` (null first; equal ones by role and the text's MD5), number of
    words, and two digests of role and text. Null roles and texts are empty."""
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select(
        "conv_id", "turn", "role", F.md5("text").alias("tie"),
        F.regexp_count("text", F.lit(WORD_PATTERN)).cast("long").alias("words"),
        F.xxhash64("role", "text").alias("d1"), F.xxhash64(F.lit(1), "text", "role").alias("d2"))
    ranked = rank_within(rows, ["conv_id"], [F.col("turn").asc_nulls_first(), "role", "tie"], "pos")
    return ranked.select("conv_id", F.col("pos").cast("long").alias("pos"), "words", "d1", "d2")


def with_shared_heads(turn_rows: DataFrame, span: int = 20, most: int = 4) -> DataFrame:
    """``turn_rows`` of rebuilt conversations: the first ``h`` turns of conversation
    ``c - c % span`` (fewer if it has fewer, none if it is not there), then those of ``c``
    after its first ``h``; ``h`` is the CRC32 of the decimal ``c`` modulo ``most``. One
    row with position 0 and nulls stands for each conversation, turnless ones too."""
    h = F.crc32(F.col("conv_id").cast("string")) % most
    base = F.col("conv_id") - F.col("conv_id") % span
    heads = turn_rows.where(F.col("pos") < most).select(F.col("conv_id").alias("_of"), F.col("pos").alias("_pos"), F.col("words").alias("_w"), F.col("d1").alias("_d1"), F.col("d2").alias("_d2"))
    convs = turn_rows.where("pos = 1").select("conv_id", h.alias("h"), base.alias("_base"))
    lent = convs.join(heads, (F.col("_base") == F.col("_of")) & (F.col("_pos") <= F.col("h")))
    n_lent = (convs.where("h > 0").join(heads.groupBy("_of").agg(F.max("_pos").alias("_n")), F.col("_base") == F.col("_of"))
              .select("conv_id", F.least("h", "_n").alias("_lent")))
    own = (turn_rows.where(F.col("pos") > h).join(n_lent, "conv_id", "left")
           .select("conv_id", (F.col("pos") - h + F.coalesce("_lent", F.lit(0))).alias("pos"), "words", "d1", "d2"))
    mark = convs.select("conv_id", F.lit(0).cast("long").alias("pos"), *[F.lit(None).cast("long").alias(c) for c in ("words", "d1", "d2")])
    return (own.unionByName(lent.select("conv_id", F.col("_pos").alias("pos"), F.col("_w").alias("words"), F.col("_d1").alias("d1"), F.col("_d2").alias("d2")))
            .unionByName(mark))


def segments(turn_rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """One row for every ``segment`` turns of a conversation: ``conv_id, band``, the digest
    ``s1, s2`` of all turns before, whether it is the ``last``, and its turns in order."""
    band = F.floor(F.greatest(F.col("pos") - 1, F.lit(0)) / segment).cast("int")
    item = F.struct("pos", "words", F.xxhash64("pos", "d1", "d2").alias("t1"), F.xxhash64("d2", "pos", "d1").alias("t2"))
    rows = turn_rows.select("conv_id", band.alias("band"), F.when(F.col("pos") > 0, item).alias("item"))
    # at most ``segment`` turns and the mark
    cut = rows.groupBy("conv_id", "band").agg(
        F.array_sort(F.collect_list("item")).alias("items"),
        F.bit_xor("item.t1").alias("x1"), F.bit_xor("item.t2").alias("x2"))
    order = Window.partitionBy("conv_id").orderBy("band")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return cut.select(
        "conv_id", "band", F.coalesce(F.bit_xor("x1").over(before), F.lit(0)).alias("s1"),
        F.coalesce(F.bit_xor("x2").over(before), F.lit(0)).alias("s2"),
        F.lead("band").over(order).isNull().alias("last"),
        F.col("items.words").alias("words"), F.col("items.t1").alias("t1"), F.col("items.t2").alias("t2"))


def shard_trie(shard: int, rows: list[tuple], segment: int) -> pa.RecordBatch:
    """The nodes of one shard in preorder. ``rows`` are segments ``(conv_id, band, s1, s2,
    last, words, t1, t2)``."""
    rows = sorted(rows, key=lambda r: (r[0], r[1]))
    turn_at = [list(zip(r[6], r[7])) for r in rows]
    postings: dict[tuple, int] = {}
    words: dict[tuple, int] = {}
    ends: dict[int, int] = {}
    onward: dict[int, int] = {}
    starts: dict[tuple, int] = {}
    for i, (conv, band, s1, s2, last, w, _, _) in enumerate(rows):
        bit, pos = 1 << i, band * segment
        starts[band, s1, s2] = starts.get((band, s1, s2), 0) | bit
        for turn, n in zip(turn_at[i], w):
            pos += 1
            key = (pos, *turn)
            postings[key] = postings.get(key, 0) | bit
            words[key] = n
        stop = ends if last else onward
        stop[pos] = stop.get(pos, 0) | bit

    def ids(bits: int) -> list[int]:
        out = []
        while bits:
            low = bits & -bits
            out.append(rows[low.bit_length() - 1][0])
            bits ^= low
        return out

    cols: list[list] = [[] for _ in range(14)]
    parent: list[int] = []
    for (band, s1, s2), members in starts.items():
        base = band * segment
        # a node: its members, depth, digest, parent's digest, words and parent's index
        stack = [(members, base, s1, s2, None, None, 0, -1)]
        while stack:
            bits, pos, p1, p2, q1, q2, w, up = stack.pop()
            at = -1
            done = (ends.get(pos, 0) | onward.get(pos, 0)) & bits
            if pos > base or band == 0:
                at = len(parent)
                parent.append(up)
                row = (shard, at, 0, band, pos, p1, p2, q1, q2, rows[(bits & -bits).bit_length() - 1][0], bits.bit_count(), w,
                       ids(ends.get(pos, 0) & bits), ids(onward.get(pos, 0) & bits))
                for column, value in zip(cols, row):
                    column.append(value)
            rest = bits & ~done
            while rest:
                turn = turn_at[(rest & -rest).bit_length() - 1][pos - base]
                key = (pos + 1, *turn)
                child = bits & postings[key]
                rest &= ~child
                stack.append((child, pos + 1, p1 ^ turn[0], p2 ^ turn[1], p1, p2, words[key], at))
    upto = list(range(1, len(parent) + 1))
    for i in range(len(parent) - 1, -1, -1):
        if parent[i] >= 0:
            upto[parent[i]] = max(upto[parent[i]], upto[i])
    cols[2] = upto
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), *[pa.int64()] * 8, pa.list_(pa.int64()), pa.list_(pa.int64())]
    names = [c.split()[0] for c in _NODE.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)


def local_nodes(segment_rows: DataFrame, segment: int = SEGMENT, shard_segments: int = SHARD_SEGMENTS,
                shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The nodes of all shards (``_NODE``)."""
    def build(batches):
        part, n_shards, rows, n_turns = TaskContext.get().partitionId() << 32, 0, [], 0
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "band", "s1", "s2", "last", "words", "t1", "t2")]):
                if rows and (len(rows) >= shard_segments or n_turns + len(row[5]) > shard_turns):
                    yield shard_trie(part + n_shards, rows, segment)
                    n_shards, rows, n_turns = n_shards + 1, [], 0
                rows.append(row)
                n_turns += len(row[5])
        if rows:
            yield shard_trie(part + n_shards, rows, segment)

    first = [F.try_element_at("t1", F.lit(i)) for i in (1, 2, 3, 4)]
    order = [F.col("band"), F.col("s1"), F.col("s2"), *first, F.col("conv_id")]
    return segment_rows.orderBy(*order).mapInArrow(build, _NODE)


def _subtree_sums(shard: pa.Table) -> pa.Table:
    shard = shard.sort_by("idx")
    upto = shard.column("upto").to_numpy()
    out = {c: shard.column(c) for c in KEY}
    for c in ("saved", "leaves"):
        total = np.concatenate([[0], np.cumsum(shard.column(c).to_numpy())]).astype(np.int64)
        out[c] = pa.array(total[upto] - total[:-1])
    return pa.table(out)


def _end_digests(ends: DataFrame) -> DataFrame:
    """``depth, p1, p2, ends_sha256`` from rows with lists of ids: ids are joined to texts
    by ranges, and the texts of a node stream through its hash in order."""
    ids = ends.select(*KEY, F.explode("ends").alias("id"))
    parts = ids.groupBy(*KEY, F.shiftright("id", ID_RANGE_BITS).alias("part")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ",").alias("ids"))

    def digest(batches):
        node, state = None, None
        for batch in batches:
            done = []
            for *key, text in zip(*[batch.column(c).to_pylist() for c in (*KEY, "ids")]):
                if key == node:
                    state.update(b",")
                else:
                    if node is not None:
                        done.append((*node, state.hexdigest()))
                    node, state = key, hashlib.sha256()
                state.update(text.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=[*KEY, "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, state.hexdigest())], names=[*KEY, "ends_sha256"])

    return (parts.repartition(*KEY).sortWithinPartitions(*KEY, "part")
            .mapInArrow(digest, "depth long, p1 long, p2 long, ends_sha256 string"))


def trie(turn_rows: DataFrame, segment: int = SEGMENT, shard_segments: int = SHARD_SEGMENTS,
         shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per node of the conversations in ``turn_rows`` (``conv_id, pos, words, d1,
    d2``; a row with position 0 and nulls marks a conversation that may have no turns).

    ``conv_id`` smallest member; ``depth``; ``parent_conv_id`` (null for the root);
    ``n_convs`` members; ``n_children``; ``n_leaves`` childless nodes in the subtree;
    ``saved_tokens``: over the subtree, words of the node's last turn times members less
    one; ``ends_sha256``: of the members with ``depth`` turns, ascending, comma-joined.
    A node is told by (``conv_id``, ``depth``). An empty table gives no rows; equal
    conversations are members of the same nodes."""
    parts = written(segments(turn_rows, segment), "trie-segments")
    local = written(local_nodes(parts, segment, shard_segments, shard_turns), "trie-shards")
    merged = written(local.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs"), F.max("words").alias("words"),
        F.max("q1").alias("q1"), F.max("q2").alias("q2")), "trie-merged")
    kids = merged.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = written(merged.join(kids, KEY, "left").fillna(0, ["n_children"]), "trie-nodes")
    known = nodes.select(*KEY, F.col("conv_id").alias("_owner"), F.col("n_convs").alias("_n"), "n_children")
    own = F.col("conv_id") == F.col("_owner")
    valued = written(local.join(known, KEY).select(
        "shard", "idx", "upto", "band", "conv_id", *KEY, "onward",
        F.when(own, (F.col("_n") - 1) * F.col("words")).otherwise(0).alias("saved"),
        F.when(own & (F.col("n_children") == 0), 1).otherwise(0).cast("long").alias("leaves")), "trie-values")
    # what a conversation owns in later segments counts at the end of its earlier ones
    later = (valued.where("band > 0").groupBy("conv_id", "band").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
             .where("saved <> 0 or leaves <> 0"))
    ahead = Window.partitionBy("conv_id").orderBy("band").rowsBetween(1, Window.unboundedFollowing)
    long_parts = parts.where("band > 0 or not last").select("conv_id", "band")
    carried = (long_parts.join(later, ["conv_id", "band"], "left")
               .select("conv_id", "band", *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias("_" + c) for c in ("saved", "leaves")]))
    extra = (valued.where(F.size("onward") > 0).select("shard", "idx", "band", F.explode("onward").alias("conv_id"))
             .join(carried, ["conv_id", "band"]).groupBy("shard", "idx").agg(F.sum("_saved").alias("_saved"), F.sum("_leaves").alias("_leaves")))
    with_later = valued.join(extra, ["shard", "idx"], "left").select(
        "shard", "idx", "upto", *KEY, *[(F.col(c) + F.coalesce("_" + c, F.lit(0))).alias(c) for c in ("saved", "leaves")])
    sums = (with_later.groupBy("shard").applyInArrow(_subtree_sums, "depth long, p1 long, p2 long, saved long, leaves long")
            .groupBy(*KEY).agg(F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves")))
    digests = _end_digests(local.where(F.size("ends") > 0).select(*KEY, "ends"))
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    return (nodes.join(sums, KEY).join(digests, KEY, "left").join(above, ["depth", "q1", "q2"], "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                    F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256")))


def conversation_trie(conversations: DataFrame, **sizes) -> DataFrame:
    """``trie`` of the rebuilt conversations (see ``with_shared_heads``) of a table
    ``conv_id, turn, role, text``. Rows without a ``conv_id`` belong to no conversation."""
    rows = written(turns(conversations), "trie-turns")
    return trie(written(with_shared_heads(rows), "trie-rebuilt"), **sizes)
