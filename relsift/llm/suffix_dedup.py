"""Suffix-array dedup: bytes covered by a string of ``length`` bytes that occurs twice.

A window is a string of ``length`` bytes at one position of one text. Its smallest hashed
k-gram (minimizer) depends on the window alone, so equal windows have equal minimizers.
Runs of neighbouring windows with one minimizer position form segments, which are dealt
out by minimizer; a minimizer that occurs once in the corpus cannot belong to a repeated
window and its segments go no further. Equal segments are counted and kept once.

Shards of bounded size get the distinct segments. Each shard sorts its suffixes by
Larsson-Sadakane refinement in numpy (sort by the first symbols, then double the sorted
depth, touching unsorted groups only) to the depth of the window, and Kasai's method
gives the common prefixes of neighbours: a window whose neighbour shares ``length``
bytes is repeated. The distinct segments of a very frequent minimizer are split over
several shards; the sorted window fingerprints of these shards are cut into ranges, and
in each range the shards' runs are merged by binary search.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import maybe_member, written
from .kernels import BLOCK_BYTES, column_bytes, prefix_hash, row_blocks, span_hash

LENGTH = 400
GRAM = 32
SHARD_BYTES = 1 << 19
#: Distinct segments of one minimizer in a shard, about, and windows in a merged range.
SPLIT = 128
RANGE_WINDOWS = 200_000
_POS = np.uint64(20)


# -- segments -----------------------------------------------------------------------

def _least_in_windows(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values, by blockwise minima from both ends."""
    n = len(v)
    pad = -n % width
    blocks = np.concatenate([v, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1: n])


def segments(data: np.ndarray, offsets: np.ndarray, length: int, gram: int = GRAM):
    """Segments of texts laid end to end: text, first window, windows, minimizer hash."""
    n, gram = len(data), min(gram, -(-length // 2))
    if n < length:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    prefix = prefix_hash(data)
    at = np.arange(n - gram + 1)
    value = span_hash(prefix, at, at + gram)
    # hash above, position below: the leftmost of equal hashes is the least
    least = _least_in_windows((value >> _POS << _POS) | at.astype(np.uint64), length - gram + 1)
    where = (least & np.uint64((1 << 20) - 1)).astype(np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: n - length + 1]
    inside = np.arange(n - length + 1) + length <= offsets[1:][text]
    change = np.empty(len(where), bool)
    change[0] = True
    change[1:] = (where[1:] != where[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(change & inside)
    ends = np.flatnonzero(change | ~inside)
    stop = np.append(ends, len(where))[np.searchsorted(ends, first, "right")]
    return text[first], first, stop - first, value[where[first]]


def _text_blocks(offsets: np.ndarray, length: int) -> Iterator[tuple[int, int, int, int]]:
    """Rows and byte range to work on at once: ``lo, hi, start, stop``. A text beyond the
    block size is cut in pieces that overlap by ``length - 1`` bytes."""
    most = BLOCK_BYTES - length
    for lo, hi in row_blocks(offsets, most):
        start, stop = int(offsets[lo]), int(offsets[hi])
        while stop - start > most:
            yield lo, hi, start, start + most + length - 1
            start += most
        yield lo, hi, start, stop


def segment_rows(docs: DataFrame, length: int) -> DataFrame:
    """``id, text_hash, start, windows, minimizer, h1, h2`` of every segment; ``h1, h2``
    are the 128-bit hash of the segment's bytes."""
    schema = "id long, text_hash long, start int, windows int, minimizer long, h1 long, h2 long"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            data, offsets = column_bytes(batch.column(2))
            view = memoryview(data)
            for lo, hi, start, stop in _text_blocks(offsets, length):
                at = np.clip(offsets[lo: hi + 1], start, stop) - start
                text, first, windows, minimizer = segments(data[start:stop], at, length)
                if not len(first):
                    continue
                raw = b"".join([xxhash.xxh3_128_digest(view[start + a: start + a + w + length - 1])
                                for a, w in zip(first.tolist(), windows.tolist(), strict=True)])
                h = np.frombuffer(raw, np.int64).reshape(-1, 2)
                row = pa.array(lo + text)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(row), batch.column(1).take(row), pa.array((start + first - offsets[lo + text]).astype(np.int32)),
                    pa.array(windows.astype(np.int32)), pa.array(minimizer.view(np.int64)), pa.array(h[:, 0]), pa.array(h[:, 1])],
                    names=[c.split()[0] for c in schema.split(", ")])

    return docs.mapInArrow(cut, schema)


# -- suffix arrays ------------------------------------------------------------------

def packed(symbols: np.ndarray) -> np.ndarray:
    """Seven symbols (of 9 bits) from each position on, in one ordered integer."""
    n = len(symbols)
    padded = np.concatenate([symbols, np.zeros(6, symbols.dtype)]).astype(np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(7):
        out = out << np.uint64(9) | padded[j: j + n]
    return out


def suffix_order(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes sorted by their first ``depth`` symbols at least, the packed symbols, and
    a mask of suffixes that share half the depth with another."""
    n = len(symbols)
    key = packed(symbols)
    order = np.argsort(key, kind="stable")
    first = np.append(True, key[order[1:]] != key[order[:-1]])
    group = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank = np.empty(n + 1, np.int64)
    rank[order], rank[n] = group, -1
    open_at = np.flatnonzero(~(first & np.append(first[1:], True)))
    deep = np.zeros(n, bool)
    h = 7
    while h < depth and len(open_at):
        if 2 * h >= depth:
            deep[order[open_at]] = True
        suffix = order[open_at]
        pair = rank[suffix] * (n + 2) + rank[np.minimum(suffix + h, n)] + 1
        place = np.argsort(pair, kind="stable")
        suffix, pair = suffix[place], pair[place]
        order[open_at] = suffix
        first = np.append(True, pair[1:] != pair[:-1])
        rank[suffix] = open_at[np.maximum.accumulate(np.where(first, np.arange(len(suffix)), 0))]
        open_at = open_at[~(first & np.append(first[1:], True))]
        h *= 2
    return order, key, deep


def common_prefixes(symbols: np.ndarray, key: np.ndarray, order: np.ndarray, wanted: np.ndarray, limit: int,
                    run: int = 32) -> np.ndarray:
    """Kasai: common prefix, up to ``limit``, of each wanted suffix with the one before it
    in ``order`` (0 for the others). Going one position on loses one symbol at most, so
    each value starts from the one before it; runs of positions advance side by side.

    ``order`` is sorted to a depth of ``limit`` or more, and suffixes that tie there stand
    in any order. A value may start from the one before it only if the position after
    that one's partner also stands ahead of it in ``order``; otherwise it starts from 0."""
    n = len(symbols)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    place = np.empty(n + 1, np.int64)
    place[order], place[n] = np.arange(n), n
    out = np.zeros(n, np.int64)
    at = np.flatnonzero(wanted & (before >= 0))
    if not len(at):
        return out
    fresh = np.append(True, np.diff(at) != 1)
    lead = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
    heads = np.flatnonzero((np.arange(len(at)) - lead) % run == 0)
    sizes = np.diff(np.append(heads, len(at)))
    carry = np.zeros(len(heads), np.int64)
    guard = np.concatenate([key, np.zeros(1, np.uint64)])
    for s in range(int(sizes.max())):
        live = np.flatnonzero(sizes > s)
        i = at[heads[live] + s]
        j = before[i]
        size = np.where(place[before[i - 1] + 1] < place[i], np.maximum(carry[live] - 1, 0), 0) if s else np.zeros(len(live), np.int64)
        todo = np.arange(len(live))
        while len(todo):  # seven symbols a step
            a, b = i[todo] + size[todo], j[todo] + size[todo]
            same = (size[todo] < limit) & (a < n) & (b < n) & (guard[np.minimum(a, n)] == guard[np.minimum(b, n)])
            todo = todo[same]
            size[todo] += 7
        a, b = i + size, j + size
        differ = guard[np.minimum(a, n)] ^ guard[np.minimum(b, n)]
        for k in range(6):  # the symbols before the one that differs
            same = (differ >> np.uint64(9 * (6 - k))) == 0
            same &= (a + k < n) & (b + k < n)
            size += same
        size = np.minimum(size, limit)
        out[i] = size
        carry[live] = size
    return out


def repeated_windows(texts: list[bytes], windows: np.ndarray, counts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the segments of a shard: the window mask laid end to end (one entry per byte,
    and a separator after each segment), each segment's first entry, and a mask of one
    window of each set of equal ones."""
    sizes = np.array([len(t) for t in texts], np.int64)
    start = np.append(0, np.cumsum(sizes + 1))
    symbols = np.zeros(int(start[-1]), np.uint16)
    flat = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    symbols[:] = flat
    symbols += 1
    symbols[start[1:] - 1] = 0
    valid = np.zeros(len(symbols) + 1, np.int64)
    np.add.at(valid, start[:-1], 1)
    np.add.at(valid, start[:-1] + windows, -1)
    valid = np.cumsum(valid)[:-1] > 0
    order, key, deep = suffix_order(symbols, length)
    lcp = common_prefixes(symbols, key, order, deep, length)
    twin = np.flatnonzero((lcp >= length) & valid)
    before = np.full(len(symbols), -1, np.int64)
    before[order[1:]] = order[:-1]
    hit = np.zeros(len(symbols), bool)
    hit[twin] = True
    hit[before[twin]] = True
    single = valid.copy()
    single[twin] = False  # the first of each set in suffix order stays
    owner = np.repeat(np.arange(len(texts)), sizes + 1)
    hit |= valid & (counts[owner] > 1)
    return hit & valid, start, single


def _runs(at: np.ndarray) -> np.ndarray:
    """Sorted positions as begin, end (exclusive) of their runs, flat."""
    if not len(at):
        return np.empty(0, np.int64)
    cut = np.flatnonzero(np.diff(at) != 1)
    return np.stack([at[np.append(0, cut + 1)], at[np.append(cut, len(at) - 1)] + 1], axis=1).ravel()


SHARD_RESULT = "minimizer long, h1 long, h2 long, runs array<int>, part int, entries binary"
_RESULT_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.binary()]


def _result(columns: list[list]) -> pa.Table:
    return pa.table([pa.array(c, t) for c, t in zip(columns, _RESULT_TYPES, strict=True)],
                    names=[c.split()[0] for c in SHARD_RESULT.split(", ")])


def shard_results(segs: DataFrame, length: int, parts: int) -> DataFrame:
    """For each shard of ``segs`` (``shard, minimizer, h1, h2, windows, count, split,
    bytes``): a row with the repeated windows of each segment, as runs, and for the
    segments of split minimizers rows with the sorted fingerprints of the shard's windows
    in each of ``parts`` ranges, to be merged with other shards'."""
    def work(key, t):
        t = t.combine_chunks()
        ids = [t[c].to_numpy() for c in ("minimizer", "h1", "h2")]
        order = np.lexsort(ids[::-1])
        ids = [c[order] for c in ids]
        texts = [t["bytes"][int(i)].as_py() for i in order]
        windows, counts = t["windows"].to_numpy()[order].astype(np.int64), t["count"].to_numpy()[order]
        split = np.array(t["split"].to_pylist(), bool)[order]
        hit, start, single = repeated_windows(texts, windows, counts, length)
        out: list[list] = [[], [], [], [], [], []]
        for i in range(len(texts)):
            runs = _runs(np.flatnonzero(hit[start[i]: start[i] + windows[i]]))
            if len(runs):
                for c, v in zip(out, (ids[0][i], ids[1][i], ids[2][i], runs, None, None), strict=True):
                    c.append(v)
        marks = []
        for i in np.flatnonzero(split):
            some = np.flatnonzero(single[start[i]: start[i] + windows[i]])
            if not len(some):
                continue
            data = np.frombuffer(texts[i], np.uint8)
            f1 = span_hash(prefix_hash(data), some, some + length)
            f2 = span_hash(prefix_hash(data[::-1]), len(data) - some - length, len(data) - some)
            row = np.empty((len(some), 7), np.int64)
            row[:, 0], row[:, 1] = f1.view(np.int64), f2.view(np.int64)
            row[:, 2] = hit[start[i] + some]
            row[:, 3:6] = [c[i] for c in ids]
            row[:, 6] = some
            marks.append(row)
        if marks:
            rows = np.concatenate(marks)
            part = (rows[:, 0].view(np.uint64) % np.uint64(parts)).astype(np.int64)
            rows = rows[np.lexsort((rows[:, 1], rows[:, 0], part))]
            part = np.sort(part)
            for p in np.unique(part):
                for c, v in zip(out, (None, None, None, None, int(p), rows[slice(*np.searchsorted(part, [p, p + 1]))].tobytes()), strict=True):
                    c.append(v)
        return _result(out)

    return segs.groupBy("shard").applyInArrow(work, SHARD_RESULT)


def merged_ranges(rows: DataFrame) -> DataFrame:
    """``minimizer, h1, h2, runs`` of the windows that another shard of their range has:
    each shard's sorted run is looked up in the others by binary search."""
    def merge(key, t):
        runs = [np.frombuffer(v, np.int64).reshape(-1, 7) for v in t["entries"].to_pylist()]
        names = [r[:, :2].copy().view([("a", np.int64), ("b", np.int64)]).ravel() for r in runs]
        everything = np.sort(np.concatenate(names))
        found = []
        for r, name in zip(runs, names, strict=True):
            again = np.searchsorted(everything, name, "right") - np.searchsorted(everything, name, "left") > 1
            found.append(r[again & (r[:, 2] == 0)])
        hits = np.concatenate(found)
        hits = hits[np.lexsort((hits[:, 6], hits[:, 5], hits[:, 4], hits[:, 3]))]
        out: list[list] = [[], [], [], [], [], []]
        if len(hits):
            first = np.flatnonzero(np.append(True, (hits[1:, 3:6] != hits[:-1, 3:6]).any(1)))
            for a, b in zip(first, np.append(first[1:], len(hits)), strict=True):
                for c, v in zip(out, (*hits[a, 3:6].tolist(), _runs(hits[a:b, 6]), None, None), strict=True):
                    c.append(v)
        return _result(out)

    return rows.groupBy("part").applyInArrow(merge, SHARD_RESULT).select("minimizer", "h1", "h2", "runs")


# -- the operator -------------------------------------------------------------------

_SEGMENT = ["minimizer", "h1", "h2"]


def _keyed(docs: DataFrame) -> list:
    return [F.coalesce(docs["doc_id"].cast("long"), F.lit(-(1 << 63))).alias("id"), F.xxhash64(docs["text"]).alias("text_hash")]


def repeated_runs(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``id, text_hash, runs``: for each text with repeated windows, flat begin and end of
    runs of window positions (not yet merged). Null ids appear as the least long."""
    texts = docs.select(*_keyed(docs), docs["text"].cast("string").alias("text"))
    found = written(segment_rows(texts, length), "segments")
    often = written(found.groupBy("minimizer").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("minimizer"), "minimizers")
    found = written(found.join(often, "minimizer", "left_semi"), "candidates")
    distinct = written(found.groupBy(*_SEGMENT).agg(
        F.count(F.lit(1)).alias("count"), F.max("windows").alias("windows"),
        F.min(F.struct("id", "text_hash", "start")).alias("at")), "distinct-segments")
    crowd = distinct.groupBy("minimizer").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SPLIT)
    crowd = written(crowd.select(F.col("minimizer").alias("_m"), F.ceil(F.col("n") / SPLIT).alias("subs")), "split-minimizers")
    total = distinct.agg(F.coalesce(F.sum(F.col("windows") + length), F.lit(0))).first()[0]
    shards = max(1, -(-total // SHARD_BYTES))
    sub = F.when(F.col("subs").isNotNull(), F.pmod(F.xxhash64("h1"), F.col("subs"))).otherwise(F.lit(0))
    placed = (distinct.join(crowd, F.col("minimizer") == F.col("_m"), "left")
              .select("at", "windows", "count", *_SEGMENT, F.col("subs").isNotNull().alias("split"),
                      F.pmod(F.xxhash64("minimizer", sub), F.lit(shards)).cast("int").alias("shard")))
    placed = written(placed, "placed-segments")
    split_windows = placed.where("split").agg(F.coalesce(F.sum("windows"), F.lit(0))).first()[0]
    parts = max(1, -(-split_windows // RANGE_WINDOWS))
    wanted = placed.groupBy(F.col("at.id").alias("_id"), F.col("at.text_hash").alias("_hash")).agg(
        F.collect_list(F.struct(F.col("at.start").alias("start"), "windows", "count", "split", "shard", *_SEGMENT)).alias("wanted"))
    # of rows that repeat an id and text one goes on, so that copies cost once each
    near = maybe_member(texts, [F.col("id"), F.col("text_hash")], placed, [F.col("at.id"), F.col("at.text_hash")], "_maybe").where("_maybe")
    near = near.dropDuplicates(["id", "text_hash"])
    source = near.join(wanted, (F.col("id") == F.col("_id")) & (F.col("text_hash") == F.col("_hash"))).select("text", "wanted")

    def copy_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                data, offsets = column_bytes(part.column(0))
                lists = part.column(1)
                flat, count = lists.flatten(), np.array([len(x) for x in lists])
                at = np.repeat(offsets[:-1], count) + flat.field("start").to_numpy()
                stop = at + flat.field("windows").to_numpy() + length - 1
                raw = pa.array([data[a:b].tobytes() for a, b in zip(at.tolist(), stop.tolist(), strict=True)], pa.binary())
                names = ["shard", *_SEGMENT, "windows", "count", "split"]
                yield pa.RecordBatch.from_arrays([*(flat.field(c) for c in names), raw], names=[*names, "bytes"])

    segs = source.mapInArrow(copy_out, "shard int, minimizer long, h1 long, h2 long, windows int, count long, split boolean, bytes binary")
    results = written(shard_results(segs, length, parts), "shard-results")
    merged = merged_ranges(results.where("part is not null").select("part", "entries"))
    runs = written(results.where("part is null").select(*_SEGMENT, "runs").unionByName(merged), "segment-runs")
    hits = found.select("id", "text_hash", "start", *_SEGMENT).join(runs, _SEGMENT)
    moved = hits.select("id", "text_hash", F.transform("runs", lambda x: x + F.col("start")).alias("runs"))
    return moved.groupBy("id", "text_hash").agg(F.flatten(F.collect_set("runs")).alias("runs"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, whole_characters: bool = False) -> DataFrame:
    """Per row of ``docs``: all its columns in ``_row``, then ``n_bytes, n_removed, n_spans,
    kept_sha256, kept`` (bytes) and ``spans`` (flat begin, end of the removed runs).

    A byte is removed if a string of ``length`` bytes that covers it starts anywhere else
    too, in this text or another; matches never cross texts, overlaps count, and strings
    are judged on the input. A null text is empty, a text shorter than ``length`` keeps
    all. Rows that repeat are texts of their own: they repeat one another wholly. With
    ``whole_characters`` a span gives up the bytes of characters that it covers in part.
    An empty table gives no rows."""
    runs = written(repeated_runs(docs, length), "repeated-runs")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = docs.select(row, *_keyed(docs), docs["text"].cast("string").alias("_text"))
    runs = runs.select(F.col("id").alias("_id"), F.col("text_hash").alias("_hash"), "runs")
    rows = maybe_member(rows, [F.col("id"), F.col("text_hash")], runs, [F.col("_id"), F.col("_hash")], "_maybe")
    joined = rows.where("_maybe").join(runs, (F.col("id") == F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left").select("_row", "_text", "runs")
    joined = joined.unionByName(rows.where("not _maybe").select("_row", "_text", F.lit(None).cast("array<int>").alias("runs")))
    row_type = joined.schema["_row"].dataType.simpleString()
    schema = f"_row {row_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<int>"

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                data, offsets = column_bytes(part.column(1))
                out: list[list] = [[], [], [], [], [], []]
                for i, found in enumerate(part.column(2).to_pylist()):
                    text = data[offsets[i]: offsets[i + 1]]
                    spans = removed_spans(found, length)
                    if whole_characters:
                        spans = on_characters(spans, text)
                    kept = b"".join(text[a:b].tobytes() for a, b in zip(np.append(0, spans[1::2]), np.append(spans[::2], len(text)), strict=True))
                    for c, v in zip(out, (len(text), len(text) - len(kept), len(spans) // 2, hashlib.sha256(kept).hexdigest(), kept, spans), strict=True):
                        c.append(v)
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(out, types, strict=True))],
                                                 names=["_row", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"])

    return joined.mapInArrow(remove, schema)


def removed_spans(runs: list[int] | None, length: int) -> np.ndarray:
    """Flat begin and end of the byte runs that windows at these positions cover."""
    if not runs:
        return np.empty(0, np.int64)
    pairs = np.array(runs, np.int64).reshape(-1, 2)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    begin, end = pairs[:, 0], np.maximum.accumulate(pairs[:, 1] + length - 1)
    new = np.append(True, begin[1:] > end[:-1])
    return np.stack([begin[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]], axis=1).ravel()


def on_characters(spans: np.ndarray, text: np.ndarray) -> np.ndarray:
    """The spans without partly covered UTF-8 characters at their ends."""
    inner = (text & 0xC0) == 0x80  # continuation bytes
    out = []
    for a, b in spans.reshape(-1, 2).tolist():
        while a < b and inner[a]:
            a += 1
        while b > a and b < len(text) and inner[b]:
            b -= 1
        if a < b:
            out += [a, b]
    return np.array(out, np.int64)
