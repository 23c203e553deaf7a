"""Document fingerprints: a Merkle tree over sections, paragraphs and runs of words.

A text is cut, without losing a character, into paragraphs (at line ends), paragraphs
into runs of words, and paragraphs are gathered into sections. Runs end after a word
whose CRC32 is divisible by ``RUN`` (by 1 in a paragraph of fewer than ``SHORT`` words, so
every word is a run there) or after ``MOST_WORDS`` words, sections at an empty line or after a paragraph whose digest is
divisible by ``SECTION``; so an edit moves no cut but those beside it. A word of more than
``WORD`` characters is cut into pieces of that length.

A run's digest is the BLAKE2b of its characters; a paragraph's, a section's and the
root's that of their children's digests. The fingerprint is text: the root (equal for
equal texts and no others, but for collisions of 128 bits), then sections parted by
``/``, paragraphs by ``.``, and 8 hex digits for each run. Inner digests follow from those
below them, so two fingerprints are compared from the root down: equal branches count
whole, differing ones are opened, and what is left shows where the texts differ.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RUN = 4
SHORT = 16
SECTION = 8
WORD = 12
MOST_WORDS = 8
ROOT_DIGITS = 32
RUN_DIGITS = 8

_PARAGRAPH = re.compile(r"[^\n]*\n+|[^\n]+")
_WORD = re.compile(r"\S{1,%d}\s*|\s+" % WORD)


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def runs(paragraph: str) -> list[str]:
    """The runs of words of a paragraph; joined, they are the paragraph."""
    found = _WORD.findall(paragraph)
    if len(found) < SHORT:
        return found
    out, start, at, words = [], 0, 0, 0
    for word in found:
        at += len(word)
        words += 1
        if words == MOST_WORDS or crc32(word.encode("utf-8", "surrogatepass")) % RUN == 0:
            out.append(paragraph[start:at])
            start, words = at, 0
    if start < at:
        out.append(paragraph[start:])
    return out


def _paragraph(paragraph: str) -> tuple[str, bytes]:
    """The digits of a paragraph's runs, and its digest."""
    leaves = [_digest(run.encode("utf-8", "surrogatepass")) for run in runs(paragraph)]
    return "".join([leaf[:RUN_DIGITS // 2].hex() for leaf in leaves]), _digest(b"".join(leaves))


def fingerprint(text: str | None, known: dict | None = None) -> str:
    """The fingerprint of a text; a null text is an empty one, whose tree has no branch.
    ``known`` keeps paragraphs for texts that share them."""
    known = {} if known is None else known
    sections, paragraphs, digests, below = [], [], [], []
    for paragraph in _PARAGRAPH.findall(text or ""):
        if paragraph not in known:
            known[paragraph] = _paragraph(paragraph)
        digits, whole = known[paragraph]
        paragraphs.append(digits)
        digests.append(whole)
        if paragraph.endswith("\n\n") or whole[0] % SECTION == 0:
            sections.append(".".join(paragraphs))
            below.append(_digest(b"p" + b"".join(digests)))
            paragraphs, digests = [], []
    if paragraphs:
        sections.append(".".join(paragraphs))
        below.append(_digest(b"p" + b"".join(digests)))
    return _digest(b"s" + b"".join(below)).hex() + ":" + "/".join(sections)


def _leaves(paragraph: str) -> list[str]:
    return [paragraph[i: i + RUN_DIGITS] for i in range(0, len(paragraph), RUN_DIGITS)]


def _differing(a: list[str], b: list[str]) -> tuple[list[str], list[str]]:
    """Branches of each side without an equal on the other, in order."""
    left, right = Counter(a), Counter(b)
    return _without(a, right), _without(b, left)


def _without(branches: list[str], others: Counter) -> list[str]:
    spare = others.copy()
    out = []
    for branch in branches:
        if spare[branch] > 0:
            spare[branch] -= 1
        else:
            out.append(branch)
    return out


def likeness(a: str, b: str) -> float:
    """Share of runs that two fingerprints have in common, 0 to 1: twice the runs below
    equal branches, by the runs of both. Two empty texts are alike, 1."""
    if a[:ROOT_DIGITS] == b[:ROOT_DIGITS]:
        return 1.0
    a, b = a[ROOT_DIGITS + 1:], b[ROOT_DIGITS + 1:]
    total = sum(len(x) - x.count("/") - x.count(".") for x in (a, b)) // RUN_DIGITS
    if not total:
        return 0.0
    x, y = _differing(a.split("/"), b.split("/"))
    x, y = _differing(".".join(x).split(".") if x else [], ".".join(y).split(".") if y else [])
    x, y = _differing(_leaves("".join(x)), _leaves("".join(y)))
    return (total - len(x) - len(y)) / total


def edited_paragraphs(a: str, b: str) -> list[tuple[int, int]]:
    """(section, paragraph) of each paragraph of ``a``, counted from 0, that has no equal
    in ``b``: sections equal on both sides are not opened."""
    if a[:ROOT_DIGITS] == b[:ROOT_DIGITS]:
        return []
    ours, theirs = a[ROOT_DIGITS + 1:].split("/"), b[ROOT_DIGITS + 1:].split("/")
    closed, out = Counter(theirs), []
    opened = _without(theirs, Counter(ours))
    spare = Counter(".".join(opened).split(".")) if opened else Counter()
    for i, section in enumerate(ours):
        if closed[section] > 0:
            closed[section] -= 1
            continue
        for j, paragraph in enumerate(section.split(".") if section else []):
            if spare[paragraph] > 0:
                spare[paragraph] -= 1
            else:
                out.append((i, j))
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, fingerprint`` of every row of ``docs`` (``doc_id, text``); null
    texts are empty ones, equal rows are kept, an empty table gives no rows."""
    def work(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(t or "") for t in texts], pa.int64()), pa.array([fingerprint(t) for t in texts])],
                ["doc_id", "n_chars", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        work, "doc_id long, n_chars long, fingerprint string")


# -- every document beside the next one ------------------------------------------------

#: Rows of a block of neighbouring documents, about, and the most blocks there are: their
#: first keys, 24 bytes each, are all that the driver and every task hold.
BLOCK_ROWS = 20_000
MOST_BLOCKS = 65_536
#: Documents compared at once.
STEP = 64


def _key(doc_id: Column, text: Column) -> list[Column]:
    """The order of documents: id (null first), then a hash of the text."""
    return [F.coalesce(doc_id, F.lit(-(1 << 63))), doc_id.isNotNull().cast("long"), F.xxhash64(text)]


def block_bounds(keys: DataFrame, block_rows: int) -> np.ndarray:
    """First keys of blocks of about ``block_rows`` rows, as sorted rows ``(id, has id,
    hash)``: the smallest key of all, then keys at even steps of a sample drawn by a hash
    of the key. There is one for each block, as in the range partitioning of a sort. A
    key that repeats often enough to fill blocks of its own stands there once for each.
    """
    n, *least = keys.agg(F.count(F.lit(1)), *[F.min(F.struct("k0", "k1", "k2"))[k] for k in ("k0", "k1", "k2")]).first()
    if not n:
        return np.empty((0, 3), np.int64)
    blocks = min(max(1, n // block_rows), MOST_BLOCKS)
    if blocks == 1:
        return np.array([least], np.int64)
    # whole rows, not keys, are drawn, so that copies count as often as they are there
    share = min(1.0, 20 * blocks / n)
    drawn = (keys.where(F.rand(seed=7) < share)
             .repartitionByRange("k0", "k1", "k2").sortWithinPartitions("k0", "k1", "k2")
             .withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
             .where(F.col("_at") % 20 == 10).select("k0", "k1", "k2"))
    return np.array([tuple(least), *sorted(tuple(r) for r in drawn.collect())], np.int64)


def _record(bounds: np.ndarray) -> np.ndarray:
    out = np.empty(len(bounds), [("k0", "<i8"), ("k1", "<i8"), ("k2", "<i8")])
    for i, k in enumerate(("k0", "k1", "k2")):
        out[k] = bounds[:, i]
    return out


def beside_next(docs: DataFrame, compare, schema: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``compare(ids, texts, next_texts)`` over every document and the next one in order of
    ``doc_id`` (null first; equal ids by a hash of their text), after the last the first.

    ``compare`` gets lists and gives the columns of ``schema``. Documents are dealt into
    blocks by the first keys of blocks, so the texts are shuffled once; the document that
    opens a block goes to the block before it as well. Rows of one key hold one text and
    are interchangeable; where they fill blocks, they are dealt out over those."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", *[k.alias(f"k{i}") for i, k in enumerate(_key(F.col("doc_id"), F.col("text")))])
    bounds = block_bounds(rows.select("k0", "k1", "k2"), block_rows)
    n_blocks = max(1, len(bounds))

    def deal(batches):
        starts = _record(bounds)
        sent, dealt_out = set(), Counter()
        for batch in batches:
            key = _record(np.stack([batch.column(f"k{i}").to_numpy(zero_copy_only=False) for i in range(3)], axis=1).astype(np.int64))
            hi = np.searchsorted(starts, key, "right") - 1
            lo = np.searchsorted(starts, key, "left")
            block, extra = hi.copy(), []
            for i in np.flatnonzero(lo <= hi):  # its key opens blocks
                first, last = int(lo[i]), int(hi[i])
                if first not in sent:
                    sent.add(first)
                    extra += [(i, (b - 1) % n_blocks) for b in range(first, last + 1)]
                # rows of a key with several blocks go round them, the last block first: it
                # holds the key's followers, so it must have one
                block[i] = last - dealt_out[first] % (last - first + 1)
                dealt_out[first] += 1
            out = batch.take(pa.array(np.concatenate([np.arange(len(key)), np.array([i for i, _ in extra], np.int64)]).astype(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([block, np.array([b for _, b in extra], np.int64)]).astype(np.int32)),
                 pa.array(np.repeat(np.array([0, 1], np.int32), [len(key), len(extra)])),
                 *[out.column(c) for c in ("k0", "k1", "k2", "doc_id", "text")]],
                ["block", "peek", "k0", "k1", "k2", "doc_id", "text"])

    def pair(batches):
        held = None  # the document before: (block, id, text)
        closed = None  # the block whose opening successor has come
        for batch in batches:
            block, peek = batch.column("block").to_pylist(), batch.column("peek").to_pylist()
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            done = ([], [], [])
            for b, p, i, t in zip(block, peek, ids, texts):
                if held is not None and held[0] == b and closed != b:
                    for column, value in zip(done, (held[1], held[2], t)):
                        column.append(value)
                if p:
                    closed = b
                else:
                    held = (b, i, t)
            for lo in range(0, len(done[0]), STEP):
                yield pa.RecordBatch.from_pydict(compare(*[c[lo: lo + STEP] for c in done]))

    dealt = rows.mapInArrow(deal, "block int, peek int, k0 long, k1 long, k2 long, doc_id long, text string")
    return (dealt.repartitionById(n_blocks, F.col("block")).sortWithinPartitions("block", "peek", "k0", "k1", "k2")
            .mapInArrow(pair, schema))


PAIR_SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
               "near_edited double, near_next double")


def half_replaced(text: str, other: str) -> str:
    """``text`` with its last ``floor(n / 2)`` characters replaced by the first as many of
    ``other``, or all of it if it is shorter."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def _compare(ids: list, texts: list[str], following: list[str]) -> dict:
    known: dict = {}
    ours = [fingerprint(t, known) for t in texts]
    edited = [half_replaced(t, o) for t, o in zip(texts, following)]
    theirs = [fingerprint(t, known) for t in edited]
    # a document's follower is most often the next row here
    after = [ours[i + 1] if i + 1 < len(ours) and following[i] is texts[i + 1] else fingerprint(following[i], known) for i in range(len(ours))]
    return {
        "doc_id": pa.array(ids, pa.int64()), "n_chars": pa.array([len(t) for t in texts], pa.int64()),
        "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited],
        "fingerprint": ours, "edited_fingerprint": theirs,
        "near_edited": pa.array([likeness(a, b) for a, b in zip(ours, theirs)], pa.float64()),
        "near_next": pa.array([likeness(a, b) for a, b in zip(ours, after)], pa.float64())}


def edited_fingerprints(docs: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The fingerprint of every document, that of its edited text (``half_replaced`` by the
    next document), and how alike the former is to the latter and to the next document's.

    Null texts are empty. A document alone follows itself. Documents without an id come
    first; equal rows each give a row and follow one another."""
    return beside_next(docs, _compare, PAIR_SCHEMA, block_rows)
