"""Phrase collocations: frequent phrases of two to five words and how their parts attract.

Words are counted by language and numbered by falling frequency over all languages, so a
pair of numbers tells the language and small numbers meet most often. A chunk of texts is
a sequence of numbers with -1 where a piece ends or a word is too rare for any phrase.

Pairs of neighbouring numbers are counted by tiles of the pair plane: a tile with many
occurrences in a chunk by direct address (one dense ``bincount``), all others as sorted
coordinates. Spark adds the chunks' counts up by pair. Pairs that are frequent enough are
numbered by falling frequency themselves and take the place of words: a pair of
neighbouring (overlapping) two-word units is a phrase of three words, and so on to five.
A phrase is frequent only if both its shorter units are, so nothing is missed.

A unit keeps the counts of its beginnings and ends from the units it was made of, so every
cut of a phrase is scored without another count.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import rank_within, topk_per_group
from .common import dropped, maybe_member, scratch, written

LEAST = 100
LONGEST = 5
TOP = 2_000
#: Words of a chunk, about; bytes split at once; rows taken from a batch at once.
CHUNK_WORDS = 500_000
SLICE_BYTES = 1 << 20
STEP = 512
#: A tile is ``2 ** TILE_BITS`` numbers square; with this many pairs it is counted densely.
TILE_BITS = 11
DENSE = 1 << 17
#: Rows of a batch handed to Spark.
BATCH = 1 << 16

_SEPARATORS = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n\n\n\n\n\n\n\n\n ")


def _slices(data: bytes):
    """``data`` cut after spaces or piece ends into parts of about ``SLICE_BYTES``."""
    lo = 0
    while lo < len(data):
        hi = lo + SLICE_BYTES
        if hi < len(data):
            cut = max(data.rfind(b" ", lo, hi), data.rfind(b"\n", lo, hi))
            if cut < lo:  # a word longer than a part
                ends = [x for x in (data.find(b" ", hi), data.find(b"\n", hi)) if x >= 0]
                cut = min(ends) if ends else len(data) - 1
            hi = cut + 1
        yield data[lo:hi]
        lo = hi


class _Chunk:
    """Texts as word numbers of their own, -1 at piece ends."""

    def __init__(self):
        self.tables: dict[str, dict[bytes, int]] = {}
        self.langs: list[str] = []
        self.words: list[bytes] = []
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, lang: str, data: bytes) -> None:
        table = self.tables.setdefault(lang, {})
        for part in _slices(data.lower().translate(_SEPARATORS)):
            tokens = np.array(part.replace(b"\n", b" \n ").split(b" ") + [b""], object)
            codes, distinct = pd.factorize(tokens)
            number = np.empty(len(distinct), np.int32)
            for k, word in enumerate(distinct):
                if word == b"":
                    number[k] = -2
                elif word == b"\n":
                    number[k] = -1
                else:
                    got = table.get(word)
                    if got is None:
                        got = table[word] = len(self.words)
                        self.words.append(word)
                        self.langs.append(lang)
                    number[k] = got
            codes = number[codes]
            self.parts.append(codes[codes != -2])
            self.size += len(self.parts[-1])
        self.parts.append(np.array([-1], np.int32))

    def row(self, chunk: int) -> pa.RecordBatch:
        codes = np.concatenate(self.parts)
        counts = np.bincount(codes[codes >= 0], minlength=len(self.words))
        return pa.RecordBatch.from_arrays(
            [pa.array([chunk]), pa.array([codes.tobytes()], pa.binary()), pa.array([self.langs], pa.list_(pa.string())),
             pa.array([[w.decode() for w in self.words]], pa.list_(pa.string())), pa.array([counts.tolist()], pa.list_(pa.int64()))],
            ["chunk", "codes", "langs", "words", "counts"])


def chunks(docs: DataFrame, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """``docs`` (``text, lang``) as chunks: ``chunk, codes, langs, words, counts``. Null
    texts are empty, a null language is ``und``."""
    def encode(batches):
        at, chunk = TaskContext.get().partitionId() << 32, _Chunk()
        for batch in (b.slice(lo, STEP) for b in batches for lo in range(0, b.num_rows, STEP)):
            langs = np.array(batch.column("lang").to_pylist(), object)
            for lang in sorted(set(langs)):
                some = np.flatnonzero(langs == lang)
                texts = batch.column("text").take(pa.array(some)).cast(pa.binary()).to_pylist()
                lo = 0
                while lo < len(texts):  # texts together up to a part's size, one at least
                    hi, size = lo, 0
                    while hi < len(texts) and (hi == lo or size + len(texts[hi]) < SLICE_BYTES):
                        size += len(texts[hi])
                        hi += 1
                    chunk.add(lang, b"\n".join(texts[lo:hi]))
                    lo = hi
                    if chunk.size >= chunk_words:
                        yield chunk.row(at)
                        at, chunk = at + 1, _Chunk()
        if chunk.size:
            yield chunk.row(at)

    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        encode, "chunk long, codes binary, langs array<string>, words array<string>, counts array<long>")


# -- sequences of units ------------------------------------------------------------------

def _packed(units: np.ndarray) -> tuple[bytes, int]:
    """Numbers as bytes, and bytes per number; runs of -1 become one."""
    keep = np.ones(len(units), bool)
    keep[1:] = (units[1:] >= 0) | (units[:-1] >= 0)
    units = units[keep]
    kind = np.int32 if not len(units) or units.max() < 1 << 31 else np.int64
    return units.astype(kind).tobytes(), np.dtype(kind).itemsize


def _unpacked(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, np.int32 if width == 4 else np.int64).astype(np.int64)


def _sequence(chunk: int, units: np.ndarray) -> pa.Table:
    data, width = _packed(units)
    return pa.table({"chunk": pa.array([chunk], pa.int64()), "units": pa.array([data], pa.binary()), "width": pa.array([width], pa.int32())})


_SEQUENCE = "chunk long, units binary, width int"


def _number_words(seq: pa.Table, numbers: pa.Table) -> pa.Table:
    """A chunk's own word numbers replaced by those of the whole corpus; -1 for rare words."""
    if not seq.num_rows:
        return pa.table({"chunk": pa.array([], pa.int64()), "units": pa.array([], pa.binary()), "width": pa.array([], pa.int32())})
    codes = np.frombuffer(seq.column("codes")[0].as_py(), np.int32)
    number = np.full(max(int(codes.max(initial=-1)), -1) + 2, -1, np.int64)  # the last stands for -1
    number[numbers.column("code").to_numpy()] = numbers.column("id").to_numpy()
    return _sequence(seq.column("chunk")[0].as_py(), number[codes])


def _number_pairs(seq: pa.Table, numbers: pa.Table) -> pa.Table:
    """Each unit replaced by the number of the pair it begins, -1 where that is not frequent."""
    if not seq.num_rows:
        return seq.select(["chunk", "units", "width"])
    units = _unpacked(seq.column("units")[0].as_py(), seq.column("width")[0].as_py())
    distinct, code = np.unique(units, return_inverse=True)
    left, right = (np.searchsorted(distinct, numbers.column(c).to_numpy()) for c in ("i", "j"))
    known = left.astype(np.int64) << 32 | right
    order = np.argsort(known)
    known, ids = known[order], numbers.column("id").to_numpy()[order]
    out = np.full(len(units), -1, np.int64)
    if len(known):
        key = code[:-1].astype(np.int64) << 32 | code[1:]
        at = np.minimum(np.searchsorted(known, key), len(known) - 1)
        out[:-1] = np.where((known[at] == key) & (units[:-1] >= 0) & (units[1:] >= 0), ids[at], -1)
    return _sequence(seq.column("chunk")[0].as_py(), out)


def tile_counts(units: np.ndarray, tile_bits: int = TILE_BITS, dense: int = DENSE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``i, j, count`` of the neighbouring pairs of a sequence, -1 being no unit."""
    here = (units[:-1] >= 0) & (units[1:] >= 0)
    if not here.any():
        return (np.empty(0, np.int64),) * 3
    distinct, code = np.unique(units, return_inverse=True)
    a, b = code[:-1][here].astype(np.int64), code[1:][here].astype(np.int64)
    tile_of = distinct >> tile_bits
    _, line = np.unique(tile_of, return_inverse=True)
    tiles, tile, n = np.unique(line[a] * (int(line.max()) + 1) + line[b], return_inverse=True, return_counts=True)
    found, mask, rest = [], (1 << tile_bits) - 1, np.ones(len(a), bool)
    for t in np.flatnonzero(n >= dense):
        inside = tile == t
        rest &= ~inside
        x, y = distinct[a[inside]], distinct[b[inside]]
        cells = np.bincount((x & mask) << tile_bits | (y & mask), minlength=1 << 2 * tile_bits)
        cell = np.flatnonzero(cells)
        found.append(((x[0] >> tile_bits << tile_bits) + (cell >> tile_bits), (y[0] >> tile_bits << tile_bits) + (cell & mask), cells[cell]))
    sparse, counts = np.unique(a[rest] << 32 | b[rest], return_counts=True)
    found.append((distinct[sparse >> 32], distinct[sparse & 0xFFFFFFFF], counts))
    return tuple(np.concatenate([f[k] for f in found]).astype(np.int64) for k in range(3))


def chunk_pairs(sequences: DataFrame) -> DataFrame:
    """``chunk, i, j, c``: how often unit ``j`` follows unit ``i`` in each chunk."""
    def count(batches):
        for batch in batches:
            for chunk, data, width in zip(*[batch.column(c).to_pylist() for c in ("chunk", "units", "width")]):
                i, j, c = tile_counts(_unpacked(data, width))
                for lo in range(0, len(i), BATCH):
                    part = slice(lo, lo + BATCH)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i[part]), chunk)), *[pa.array(x[part]) for x in (i, j, c)]], ["chunk", "i", "j", "c"])

    return sequences.mapInArrow(count, "chunk long, i long, j long, c long")


def _renumbered(sequences: DataFrame, numbers: DataFrame, replace) -> DataFrame:
    return sequences.groupBy("chunk").cogroup(numbers.groupBy("chunk")).applyInArrow(replace, _SEQUENCE)


def _ranked(frequent: DataFrame, ties: list[str], name: str) -> DataFrame:
    """``frequent`` with ``id``, its rank by falling ``a`` from 0, written."""
    return written(rank_within(frequent, [], [F.col("a").desc(), *ties], "_rn").withColumn("id", F.col("_rn").cast("long") - 1).drop("_rn"), name)


def frequent_units(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, chunk_words: int = CHUNK_WORDS) -> tuple[DataFrame, list[DataFrame]]:
    """All words by language (``lang, n``), and for each length from 1 to ``longest`` its
    phrases that occur ``least`` times or more: ``id, i, j, a, lang, words, starts, ends``,
    where ``i`` and ``j`` are the ids of the phrase without its last and first word, and
    ``starts`` and ``ends`` the counts of its beginnings and ends of 1, 2, ... words."""
    spark = docs.sparkSession
    with scratch() as passed:  # tables of a step that the next one no longer reads
        coded = written(chunks(docs, chunk_words), "colloc-chunks")
        vocabulary = coded.select("chunk", F.posexplode(F.arrays_zip("langs", "words", "counts")).alias("code", "w")).select(
            "chunk", F.col("code").cast("long").alias("code"), F.col("w.langs").alias("lang"), F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
        vocabulary = written(vocabulary, "colloc-vocabulary")
    totals = written(vocabulary.groupBy("lang").agg(F.sum("n").alias("n")), "colloc-totals")
    counted = vocabulary.groupBy("lang", "word").agg(F.sum("n").alias("a")).where(F.col("a") >= least)
    none = F.lit(None).cast("long")
    units = [written(_ranked(counted, ["lang", "word"], "colloc-words").select(
        "id", none.alias("i"), none.alias("j"), "a", "lang", F.array("word").alias("words"), F.array("a").alias("starts"), F.array("a").alias("ends")), "colloc-units")]
    numbers = (vocabulary.select("chunk", "code", "lang", "word").join(units[0].select("id", "lang", F.col("words")[0].alias("word")), ["lang", "word"])
               .select("chunk", "code", "id"))
    with scratch() as current:
        sequences = written(_renumbered(coded.select("chunk", "codes"), numbers, _number_words), "colloc-sequences")
    dropped(spark, passed)
    for length in range(2, longest + 1):
        with scratch() as passed:
            pairs = written(chunk_pairs(sequences), "colloc-pairs")
            frequent = pairs.groupBy("i", "j").agg(F.sum("c").alias("a")).where(F.col("a") >= least)
            ranked = _ranked(frequent, ["i", "j"], "colloc-frequent")
        left = units[-1].select(F.col("id").alias("i"), "lang", F.col("words").alias("_first"), F.col("starts").alias("_starts"))
        right = units[-1].select(F.col("id").alias("j"), F.element_at("words", -1).alias("_last"), F.col("ends").alias("_ends"))
        units.append(written(ranked.join(left, "i").join(right, "j").select(
            "id", "i", "j", "a", "lang", F.concat("_first", F.array("_last")).alias("words"),
            F.concat("_starts", F.array("a")).alias("starts"), F.concat("_ends", F.array("a")).alias("ends")), "colloc-units"))
        passed += current
        if length < longest:
            likely = maybe_member(pairs, [F.col("i"), F.col("j")], ranked, [F.col("i"), F.col("j")], "_maybe").where("_maybe")
            numbers = likely.select("chunk", "i", "j").join(ranked.select("i", "j", "id"), ["i", "j"])
            with scratch() as current:
                sequences = written(_renumbered(sequences, numbers, _number_pairs), "colloc-sequences")
        dropped(spark, passed)
    return totals, units


#: The weakest cut of a phrase, ties to the shortest first part; exact in 38 digits.
_WEAKEST = """array_min(transform(sequence(1, size(words) - 1), m -> named_struct(
  'score', (cast(a as decimal(19, 0)) * cast(n as decimal(19, 0)) * cast(1000 as decimal(4, 0)))
           div (cast(starts[m - 1] as decimal(19, 0)) * cast(ends[size(words) - m - 1] as decimal(19, 0))),
  'cut', m, 'l', starts[m - 1], 'r', ends[size(words) - m - 1])))"""


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP,
                 chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """Each language's ``top`` phrases: ``lang, rank, phrase, a, l, r, n, score``.

    ``docs`` has ``text`` and ``lang``. A-Z are lower-cased; ``.,;:!?`` and line ends part
    pieces, spaces and tabs words; phrases lie within a piece. ``a`` is a phrase's count
    (overlaps too), ``l`` and ``r`` those of the parts of its lowest-scoring cut (ties: the
    shortest first part), ``n`` all words of the language, ``score`` the whole part of
    ``1000 a n / (l r)``. A phrase goes if a longer one that holds it occurs as often; as
    counts never rise with length, one word longer is enough to look at. Order: score and
    ``a`` falling, phrase. A null language is ``und``; null and empty texts have no words;
    repeated rows count each; an empty table gives no rows."""
    totals, units = frequent_units(docs, least, longest, chunk_words)
    kept = []
    for k in range(1, len(units)):
        phrases = units[k]
        if k + 1 < len(units):
            longer = units[k + 1]
            inside = longer.select(F.col("i").alias("id"), "a").union(longer.select("j", "a")).distinct()
            phrases = phrases.join(inside, ["id", "a"], "left_anti")
        kept.append(phrases.select("lang", "words", "a", "starts", "ends"))
    rows = kept[0]
    for more in kept[1:]:
        rows = rows.unionByName(more)
    scored = rows.join(totals, "lang").withColumn("w", F.expr(_WEAKEST)).select(
        "lang", F.array_join("words", " ").alias("phrase"), "a", F.col("w.l").alias("l"), F.col("w.r").alias("r"), "n", F.col("w.score").alias("score"))
    best = topk_per_group(scored, ["lang"], [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()], top)
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
