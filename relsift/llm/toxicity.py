"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is a logistic function of the
summed weights of its words' features (the hashed, lower-cased word and its first 4, 5
and 6 bytes, for word families); the document's is the noisy-or of its sentences, ``1 - prod(1 - p)``. Only documents are labelled: the likelihood of the
document labels trains the word weights through the noisy-or, and the trained sentence
scores then point at the offending sentences.

The weights are fitted on the whole texts of a bounded sample of labelled documents
(``SAMPLE_POSITIVE`` and ``SAMPLE_NEGATIVE``, chosen by a hash of ``doc_id``). Which
features take part follows from counts that Spark adds up; only those of each sentence,
equal sentences once with their number, reach the fitting task. Every document is scored
over its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .kernels import LOWER, column_bytes, mix, prefix_hash, row_blocks, span_hash, sums_between

DIM = 1 << 18
SAMPLE_POSITIVE = 6_000
SAMPLE_NEGATIVE = 10_000
#: A feature takes part if so many sampled documents hold it, and if its share of the
#: documents of the two labels differs by so many standard errors.
MIN_DOCUMENTS = 8
MIN_DIFFERENCE = 5.0
#: Lengths in bytes of the word beginnings that are features beside the word.
STEMS = (4, 5, 6)
PER_WORD = 1 + len(STEMS)

_LETTER = np.zeros(256, bool)
_LETTER[48:58] = _LETTER[65:91] = _LETTER[97:123] = True
_LETTER[128:] = True
_LETTER[39] = True  # '
_STOP = np.zeros(256, bool)
_STOP[[10, 13, 33, 46, 63]] = True  # line ends . ! ?


def sentence_words(data: np.ndarray, offsets: np.ndarray):
    """Features of texts laid end to end: ``slots`` (``PER_WORD`` for each word), the
    first slot of each sentence (with an end entry), the text of each sentence, and each
    sentence's byte range."""
    n = len(data)
    letter = _LETTER[data]
    new_text = np.zeros(n + 1, bool)
    new_text[offsets] = True
    before = np.concatenate([[False], letter[:-1]]) if n else letter
    after = np.concatenate([letter[1:], [False]]) if n else letter
    starts = np.flatnonzero(letter & (~before | new_text[:n]))
    ends = np.flatnonzero(letter & (~after | new_text[1:])) + 1
    prefix = prefix_hash(LOWER[data])
    slots = np.empty((len(starts), PER_WORD), np.int64)
    for k, length in enumerate((None, *STEMS)):
        stop = ends if length is None else np.minimum(starts + length, ends)
        slots[:, k] = mix(span_hash(prefix, starts, stop) + np.uint64(k)) >> np.uint64(65 - DIM.bit_length())
    opens = new_text[:n].copy()
    opens[1:] |= _STOP[data[:-1]] if n else False
    bounds = np.flatnonzero(opens)
    sentence = np.searchsorted(bounds, starts, "right") - 1
    first = np.flatnonzero(np.diff(sentence, prepend=-1))
    used = sentence[first]
    lo = bounds[used]
    hi = np.append(bounds, n)[used + 1]
    text = np.searchsorted(offsets, lo, "right") - 1
    return slots.ravel(), np.append(first, len(starts)) * PER_WORD, text, lo, hi


def sentence_logits(weights: np.ndarray, slots: np.ndarray, first: np.ndarray) -> np.ndarray:
    """``weights`` holds the bias last."""
    return np.clip(sums_between(weights[slots], first) + weights[-1], -30, 30)


def noisy_or(logits: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Log of the probability that no sentence offends, for each of ``n`` texts."""
    return -np.bincount(text, np.logaddexp(0, logits), n)


def used_features(present: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The features that take part, from the documents of each label (rows 0 and 1) that
    hold them and the documents ``n`` of each label."""
    overall = present.sum(0) / n.sum()
    error = np.sqrt(np.maximum(overall * (1 - overall), 1e-12) * (1 / n).sum())
    return np.flatnonzero((present.sum(0) >= MIN_DOCUMENTS)
                          & (np.abs(present[1] / n[1] - present[0] / n[0]) >= MIN_DIFFERENCE * error))


def kept_sentences(slots: np.ndarray, first: np.ndarray, place: np.ndarray):
    """A document by its used features only, as their places: ``at`` (the sentences' places
    end to end, sorted in each), ``sizes`` and ``times``. Equal sentences are one with their
    number; the last is that of all sentences without a used feature."""
    at = place[slots]
    on = at >= 0
    sentence = np.repeat(np.arange(len(first) - 1), np.diff(first))[on]
    at = at[on]
    order = np.lexsort((at, sentence))
    at, (found, sizes) = at[order].astype(np.int32), np.unique(sentence, return_counts=True)
    stops = np.cumsum(sizes)
    times: dict[bytes, int] = {}
    for lo, hi in zip((stops - sizes).tolist(), stops.tolist(), strict=True):
        own = at[lo:hi].tobytes()
        times[own] = times.get(own, 0) + 1
    sizes = [len(own) // 4 for own in times]
    return (np.frombuffer(b"".join(times), np.int32), np.array([*sizes, 0], np.int32),
            np.array([*times.values(), len(first) - 1 - len(found)], np.int64))


def fit_weights(bags: list[tuple[np.ndarray, np.ndarray, np.ndarray]], features: int, labels: np.ndarray, importance: np.ndarray,
                steps: int = 600, batch: int = 1024, rate: float = 0.1, shrink: float = 1e-5) -> np.ndarray:
    """Adam steps on the likelihood of the bag labels: a weight for each of ``features``
    places, the bias last. A bag is what ``kept_sentences`` returns; ``importance`` undoes
    the sampling rates of the classes."""
    w = np.zeros(features + 1)
    w[-1] = -5.0
    m, v, t = np.zeros(len(w)), np.zeros(len(w)), 0
    rng = np.random.default_rng(7)
    while t < steps:
        order = rng.permutation(len(bags))
        for lo in range(0, len(bags), batch):
            pick = order[lo: lo + batch]
            slots = np.concatenate([bags[i][0] for i in pick])
            sizes = np.concatenate([bags[i][1] for i in pick])
            times = np.concatenate([bags[i][2] for i in pick])
            text = np.repeat(np.arange(len(pick)), [len(bags[i][1]) for i in pick])
            z = sentence_logits(w, slots, np.append(0, np.cumsum(sizes)))
            none = np.minimum(-np.bincount(text, times * np.logaddexp(0, z), len(pick)), -1e-12)
            p = 1 / (1 + np.exp(-z))
            y = labels[pick]
            pull = np.where(y == 1, np.exp(none) / -np.expm1(none), -1.0) * importance[pick]
            gz = pull[text] * p
            grad = np.bincount(slots, np.repeat(gz, sizes), len(w))
            grad[-1] = (gz * times).sum()
            grad = grad / importance[pick].sum() - shrink * np.append(w[:-1], 0)
            t += 1
            m = 0.9 * m + 0.1 * grad
            v = 0.99 * v + 0.01 * grad * grad
            w += rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
    return w


def train(docs: DataFrame, labels: DataFrame, held_out_modulus: int = 5) -> np.ndarray | None:
    """Word weights from the rows of ``docs`` whose ``labels.toxic`` is known and whose
    ``crc32(doc_id) mod held_out_modulus`` is not 0; None when a class is missing.

    An id that ``labels`` repeats is toxic if any of its rows says so; of rows of ``docs``
    that share an id the smallest text counts. Rows without an id, and texts without a
    word, teach nothing. The sampled ids are a bounded table (``SAMPLE_POSITIVE +
    SAMPLE_NEGATIVE`` rows), which is broadcast; their texts count whole. The driver gets
    two counts for each of at most ``DIM`` features."""
    known = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
             .where(F.crc32(F.col("doc_id").cast("string")) % held_out_modulus != 0)
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    total = {bool(r[0]): r[1] for r in known.groupBy(F.col("toxic") != 0).count().collect()}
    if len(total) < 2:
        return None
    order = F.xxhash64("doc_id", F.lit("toxic-sample"))
    picked = None
    for positive, most in ((True, SAMPLE_POSITIVE), (False, SAMPLE_NEGATIVE)):
        part = (known.where((F.col("toxic") != 0) == positive).orderBy(order, "doc_id").limit(most)
                .select(F.col("doc_id").alias("_id"), F.lit(int(positive)).alias("_y")))
        picked = part if picked is None else picked.unionByName(part)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(2))
            for a, b in row_blocks(offsets):
                rows, slots_out, first_out = [], [], []
                for i in range(a, b):
                    slots, first, _, _, _ = sentence_words(data[offsets[i]: offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]]))
                    if len(slots):
                        rows.append(i)
                        slots_out.append(slots.astype(np.int32).tobytes())
                        first_out.append(first.astype(np.int64).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows, pa.int64())), batch.column(1).take(pa.array(rows, pa.int64())),
                     pa.array(slots_out, pa.binary()), pa.array(first_out, pa.binary())], names=["id", "y", "slots", "first"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        present = np.zeros((2, DIM), np.int64)
        for batch in batches:
            for y, slots in zip(batch.column("y").to_pylist(), batch.column("slots").to_pylist(), strict=True):
                present[y, np.unique(np.frombuffer(slots, np.int32))] += 1
        y, slot = np.nonzero(present)
        yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(slot, pa.int32()), pa.array(present[y, slot])], names=["y", "slot", "n"])

    texts = (docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_id"))
             .groupBy(F.col("_id").cast("long").alias("id")).agg(F.max("_y").alias("y"), F.min("text").alias("text")))
    bags = written(texts.mapInArrow(extract, "id long, y int, slots binary, first binary"), "toxic-bags")
    n = np.zeros(2)
    for r in bags.groupBy("y").count().collect():
        n[r["y"]] = r["count"]
    if not n.all():
        return None
    counts = (bags.select("y", "slots").mapInArrow(count, "y int, slot int, n long")
              .groupBy("slot").agg(*[F.coalesce(F.sum(F.when(F.col("y") == y, F.col("n"))), F.lit(0)).alias(f"n{y}") for y in (0, 1)])
              .where(F.col("n0") + F.col("n1") >= MIN_DOCUMENTS).toPandas())
    present = np.zeros((2, DIM))
    for y in (0, 1):
        present[y, counts["slot"].to_numpy(np.int64)] = counts[f"n{y}"].to_numpy(np.float64)
    used = used_features(present, n)
    place = np.full(DIM, -1, np.int32)
    place[used] = np.arange(len(used))
    rates = np.array([total[False], total[True]]) / n

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [kept_sentences(np.frombuffer(a, np.int32), np.frombuffer(b, np.int64), place)
                    for a, b in zip(batch.column("slots").to_pylist(), batch.column("first").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("y"), *[pa.array([k[c].tobytes() for k in kept], pa.binary()) for c in range(3)]],
                names=["id", "y", "at", "sizes", "times"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            parts = [[np.frombuffer(v, kind) for v in batch.column(c).to_pylist()] for c, kind in (("at", np.int32), ("sizes", np.int32), ("times", np.int64))]
            rows += zip(batch.column("id").to_pylist(), batch.column("y").to_pylist(), zip(*parts, strict=True), strict=True)
        if rows:
            rows.sort(key=lambda r: r[0])  # the order in which tasks deliver is left to chance
            y = np.array([r[1] for r in rows], np.int64)
            w = fit_weights([r[2] for r in rows], len(used), y, rates[y])
            yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary())], names=["w"])

    found = (bags.mapInArrow(keep, "id long, y int, at binary, sizes binary, times binary").repartition(1)
             .mapInArrow(fit, "w binary").collect())
    w = np.frombuffer(bytes(found[0]["w"]), np.float64)
    out = np.zeros(DIM + 1)
    out[used], out[-1] = w[:-1], w[-1]
    return out


def _scored(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray, threshold: float):
    """Scores of texts laid end to end, and (text, byte range) of sentences over the threshold."""
    n = len(offsets) - 1
    slots, first, text, lo, hi = sentence_words(data, offsets)
    if not len(slots):
        return np.zeros(n), []
    z = sentence_logits(weights, slots, first)
    hit = np.flatnonzero(z >= np.log(threshold / (1 - threshold)))
    return -np.expm1(noisy_or(z, text, n)), list(zip(text[hit].tolist(), lo[hit].tolist(), hi[hit].tolist(), strict=True))


def score_toxicity(docs: DataFrame, weights: np.ndarray | None, threshold: float = 0.5, keep_row: bool = False) -> DataFrame:
    """``doc_id, score, predicted, sentences`` of every row of ``docs`` (``doc_id, text``).

    ``score`` is the noisy-or over the whole text, ``predicted`` 1 if it reaches 0.5,
    ``sentences`` the sentences whose own score reaches ``threshold``. A text without
    a word (null, empty) scores 0, and so does every text when nothing was learned
    (``weights`` None). Repeated rows give a row each; an empty table gives no rows.
    With ``keep_row`` the columns of ``docs`` come first, unchanged, as ``_row``."""
    fields = "doc_id long, score double, predicted int, sentences array<string>"
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]) if keep_row else F.lit(None).cast("struct<a:int>")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), *([row.alias("_row")] if keep_row else []))
    schema = fields + (f", _row {source.schema['_row'].dataType.simpleString()}" if keep_row else "")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            for a, b in row_blocks(offsets):
                base, at = offsets[a], offsets[a: b + 1] - offsets[a]
                part = data[base: offsets[b]]
                if weights is None:
                    scores, hits = np.zeros(b - a), []
                else:
                    scores, hits = _scored(part, at, weights, threshold)
                found: list[list[str]] = [[] for _ in range(b - a)]
                for i, lo, hi in hits:
                    found[i].append(bytes(part[lo:hi]).decode("utf-8", "replace").strip())
                columns = [batch.column(0).slice(a, b - a), pa.array(np.clip(scores, 0, 1)), pa.array((scores >= 0.5).astype(np.int32)), pa.array(found, pa.list_(pa.string()))]
                names = ["doc_id", "score", "predicted", "sentences"]
                if keep_row:
                    columns.append(batch.column(2).slice(a, b - a))
                    names.append("_row")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return source.mapInArrow(score, schema)
