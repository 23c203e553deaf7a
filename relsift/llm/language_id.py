"""Language identification in two steps: family, then language within the family.

Features are byte trigrams of the whole lower-cased text, hashed into ``DIM``
counts, square-rooted and scaled to length 1. A linear one-versus-rest support
vector machine picks the language family; inside a family, one-versus-one linear
machines vote on the language. All machines minimise the squared hinge with an L2
penalty by accelerated gradient steps.

They are fitted on a bounded sample of labelled rows (``sample_rows``, shared evenly
by the languages, chosen by a hash of ``doc_id``); every row is scored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .kernels import LOWER, column_bytes, row_blocks

DIM = 4096
SAMPLE_ROWS = 6_000
UNDETERMINED = "und"

# Language families by ISO 639-1 code; another code is a family of its own.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sh sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "uralic": "et fi hu",
    "turkic": "az kk ky tk tr tt ug uz",
    "indic": "as bn gu hi mr ne or pa si ur",
    "dravidian": "kn ml ta te",
    "semitic": "am ar he mt",
    "sinitic": "zh yue wuu",
    "malayo": "id jv ms su tl",
}
_FAMILY_OF = {code: name for name, codes in FAMILIES.items() for code in codes.split()}


def family_of(lang: str) -> str:
    return _FAMILY_OF.get(lang.lower().replace("_", "-").split("-")[0], lang)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A unit row of hashed trigram weights for each text; zero for fewer than 3 bytes."""
    rows = len(offsets) - 1
    low = LOWER[data].astype(np.uint32)
    if len(low) < 3:
        return np.zeros((rows, DIM), np.float32)
    gram = low[:-2] | low[1:-1] << np.uint32(8) | low[2:] << np.uint32(16)
    slot = (gram * np.uint32(2654435761)) >> np.uint32(32 - DIM.bit_length() + 1)
    row = np.repeat(np.arange(rows), np.diff(offsets))
    inside = row[:-2] == row[2:]
    counts = np.bincount((row[:-2] * DIM + slot)[inside], minlength=rows * DIM).reshape(rows, DIM)
    x = np.sqrt(counts, dtype=np.float32)
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.maximum(norm, 1e-12)


def fit_machine(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, steps: int = 150) -> np.ndarray:
    """Weights and bias (last) of a linear machine with squared hinge; ``y`` is -1 or 1.
    Both classes weigh the same in total."""
    n, d = x.shape
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = np.zeros(d + 1, np.float32)
    ahead, t = w.copy(), 1.0
    rate = 1.0 / (2 * 2.0 + penalty)  # rows have length 1 and a bias of 1
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (x @ ahead[:-1] + ahead[-1])) * share * y
        grad = np.append(-2 * (slack @ x) + penalty * ahead[:-1], -2 * slack.sum()).astype(np.float32)
        new = ahead - rate * grad
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = new + np.float32((t - 1) / t_new) * (new - w)
        w, t = new, t_new
    return w


@dataclass
class LanguageModel:
    families: list[str]
    family_machines: np.ndarray  # one row each; empty for a single family
    members: dict[str, list[str]]
    pair_machines: dict[str, np.ndarray]  # rows by pair (i, j), i < j: positive means i

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score (0 to 1) of each feature row."""
        n = len(x)
        if not self.families:
            return [UNDETERMINED] * n, np.zeros(n)
        if len(self.families) > 1:
            margin = x @ self.family_machines[:, :-1].T + self.family_machines[:, -1]
            which = margin.argmax(1)
            score = _sigmoid(np.partition(margin, -1, axis=1)[:, -1])
        else:
            which, score = np.zeros(n, int), np.ones(n)
        out = np.empty(n, object)
        for f, name in enumerate(self.families):
            rows, langs = np.flatnonzero(which == f), self.members[name]
            if len(langs) == 1:
                out[rows] = langs[0]
            elif len(rows):
                machines = self.pair_machines[name]
                margin = x[rows] @ machines[:, :-1].T + machines[:, -1]
                votes, least = np.zeros((len(rows), len(langs))), np.full((len(rows), len(langs)), np.inf)
                for p, (i, j) in enumerate(_pairs(len(langs))):
                    m = margin[:, p]
                    votes[:, i] += m > 0
                    votes[:, j] += m <= 0
                    least[:, i] = np.minimum(least[:, i], m)
                    least[:, j] = np.minimum(least[:, j], -m)
                best = (votes + 0.5 * np.tanh(least) / len(langs)).argmax(1)
                out[rows] = np.array(langs, object)[best]
                score[rows] *= _sigmoid(least[np.arange(len(rows)), best])
        return out.tolist(), score


def _sigmoid(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-4.0 * np.clip(margin.astype(np.float64), -20, 20)))


def _pairs(n: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(n) for j in range(i + 1, n)]


def fit_model(x: np.ndarray, langs: np.ndarray) -> LanguageModel:
    members: dict[str, list[str]] = {}
    for lang in sorted(set(langs.tolist())):
        members.setdefault(family_of(lang), []).append(lang)
    names = sorted(members)
    family = np.array([family_of(a) for a in langs.tolist()], object)
    sign = lambda hit: np.where(hit, 1, -1).astype(np.float32)
    top = np.array([fit_machine(x, sign(family == f)) for f in names]) if len(names) > 1 else np.zeros((0, DIM + 1))
    pairs = {}
    for f in names:
        machines = []
        for i, j in _pairs(len(members[f])):
            a, b = members[f][i], members[f][j]
            rows = (langs == a) | (langs == b)
            machines.append(fit_machine(x[rows], sign(langs[rows] == a)))
        if machines:
            pairs[f] = np.array(machines)
    return LanguageModel(names, top, members, pairs)


def train(docs: DataFrame, usable: Column, sample_rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Fit on at most ``max(20, sample_rows // languages)`` distinct texts a language, of
    rows where ``usable`` holds and ``lang`` and ``text`` are not null; the sample's
    features reach one task, the weights the driver.

    The draw goes by the text: it needs no id, copies of a text are one example, and a
    rank per language bounds it whatever repeats. An empty table gives a model that
    knows no language."""
    rows = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        "lang", "text", F.xxhash64("text", F.lit("lang-sample")).alias("_draw"))
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("_draw").alias("_n"))
    langs = {r["lang"]: r["_n"] for r in counts.collect()}  # one row per language
    if not langs:
        return LanguageModel([], np.zeros((0, DIM + 1)), {}, {})
    each = max(20, sample_rows // len(langs))
    # a quarter more than wanted, as the counts are estimates; the rank takes the rest off
    share = F.create_map(*[F.lit(v) for a, n in langs.items() for v in (a, min(1.0, 1.25 * each / max(1, n)))])
    unit = F.pmod(F.col("_draw"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = rows.where(unit < share[F.col("lang")]).groupBy("lang", "_draw").agg(F.min("text").alias("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod(F.col("_draw"), F.lit(1 << 30)), "_draw"))
    sample = drawn.withColumn("_rank", rank).where(F.col("_rank") <= each)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            for lo, hi in row_blocks(offsets, most_rows=256):
                x = features(data[offsets[lo]: offsets[hi]], offsets[lo: hi + 1] - offsets[lo]).astype(np.float16)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([v.tobytes() for v in x], pa.binary())], names=["lang", "x"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, x = [], []
        for batch in batches:
            names += batch.column(0).to_pylist()
            x += [np.frombuffer(v, np.float16) for v in batch.column(1).to_pylist()]
        if names:
            parts = vars(fit_model(np.array(x, np.float32), np.array(names, object)))
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(parts)], pa.binary())], names=["model"])

    found = (sample.select("lang", "text").mapInArrow(extract, "lang string, x binary")
             .repartition(1).mapInArrow(fit, "model binary").collect())
    return LanguageModel(**pickle.loads(bytes(found[0]["model"]))) if found else LanguageModel([], np.zeros((0, DIM + 1)), {}, {})


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``doc_id, lang_pred, score`` of every row of ``docs`` (``doc_id, text``).

    Null texts and texts without a letter are ``und`` with score 0, as is every row
    when nothing was learned. Repeated rows give a row each; whole texts are read,
    block by block, whatever their length; an empty table gives no rows."""
    schema = "doc_id long, lang_pred string, score double"

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            known = np.array(batch.column(2).to_pylist(), bool)
            langs, scores = [], []
            for lo, hi in row_blocks(offsets, most_rows=512):
                a, s = model.predict(features(data[offsets[lo]: offsets[hi]], offsets[lo: hi + 1] - offsets[lo]))
                langs += a
                scores.append(s)
            if batch.num_rows:
                langs = [a if k else UNDETERMINED for a, k in zip(langs, known, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(np.where(known, np.concatenate(scores), 0.0))], names=["doc_id", "lang_pred", "score"])

    has_letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return docs.select(F.col("doc_id").cast("long"), "text", has_letter.alias("_letter")).mapInArrow(predict, schema)
