"""Exact top-k search by inner product with a pivot table.

Vectors are quantised to integers ``floor(scale * x)``. The table holds every
vector's Euclidean distance to a fixed set of pivots. For a query and a candidate the
triangle inequality gives, over all pivots, ``d >= max |d(q, p) - d(x, p)|``, and with
both lengths an upper bound of the inner product, ``(|q|^2 + |x|^2 - d^2) / 2``. A
query's candidates are evaluated in the order of that bound until the next bound lies
under the k-th best score: what is left cannot enter the result.

Queries and candidates meet in (shard, query block) pairs of bounded size; each gives
k rows per query, and the best k of those are the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .vectors import best_per_query, dealt, matrix, pieces, usable_vectors

SCALE = 256.0
PIVOTS = 32
#: Vectors among which the pivots are chosen.
PIVOT_SAMPLE = 512
SHARD_ROWS = 8_192
BLOCK_ROWS = 4_096
_EXACT = float(1 << 53)


def choose_pivots(sample: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """Farthest-first choice: each next pivot is the sample vector farthest from those chosen."""
    chosen = [0]
    gap = ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(count, len(sample)) and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.stack([((x - p) ** 2).sum(1) for p in pivots], axis=1)) if len(pivots) else np.zeros((len(x), 0))


def pivot_table(vectors: DataFrame, scale: float = SCALE, pivots: int = PIVOTS) -> DataFrame:
    """``id, dim, v`` (integers as long array) and ``d`` (distances to the pivots of that
    dimension) of each usable vector. The pivots come from a bounded sample by hash of id."""
    ints = usable_vectors(vectors).select("id", F.size("v").alias("dim"), F.transform("v", lambda x: F.floor(F.lit(scale) * x)).alias("v"))
    ints = written(ints, "pivot-vectors")
    sample: dict[int, list] = {}
    for r in ints.orderBy(F.xxhash64("id"), "id").limit(PIVOT_SAMPLE).collect():
        sample.setdefault(r["dim"], []).append(r["v"])
    chosen = {dim: choose_pivots(np.array(v, np.float64).reshape(len(v), dim), pivots) for dim, v in sample.items()}

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2).to_pylist()
            d = [np.empty(0)] * len(lists)
            for dim in set(map(len, lists)):
                rows = [i for i, v in enumerate(lists) if len(v) == dim]
                for i, row in zip(rows, distances(np.array([lists[i] for i in rows], np.float64), chosen.get(dim, ())), strict=True):
                    d[i] = row
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(d, pa.list_(pa.float64()))], names=["id", "dim", "v", "d"])

    return ints.mapInArrow(measure, "id long, dim int, v array<long>, d array<double>")


def search_block(q_ids, q, q_dist, ids, x, x_dist, k: int):
    """Top-k of every query among the candidates: (query position, candidate position, score)."""
    largest = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    exact = largest < _EXACT  # doubles hold every product and sum
    qf, xf = q.astype(np.float64), x.astype(np.float64)
    q_len, x_len = (qf * qf).sum(1), (xf * xf).sum(1)
    out_q, out_x, out_s = [], [], []
    for lo in range(0, len(q_ids), 64):
        hi = min(lo + 64, len(q_ids))
        low = np.zeros((hi - lo, len(ids)))
        for p in range(q_dist.shape[1]):
            np.maximum(low, np.abs(q_dist[lo:hi, p, None] - x_dist[None, :, p]), out=low)
        total = q_len[lo:hi, None] + x_len[None, :]
        bound = (total * (1 + 1e-9) - low * low * (1 - 1e-9)) / 2 + 1e-6
        bound[q_ids[lo:hi, None] == ids[None, :]] = -np.inf
        for i in range(lo, hi):
            row = bound[i - lo]
            order = np.argsort(-row, kind="stable")
            order = order[: int((row > -np.inf).sum())]
            best_x, best_s = np.empty(0, np.int64), np.empty(0, np.float64 if exact else object)
            at, step = 0, 8 * k
            while at < len(order) and not (len(best_s) == k and row[order[at]] < best_s[-1]):
                part = order[at: at + step]
                score = xf[part] @ qf[i] if exact else (x[part].astype(object) * q[i].astype(object)).sum(1)
                best_x, best_s = np.append(best_x, part), np.append(best_s, score)
                keep = np.lexsort((ids[best_x], -best_s)) if exact else np.array(sorted(range(len(best_x)), key=lambda j: (-best_s[j], ids[best_x[j]])))
                best_x, best_s = best_x[keep[:k]], best_s[keep[:k]]
                at, step = at + step, step * 2
            out_q.append(np.full(len(best_x), i))
            out_x.append(best_x)
            out_s.append(best_s)
    return np.concatenate(out_q), np.concatenate(out_x), np.concatenate(out_s)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = SCALE) -> DataFrame:
    """``query_id, rank, vec_id, score`` for each row where ``is_query`` (an expression of
    ``id``) holds, against every other id with a vector of the same length.

    Vectors that are null or hold a null or non-finite component take no part, nor do
    null ids. Equal scores go to the smaller id. Components beyond the range of a long
    saturate, as does a score. A query without candidates gives no row; an empty table
    gives none."""
    table = written(pivot_table(vectors, scale), "pivot-table")
    rows, queries = table.agg(F.count(F.lit(1)), F.count(F.when(is_query, 1))).first()
    shards, blocks = pieces(rows, SHARD_ROWS), pieces(queries, BLOCK_ROWS)
    candidates = dealt(table, "shard", shards, "block", blocks, "id")
    asked = dealt(table.where(is_query), "block", blocks, "shard", shards, "id").select(*candidates.columns)

    def search(key, left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        q_ids, ids = left["id"].to_numpy(), right["id"].to_numpy()
        parts = [matrix(t[c], t.num_rows, kind) for t in (left, right) for c, kind in (("v", np.int64), ("d", np.float64))]
        at, hit, score = search_block(q_ids, parts[0], parts[1], ids, parts[2], parts[3], k)
        whole = [max(-(1 << 63), min((1 << 63) - 1, int(s))) for s in score]
        return pa.table([pa.array(q_ids[at]), pa.array(ids[hit]), pa.array(whole, pa.int64())], schema=schema)

    key = ["dim", "shard", "block"]
    found = asked.groupBy(*key).cogroup(candidates.groupBy(*key)).applyInArrow(search, "query_id long, vec_id long, score long")
    return best_per_query(found, k)
