"""Approximate nearest neighbours: one hierarchical navigable small world per shard.

Equal vectors are one node that keeps its smallest ids (as many as a result can hold).
Nodes are dealt to shards by their length, in steps of ``LENGTH_RATIO``, and by a hash of
the vector. A shard's graph is stored as flat
neighbour arrays, one row of ``m`` (bottom layer: ``2 m``) node numbers for each node of
a layer, -1 where there are fewer. Largest inner product is turned into nearest
neighbour by one more component that gives all vectors of a shard one length (0 for a
query); as a shard's lengths are alike, it stays small against the others.

Layers are built from the top. A layer's nodes join in batches: each batch searches the
graph so far from where the layer above leads it, keeps neighbours that are nearer to
it than to a neighbour already kept, and is linked back, nodes with too many links
keeping theirs by the same rule. Searches run in step for a block of queries. Shard
results are scored on the original vectors in double precision and merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .vectors import best_per_query, dealt, matrix, pieces, usable_vectors

SHARD_ROWS = 8_192
BLOCK_ROWS = 4_096
#: Longest to shortest vector of a shard, at most.
LENGTH_RATIO = 1.25
LINKS = 16
EF_BUILD = 64
EF_SEARCH = 160
_STEP = 4  # beam members opened at once
_BATCH = 512


class Graph:
    """Flat neighbour arrays by layer over ``x`` (rows of one length)."""

    def __init__(self, x: np.ndarray, m: int = LINKS, seed: int = 1):
        self.x, self.m = np.ascontiguousarray(x, np.float32), m
        n = len(x)
        level = np.floor(-np.log(np.random.default_rng(seed).random(n)) / np.log(m)).astype(int) if n else np.zeros(0, int)
        self.members = [np.flatnonzero(level >= h) for h in range(int(level.max(initial=0)) + 1)]
        self.links: list[np.ndarray] = [None] * len(self.members)  # (n, width) with global node numbers

    def build(self, ef: int = EF_BUILD) -> Graph:
        above = np.empty(0, int)
        for h in range(len(self.members) - 1, -1, -1):
            fresh = np.setdiff1d(self.members[h], above)
            self._build_layer(h, above, fresh, ef)
            above = self.members[h]
        return self

    def _build_layer(self, h: int, above: np.ndarray, fresh: np.ndarray, ef: int) -> None:
        width = self.m * (2 if h == 0 else 1)
        links = np.full((len(self.x), width), -1, np.int32)
        self.links[h] = links
        order = np.concatenate([above, fresh])
        done = max(len(above), 1)
        for lo in range(0, done, _BATCH):  # the layer above, a small part, by brute force
            some = order[lo: min(lo + _BATCH, done)]
            near = self.x[some] @ self.x[order[:done]].T
            take = min(2 * self.m, done)
            self._join(links, some, order[np.argpartition(-near, take - 1, axis=1)[:, :take]])
        while done < len(order):
            batch = order[done: done + min(_BATCH, max(16, done))]
            start = self._descend(self.x[batch], h + 1, order[0])
            found, _ = self._beam(self.x[batch], h, start, ef)
            self._join(links, batch, found)
            done += len(batch)

    def _join(self, links: np.ndarray, batch: np.ndarray, found: np.ndarray) -> None:
        """Link new nodes to what they found and to one another, and back."""
        if len(batch) < 2 and not found.size:
            return
        near = self.x[batch] @ self.x[batch].T
        np.fill_diagonal(near, -np.inf)
        take = min(self.m, len(batch) - 1)
        own = batch[np.argpartition(-near, take - 1, axis=1)[:, :take]] if take else np.empty((len(batch), 0), int)
        kept = self._choose(batch, np.concatenate([found, own], axis=1), self.m)
        links[batch, : kept.shape[1]] = kept
        src = np.repeat(batch, kept.shape[1])
        dst = kept.ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        near = np.einsum("ij,ij->i", self.x[src], self.x[dst])
        order = np.lexsort((-near, dst))
        src, dst = src[order], dst[order]
        place = np.arange(len(dst)) - np.searchsorted(dst, dst)
        width = links.shape[1]
        fits = place < 2 * width  # nearest first; a hub's farther links would be dropped below anyway
        nodes, row = np.unique(dst[fits], return_inverse=True)
        back = np.full((len(nodes), int(place[fits].max(initial=-1)) + 1), -1)
        back[row, place[fits]] = src[fits]
        for lo in range(0, len(nodes), 256):
            some = nodes[lo: lo + 256]
            both = np.concatenate([links[some], back[lo: lo + 256]], axis=1)
            few = (both >= 0).sum(1) <= width
            # still room: append; else choose again
            ordered = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), axis=1)[:, :width]
            links[some[few]] = ordered[few]
            if (~few).any():
                chosen = self._choose(some[~few], both[~few], width)
                links[some[~few]] = -1
                links[some[~few], : chosen.shape[1]] = chosen

    def _choose(self, nodes: np.ndarray, options: np.ndarray, most: int) -> np.ndarray:
        """Up to ``most`` options per node, nearest first, each nearer to the node than to
        one kept before; free places go to the nearest of the rest."""
        if not options.shape[1]:
            return np.empty((len(nodes), 0), np.int32)
        out = np.full((len(nodes), most), -1, np.int32)
        for lo in range(0, len(nodes), 128):
            ids, own = options[lo: lo + 128], nodes[lo: lo + 128]
            bad = (ids < 0) | (ids == own[:, None])
            vec = self.x[np.where(bad, 0, ids)]
            near = np.einsum("bcd,bd->bc", vec, self.x[own])
            near[bad] = -np.inf
            order = np.argsort(-near, axis=1, kind="stable")[:, : 4 * most]
            ids, near = np.take_along_axis(ids, order, 1), np.take_along_axis(near, order, 1)
            vec = np.take_along_axis(vec, order[:, :, None], 1)
            between = np.einsum("bcd,bed->bce", vec, vec)
            c = ids.shape[1]
            usable = near > -np.inf
            for j in range(1, c):  # an option that stands there already
                usable[:, j] &= ~(ids[:, :j] == ids[:, j: j + 1]).any(1)
            kept = np.zeros_like(usable)
            closest = np.full(near.shape, -np.inf)  # to any kept option
            count = np.zeros(len(own), int)
            for j in range(c):
                take = usable[:, j] & (near[:, j] > closest[:, j]) & (count < most)
                kept[:, j] = take
                count += take
                closest = np.where(take[:, None], np.maximum(closest, between[:, j]), closest)
            rank = np.where(kept, 0, np.where(usable, 1, 2)) * c + np.arange(c)
            final = np.argsort(rank, axis=1)[:, :most]
            good = np.take_along_axis(usable, final, 1)
            chosen = np.where(good, np.take_along_axis(ids, final, 1), -1)
            out[lo: lo + 128, : chosen.shape[1]] = chosen
        return out

    def _descend(self, q: np.ndarray, to: int, first: int) -> np.ndarray:
        """The node that the layers down to ``to`` lead each query to."""
        at = np.full(len(q), self.members[-1][0] if to < len(self.links) else first)
        for h in range(len(self.links) - 1, to - 1, -1):
            found, _ = self._beam(q, h, at, 1)
            at = found[:, 0]
        return at

    def _beam(self, q: np.ndarray, h: int, start: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``ef`` best nodes found for each query, best first (-1: none)."""
        links, n, rows = self.links[h], len(self.x), len(q)
        seen = np.zeros(rows * n, bool)
        ids = np.full((rows, ef), -1, np.int64)
        near = np.full((rows, ef), -np.inf, np.float32)
        opened = np.ones((rows, ef), bool)
        ids[:, 0], near[:, 0], opened[:, 0] = start, np.einsum("ij,ij->i", q, self.x[start]), False
        seen[np.arange(rows) * n + start] = True
        step = min(_STEP, ef)
        while True:
            waiting = np.where(opened, -np.inf, near)
            pick = np.argpartition(-waiting, step - 1, axis=1)[:, :step] if step < ef else np.tile(np.arange(ef), (rows, 1))
            good = np.take_along_axis(waiting, pick, 1) > -np.inf
            r, c = np.nonzero(good)
            if not len(r):
                break
            slot = pick[r, c]
            opened[r, slot] = True
            next_ids = links[ids[r, slot]]
            flat = (r[:, None] * n + next_ids)[next_ids >= 0]
            flat = np.unique(flat[~seen[flat]])
            if not len(flat):
                continue
            seen[flat] = True
            row, node = flat // n, flat % n
            value = np.einsum("ij,ij->i", q[row], self.x[node])
            better = value > near[row, -1] if ef == 1 else value > near.min(1)[row]
            row, node, value = row[better], node[better], value[better]
            if not len(row):
                continue
            place = np.arange(len(row)) - np.searchsorted(row, row)
            width = int(place.max()) + 1
            new_ids, new_near = np.full((rows, width), -1, np.int64), np.full((rows, width), -np.inf, np.float32)
            new_ids[row, place], new_near[row, place] = node, value
            ids, near = np.concatenate([ids, new_ids], 1), np.concatenate([near, new_near], 1)
            opened = np.concatenate([opened, new_near == -np.inf], 1)
            top = np.argpartition(-near, ef - 1, axis=1)[:, :ef]
            ids, near, opened = (np.take_along_axis(a, top, 1) for a in (ids, near, opened))
        order = np.argsort(-near, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(near, order, 1)

    def search(self, q: np.ndarray, ef: int = EF_SEARCH) -> np.ndarray:
        """Nodes found for each query, best first, -1 where there are fewer."""
        if not len(self.x) or not len(q):
            return np.empty((len(q), 0), int)
        q = np.ascontiguousarray(q, np.float32)
        parts = []
        for lo in range(0, len(q), _BATCH):
            some = q[lo: lo + _BATCH]
            parts.append(self._beam(some, 0, self._descend(some, 1, self.members[-1][0]), ef)[0])
        return np.concatenate(parts)


def same_length(v: np.ndarray) -> np.ndarray:
    """``v`` with one more component that gives every row the length of the longest."""
    sq = (v * v).sum(1)
    return np.concatenate([v, np.sqrt(np.maximum(sq.max(initial=0) - sq, 0))[:, None]], axis=1)


def nodes_of(vectors: DataFrame, k: int) -> DataFrame:
    """``dim, v, ids, step``: distinct non-zero vectors with their ``k + 1`` smallest ids,
    which are all that a result of k can hold, and the step of their length in powers of
    ``LENGTH_RATIO``. The rank filter runs before the shuffle."""
    rows = usable_vectors(vectors).where(F.exists("v", lambda x: x != 0))
    w = Window.partitionBy("v").orderBy("id")
    few = rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k + 1)
    nodes = few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    nodes = nodes.withColumn("_most", F.array_max(F.transform("v", F.abs)))  # a column of its own, or each component finds it anew
    parts = F.aggregate("v", F.lit(0.0), lambda total, x: total + (x / F.col("_most")) * (x / F.col("_most")))
    step = F.floor((F.log("_most") + F.log(parts) / 2) / float(np.log(LENGTH_RATIO)) + 0.5)
    return nodes.select(F.size("v").alias("dim"), "v", "ids", step.alias("step"))


def in_shards(nodes: DataFrame, shard_rows: int) -> tuple[DataFrame, int]:
    """``nodes`` with their ``shard``, and the number of shards. A step of lengths has a
    shard for each ``shard_rows`` nodes, about; the range of a double bounds the steps of a
    dimension (some 6,400)."""
    steps = nodes.groupBy("dim", "step").agg(F.ceil(F.count(F.lit(1)) / shard_rows).cast("int").alias("own"))
    steps = steps.withColumn("past", F.sum("own").over(Window.partitionBy("dim").orderBy("step")).cast("int") - F.col("own"))
    steps = written(steps, "hnsw-steps")
    shards = steps.agg(F.max(F.col("past") + F.col("own"))).first()[0] or 1
    put = nodes.join(steps, ["dim", "step"]).withColumn("shard", F.col("past") + F.pmod(F.xxhash64("v"), F.col("own")).cast("int"))
    return put.select("dim", "shard", "v", "ids"), shards


def build_index(nodes: DataFrame) -> DataFrame:
    """One row per (dimension, shard): vectors, ids and the graph's flat neighbour arrays."""
    schema = ("dim int, shard int, n int, vectors binary, id_first array<int>, ids array<long>, "
              "members array<array<int>>, links array<binary>")

    def build(key, t):
        v = matrix(t["v"], t.num_rows)
        lists = t["ids"].to_pylist()
        order = np.argsort([a[0] for a in lists], kind="stable")
        v, lists = v[order], [lists[i] for i in order]
        g = Graph(same_length(v)).build()
        first = np.append(0, np.cumsum([len(a) for a in lists]))
        return pa.table([
            pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), pa.array([len(v)], pa.int32()),
            pa.array([v.tobytes()], pa.binary()), pa.array([first.tolist()], pa.list_(pa.int32())),
            pa.array([[i for a in lists for i in a]], pa.list_(pa.int64())),
            pa.array([[m.tolist() for m in g.members]], pa.list_(pa.list_(pa.int32()))),
            pa.array([[a[m].tobytes() for a, m in zip(g.links, g.members, strict=True)]], pa.list_(pa.binary()))],
            names=["dim", "shard", "n", "vectors", "id_first", "ids", "members", "links"])

    return nodes.groupBy("dim", "shard").applyInArrow(build, schema)


def restored(row: dict) -> tuple[Graph, np.ndarray]:
    v = np.frombuffer(row["vectors"], np.float64).reshape(row["n"], -1)
    g = Graph(same_length(v))
    g.members = [np.array(m) for m in row["members"]]
    g.links = []
    for m, raw in zip(g.members, row["links"], strict=True):
        flat = np.frombuffer(raw, np.int32).reshape(len(m), -1)
        full = np.full((len(v), flat.shape[1]), -1, np.int32)
        full[m] = flat
        g.links.append(full)
    return g, v


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, ef: int = EF_SEARCH) -> DataFrame:
    """``query_id, rank, vec_id, score`` for each id where ``is_query`` (an expression of
    ``id``) holds: the k nearest found among all other ids, by inner product.

    Every row is indexed. Null, zero and non-finite vectors and null ids take no part;
    only vectors of a query's length are its candidates. A score is the double inner
    product of the original vectors, ties go to the smaller id. Empty tables give no
    rows. The beam is at least k + 1 wide, so a small shard is searched whole."""
    nodes = written(nodes_of(vectors, k), "hnsw-nodes")
    usable = usable_vectors(vectors).where(is_query).where(F.exists("v", lambda x: x != 0))
    asked = written(usable.select("id", F.size("v").alias("dim"), "v"), "hnsw-queries")
    placed, shards = in_shards(nodes, SHARD_ROWS)
    blocks = pieces(asked.count(), BLOCK_ROWS)
    index = written(build_index(placed), "hnsw-index")
    graphs = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    queries = dealt(asked, "block", blocks, "shard", shards, "id")
    beam = max(ef, k + 1)

    def search(key, left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        row = right.to_pylist()[0]
        g, v = restored(row)
        first, ids = np.array(row["id_first"]), np.array(row["ids"])
        q_ids, q = left["id"].to_numpy(), matrix(left["v"], left.num_rows)
        found = g.search(np.concatenate([q, np.zeros((len(q), 1))], axis=1), beam)[:, : 2 * k + 1]
        at, col = np.nonzero(found >= 0)
        node = found[at, col]
        score = np.concatenate([np.empty(0), *((q[at[lo: lo + 65536]] * v[node[lo: lo + 65536]]).sum(1) for lo in range(0, len(at), 65536))])
        size = first[node + 1] - first[node]
        take = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first[node], size)
        out_q, out_x, out_s = np.repeat(q_ids[at], size), ids[take], np.repeat(score, size)
        other = out_q != out_x
        out_q, out_x, out_s = out_q[other], out_x[other], out_s[other]
        order = np.lexsort((out_x, -out_s, out_q))
        out_q, out_x, out_s = out_q[order], out_x[order], out_s[order]
        top = np.arange(len(out_q)) - np.searchsorted(out_q, out_q) < k
        return pa.table([pa.array(out_q[top]), pa.array(out_x[top]), pa.array(out_s[top])], schema=schema)

    key = ["dim", "shard", "block"]
    found = queries.groupBy(*key).cogroup(graphs.groupBy(*key)).applyInArrow(search, "query_id long, vec_id long, score double")
    return best_per_query(found, k)
