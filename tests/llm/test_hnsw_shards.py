"""Recall through several shards and their merge, with even and uneven vector lengths."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from relsift.llm import hnsw


@pytest.mark.parametrize("spread", [0.0, 0.5])
def test_recall_of_several_shards(spark, monkeypatch, spread):
    monkeypatch.setattr(hnsw, "SHARD_ROWS", 900)
    rng = np.random.default_rng(11)
    v = rng.normal(size=(4000, 32))
    v *= np.exp(spread * rng.normal(size=4000))[:, None] / np.linalg.norm(v, axis=1)[:, None]
    df = spark.createDataFrame([(i, x, 0, 0.0) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<double>, step int, past double")
    nodes = hnsw.nodes_of(df, 20)
    placed, shards = hnsw.in_shards(nodes, 900)
    size = {r["shard"]: r["count"] for r in placed.groupBy("shard").count().collect()}
    assert shards >= 5 and sum(size.values()) == 4000 and max(size) < shards and max(size.values()) <= 1.2 * 900
    got = {}
    for r in hnsw.nearest(df, F.col("id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert len(got) == 200 and all(len(x) == 20 for x in got.values())
    hits = 0
    for q, found in got.items():
        score = v @ v[q]
        assert all(i != q and abs(score[i] - s) < 1e-9 for i, s in found)
        score[q] = -np.inf
        hits += len({i for i, _ in found} & set(np.argsort(-score)[:20].tolist()))
    assert hits / 4000 >= 0.95


def test_lengths_at_the_ends_of_a_double(spark):
    rows = [(0, [1e-300, 0.0], 0), (1, [1e-300, 1e-300], 0), (2, [3.0, 4.0], 0), (3, [0.0, 0.0], 0), (4, [1e150, 0.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, shard int")
    got = [(r["rank"], r["vec_id"]) for r in hnsw.nearest(df, F.col("id") == 2).collect()]
    assert sorted(got) == [(1, 4), (2, 1), (3, 0)]
