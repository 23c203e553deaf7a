"""QWK, folds and confusion tables."""

import random

import numpy as np
from pyspark.sql import functions as F

from relsift.operators import evaluate as EV


def _qwk_matrix(a, b):
    lo, hi = min(a + b), max(a + b)
    k = hi - lo + 1
    o = np.zeros((k, k))
    for x, y in zip(a, b):
        o[x - lo, y - lo] += 1
    ha, hb = o.sum(1), o.sum(0)
    n = len(a)
    w = np.array([[(i - j) ** 2 / (k - 1) ** 2 for j in range(k)] for i in range(k)])
    return 1 - (w * o).sum() / (w * np.outer(ha, hb) / n).sum()


def test_qwk_moments_equal_matrix(spark):
    rnd = random.Random(7)
    a = [rnd.randint(1, 4) for _ in range(300)]
    b = [min(4, max(1, x + rnd.choice([-1, 0, 0, 1]))) for x in a]
    df = spark.createDataFrame(list(zip(range(300), a, b)), "id long, median_relevance int, prediction int")
    got = EV.qwk(df).first()["qwk"]
    assert abs(got - _qwk_matrix(a, b)) < 1e-12


def test_qwk_perfect_and_degenerate(spark):
    df = spark.createDataFrame([(i, i % 4 + 1, i % 4 + 1) for i in range(20)], "id long, median_relevance int, prediction int")
    assert abs(EV.qwk(df).first()["qwk"] - 1.0) < 1e-12
    one = spark.createDataFrame([(i, 3, 3) for i in range(5)], "id long, median_relevance int, prediction int")
    assert EV.qwk(one).first()["qwk"] is None


def test_folds_stratified(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice([1, 2, 3, 4, 4, 4])) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, median_relevance int")
    f = EV.stratified_folds(df, k=10, seed=1).toPandas()
    assert f["id"].is_unique and len(f) == 500
    counts = f.groupby(["median_relevance", "fold"]).size().unstack(fill_value=0)
    assert (counts.max(axis=1) - counts.min(axis=1)).max() <= 1


def test_confusion_rows_match_histogram(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.randint(1, 4), rnd.randint(2, 3)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, median_relevance int, prediction int")
    cm = EV.confusion_matrix(df).groupBy("a").agg(F.sum("n").alias("n")).orderBy("a").collect()
    h = EV.rating_histogram(df).orderBy("rating").collect()
    assert [r["n"] for r in cm] == [r["n"] for r in h]
