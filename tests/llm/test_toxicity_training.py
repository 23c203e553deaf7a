"""Training of toxicity: whole texts of any length, repeated and missing ids, order of rows."""

import random

import numpy as np
from pyspark.sql import functions as F

from relsift.llm import toxicity

SCHEMA = "doc_id long, text string, y int, toxic int"


def rows_of(spark, texts, ids=None):
    return spark.createDataFrame([(ids[i] if ids else i, t, 7, 7) for i, t in enumerate(texts)], SCHEMA)


def test_kept_sentences_by_hand():
    place = np.full(10, -1, np.int32)
    place[[3, 5, 8]] = [0, 1, 2]
    slots = np.array([5, 3, 1, 1, 2, 3, 9, 5, 8, 0])  # sentences: 5 3 1 | 1 2 | 3 9 5 | 8 | 0
    at, sizes, times = toxicity.kept_sentences(slots, np.array([0, 3, 5, 8, 9, 10]), place)
    assert at.tolist() == [0, 1, 2] and sizes.tolist() == [2, 1, 0] and times.tolist() == [2, 1, 2]
    at, sizes, times = toxicity.kept_sentences(np.array([1, 2]), np.array([0, 2]), place)
    assert at.tolist() == [] and sizes.tolist() == [0] and times.tolist() == [1]


def test_long_texts_teach(spark):
    """The foul words stand only in texts of over 60,000 words, at their ends; texts as long without them are clean."""
    rng = random.Random(3)
    calm = [" ".join(f"w{rng.randrange(40)}" for _ in range(30)) + "." for _ in range(200)]
    long = ["calm day. " * 30_000 + f"w{i}." for i in range(30)]
    docs = rows_of(spark, calm + long + [t + " you vile oaf." for t in long])
    labels = spark.createDataFrame([(i, int(i >= 230)) for i in range(260)], "doc_id long, toxic int")
    w = toxicity.train(docs, labels)
    odd = rows_of(spark, ["w1 w2. you vile oaf.", "w1 w2 w3."])
    assert {r["doc_id"]: r["predicted"] for r in toxicity.score_toxicity(odd, w).collect()} == {0: 1, 1: 0}


def test_repeated_and_missing_ids_and_order_of_rows(spark):
    rng = random.Random(4)
    calm = [" ".join(f"w{rng.randrange(40)}" for _ in range(20)) for _ in range(200)]
    texts = calm + [c + ". you vile oaf" for c in calm[:60]]
    labels = spark.createDataFrame([(i, int(i >= 200)) for i in range(260)], "doc_id long, toxic int")
    docs = rows_of(spark, texts)
    w = toxicity.train(docs, labels)
    copies = rows_of(spark, [texts[0]] * 500 + ["zzz you vile oaf"] * 500, ids=[0] * 500 + [None] * 500)
    assert (toxicity.train(docs.repartition(7).unionByName(copies), labels) == w).all()
    twice = labels.union(labels.where("toxic = 1")).union(labels.where("toxic = 1").select("doc_id", F.lit(0)))
    assert (toxicity.train(docs, twice) == w).all()
    empty = rows_of(spark, [None, "", "..."], ids=[0, 201, 202])
    assert toxicity.train(empty, labels) is None
