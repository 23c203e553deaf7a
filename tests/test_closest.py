"""Closest words by probes: the same rows as the form that reads the whole pair table."""

import random

from pyspark.sql import functions as F

from relsift.operators import corpus as C

SCHEMA = "doc string, text string"


def both(spark, corpus, probes, limit, min_count, min_len=2):
    p = spark.createDataFrame([(w,) for w in probes], "word string")
    vocab, pairs = C.cooccurrence_pruned(corpus, min_count, min_len)
    whole = C.closest_words(p, pairs, vocab, C.corpus_size(corpus), limit)
    asked = C.closest_words_of(p, corpus, limit, min_count, min_len)
    order = ["word", "partner", "n", "co_rank", "distance", "dist_rank"]
    rows = lambda df: sorted((*r[:4], None if r[4] is None else round(r[4], 9), r[5]) for r in df.select(order).collect())
    return rows(whole), rows(asked)


def test_probes_equal_the_pair_table(spark):
    rnd = random.Random(5)
    # frequencies from one to a few hundred, so that several bands are read
    words = [f"w{i:02d}" for i in range(60)] + ["x"]
    texts = [" ".join(w for i, w in enumerate(words) if rnd.random() < 1.3 / (1 + i % 30)) for _ in range(400)]
    corpus = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], SCHEMA)
    for limit, least in ((3, 2), (1, 1), (50, 5)):
        whole, asked = both(spark, corpus, [*words, "unknown", "", None], limit, least)
        assert whole and asked == whole


def test_probe_that_is_never_the_larger_word(spark):
    # "aa" has partners but none smaller, so it is in the first column only
    corpus = spark.createDataFrame([(str(i), "aa bb cc") for i in range(30)] + [("x", "dd")], SCHEMA)
    whole, asked = both(spark, corpus, ["aa", "bb", "cc", "dd"], 2, 5)
    assert asked == whole and {r[0] for r in asked} == {"bb", "cc"}


def test_ties_at_the_bound_of_the_next_band(spark):
    # partner "ab" of the lower band is as frequent with the probe as the k-th of the first
    rows = [("zz mm" + (" ab" if i < 15 else "") + (" nn" if i < 15 else " oo")) for i in range(40)] + ["nn"] * 30
    corpus = spark.createDataFrame([(str(i), t) for i, t in enumerate(rows)], SCHEMA)
    whole, asked = both(spark, corpus, ["zz"], 3, 2)
    assert asked == whole


def test_empty_corpus_and_rare_words(spark):
    corpus = spark.createDataFrame([("1", "aa bb")], SCHEMA)
    for c in (corpus, corpus.limit(0)):
        assert both(spark, c, ["aa"], 3, 2) == ([], [])


def test_a_word_in_every_long_text(spark):
    corpus = spark.createDataFrame(
        [(str(i), "zhot " + " ".join(f"v{j:04d}" for j in range(i % 7, 2000, 7))) for i in range(50)], SCHEMA)
    whole, asked = both(spark, corpus.withColumn("n", F.lit(1)).withColumn("word", F.lit("clash")), ["zhot", "v0007"], 4, 5)
    assert asked == whole and len(asked) == 8


def test_documents_go_through_the_shuffles_as_numbers(spark, monkeypatch):
    seen, store = [], C.materialize
    monkeypatch.setattr(C, "materialize", lambda df, *folders: (seen.append(df.schema), store(df, *folders))[1])
    corpus = spark.createDataFrame([(f"{i:032d}", "aa bb cc") for i in range(30)], SCHEMA)
    assert C.closest_words_of(spark.createDataFrame([("bb",)], "word string"), corpus, 2, 5).count() == 2
    kinds = {s["doc"].dataType.simpleString() for s in seen if "doc" in s.names}
    assert kinds == {"bigint"}


def test_corpus_reads_its_rows_once(spark):
    rel = spark.createDataFrame([("t", "d"), ("t", None), ("d", "e"), (None, None), ("", "t")], "product_title string, product_description string")
    corpus = C.corpus_a(rel)
    assert sorted(r.text for r in corpus.collect()) == ["", "d", "e", "t"]
    assert "Union" not in corpus._jdf.queryExecution().optimizedPlan().toString()
