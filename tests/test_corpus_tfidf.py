"""Toy corpora: document frequency, pairs, distances, term counts, TF-IDF."""

import math
from collections import Counter

from pyspark.sql import functions as F

from relsift.operators import corpus as C
from relsift.operators import tfidf as TF
from relsift.functions import text as T

TOY_TRAIN = ["a large dog", "a dog house", "a small cat", "a small dog", "a furry cat", "dog bites cat"]


def _corpus(spark, docs):
    return spark.createDataFrame([(d,) for d in docs], "text string").select(F.md5("text").alias("doc"), "text")


def test_df_and_pairs(spark):
    corp = _corpus(spark, TOY_TRAIN)
    dfc = {r["word"]: r["n"] for r in C.word_document_frequency(corp).collect()}
    assert dfc["a"] == 5 and dfc["dog"] == 4 and dfc["cat"] == 3
    pairs = {(r["word1"], r["word2"]): r["n"] for r in C.word_cooccurrence(corp).collect()}
    assert pairs[("a", "dog")] == 3 and pairs[("cat", "dog")] == 1
    for (w1, w2), n in pairs.items():
        assert w1 < w2 and n <= min(dfc[w1], dfc[w2])


def test_distance_edge_cases(spark):
    corp = _corpus(spark, ["x y", "x y z", "x y w"])
    dfc = C.word_document_frequency(corp)
    d = {(r["word1"], r["word2"]): r["distance"]
         for r in C.normalized_distance(C.word_cooccurrence(corp), dfc, C.corpus_size(corp)).collect()}
    assert d[("x", "y")] is None  # both words in every document: 0/0
    rel = spark.createDataFrame([(1, "x", "x"), (2, "x", "y z")], "id long, query string, product_title string")
    pd = {r["id"]: r["distance"] for r in C.phrase_distance(rel, corp).collect()}
    assert pd[1] == float("inf")  # a word with itself has no pair
    expected = (math.log(3) - math.log(1)) / (math.log(3) - math.log(1))  # x-z: n1=3, n2=1, n12=1
    assert abs(pd[2] - expected) < 1e-12  # x-y is null (0/0) and skipped


def test_term_counts_match_counter(spark):
    docs = ["b a b c", "", "z z z", "a"]
    df = spark.createDataFrame(list(enumerate(docs)), "id long, s string")
    got = {(r["id"], r["term"]): r["tf"] for r in TF.term_counts(df, T.tokenize_nonempty("s")).collect()}
    exp = {(i, t): n for i, d in enumerate(docs) for t, n in Counter(d.split()).items()}
    assert got == exp


def test_tfidf_smooth_formula(spark):
    df = spark.createDataFrame(list(enumerate(TOY_TRAIN)), "id long, s string")
    w = {(r["id"], r["term"]): r["weight"]
         for r in TF.tfidf(df, df, lambda d: T.tokenize_nonempty("s"), idf="smooth").collect()}
    n = len(TOY_TRAIN)
    dfs = Counter(t for d in TOY_TRAIN for t in set(d.split()))
    for (i, t), v in w.items():
        tf = TOY_TRAIN[i].split().count(t)
        assert abs(v - tf * (math.log((1 + n) / (1 + dfs[t])) + 1)) < 1e-12


def test_tfidf_l2_norm(spark):
    df = spark.createDataFrame(list(enumerate(TOY_TRAIN)), "id long, s string")
    w = TF.tfidf(df, df, lambda d: T.tokenize_nonempty("s"), sublinear=True, norm="l2")
    norms = w.groupBy("id").agg(F.sqrt(F.sum(F.col("weight") ** 2)).alias("n")).collect()
    assert all(abs(r["n"] - 1) < 1e-12 for r in norms)


def test_char_wb_rows_equal_array_form(spark):
    docs = ["A dog  house ab", "x", "", "supercalifragilistic word"]
    df = spark.createDataFrame(list(enumerate(docs)), "id long, s string")
    rows = TF.count_terms(TF.char_wb_rows(df, F.col("s"), 2, 5))
    arr = TF.term_counts(df, T.char_wb_ngrams("s", 2, 5))
    key = lambda d: sorted(map(tuple, d.select("id", "term", "tf").collect()))
    assert key(rows) == key(arr)


def test_distances_non_negative_on_fixture(spark, sf_small):
    from relsift.plans.registry import srel
    corp = C.corpus_a(srel(spark, sf_small))
    dfc = C.word_document_frequency(corp)
    d = C.normalized_distance(C.word_cooccurrence(corp), dfc, C.corpus_size(corp))
    assert d.where(F.col("distance") < 0).count() == 0
    sym = C.word_cooccurrence(corp).where(F.col("word1") >= F.col("word2")).count()
    assert sym == 0


def test_block_pairs_equal_all_pairs_and_spread(spark, monkeypatch):
    """A long text's pairs come from many (document, block, block) keys and lose none."""
    from itertools import combinations
    from relsift.operators import corpus as C
    monkeypatch.setattr(C, "PAIR_BLOCK", 16)
    words = [f"w{i}" for i in range(150)]
    texts = [(0, " ".join(words)), (1, "w1 w2 w1"), (2, "solo"), (3, "")]
    corp = spark.createDataFrame(texts, "doc long, text string")
    got = {(r["word1"], r["word2"]): r["n"] for r in C.word_cooccurrence(corp).collect()}
    want = {}
    for _, t in texts:
        for a, b in combinations(sorted(set(t.split())), 2):
            want[a, b] = want.get((a, b), 0) + 1
    assert got == want
    blocks = -(-len(words) // C.PAIR_BLOCK)
    assert blocks * (blocks + 1) // 2 > 20  # keys that share the work of document 0


def test_pair_distance_of_absent_pairs(spark):
    from relsift.operators import corpus as C
    corp = spark.createDataFrame([(0, "a b"), (1, "a c"), (2, "b c"), (3, "d")], "doc long, text string")
    given = spark.createDataFrame([("b", "a"), ("a", "b"), ("a", "d"), ("a", "nowhere")], "w1 string, w2 string")
    got = {(r["word1"], r["word2"]): r["distance"] for r in C.pair_distance(given, corp).collect()}
    assert got["a", "d"] == got["a", "nowhere"] == float("inf")
    assert abs(got["a", "b"] - 1.0) < 1e-9 and len(got) == 3  # (ln 2 - ln 1) / (ln 4 - ln 2)


def test_quartiles_by_rank(spark):
    import numpy as np
    from relsift.operators import corpus as C
    rng = np.random.default_rng(0)
    values = [(i, float(v)) for i, v in enumerate(rng.random(41))] + [(100, float("inf")), (101, 0.5), (102, float("inf"))]
    dist = spark.createDataFrame(values, "id long, distance double")
    rel = spark.createDataFrame([(i, 1 if i < 41 else (2 if i < 102 else 3)) for i, _ in values], "id long, median_relevance int")
    got = {r["class"]: r for r in C.distance_by_class(dist, rel).collect()}
    v = [x for i, x in values if i < 41]
    assert [got[1][c] for c in ("q1", "median", "q3")] == [pytest_approx(np.quantile(v, q)) for q in (0.25, 0.5, 0.75)]
    assert got[2]["median"] == 0.5 and got[2]["n"] == 2 and got[2]["n_finite"] == 1
    assert got[3]["median"] is None and got[3]["n_finite"] == 0


def pytest_approx(x):
    import pytest
    return pytest.approx(x)


def test_pseudo_ids_follow_the_train_ids(spark):
    from relsift.operators import augment as AU
    pages = spark.createDataFrame([(1, "u", "<title>Q</title><li><a href=\"x\">skip</a></li><li><a href=\"x\">one</a></li><li><a href=\"x\">two</a></li>")],
                                  "page_id long, url string, html string")
    train = spark.createDataFrame([(AU.START_ID + 5, "q", "t", "d", 1, 0.0)],
                                  "id long, query string, product_title string, product_description string, median_relevance int, relevance_variance double")
    ids = [r["id"] for r in AU.augment_train(train, pages).select("id").collect()]
    assert sorted(ids) == [AU.START_ID + 5, AU.START_ID + 6, AU.START_ID + 7]
    assert AU.pseudo_label_rows(pages).agg({"id": "min"}).first()[0] == AU.START_ID


def test_given_pairs_are_counted_where_both_words_occur(spark, monkeypatch):
    texts = ["a b c d", "a b", "c d x", "hub a", "hub b", "hub c x", "hub hub d", "y", "a hub b"]
    corp = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc int, text string")
    words = ["a", "b", "c", "d", "x", "y", "nowhere"]
    pairs = [("hub", w) for w in words] + [(w, "hub") for w in words] + [("a", "b"), ("c", "b"), ("y", "x")]
    given = spark.createDataFrame(pairs, "w1 string, w2 string")
    sets = [set(t.split()) for t in texts]

    def expected(a, b):
        n1, n2, both = (sum(f(s) for s in sets) for f in (lambda s: a in s, lambda s: b in s, lambda s: a in s and b in s))
        if not both:
            return float("inf")
        return (max(math.log(n1), math.log(n2)) - math.log(both)) / (math.log(len(sets)) - min(math.log(n1), math.log(n2)))

    for most in (C.BROADCAST_PAIRS, 0):  # partners sent to every task, or joined by word
        monkeypatch.setattr(C, "BROADCAST_PAIRS", most)
        got = {(r["word1"], r["word2"]): r["distance"] for r in C.pair_distance(given, corp).collect()}
        assert set(got) == {(min(p), max(p)) for p in pairs}
        for (a, b), value in got.items():
            assert value == expected(a, b) or math.isclose(value, expected(a, b), abs_tol=1e-12)


def test_tiles_count_every_pair_once(spark, monkeypatch):
    from itertools import combinations
    from random import Random
    from relsift.operators import pair_counts as PC
    draw = Random(1)
    words = [f"w{i}" for i in range(400)] + ["é", "Z", "~"]
    texts = [" ".join(draw.sample(words, draw.choice([0, 1, 2, 30, 200]))) for _ in range(60)] + [" ".join(words)]
    corp = spark.createDataFrame(list(enumerate(texts)), "doc int, text string")
    want = Counter()
    for t in texts:
        want.update(combinations(sorted(set(t.split()), key=lambda w: w.encode()), 2))
    monkeypatch.setattr(PC, "CHUNK_WORDS", 500)
    monkeypatch.setattr(C, "PAIR_BLOCK", 90)
    got = {(r["word1"], r["word2"]): r["n"] for r in C.word_cooccurrence(corp).collect()}
    assert got == dict(want)
    keep = spark.createDataFrame([(w,) for w in words[:50] * 2], "word string")
    some = C.word_cooccurrence(corp, keep, min_n=20).collect()
    assert {(r["word1"], r["word2"]): r["n"] for r in some} == {p: n for p, n in want.items() if n >= 20 and set(p) <= set(words[:50])}
    assert C.word_cooccurrence(corp.limit(0)).count() == 0


def test_strips_and_pieces_of_a_tile(monkeypatch):
    import numpy as np
    import pyarrow as pa
    from itertools import combinations
    from random import Random
    from relsift.operators import pair_counts as PC
    for name, value in (("COUNTERS", 200), ("EVENTS", 50), ("BATCH_ROWS", 7)):
        monkeypatch.setattr(PC, name, value)
    draw, want, batches = Random(2), Counter(), []
    names = {0: [f"a{i}" for i in range(40)], 1: [f"b{i}" for i in range(30)]}
    for chunk in range(3):
        rows = []
        for doc in range(20):
            words = [(b, i) for b in names for i in range(len(names[b])) if draw.random() < draw.choice([0.0, 0.1, 0.9])]
            want.update(combinations([names[b][i] for b, i in words], 2))
            rows += [(chunk, doc, b, i) for b, i in words]
        draw.shuffle(rows)
        table = pa.table(dict(zip(("chunk", "doc", "band", "lid"), (np.array(c) for c in zip(*rows)))))
        batches += PC._pack(table).to_pylist()
    got = Counter()
    for tile, bands in ((0, [0]), (1, [0, 1]), (3, [1])):
        rows = [{"tile": tile, "words": None, **r} for r in batches if r["band"] in bands]
        rows += [{"tile": tile, "chunk": None, "band": b, "docs": None, "sizes": None, "lids": None, "words": names[b]} for b in bands]
        out = list(PC._tiles(2, 3)([pa.RecordBatch.from_pylist(rows)]))
        for r in (r for batch in out for r in batch.to_pylist()):
            assert (r["word1"], r["word2"]) not in got
            got[r["word1"], r["word2"]] = r["n"]
    assert got == {p: n for p, n in want.items() if n >= 3}


def test_pair_query_has_rare_and_short_words(spark, tmp_path):
    """No word is left out for its length or its few documents."""
    import duckdb
    from itertools import combinations
    import __spark_entry__ as E
    texts = ["a rare word", "word b c", "rare a", "a rare word", "solo", " ".join(f"x{i}" for i in range(13)) + " tail of a text"]
    rows = [(i, t, "en", f"s{i}") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {(r["word1"], r["word2"]): r["n"] for r in E.queries()["word_cooccurrence"](spark, str(tmp_path)).collect()}
    want = Counter()
    for t in {*texts[:5], " ".join(f"x{i}" for i in range(12)), "x12 tail of a text"}:
        want.update(combinations(sorted(set(t.split())), 2))
    assert got == dict(want) and got["a", "rare"] == 2
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    assert {r[:2]: r[2] for r in con.execute(E.oracle_sql()["word_cooccurrence"]).fetchall()} == got


def test_no_document_or_packed_word_is_shuffled_for_pairs(spark, monkeypatch):
    """Words are packed where their documents are, and tiles read the folders of their bands."""
    from relsift.operators import pair_counts as PC
    made = []
    keep = PC.materialize
    monkeypatch.setattr(PC, "materialize", lambda df, *f: made.append(df) or keep(df, *f))
    corp = spark.createDataFrame([(i, f"a{i % 7} b{i % 5} c{i % 3}") for i in range(60)], "doc int, text string")
    pairs = C.word_cooccurrence(corp)
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in (pairs, made[-1])]
    assert not any("RepartitionByExpression" in p or "RebalancePartitions" in p or "FlatMapGroups" in p for p in plans)
    assert "Exchange" not in pairs._jdf.queryExecution().sparkPlan().toString()
    assert pairs.agg(F.sum("n")).first()[0] == 60 * 3


def test_sparse_and_dense_strips_agree(monkeypatch):
    import numpy as np
    from relsift.operators import pair_counts as PC
    draw = np.random.default_rng(3)
    chunks = []
    for _ in range(3):  # the first numbers are in most documents, the last in few
        there = draw.random((40, 90)) < np.linspace(0.8, 0.0, 90) ** 6
        docs, lids = np.nonzero(there)
        at, sizes = np.unique(docs, return_counts=True)
        packed = tuple(v.tobytes() for v in (at.astype(np.int32), sizes.astype(np.int32), lids.astype(np.uint16)))
        chunks.append((there.astype(int), PC._lookups(packed, packed, True)))
    want = np.triu(sum(x.T @ x for x, _ in chunks), 1)
    for counters, events, sparse in ((10**6, 10**6, 10**9), (180, 60, 1), (90, 10**6, 0)):
        for name, value in (("COUNTERS", counters), ("EVENTS", events), ("SPARSE", sparse)):
            monkeypatch.setattr(PC, name, value)
        some = [c for _, c in chunks]
        kinds = {s for _, _, s in PC._strips(some, 90, 90)}
        assert kinds == ({False} if sparse == 10**9 else {True, False} if sparse else {True})
        got = np.zeros((90, 90), int)
        for a, b, n in PC._tile_counts(some, 90, 90, 1):
            assert (got[a, b] == 0).all()
            got[a, b] += n
        assert (got == want).all()


def test_documents_that_are_cut_by_a_batch_stay_whole(monkeypatch):
    import numpy as np
    import pyarrow as pa
    from relsift.operators import pair_counts as PC
    monkeypatch.setattr(PC, "CHUNK_WORDS", 7)
    doc = np.repeat([5, 3, 9, 4], [4, 12, 1, 6])
    table = pa.table({"doc": doc, "band": pa.array([0] * len(doc), pa.int32()), "lid": pa.array(range(len(doc)), pa.int32())})
    rows = [r for b in PC._pack_chunks(iter(table.to_batches(max_chunksize=5))) for r in b.to_pylist()]
    sizes = [s for r in rows for s in np.frombuffer(r["sizes"], np.int32)]
    assert sorted(sizes) == [1, 4, 6, 12] and len({r["chunk"] for r in rows}) == len(rows) > 1


def test_corpus_of_a_stored_table(spark):
    rel = spark.createDataFrame([("t", "d"), ("t", None), ("d", "e"), (None, "f"), ("", "e"), ("u", "u")], "product_title string, product_description string")
    want = sorted(tuple(r) for r in C.corpus_a(rel).collect())
    assert sorted(tuple(r) for r in C.corpus_a(rel, stored=True).collect()) == want and len(want) == 6
    plan = C.corpus_a(rel, stored=True)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2


def test_distances_by_class_are_counted_for_rated_rows_only(spark, tmp_path, monkeypatch):
    import __spark_entry__ as E
    texts = ["red shoe big red hat", "blue hat big sock shoe", "red sock blue", "big red sock hat blue shoe"] * 3
    rows = [(i, f"{t} n{i}", "en", f"s{i % 2}") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(5)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    asked, keep = [], C.phrase_distance
    monkeypatch.setattr(C, "phrase_distance", lambda rel, corp: asked.append((rel.count(), corp.count())) or keep(rel, corp))
    got = {r["class"]: r.asDict() for r in E.queries()["distance_by_class"](spark, str(tmp_path)).collect()}
    assert asked == [(5, 12)]
    from relsift.plans.corpus_queries import _corpus
    s, corp = _corpus(spark, str(tmp_path))
    want = {r["class"]: r.asDict() for r in C.distance_by_class(keep(s, corp), s).collect()}
    assert got.keys() == want.keys() and sum(r["n"] for r in got.values()) == 5
    assert all(a == b or math.isclose(a, b, abs_tol=1e-6) for k in want for a, b in zip(got[k].values(), want[k].values()))


def test_tiles_of_a_group_need_few_scans(spark, monkeypatch):
    from relsift.operators import pair_counts as PC
    texts = [" ".join(f"w{j}" for j in range(i % 3, 60, 3)) for i in range(9)]
    corp = spark.createDataFrame(list(enumerate(texts)), "doc int, text string")
    monkeypatch.setattr(C, "PAIR_BLOCK", 12)
    monkeypatch.setattr(PC, "TILE_TASKS", 4)
    pairs = C.word_cooccurrence(corp)
    assert pairs._jdf.queryExecution().optimizedPlan().toString().count("Relation") < 10
    got = {(r["word1"], r["word2"]): r["n"] for r in pairs.collect()}
    assert len(got) == 3 * 190 and set(got.values()) == {3}
