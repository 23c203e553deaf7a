"""SVD by joins, Fourier features, target statistics, scores in one pass, pipeline search."""

import numpy as np
import pytest

from relsift.operators import models as M
from relsift.operators import search as SE
from relsift.operators import svd
from relsift.session import materialize


def entries(spark, x):
    return spark.createDataFrame([(i, f"t{j}", float(x[i, j])) for i in range(x.shape[0]) for j in range(x.shape[1]) if x[i, j]],
                                 "id long, term string, weight double")


@pytest.mark.parametrize("block_entries", [60, 10**6])
def test_svd_equals_numpy(spark, block_entries):
    rng = np.random.default_rng(3)
    x = (rng.random((40, 25)) < 0.4) * rng.random((40, 25))
    other = (rng.random((7, 25)) < 0.4) * rng.random((7, 25))
    proj, values = svd.truncated_svd(entries(spark, x), 5, apply_to=entries(spark, other), iterations=8, block_entries=block_entries)
    _, want, v = np.linalg.svd(x)
    assert np.allclose(values, want[:5], rtol=1e-6)
    got = {r.id: np.abs(r.svd) for r in proj.collect()}
    assert all(np.allclose(got[i], np.abs(other[i] @ v[:5].T), atol=1e-3) for i in got) and len(got) == 7


def test_svd_of_low_rank_and_of_nothing(spark):
    x = np.outer(np.arange(1, 9), np.arange(1, 6)) + 0.0
    proj, values = svd.truncated_svd(entries(spark, x), 4)
    assert len(values) == 1 and abs(values[0] - np.linalg.svd(x)[1][0]) < 1e-6
    assert all(abs(abs(r.svd[0]) - np.linalg.norm(x[r.id])) < 1e-6 for r in proj.collect())
    proj, values = svd.truncated_svd(entries(spark, np.zeros((3, 3))), 2)
    assert values == [] and proj.collect() == []


def test_fourier_features_tell_a_ring_apart(spark):
    rng = np.random.default_rng(1)
    angle, inner = rng.uniform(0, 2 * np.pi, 400), np.arange(400) % 2
    r = np.where(inner == 1, rng.uniform(0, 0.7, 400), rng.uniform(1.2, 1.8, 400))
    rows = [(i, float(r[i] * np.cos(angle[i])), float(r[i] * np.sin(angle[i])), float(inner[i])) for i in range(400)]
    data = M.assemble(spark.createDataFrame(rows, "id long, x double, y double, label double"), ["x", "y"])

    def hits(df):
        model = M.margin_classifier(9.0, 300).fit(df.where("id < 300"))
        return model.transform(df.where("id >= 300")).where("prediction = label").count()

    data, lifted = materialize(data), materialize(M.random_fourier(data, 2, 200))
    assert hits(lifted) >= 97 > 80 > hits(data)
    a, b = [np.array(v.features) for v in lifted.orderBy("id").limit(2).collect()]
    near = np.exp(-0.5 * ((rows[0][1] - rows[1][1]) ** 2 + (rows[0][2] - rows[1][2]) ** 2))
    assert abs(a @ b - near) < 0.2


def test_a_thousand_queries_told_apart(spark):
    rows = [(i, f"q{i % 1000}") for i in range(6000)]
    label = lambda i: (i % 1000) % 2 + 1
    folds = spark.createDataFrame([(i, i % 7, label(i)) for i, _ in rows if i < 5000], "id long, fold int, label int")
    got = {r.id: r for r in SE.target_statistics(spark.createDataFrame(rows, "id long, q string"), folds, "q", [1, 2]).collect()}
    assert len(got) == 6000 and all((got[i].ts_1 > 0.6) == (label(i) == 1) for i in got)
    assert all(got[i].ts_n == 5 for i in range(5000, 6000)) and got[0].ts_n == 4


def test_own_label_is_not_seen(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "unseen")], "id long, q string")
    folds = spark.createDataFrame([(1, 1, 1), (2, 2, 2), (3, 1, 2)], "id long, fold int, label int")
    got = {r.id: r for r in SE.target_statistics(rows, folds, "q", [1, 2]).collect()}
    assert all(abs(got[i].ts_1 - 1 / 3) < 1e-12 and got[i].ts_n == 0 for i in (1, 2, 3, 4))


def test_fold_scores_of_known_predictions(spark):
    from relsift.operators.evaluate import KappaEvaluator
    rows = [(s, f, i, float(i % 4), float((i * (3 if s == "a" else 1) + f) % 4)) for s in "ab" for f in (1, 2) for i in range(40)]
    pred = spark.createDataFrame(rows, "setting string, fold int, id long, label double, prediction double")
    for r in SE.fold_scores(pred).collect():
        part = [(x[3], x[4]) for x in rows if x[:2] == (r.setting, r.fold)]
        a, b = np.array(part).T
        want = 1 - ((a - b) ** 2).mean() / ((a[:, None] - b[None, :]) ** 2).mean()
        assert abs(r.score - want) < 1e-12 and r.n == 40
        one = pred.where(f"setting = '{r.setting}' and fold = {r.fold}")
        assert abs(KappaEvaluator().evaluate(one) - want) < 1e-12


def test_search_shares_prefixes_and_stops_early():
    made, tried = [], []
    settings = [{"p": p, "c": c} for p in (1, 2) for c in (1, 2)]

    def prepare(prefix, some, fold):
        made.append((prefix, fold, len(some)))
        return prefix

    def score(prepared, s):
        tried.append((s["p"], s["c"]))
        return s["p"] + s["c"] / 10

    rows, best = SE.pipeline_search(settings, [1, 2, 3], lambda s: s["p"], prepare, score)
    assert best == {"p": 2, "c": 2} and len(rows) == 4 + 2 + 1
    assert made == [(1, 1, 2), (2, 1, 2), (2, 2, 2), (2, 3, 1)]


def test_repeated_schemes_all_run(spark, sf_small):
    import __spark_entry__ as E
    rows = E.queries()["repeated_cv"](spark, sf_small).collect()
    assert len(rows) == 3 * 3 + 10 + 3 + 3 * 10
    assert {(r.folds, r.repeats) for r in rows} == {(3, 3), (10, 1), (3, 1), (3, 10)}
    assert all(-1 <= r.score <= 1 for r in rows)


def test_rounded_arrays(spark):
    from relsift.plans.registry import rounded
    df = spark.createDataFrame([(1, [0.12345678, float("nan"), None, -0.0])], "id long, v array<double>")
    assert rounded(df).first().v == [0.123457, None, None, 0.0]


def test_svd_through_words_equals_the_product(spark):
    rng = np.random.default_rng(5)
    x, y = [(rng.random(s) < 0.4) * rng.random(s) for s in ((40, 15), (15, 25))]
    words = entries(spark, x).withColumnRenamed("term", "t").selectExpr("id", "concat('w', substr(t, 2)) term", "weight")
    through = entries(spark, y).selectExpr("concat('w', id) id", "term", "weight")
    for block in (60, 10**6):
        proj, values = svd.truncated_svd(words, 5, iterations=8, block_entries=block, through=through)
        _, want, v = np.linalg.svd(x @ y)
        assert np.allclose(values, want[:5], rtol=1e-6)
        got = {r.id: np.abs(r.svd) for r in proj.collect()}
        assert len(got) == 40 and all(np.allclose(got[i], np.abs((x @ y)[i] @ v[:5].T), atol=1e-3) for i in got)


def test_factors_are_the_ngram_weights(spark):
    from relsift.operators import tfidf as TF
    from pyspark.sql import functions as F
    texts = ["Red shoe  red", "a blue shoe", "", None, "shoe\tsize x", "red", "zq", "blu\u00e9 shoe"]
    rows = spark.createDataFrame([(i % 7, t) for i, t in enumerate(texts)], "id long, s string")
    train = rows.where("id < 5")
    for low, high in ((1, 6), (4, 5), (2, 2)):
        want = {(r.id, r.term): r.weight for r in TF.tfidf(train, rows, lambda d: TF.char_wb_rows(d, F.col("s"), low, high), min_df=2, nested=True).collect()}
        counts, grams = TF.char_wb_factors(train, rows, F.col("s"), low, high, min_df=2)
        got = {}
        for r in counts.join(grams.select(F.col("id").alias("word"), F.col("term").alias("gram"), F.col("weight").alias("g")), F.col("term") == F.col("word")).collect():
            got[r.id, r.gram] = got.get((r.id, r.gram), 0) + r.weight * r.g
        assert want.keys() == got.keys() and want and all(abs(want[k] - got[k]) < 1e-9 for k in want)
        plain = {tuple(r) for r in TF.count_terms(TF.char_wb_rows(rows, F.col("s"), low, high)).collect()}
        assert {tuple(r) for r in TF.char_wb_counts(rows, F.col("s"), low, high).collect()} == plain


def test_repeats_of_cross_validation_run_side_by_side(spark, monkeypatch):
    import threading
    from relsift.plans import ml_queries as Q
    rows = spark.range(12).selectExpr("id", "cast(id % 2 as double) label", "cast(1 as double) features")
    monkeypatch.setattr(Q, "_overlap_sets", lambda spark, sf_dir: (rows, None))
    monkeypatch.setattr(Q, "CV_SCHEMES", ((2, 1), (3, 1)))
    both = threading.Barrier(2, timeout=60)  # passed only if the two repeats meet

    def predictions(fit, settings, folds, values):
        both.wait()
        return folds.selectExpr("'s' as setting", "fold", "id", "label", "label as prediction")

    monkeypatch.setattr(Q.SE, "fold_predictions", predictions)
    got = Q.q_repeated_cv(spark, None).collect()
    assert sorted((r.folds, r.fold) for r in got) == [(2, 1), (2, 2), (3, 1), (3, 2), (3, 3)]


def test_every_setting_meets_every_fold():
    settings = [{"p": p, "c": c} for p in (1, 2) for c in (1, 2, 3)]
    scores = {(1, 1): 9, (2, 3): 5}
    rows, best = SE.pipeline_search(settings, [1, 2, 3], lambda s: s["p"], lambda prefix, some, fold: fold,
                                    lambda fold, s: scores.get((s["p"], s["c"]), 0) if fold == 1 else s["c"] * s["p"], keep=1.0, prefixes=2, fits=3)
    assert len(rows) == 6 * 3 and best == {"p": 2, "c": 3}
    assert [r["setting"] for r in rows[:6]] == settings  # in order, whoever is done first


def test_random_search_draws_as_many_as_the_reference(spark, monkeypatch):
    import __spark_entry__  # noqa: F401  (registers in order)
    from relsift.plans import ml_queries as Q
    asked = []

    def search(spark, sf_dir, n, **more):
        asked.append(n)
        best = {"C": 4}
        return spark.range(1), [{"setting": best, "name": "C=4", "score": 0.5}], best

    monkeypatch.setattr(Q, "joined_search", search)
    assert Q.q_random_search(spark, "").count() == 1 and asked == [250]


def test_joined_search_scores_all_settings_on_all_folds(spark, tmp_path, monkeypatch):
    from pyspark.ml.classification import LogisticRegression, OneVsRest
    from relsift.operators import models as M
    import __spark_entry__  # noqa: F401  (registers in order)
    from relsift.plans import ml_queries as Q
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(["red", "blue", "shoe", "hat", "sock", "big"], 14)) for _ in range(60)]
    spark.createDataFrame([(i, t, "en", f"s{i % 4}") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, i % 3 % 2) for i in range(45)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    sizes = []

    def quick(C, n):
        sizes.append(n)
        return OneVsRest(classifier=LogisticRegression(maxIter=2), labelCol="label", featuresCol="features")

    def svd(entries, k, apply_to, **more):  # quick, and its sign and scale do not matter here
        at = apply_to.groupBy("id").agg({"weight": "sum"}).toDF("id", "w")
        return at.selectExpr("id", f"transform(sequence(1, {k}), i -> w / i + id % (i + 1)) svd"), [1.0] * k

    monkeypatch.setattr(M, "margin_classifier", quick)
    monkeypatch.setattr(Q.SVD, "truncated_svd", svd)
    space = {"ngrams": [(1, 2)], "min_df": [1], "components": [2, 4], "k": [3], "C": [4, 5]}
    pred, scores, best = Q.joined_search(spark, str(tmp_path), 4, folds=2, space=space)
    assert len(scores) == 4 * 2 and {r["fold"] for r in scores} == {1, 2} and len({r["name"] for r in scores}) == 4
    assert len(sizes) == 4 * 2 + 1 and sizes[-1] == 45
    assert sorted(r.id for r in pred.collect()) == list(range(45, 60))
    means = {r["name"]: sum(x["score"] for x in scores if x["name"] == r["name"]) for r in scores}
    assert means[SE.setting_name(best)] == max(means.values())


def test_a_fitted_model_is_not_kept(spark, monkeypatch):
    """Predictions are stored fit by fit; with many rows fits come one after another."""
    import threading
    import gc
    import weakref
    alive, most, lock = weakref.WeakSet(), [], threading.Lock()

    class Model:
        def transform(self, df):
            return df.withColumn("prediction", df["label"])

    def fit(setting, train):
        gc.collect()
        with lock:
            most.append(len(alive))
            m = Model()
            alive.add(m)
        return m

    folds = spark.range(30).selectExpr("id", "cast(id % 2 as double) label", "cast(id % 3 + 1 as int) fold")
    monkeypatch.setattr(SE, "SIDE_BY_SIDE_ROWS", 10)
    out = SE.fold_predictions(fit, [{"a": 1}, {"a": 2}], folds)
    gc.collect()
    assert max(most) == 0 and len(most) == 6 and not alive
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 6 and "Project" not in plan  # six stored tables, nothing left to predict
    assert out.count() == 60


def test_a_block_of_rows_grows_in_place():
    """What a task holds of a block is not twice or three times its rows."""
    import tracemalloc
    import pyarrow as pa

    class Frame:  # gives the function that runs in the tasks
        def __getattr__(self, name):
            return lambda *a, **k: a[0] if name == "mapInArrow" else self

    width, n, step = 64, 40_000, 500
    run = svd._by_block(Frame(), Frame(), width, lambda ids, y, entries: [(len(ids), y.sum(), y.base.nbytes if y.base is not None else y.nbytes)], "", keep=False)
    batches = (pa.RecordBatch.from_pydict({"block": [0], "term": ["t"], "ids": [list(range(lo, lo + step))], "weights": [[1.0] * step],
                                           "vec": pa.array([np.ones(width).tobytes()], pa.binary())}) for lo in range(0, n, step))
    tracemalloc.start()
    (rows, total, held), = list(run(batches))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == n and total == n * width
    assert held <= n * width * 8 * 1.3 and most < n * width * 8 * 1.8
