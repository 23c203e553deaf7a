"""Model queries: ids, class domain, seed stability (rows-only checks)."""


def test_rf_overlap(spark, sf_small):
    import __spark_entry__ as E
    a = E.queries()["rf_overlap"](spark, sf_small).toPandas().sort_values("id")
    b = E.queries()["rf_overlap"](spark, sf_small).toPandas().sort_values("id")
    assert a["id"].is_unique and set(a["prediction"]) <= {1, 2, 3, 4}
    assert a["prediction"].tolist() == b["prediction"].tolist()


def test_forest_beats_majority_class(spark, sf_small):
    import __spark_entry__ as E
    q = E.queries()["kappa_scorer"](spark, sf_small).first()["qwk"]
    assert q > 0  # a constant (majority-class) prediction has kappa 0


def test_level_one_probabilities(spark):
    from relsift.operators import models as M
    rows = [(i, float(i % 40), float(i % 3), float(i % 4)) for i in range(120)]
    data = M.assemble(spark.createDataFrame(rows, "id long, q double, x double, label double"), ["q", "x"])
    model = M.gbm_ovr(2, 0.1, 3).fit(data)
    probs = M.class_probabilities(model.transform(data)).select("L1", "L2", "L3", "L4").collect()
    assert all(abs(sum(r) - 1) < 1e-9 and min(r) >= 0 for r in probs)


def test_scaled_columns_have_unit_variance(spark):
    import numpy as np
    from relsift.operators.vectors import standard_scale
    df = spark.createDataFrame([(i, float(i * i), 1.0) for i in range(30)], "id long, a double, b double")
    rows = standard_scale(df, df, ["a", "b"]).collect()
    assert abs(np.var([r["a"] for r in rows]) - 1) < 1e-9 and {r["b"] for r in rows} == {0.0}


def test_undefined_features_take_the_upper_side(spark):
    from relsift.operators import models as M
    rows = [(i, [float(i % 5), None, float("nan")][i % 3], i % 3 + 1, i % 2) for i in range(60)]
    data = M.with_label(M.assemble_defined(spark.createDataFrame(rows, "id long, x double, median_relevance int, n int"), ["x", "n"]))
    assert {v.features[0] for v in data.where("id % 3 > 0").collect()} == {M.UNDEFINED}
    assert [v.features[0] for v in data.where("id % 3 = 0").orderBy("id").limit(3).collect()] == [0.0, 3.0, 1.0]
    for model in (M.random_forest(5).fit(data), M.gbm_ovr(2, 0.1, 2).fit(data)):
        got = model.transform(data).where("id % 3 = 0").select("label", "prediction").collect()
        assert all(r.label == r.prediction for r in got)


def test_distance_forest_with_empty_texts(spark, tmp_path):
    import __spark_entry__ as E
    texts = [(i, ["red shoe size", "\u4e00\u4e8c", "blue hat", None][i % 4], "en", "a" if i % 4 != 1 else "b", 3) for i in range(48)]
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i // 4 % 2, i // 8 % 2) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert len(E.queries()["rf_importance"](spark, str(tmp_path)).collect()) == 70


def test_chi_squared_reads_the_rows_once(spark):
    from relsift.operators import vectors as V
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    long = spark.createDataFrame([(i, f, float((i + 1) * (f == "a") + 1)) for i in range(8) for f in "ab"], "id long, feature string, value double")
    labels = spark.createDataFrame([(i, i % 2 + 1) for i in range(8)], "id long, label int")
    got = V.chi2_select(long.mapInArrow(counted, long.schema), labels, 2, [1, 2]).collect()
    obs = [sum(i + 2 for i in range(8) if i % 2 == k) for k in (0, 1)]
    want = sum((o - sum(obs) / 2) ** 2 / (sum(obs) / 2) for o in obs)
    assert [(r.feature, r.rank) for r in got] == [("a", 1), ("b", 2)] and abs(got[0].chi2 - want) < 1e-12 and got[1].chi2 == 0
    assert seen.value == 16


def test_scrub_of_odd_characters(spark):
    from relsift.functions import text as T
    rows = [("  A\t\n b--C_9.\u4e00 \x0b\u0130 z ",), (" ",), ("",), (None,), ("\U0001f600 x",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(T.scrub("t")).collect()]
    assert got == ["a b--c9 i z ", "", "", None, "x"]


def test_few_rows_make_few_partitions_of_trees(spark):
    from relsift.operators import models as M
    df = spark.range(0, 100, 1, 7)
    assert [M.dealt_for_trees(df, n).rdd.getNumPartitions() for n in (1000, 40, 10)] == [1, 3, 7]
    assert M.dealt_for_trees(df.limit(0)).count() == 0


def test_labelled_rows_are_cut_from_the_texts_once(spark, sf_small):
    import __spark_entry__  # noqa: F401  (registers in order)
    from relsift.plans import ml_queries as Q
    s, train, test = Q._labelled(spark, sf_small)
    assert "product_description" not in s.columns and "product_description" in Q._labelled(spark, sf_small, description=True)[0].columns
    assert all("documents.parquet" not in f for df in (s, train, test) for f in df.inputFiles())
    assert train.count() + test.count() == s.count() > 0


def test_scaled_vectors_equal_scaled_columns(spark):
    from pyspark.sql import functions as F
    from pyspark.ml.functions import vector_to_array
    from relsift.operators import vectors as V
    rows = [(i, i % 2, 1, i % 5 // 4) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, a int, b int, c int")
    train = df.where("id < 25")
    cols = V.standard_scale(train, df, ["a", "b", "c"])
    arrays = df.select("id", F.array(*[F.col(c).cast("tinyint") for c in ("a", "b", "c")]).alias("x"))
    vec = V.scaled_vector(arrays.where("id < 25"), arrays, "x", 3, "v").select("id", vector_to_array("v").alias("v"))
    for r in vec.join(cols, "id").collect():
        assert all(abs(x - y) < 1e-12 for x, y in zip(r.v, (r.a, r.b, r.c))), r
    one = [r.a for r in cols.orderBy("id").collect()][:2]  # population deviation of 13 zeros and 12 ones
    p = 12 / 25
    assert abs(one[0] + p / (p * (1 - p)) ** 0.5) < 1e-12 and abs(one[1] - (1 - p) / (p * (1 - p)) ** 0.5) < 1e-12


def test_scaling_many_columns_is_a_narrow_aggregate(spark):
    from pyspark.sql import functions as F
    from relsift.operators import vectors as V
    n = 120
    df = spark.range(20).select("id", *[(F.col("id") % (i + 2)).cast("double").alias(f"c{i}") for i in range(n)])
    mean, sdev = V.moments(df, F.array(*[f"c{i}" for i in range(n)]), n)
    assert len(mean) == len(sdev) == n and mean[0] == 0.5 and sdev[0] == 0.5
    assert V.moments(df.limit(0), F.array("c0"), 1) == ([None], [1.0])
