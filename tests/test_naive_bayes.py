"""Fold models by count subtraction equal models trained on the fold's rows."""

from pyspark.sql import functions as F

from relsift.operators import naive_bayes as NB


def _data(spark):
    words = ["red", "blue", "shoe", "boot", "lamp", "desk", "cable", "phone"]
    rows = []
    for i in range(60):
        q = f"{words[i % 4]} {words[4 + i % 3]}"
        t = f"{words[i % 5]} {words[(i * 3) % 8]} {words[(i + 2) % 8]}"
        rows.append((i, q, t, 1 + (i * 7) % 4))
    return spark.createDataFrame(rows, "id long, query string, product_title string, label int")


def test_fold_model_equals_direct_training(spark):
    d = _data(spark)
    labels = d.select("id", "label", (F.col("id") % 3 + 1).cast("int").alias("fold"))
    docs = d.select("id", "query", "product_title")
    bag = NB.bag_of_terms(docs)
    stats = NB.train_statistics(bag, labels, 3)
    # model of fold 2, scored on the rows of fold 2
    model_of = labels.where("fold = 2").select("id", F.lit(2).alias("f"))
    sub = NB.by_label(NB.predict_views(bag, model_of, stats), "view", "id").toPandas().set_index(["view", "id", "label"])["p"]
    # the same model trained directly on the other folds (as model 0 of a 0-fold split)
    train_rows = labels.where("fold != 2").select("id", "label", F.lit(1).alias("fold"))
    direct_stats = NB.train_statistics(bag, train_rows, 1)
    direct_stats_full = dict(direct_stats)
    direct = NB.by_label(NB.predict_views(bag, labels.where("fold = 2").select("id", F.lit(0).alias("f")),
                                          direct_stats_full), "view", "id").toPandas().set_index(["view", "id", "label"])["p"]
    assert len(sub) == len(direct) > 0
    assert (sub.sort_index() - direct.sort_index()).abs().max() < 1e-9


def test_probabilities_sum_to_one(spark):
    d = _data(spark)
    labels = d.select("id", "label", (F.col("id") % 3 + 1).cast("int").alias("fold"))
    out = NB.nb_three_view(d.select("id", "query", "product_title"),
                           labels.withColumnRenamed("label", "median_relevance"), 3)
    sums = NB.by_label(out, "id").groupBy("id").agg(F.sum("p").alias("s")).collect()
    assert all(abs(r["s"] - 1) < 1e-9 for r in sums)
    assert {r["prediction"] for r in out.select("prediction").collect()} <= {1, 2, 3, 4}


def test_frequent_terms_are_split(spark):
    """With broadcast off, the dictionary join reads two plain shuffles, which AQE splits."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes",
                                          "spark.sql.adaptive.skewJoin.skewedPartitionFactor", "spark.sql.adaptive.advisoryPartitionSizeInBytes",
                                          "spark.sql.adaptive.coalescePartitions.enabled")}
    rows = [(i, f"common q{i % 7}", f"common common{i}", 1 + i % 4) for i in range(6000)]
    d = spark.createDataFrame(rows, "id long, query string, product_title string, label int").repartition(16)
    labels = d.select("id", "label", (F.col("id") % 3 + 1).cast("int").alias("fold"))
    bag = NB.bag_of_terms(d)
    stats = NB.train_statistics(bag, labels, 3)
    try:
        for k, v in zip(old, ("-1", "8k", "1.2", "8k", "false")):
            spark.conf.set(k, v)
        out = NB.predict_views(bag, labels.select("id", F.col("fold").alias("f")), stats)
        out.write.format("noop").mode("overwrite").save()
        out.collect()
        assert "SortMergeJoin(skew=true)" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
