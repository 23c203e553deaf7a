"""Skew-safe helpers equal their single-window forms on a skewed key."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from relsift.operators.skew import rank_within, topk_per_group


def _skewed(spark):
    # one key holds more than a third of the rows
    rows = [(i, "hot" if i % 3 != 0 else f"k{i % 7}", (i * 7919) % 1000) for i in range(3000)]
    return spark.createDataFrame(rows, "id long, g string, v long")


def test_rank_within(spark):
    df = _skewed(spark)
    got = rank_within(df, ["g"], ["v", "id"], out="rn").select("id", "rn").toPandas().sort_values("id")
    w = Window.partitionBy("g").orderBy("v", "id")
    exp = df.select("id", F.row_number().over(w).alias("rn")).toPandas().sort_values("id")
    assert got["rn"].tolist() == exp["rn"].tolist()


def test_topk(spark):
    df = _skewed(spark)
    got = topk_per_group(df, ["g"], [F.desc("v"), F.asc("id")], 5, buckets=16).select("g", "id", "rank")
    w = Window.partitionBy("g").orderBy(F.desc("v"), F.asc("id"))
    exp = df.select("g", "id", F.row_number().over(w).alias("rank")).where("rank <= 5")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, exp.collect()))


def test_index_categorical_matches_string_indexer(spark):
    from pyspark.ml.feature import StringIndexer
    from relsift.operators.vectors import index_categorical
    rows = [(i, f"q{(i * 7) % 5 if i % 3 else 0}") for i in range(60)]
    train = spark.createDataFrame(rows[:50], "id long, query string")
    allr = spark.createDataFrame(rows + [(99, "unseen")], "id long, query string")
    ours = {r["id"]: r["query_idx"] for r in index_categorical(train, allr, "query").collect()}
    model = StringIndexer(inputCol="query", outputCol="ix", handleInvalid="keep").fit(train)
    theirs = {r["id"]: r["ix"] for r in model.transform(allr).collect()}
    assert ours == theirs
