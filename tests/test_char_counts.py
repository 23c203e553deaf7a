"""TF-IDF of character n-grams counted where a text is: the rows of the general form."""

from pyspark.sql import functions as F

from relsift.operators import tfidf as TF


def test_char_weights_equal_the_general_form(spark):
    texts = ["Red shoe  red", "a blue shoe", "", None, "shoe\tsize x", "red", "zq", "blué shoe", "shoe box"]
    ids = [1, 2, 3, 4, 5, 1, None, 7, None]  # an id with two texts, rows without an id
    rows = spark.createDataFrame(list(zip(ids, texts)), "id long, s string")
    train = rows.where("id is null or id < 6")
    for low, high, least in ((1, 6, 2), (3, 4, 1)):
        want = TF.tfidf(train, rows, lambda d: TF.char_wb_rows(d, F.col("s"), low, high), min_df=least, nested=True)
        got = TF.char_wb_tfidf(train, rows, F.col("s"), low, high, min_df=least)
        values = lambda df: sorted(((r.id is None, r.id, r.term), round(r.weight, 9)) for r in df.where("id is not null").collect())
        assert values(got) == values(want) and len(values(got)) > 10
        assert got.where("id is null").count() == want.where("id is null").count()


def test_ngrams_are_not_shuffled(spark):
    rows = spark.createDataFrame([(i, f"word{i % 5} shoe") for i in range(40)], "id long, s string")
    plan = TF.char_wb_tfidf(rows, rows, F.col("s"), min_df=2)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and plan.count("hashpartitioning") == 1
