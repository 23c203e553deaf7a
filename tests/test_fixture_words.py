"""The fixture's texts are those of a split into all words."""

from relsift.sources.fixture import relevance_table

W = [f"w{i}" for i in range(1, 31)]
TEXTS = [" ".join(W), "  \t" + "\n ".join(W) + " \r\n", " ".join(W[:12]), " ".join(W[:12]) + "  ", "\x0b".join(W[:13]) + "\t",
         " ".join(W[:2]), "", "   ", None, "a \t b", "\x0c".join(W[:14]), "one  two\t\tthree \n" * 9, " x " * 20]


def test_texts_equal_a_split_into_all_words(spark, tmp_path):
    from pyspark.sql import functions as F
    from relsift.functions.text import WS_CLASS
    rows = [(i, t, "en", f"s{i}") for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rel = relevance_table(spark, str(tmp_path))
    got = {r.id: (r.query, r.product_title, r.product_description) for r in rel.collect()}
    assert len(got) == len(TEXTS)
    words = F.filter(F.split("text", WS_CLASS + "+", -1), lambda x: x != "")
    for r in spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").select("doc_id", words.alias("w")).collect():
        want = (None,) * 3 if r.w is None else (" ".join(r.w[:3]), " ".join(r.w[:12]), " ".join(r.w[12:]) or None)
        assert got[r.doc_id] == want, r.doc_id


def test_a_title_makes_no_array_of_all_words(spark, tmp_path):
    spark.createDataFrame([(0, " ".join(W), "en", "s")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    plan = relevance_table(spark, str(tmp_path)).select("product_title")._jdf.queryExecution().optimizedPlan().toString()
    assert "+, 13)" in plan and "+, -1)" not in plan


def test_no_text_is_shuffled_to_meet_small_tables(spark, tmp_path):
    rows = [(i, " ".join(W), "en", f"s{i % 3}") for i in range(9)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rel = relevance_table(spark, str(tmp_path))
    plan = rel._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in plan
    assert rel.count() == 9


def test_an_id_that_repeats_gives_its_queries_to_all_rows(spark, tmp_path):
    # the lowest id twice in one (lang, source): two queries, each beside every row
    rows = [(1, "a b c d", "en", "s"), (1, "e f g h", "en", "s"), (2, " ".join(W), "en", "s"), (3, "x", None, "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = sorted((r.id, r.query) for r in relevance_table(spark, str(tmp_path)).collect())
    assert got == [(1, "a b c"), (1, "a b c"), (1, "e f g"), (1, "e f g"), (2, "a b c"), (2, "e f g")]
