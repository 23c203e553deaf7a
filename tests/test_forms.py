"""Forms from a user's table: versions, longest suffix, unmatched tokens, the file."""

from pyspark.sql import functions as F

from relsift.operators import forms as FM
from relsift.sources import files as IO

TABLE = [(1, "mice", "mouse"), (2, "mice", "mus"), (3, "mice", None), (1, "geese", "goose"), (1, "geese", "goos"),
         (1, "*s", ""), (1, "*ies", "y"), (2, "*es", "e"), (None, "dogs", "x"), (1, None, "x"), (1, "", "x"), (1, "*", "x")]


def table(spark):
    return spark.createDataFrame(TABLE, IO.FORM_TABLE)


def test_versions(spark):
    at = lambda v: {r["token"]: r["form"] for r in FM.forms_at(table(spark), v).collect()}
    assert at(0) == {}
    assert at(1) == {"mice": "mouse", "geese": "goos", "*s": "", "*ies": "y"}
    assert at(2)["mice"] == "mus" and at(2)["*es"] == "e"
    assert "mice" not in at(None) and at(None) == at(3)


def test_longest_suffix_and_report(spark):
    texts = [(1, ["mice", "parties", "boxes", "cats", "as", "ies", "cat", "cat", ""]), (2, None), (3, []), (4, ["cat", "cats"])]
    docs = spark.createDataFrame(texts, "doc_id long, words array<string>").withColumn("token", F.lit("clash")).withColumn("form", F.lit("clash"))
    forms = FM.forms_at(table(spark), 2)
    got = {(r["doc_id"], r["pos"]): (r["form"], r["matched_by"]) for r in FM.apply_forms(docs, "doc_id", F.col("words"), forms).collect()}
    # "as" and "ies" would leave one and no characters ("ies" still ends in "s")
    assert got == {(1, 0): ("mus", "entry"), (1, 1): ("party", "suffix"), (1, 2): ("boxe", "suffix"), (1, 3): ("cat", "suffix"),
                   (1, 4): ("as", "none"), (1, 5): ("ie", "suffix"), (1, 6): ("cat", "none"), (1, 7): ("cat", "none"),
                   (4, 0): ("cat", "none"), (4, 1): ("cat", "suffix")}
    left = FM.unmatched_tokens(docs, "doc_id", F.col("words"), forms).collect()
    assert sorted((r["token"], r["n"], r["n_rows"], r["rank"]) for r in left) == [("as", 1, 1, 2), ("cat", 3, 2, 1)]
    assert FM.apply_forms(docs.limit(0), "doc_id", F.col("words"), forms).count() == 0
    none = FM.apply_forms(docs, "doc_id", F.col("words"), forms.limit(0))
    assert none.where("matched_by <> 'none' or form <> token").count() == 0 and none.count() == 10


def test_file_keeps_null_and_empty_forms(spark, tmp_path):
    path = IO.write_form_table(table(spark).where("token <> ''"), str(tmp_path / "forms"))
    back = IO.read_form_table(spark, path)
    key = lambda r: (r["token"], r["version"] or 0, r["form"] or "")
    assert sorted(back.collect(), key=key) == sorted(table(spark).where("token <> ''").collect(), key=key)
