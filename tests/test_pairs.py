"""Hand-computed pair features (FIXTURES section 4)."""

import math

from pyspark.sql import functions as F

from relsift.functions import pairs as P
from relsift.functions import text as T
from relsift.operators import features as FE


def _feats(spark, q, t):
    df = spark.createDataFrame([(1, q, t)], "id long, query string, product_title string")
    return FE.distance_features(df, outcome=None).first().asDict()


def test_identical_strings(spark):
    f = _feats(spark, "abc", "abc")
    assert f["longestprefix"] == 3
    assert f["longestsuffix"] == 0  # identical strings: suffix 0
    assert f["btitleinquery"] == 1
    assert f["charjaccardsim"] == 0
    assert f["charcossim"] == 1


def test_ab_bc(spark):
    f = _feats(spark, "ab", "bc")
    assert math.isclose(f["charjaccardsim"], 1 / 3)
    assert math.isclose(f["charcossim"], 1 / 2)
    assert f["longestprefix"] == 0 and f["longestsuffix"] == 0
    row = spark.createDataFrame([(["a", "b"], ["b", "c"])], "q array<string>, t array<string>").select(
        P.union_count("q", "t").alias("u"), P.leftover("q", "t").alias("l")).first()
    assert row["u"] == 3 and row["l"] == 1


def test_empty_query(spark):
    f = _feats(spark, "", "abc")
    assert f["btitleinquery"] == 1
    assert f["queryentropy"] == 0
    assert f["longestQueryPrefixPerc"] == 0 and f["longestQuerySuffixPerc"] == 0
    assert f["charcossim"] is None


def test_both_empty_no_error(spark):
    f = _feats(spark, "", "")
    for k, v in f.items():
        assert v is None or v == v  # no NaN, no exception under ANSI mode


def test_entropy(spark):
    r = spark.createDataFrame([("aabb",), ("",), ("abcd",)], "s string").select(
        P.char_entropy("s").alias("e")).collect()
    assert [x["e"] for x in r] == [1.0, 0.0, 2.0]


def test_word_blocks_equal(spark):
    f = _feats(spark, "red shoes for men", "mens red running shoes")
    for name in ("wordquerycount", "wordtitlecount", "wordngcount", "leftngcount", "wordngjacc", "wordngcos"):
        assert len({f[f"{name}{i}"] for i in range(1, 6)}) == 1


def test_suffix_proper(spark):
    f = _feats(spark, "shoes", "red shoes")
    assert f["longestsuffix"] == 5


def test_tokenize_trailing_space(spark):
    r = spark.createDataFrame([("a b ",), ("",)], "s string").select(F.size(T.tokenize_ws("s")).alias("n")).collect()
    assert [x["n"] for x in r] == [3, 1]


def test_null_description(spark):
    df = spark.createDataFrame([(1, "red shoe", "red shoe box", None)],
                               "id long, query string, product_title string, product_description string")
    r = FE.query_title_coverage(df).first()
    assert r["qInD"] == 0 and r["pdw"] == 1 and r["qInT"] == 1.0


def test_scrub(spark):
    r = spark.createDataFrame([("  Hello,\tWORLD!  \x0bé-x ",)], "s string").select(T.scrub("s").alias("c")).first()
    assert r["c"] == "hello world -x "


def test_stem_and_lemma(spark):
    from relsift.operators.tfidf import lemma_rule
    words = ["ponies", "caresses", "cats", "bus", "boxes", "churches", "is"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    st = [r["s"] for r in df.select(T.s_stem(F.col("w")).alias("s")).collect()]
    assert st == ["pony", "caresse", "cat", "bus", "boxe", "churche", "is"]
    lm = [r["s"] for r in df.select(lemma_rule(F.col("w")).alias("s")).collect()]
    assert lm == ["pony", "caress", "cat", "bus", "box", "church", "is"]


def test_char_wb_matches_reference_rule(spark):
    def ref(text, lo, hi):  # the analyzer rule written out in Python
        out = []
        for w in text.lower().split():
            w = f" {w} "
            for n in range(lo, hi + 1):
                if len(w) <= n:
                    out.append(w)
                    break
                out += [w[i:i + n] for i in range(len(w) - n + 1)]
        return sorted(out)
    text = "A dog  house ab"
    got = spark.createDataFrame([(text,)], "s string").select(T.char_wb_ngrams("s", 1, 6).alias("g")).first()["g"]
    assert sorted(got) == ref(text, 1, 6)


def test_shingles_are_all_runs_of_characters(spark):
    texts = ["", "a", "ab", "abc", "abcdefghij", "a\nb\r\nc d", "x\U0001F600y\U0001F601zw", "\u0e01\u0e33\u0e01\u0e33", "aaaaaa", None]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    for q in (1, 3, 5, 7):
        got = df.select("s", T.char_shingles("s", q).alias("g"))
        for r in got.collect():
            want = None if r.s is None else [r.s] if len(r.s) < q else [r.s[i:i + q] for i in range(len(r.s) - q + 1)]
            assert r.g == want, (r.s, q)
        assert "lambdafunction" not in got._jdf.queryExecution().analyzed().toString()
