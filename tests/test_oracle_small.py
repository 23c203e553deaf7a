"""Registered queries against their DuckDB oracle on sf0.001 (fast subset)."""

import pytest

FAST = ["rel_fixture", "scrub", "overlap_features", "query_minmax_rating", "overlap_minmax", "distance_features",
        "query_title_coverage", "word_document_frequency", "phrase_distance", "stratified_folds", "qwk",
        "confusion_matrix", "top_terms", "char_wb_ngrams", "tfidf_sublinear", "harvest_results",
        "pseudo_label_rows", "chi2_select", "index_categorical", "src_csv", "stream_distance_features"]


@pytest.fixture(scope="module")
def duck(sf_small):
    from scripts.check_oracle import duck as mk
    return mk(sf_small)


@pytest.mark.parametrize("name", FAST)
def test_matches_oracle(spark, duck, sf_small, name):
    import __spark_entry__ as E
    from scripts.check_oracle import table_hash
    sdf = E.queries()[name](spark, sf_small).toPandas()
    ddf = duck.execute(E.oracle_sql()[name]).df()
    hs, _, cs = table_hash(sdf)
    hd, _, cd = table_hash(ddf)
    assert len(sdf) == len(ddf) and cs == cd and hs == hd


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0 and set(df.columns) == {"id", "X1", "X2", "X3", "X4", "maxr", "minr"}
