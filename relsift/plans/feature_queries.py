"""Registered queries: fixture, cleaning and row-local pair features."""

from __future__ import annotations

from ..operators import features as FE
from ..sources.fixture import relevance_table
from . import oracle as O
from .registry import register, srel

# --- 2.1 / 2.2: fixture and cleaning -------------------------------------

@register("rel_fixture", O.with_rel(
    "SELECT id, query, product_title, product_description, median_relevance, "
    "relevance_variance FROM rel", scrubbed=False))
def q_rel_fixture(spark, sf_dir):
    return relevance_table(spark, sf_dir)


@register("scrub", O.with_rel(
    "SELECT id, query, product_title, product_description FROM srel"))
def q_scrub(spark, sf_dir):
    return srel(spark, sf_dir).select("id", "query", "product_title", "product_description")


# --- 2.3: pair features ------------------------------------------------------

@register("overlap_features", O.with_rel(
    "SELECT id, " + O.r6("len(list_filter(list_distinct(qw), lambda x: list_contains(tw, x)))") + " AS X1, "
    + O.r6("len(qw)") + " AS X2, " + O.r6("len(tw)") + " AS X3, "
    + O.r6("len(list_filter(list_distinct(qw), lambda x: list_contains(tw, x))) / len(qw)") + " AS X4 "
    "FROM (SELECT id, string_split_regex(query, '" + O.WS + "+') AS qw, "
    "string_split_regex(product_title, '" + O.WS + "+') AS tw FROM srel)"))
def q_overlap(spark, sf_dir):
    return FE.overlap_features(srel(spark, sf_dir))


@register("query_minmax_rating", O.with_rel(
    "SELECT s.id, " + O.r6("r.maxr") + " AS maxr, " + O.r6("r.minr") + " AS minr FROM srel s LEFT JOIN "
    "(SELECT query, max(median_relevance) AS maxr, min(median_relevance) AS minr FROM srel "
    "WHERE median_relevance IS NOT NULL GROUP BY query) r ON r.query = s.query"))
def q_minmax(spark, sf_dir):
    return FE.query_minmax_rating(srel(spark, sf_dir))


def _entry_sql() -> str:
    return O.with_rel(
        "SELECT s.id, " + O.r6("len(list_filter(list_distinct(qw), lambda x: list_contains(tw, x)))") + " AS X1, "
        + O.r6("len(qw)") + " AS X2, " + O.r6("len(tw)") + " AS X3, "
        + O.r6("len(list_filter(list_distinct(qw), lambda x: list_contains(tw, x))) / len(qw)") + " AS X4, "
        + O.r6("r.maxr") + " AS maxr, " + O.r6("r.minr") + " AS minr "
        "FROM (SELECT id, query, string_split_regex(query, '" + O.WS + "+') AS qw, "
        "string_split_regex(product_title, '" + O.WS + "+') AS tw FROM srel) s LEFT JOIN "
        "(SELECT query, max(median_relevance) AS maxr, min(median_relevance) AS minr FROM srel "
        "WHERE median_relevance IS NOT NULL GROUP BY query) r ON r.query = s.query")


def overlap_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The minimum slice: rel -> scrub -> (id, X1..X4, maxr, minr)."""
    s = srel(spark, sf_dir)
    return FE.overlap_features(s).join(FE.query_minmax_rating(s), "id")


register("overlap_minmax", _entry_sql())(overlap_minmax)


def _distance_sql() -> str:
    arr_cte, body = O.distance_features_sql()
    return O.with_rel(body, extra=arr_cte)


@register("distance_features", _distance_sql())
def q_distance(spark, sf_dir):
    return FE.distance_features(srel(spark, sf_dir))


@register("query_title_coverage", O.with_rel(
    "SELECT id, CASE WHEN contains(lower(product_title), lower(query)) THEN 1 ELSE 0 END AS qit, "
    + O.r6("ht / qw") + " AS qInT, " + O.r6("hd / qw") + " AS qInD, " + O.r6("qw") + " AS qw, "
    + O.r6("ptw") + " AS ptw, " + O.r6("pdw") + " AS pdw, " + O.r6("ht / qw * qw") + " AS qInT_qWords, "
    + O.r6("ht / qw * ptw") + " AS qInT_ptWords, " + O.r6("ht / qw * pdw") + " AS qInT_pdWords "
    "FROM (SELECT id, query, product_title, len(string_split(query, ' ')) AS qw, "
    "len(string_split(product_title, ' ')) AS ptw, "
    "CASE WHEN product_description IS NULL THEN 1 ELSE len(string_split(product_description, ' ')) END AS pdw, "
    "len(list_filter(string_split(query, ' '), lambda w: contains(lower(product_title), lower(w)))) AS ht, "
    "len(list_filter(string_split(query, ' '), lambda w: coalesce(contains(lower(product_description), lower(w)), false))) AS hd "
    "FROM srel)"))
def q_coverage(spark, sf_dir):
    return FE.query_title_coverage(srel(spark, sf_dir))


@register("query_minmax_rating_loo", O.with_rel(
    "SELECT id, " + O.r6("maxr") + " AS maxr, " + O.r6("minr") + " AS minr FROM ("
    "SELECT id, max(median_relevance) OVER w AS maxr, min(median_relevance) OVER w AS minr "
    "FROM srel WHERE median_relevance IS NOT NULL "
    "WINDOW w AS (PARTITION BY query ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE CURRENT ROW) "
    "UNION ALL SELECT s.id, r.maxr, r.minr FROM srel s LEFT JOIN (SELECT query, max(median_relevance) AS maxr, "
    "min(median_relevance) AS minr FROM srel WHERE median_relevance IS NOT NULL GROUP BY query) r USING (query) "
    "WHERE s.median_relevance IS NULL)"))
def q_minmax_loo(spark, sf_dir):
    """Opt-in leave-one-out rating range: a train row does not see its own label."""
    return FE.query_minmax_rating(srel(spark, sf_dir), leave_one_out=True)


# Single coverage operators of SURVEY 2.3 as column subsets of the coverage pass.
COVERAGE_SQL = {
    "qInT": "ht / qw", "qInD": "hd / qw", "qw": "qw", "ptw": "ptw", "pdw": "pdw",
    "qInT_qWords": "ht / qw * qw", "qInT_ptWords": "ht / qw * ptw", "qInT_pdWords": "ht / qw * pdw",
}
COVERAGE_OPS = {
    "query_coverage": ["qInT"],
    "desc_coverage": ["qInD"],
    "word_counts": ["qw", "ptw", "pdw"],
    "interaction_features": ["qInT_qWords", "qInT_ptWords", "qInT_pdWords"],
}
COVERAGE_FROM = (
    "FROM (SELECT id, query, product_title, len(string_split(query, ' ')) AS qw, "
    "len(string_split(product_title, ' ')) AS ptw, "
    "CASE WHEN product_description IS NULL THEN 1 ELSE len(string_split(product_description, ' ')) END AS pdw, "
    "len(list_filter(string_split(query, ' '), lambda w: contains(lower(product_title), lower(w)))) AS ht, "
    "len(list_filter(string_split(query, ' '), lambda w: coalesce(contains(lower(product_description), "
    "lower(w)), false))) AS hd FROM srel)")


def _coverage_query(cols):
    def q(spark, sf_dir):
        return FE.query_title_coverage(srel(spark, sf_dir)).select("id", *cols)
    return q


for _name, _cols in COVERAGE_OPS.items():
    register(_name, O.with_rel("SELECT id, " + ", ".join(f"{O.r6(COVERAGE_SQL[c])} AS {c}" for c in _cols)
                               + " " + COVERAGE_FROM))(_coverage_query(_cols))
