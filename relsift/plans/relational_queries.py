"""Registered queries: the single pair measures of SURVEY 2.3 (each a column
subset of the one-pass distance features; Catalyst prunes the rest) and the
joins, filters and set operations of SURVEY 2.4."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluate as EV
from ..operators import features as FE
from . import oracle as O
from .registry import register, srel, srel_shared

# pair measure -> its columns of the distance feature header
PAIR_OPS = {
    "char_entropy": ["queryentropy", "titleentropy"],
    "title_contains_query": ["btitleinquery"],
    "common_prefix": ["longestprefix"],
    "common_suffix": ["longestsuffix"],
    "prefix_suffix_share": ["longestQueryPrefixPerc", "longestQuerySuffixPerc",
                            "longestTitlePrefixPerc", "longestTitleSuffixPerc"],
    "digit_features": ["numtitledigits", "numquerydigits", "numdigitdiff", "bindigiteq"],
    "title_only_share_char": ["charjaccardsim"],
    "ochiai_char": ["charcossim"],
    "char_ngram_block": [f"{p}{n}" for n in range(3, 8)
                         for p in ("charquerycount", "chartitlecount", "charngcount", "charngjacc", "charngcos")],
    "title_only_share": ["wordngjacc1"],
    "ochiai": ["wordngcos1"],
    "union_term_count": ["wordngcount1"],
    "query_leftover": ["leftngcount1"],
    "word_block": [f"{p}{i}" for i in range(1, 6)
                   for p in ("wordquerycount", "wordtitlecount", "wordngcount", "leftngcount", "wordngjacc",
                             "wordngcos")],
}


def _pair_sql(cols: list[str]) -> str:
    arr_cte, _ = O.distance_features_sql()
    exprs = dict(O.distance_select())
    sel = ", ".join(f"{O.r6(exprs[c])} AS {c}" for c in cols)
    return O.with_rel(f"SELECT id, {sel} FROM arr", extra=arr_cte)


def _pair_query(cols):
    def q(spark, sf_dir):
        return FE.distance_features(srel(spark, sf_dir), outcome=None).select("id", *cols)
    return q


for _name, _cols in PAIR_OPS.items():
    register(_name, _pair_sql(_cols))(_pair_query(_cols))


@register("query_in_title", O.with_rel(
    "SELECT id, CASE WHEN contains(lower(product_title), lower(query)) THEN 1 ELSE 0 END AS qit FROM srel"))
def q_query_in_title(spark, sf_dir):
    return FE.query_title_coverage(srel(spark, sf_dir)).select("id", "qit")


# --- joins, filters, set operations ---------------------------------------------------

@register("join_merge", O.with_rel(
    "SELECT mx.query, mx.maxr, mn.minr FROM "
    "(SELECT query, max(median_relevance) AS maxr FROM srel WHERE median_relevance IS NOT NULL GROUP BY query) mx "
    "JOIN (SELECT query, min(median_relevance) AS minr FROM srel WHERE median_relevance IS NOT NULL GROUP BY query) mn "
    "USING (query)"))
def q_join_merge(spark, sf_dir):
    train = srel(spark, sf_dir).where(F.col("median_relevance").isNotNull())
    mx = train.groupBy("query").agg(F.max("median_relevance").alias("maxr"))
    mn = train.groupBy("query").agg(F.min("median_relevance").alias("minr"))
    return mx.join(mn, "query", "inner")


@register("join_positional", O.with_rel(
    "SELECT o.id, " + O.r6("len(list_filter(list_distinct(string_split_regex(query, '" + O.WS + "+')), "
                          "lambda x: list_contains(string_split_regex(product_title, '" + O.WS + "+'), x)))")
    + " AS X1, CASE WHEN contains(lower(product_title), lower(query)) THEN 1 ELSE 0 END AS qit FROM srel o"))
def q_join_positional(spark, sf_dir):
    """Side-by-side blocks are joined on ``id``; the reference's length check is
    a full-outer count of unmatched ids (must be 0)."""
    s = srel(spark, sf_dir)
    a = FE.overlap_features(s).select("id", "X1")
    b = FE.query_title_coverage(s).select("id", "qit")
    unmatched = (a.join(b, "id", "full_outer").where(F.col("X1").isNull() | F.col("qit").isNull())
                 .limit(1).count())  # 0 or 1 row to the driver
    if unmatched:
        raise ValueError("blocks have different ids")
    return a.join(b, "id")


@register("anti_join", O.with_rel(
    "SELECT id FROM srel WHERE median_relevance IS NOT NULL AND id NOT IN (SELECT id FROM folds WHERE fold = 1)",
    extra="folds AS (SELECT id, cast((row_number() OVER (PARTITION BY median_relevance "
          "ORDER BY md5('0:' || cast(id AS varchar)), id) - 1) % 10 + 1 AS integer) AS fold "
          "FROM srel WHERE median_relevance IS NOT NULL)"))
def q_anti_join(spark, sf_dir):
    train = srel(spark, sf_dir).where(F.col("median_relevance").isNotNull())
    folds = EV.stratified_folds(train.select("id", "median_relevance"), k=10, seed=0)
    return train.select("id").join(folds.where(F.col("fold") == 1).select("id"), "id", "left_anti")


# The columns named as weak in the forest script.
DROP_COLS = ["wordngcount2", "leftngcount2", "wordngjacc2", "wordngcount3", "leftngcount3", "wordngjacc3",
             "wordngcount4", "leftngcount4", "wordngjacc4", "wordngcount5", "leftngcount5", "wordngjacc5"]


@register("filter_drop_columns", _pair_sql([c for c in FE.DISTANCE_HEADER if c not in DROP_COLS]))
def q_drop(spark, sf_dir):
    return FE.distance_features(srel(spark, sf_dir), outcome=None).drop(*DROP_COLS)


@register("set_union_all", O.with_rel(
    "SELECT 'B' AS corpus, id, query AS text FROM srel UNION ALL SELECT 'C' AS corpus, id, product_title FROM srel"))
def q_union_all(spark, sf_dir):
    s = srel(spark, sf_dir)
    return (s.select(F.lit("B").alias("corpus"), "id", F.col("query").alias("text"))
            .unionByName(s.select(F.lit("C").alias("corpus"), "id", F.col("product_title").alias("text"))))


@register("set_union_distinct", O.with_rel(
    "SELECT DISTINCT text FROM (SELECT product_title AS text FROM srel UNION ALL "
    "SELECT product_description FROM srel) WHERE text IS NOT NULL"))
def q_union_distinct(spark, sf_dir):
    s = srel(spark, sf_dir)
    return (s.select(F.col("product_title").alias("text")).unionByName(s.select(F.col("product_description").alias("text")))
            .where(F.col("text").isNotNull()).distinct())


_WORD_SETS = ("(SELECT id, list_filter(string_split(query, ' '), lambda x: x <> '') AS q, "
              "list_filter(string_split(product_title, ' '), lambda x: x <> '') AS t FROM srel)")


def _set_sql(test: str) -> str:
    return (f"SELECT id, unnest(list_filter(list_distinct(q), lambda x: {test} list_contains(t, x))) AS word "
            f"FROM {_WORD_SETS}")


def _word_sets(spark, sf_dir, combine):
    from ..functions.arrays import explode_rows
    s = srel(spark, sf_dir)
    sets = s.select("id", combine(T.tokenize_nonempty("query"), T.tokenize_nonempty("product_title")).alias("w"))
    return explode_rows(sets, F.col("w"), "word", "id")


@register("set_intersect", O.with_rel(_set_sql("")))
def q_set_intersect(spark, sf_dir):
    """Words of the query that the title has."""
    return _word_sets(spark, sf_dir, F.array_intersect)


@register("set_except", O.with_rel(_set_sql("NOT")))
def q_set_except(spark, sf_dir):
    """Words of the query that the title lacks."""
    return _word_sets(spark, sf_dir, F.array_except)


@register("set_intersect_except", O.with_rel(
    f"SELECT id, len(list_filter(list_distinct(q), lambda x: list_contains(t, x))) AS n_common, "
    f"len(list_filter(list_distinct(q), lambda x: NOT list_contains(t, x))) AS n_query_only FROM {_WORD_SETS}"))
def q_set_ops(spark, sf_dir):
    s = srel(spark, sf_dir)
    q, t = T.tokenize_nonempty("query"), T.tokenize_nonempty("product_title")
    return s.select("id", F.size(F.array_intersect(q, t)).alias("n_common"),
                    F.size(F.array_except(q, t)).alias("n_query_only"))


@register("sort_unordered_pair", O.with_rel(
    "SELECT DISTINCT least(a, b) AS word1, greatest(a, b) AS word2 FROM ("
    "SELECT unnest(q) AS a, t FROM (SELECT list_filter(string_split(query, ' '), lambda x: x <> '') AS q, "
    "list_filter(string_split(product_title, ' '), lambda x: x <> '') AS t FROM srel)), LATERAL (SELECT unnest(t) AS b) "
    "WHERE a <> b"))
def q_sort_pair(spark, sf_dir):
    from ..functions.arrays import explode_rows
    s = srel(spark, sf_dir).select(T.tokenize_nonempty("query").alias("q"), T.tokenize_nonempty("product_title").alias("t"))
    a = explode_rows(s, F.col("q"), "a", "t")
    b = explode_rows(a, F.col("t"), "b", "a")
    return (b.where(F.col("a") != F.col("b"))
            .select(F.least("a", "b").alias("word1"), F.greatest("a", "b").alias("word2")).distinct())



_RANGES_SQL = ("(SELECT query, max(median_relevance) AS maxr, min(median_relevance) AS minr FROM srel "
               "WHERE median_relevance IS NOT NULL GROUP BY query)")


@register("join_lookup_left", O.with_rel(
    "SELECT s.id, s.query, r.maxr, r.minr FROM srel s LEFT JOIN " + _RANGES_SQL + " r USING (query)"))
def q_join_lookup(spark, sf_dir):
    """Every row with its query's rating range, null for a query unseen in train."""
    s = srel(spark, sf_dir)
    ranges = (s.where(F.col("median_relevance").isNotNull()).groupBy("query")
              .agg(F.max("median_relevance").alias("maxr"), F.min("median_relevance").alias("minr")))
    return s.select("id", "query").join(ranges, "query", "left")


@register("filter_min_count_len", O.with_rel(
    "SELECT word, count(*) AS n FROM (SELECT id, unnest(list_distinct(list_filter(string_split(product_title, ' '), "
    "lambda x: x <> ''))) AS word FROM srel) GROUP BY word HAVING count(*) >= 20 AND length(word) >= 2"))
def q_filter_min_count(spark, sf_dir):
    """Title words in at least 20 rows and of at least 2 letters."""
    from ..functions.arrays import explode_rows
    from ..operators import corpus as C
    s = srel(spark, sf_dir).select("id", F.array_distinct(T.tokenize_nonempty("product_title")).alias("w"))
    counts = explode_rows(s, F.col("w"), "word").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return C.pruned_vocabulary(counts)


@register("topk_by_count", O.with_rel(
    "SELECT query, n, rank FROM (SELECT query, count(*) AS n, cast(row_number() OVER (ORDER BY count(*) DESC, query) "
    "AS integer) AS rank FROM srel GROUP BY query) WHERE rank <= 20"))
def q_topk(spark, sf_dir):
    """The 20 most frequent queries (a top-k report)."""
    from pyspark.sql import Window
    counts = srel(spark, sf_dir).groupBy("query").agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.desc("n"), "query").limit(20)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "query")))


def _sort_asc_sql() -> str:
    from .corpus_queries import NEEDED_CTE, _c, dist_cte
    return _c("SELECT word1, word2, " + O.r6("distance") + " AS distance, row_number() OVER (ORDER BY " + O.r6("distance") + ", word1, "
              "word2) AS rank FROM dist WHERE distance IS NOT NULL", NEEDED_CTE, dist_cte("dist", "npairs", "dfc"))


@register("sort_asc", _sort_asc_sql())
def q_sort_asc(spark, sf_dir):
    """The finite distances of the given pairs in ascending order, with their rank."""
    from ..operators import corpus as C
    from ..operators.skew import rank_within
    s = srel_shared(spark, sf_dir)
    dist = C.pair_distance(C.query_title_pairs(s), C.corpus_a(s, stored=True))
    finite = dist.where(F.col("distance").isNotNull() & (F.col("distance") != F.lit(float("inf"))))
    finite = finite.withColumn("distance", F.round("distance", 6))  # one order in both engines
    return rank_within(finite, [], ["distance", "word1", "word2"], out="rank").select(
        "word1", "word2", "distance", F.col("rank").cast("long").alias("rank"))
