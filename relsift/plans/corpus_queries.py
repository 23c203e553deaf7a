"""Registered queries: corpus statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.arrays import explode_rows
from ..functions.stopwords import ENGLISH_STOPWORDS
from ..operators import corpus as C
from . import oracle as O
from ..session import materialize
from .registry import register, srel, srel_shared

MIN_COUNT = C.MIN_COUNT
MIN_LEN = C.MIN_WORD_LEN
CLOSEST_LIMIT = 10

# --- oracle building blocks ----------------------------------------------------

CORPUS_CTES = """
corp AS (SELECT DISTINCT text FROM (SELECT product_title AS text FROM srel
                                    UNION ALL SELECT product_description FROM srel) WHERE text IS NOT NULL),
ndocs AS (SELECT count(*) AS n FROM corp),
dw AS (SELECT md5(text) AS d, list_distinct(list_filter(string_split(text, ' '), lambda x: x <> '')) AS words FROM corp),
tokw AS (SELECT d, unnest(words) AS word FROM dw),
dfc AS (SELECT word, count(*) AS n FROM tokw GROUP BY word)"""

PRUNED_VOCAB = f"""
pdfc AS (SELECT word, n FROM dfc WHERE n >= {MIN_COUNT} AND length(word) >= {MIN_LEN})"""

# pairs of all words
ALL_PAIRS_CTE = """
pairs AS (
  SELECT a.word AS word1, b.word AS word2, count(*) AS n FROM tokw a JOIN tokw b ON a.d = b.d AND a.word < b.word GROUP BY 1, 2)"""

# pairs of the pruned vocabulary
PAIRS_CTE = PRUNED_VOCAB + """,
ptok AS (SELECT tokw.* FROM tokw JOIN pdfc USING (word)),
pairs AS (
  SELECT a.word AS word1, b.word AS word2, count(*) AS n FROM ptok a JOIN ptok b ON a.d = b.d AND a.word < b.word GROUP BY 1, 2)"""

PRUNED_CTES = f"""
ppairs AS (SELECT p.* FROM pairs p WHERE p.n >= {MIN_COUNT})"""

# pairs that some (query, title) row needs
NEEDED_CTE = """
need AS (SELECT DISTINCT least(a, b) AS word1, greatest(a, b) AS word2 FROM (
    SELECT unnest(q) AS a, t FROM (SELECT list_filter(string_split(query, ' '), lambda x: x <> '') AS q,
      list_filter(string_split(product_title, ' '), lambda x: x <> '') AS t FROM srel)), LATERAL (SELECT unnest(t) AS b)
  WHERE a <> b),
npairs AS (SELECT n.word1, n.word2, count(*) AS n FROM need n JOIN tokw a ON a.word = n.word1
  JOIN tokw b ON b.word = n.word2 AND b.d = a.d GROUP BY 1, 2)"""

NEEDED_PRUNED = PRUNED_VOCAB + f""",
nppairs AS (SELECT * FROM npairs WHERE n >= {MIN_COUNT})"""


def dist_cte(name: str, pairs: str, dfc: str) -> str:
    return f"""
{name} AS (
  SELECT p.word1, p.word2,
         CASE WHEN ln((SELECT n FROM ndocs)) - least(ln(d1.n), ln(d2.n)) = 0 THEN NULL
              ELSE (greatest(ln(d1.n), ln(d2.n)) - ln(p.n)) / (ln((SELECT n FROM ndocs)) - least(ln(d1.n), ln(d2.n)))
         END AS distance
  FROM {pairs} p JOIN {dfc} d1 ON d1.word = p.word1 JOIN {dfc} d2 ON d2.word = p.word2)"""


def phrase_sql(dist: str, rounded: bool = True) -> str:
    value = "CASE WHEN coalesce(x.num, 0) = 0 THEN 'inf'::double WHEN x.s = 0 THEN 0.0 ELSE x.s / x.num END"
    return f"""
SELECT r.id, {O.r6(value) if rounded else value} AS distance
FROM srel r LEFT JOIN (
  SELECT pr.id, count(dd.distance) AS num, sum(dd.distance) AS s
  FROM (SELECT id, unnest(qw) AS w1, tw FROM (
          SELECT id, list_filter(string_split(query, ' '), lambda x: x <> '') AS qw,
                 list_filter(string_split(product_title, ' '), lambda x: x <> '') AS tw FROM srel)) q,
       LATERAL (SELECT q.id, q.w1, unnest(q.tw) AS w2) pr
  LEFT JOIN {dist} dd ON dd.word1 = least(pr.w1, pr.w2) AND dd.word2 = greatest(pr.w1, pr.w2)
  WHERE pr.w1 <> pr.w2
  GROUP BY pr.id) x ON x.id = r.id"""


def _c(body: str, *extra: str) -> str:
    return O.with_rel(body, extra=",".join([CORPUS_CTES, *extra]))


# --- Spark side ---------------------------------------------------------------

def _corpus(spark, sf_dir):
    s = srel_shared(spark, sf_dir)
    return s, C.corpus_a(s, stored=True)


@register("corpus_size", _c("SELECT n AS N FROM ndocs"))
def q_corpus_size(spark, sf_dir):
    return C.corpus_size(_corpus(spark, sf_dir)[1])


@register("word_document_frequency", _c("SELECT word, n FROM dfc"))
def q_df(spark, sf_dir):
    return C.word_document_frequency(_corpus(spark, sf_dir)[1])


def _pruned_pairs(corp):
    """The pruned vocabulary and the counts of all its pairs."""
    vocab = materialize(C.pruned_vocabulary(C.word_document_frequency(corp)))
    return vocab, C.word_cooccurrence(corp, keep_words=vocab)


@register("word_cooccurrence", _c("SELECT word1, word2, n FROM pairs", ALL_PAIRS_CTE))
def q_cooc(spark, sf_dir):
    """Pairs of all words; the table is quadratic in the words of a text."""
    return C.word_cooccurrence(_corpus(spark, sf_dir)[1])


@register("sink_dictionary", _c(
    "SELECT word AS word1, '' AS word2, n AS co FROM pdfc UNION ALL SELECT word1, word2, n AS co FROM ppairs",
    PAIRS_CTE, PRUNED_CTES))
def q_dictionary(spark, sf_dir):
    """The pruned dictionary written as ``word1,word2,co`` CSV and read back; the blank
    ``word2`` of a count row is kept as an empty string, not null."""
    from ..sources import files as IO
    corp = _corpus(spark, sf_dir)[1]
    d = C.dictionary(*C.cooccurrence_pruned(corp))
    path = IO.write_csv(d, IO.scratch_dir(spark, "dictionary"))
    return (spark.read.option("header", True).schema("word1 string, word2 string, co long").csv(path)
            .withColumn("word2", F.coalesce("word2", F.lit(""))))


@register("cooccurrence_pruned", _c(
    "SELECT word AS word1, '' AS word2, n AS co FROM pdfc UNION ALL SELECT word1, word2, n AS co FROM ppairs",
    PAIRS_CTE, PRUNED_CTES))
def q_pruned(spark, sf_dir):
    corp = _corpus(spark, sf_dir)[1]
    vocab, pairs = C.cooccurrence_pruned(corp)
    return C.dictionary(vocab, pairs)


@register("normalized_distance", _c(
    "SELECT word1, word2, " + O.r6("distance") + " AS distance FROM dist",
    PAIRS_CTE, dist_cte("dist", "pairs", "pdfc")))
def q_norm_dist(spark, sf_dir):
    corp = _corpus(spark, sf_dir)[1]
    vocab, pairs = _pruned_pairs(corp)
    return C.normalized_distance(pairs, vocab, C.corpus_size(corp))


@register("pair_distance", _c(
    "SELECT n.word1, n.word2, CASE WHEN p.n IS NULL THEN 'inf'::double ELSE " + O.r6("d.distance") + " END AS distance "
    "FROM need n LEFT JOIN npairs p USING (word1, word2) LEFT JOIN dist d USING (word1, word2)",
    NEEDED_CTE, dist_cte("dist", "npairs", "dfc")))
def q_pair_distance(spark, sf_dir):
    """Distance of given pairs (those of the query and title words), +inf when absent."""
    s, corp = _corpus(spark, sf_dir)
    return C.pair_distance(C.query_title_pairs(s), corp)


@register("phrase_distance", _c(phrase_sql("dist"), NEEDED_CTE, dist_cte("dist", "npairs", "dfc")))
def q_phrase(spark, sf_dir):
    s, corp = _corpus(spark, sf_dir)
    return C.phrase_distance(s, corp)


@register("phrase_distance_pruned", _c(phrase_sql("pdist"), NEEDED_CTE, NEEDED_PRUNED,
                                        dist_cte("pdist", "nppairs", "pdfc")))
def q_phrase_pruned(spark, sf_dir):
    s, corp = _corpus(spark, sf_dir)
    return C.phrase_distance(s, corp, pruned=True)


CLOSEST_SQL = f"""
SELECT c.word, c.partner, c.n, c.co_rank, {O.r6("d.distance")} AS distance,
  cast(row_number() OVER (PARTITION BY c.word ORDER BY d.distance NULLS LAST, c.co_rank) AS integer) AS dist_rank
FROM (
  SELECT word, partner, n, cast(row_number() OVER (PARTITION BY word ORDER BY n DESC, partner) AS integer) AS co_rank
  FROM (SELECT word1 AS word, word2 AS partner, n FROM ppairs
        UNION ALL SELECT word2 AS word, word1 AS partner, n FROM ppairs)
  WHERE word IN (SELECT DISTINCT unnest(string_split(query, ' ')) FROM srel)
    AND word IN (SELECT word2 FROM ppairs)
    AND word IN (SELECT word1 FROM ppairs UNION SELECT word FROM pdfc)) c
LEFT JOIN pdist d ON d.word1 = least(c.word, c.partner) AND d.word2 = greatest(c.word, c.partner)
WHERE c.co_rank <= {CLOSEST_LIMIT}"""


@register("closest_words", _c(CLOSEST_SQL, PAIRS_CTE, PRUNED_CTES, dist_cte("pdist", "ppairs", "pdfc")))
def q_closest(spark, sf_dir):
    # the texts are read once, into the corpus, and the queries apart: nothing to store
    s = srel(spark, sf_dir)
    return C.closest_words_of(explode_rows(s, F.split("query", " "), "word"), C.corpus_a(s), limit=CLOSEST_LIMIT)


DIST_BY_CLASS_SQL = """
SELECT r.median_relevance AS class, count(*) AS n, count(f) AS n_finite, {mn} AS min, {q1} AS q1,
       {md} AS median, {q3} AS q3, {mx} AS max
FROM (SELECT id, CASE WHEN distance <> 'inf'::double THEN distance END AS f FROM phr) p
JOIN srel r ON r.id = p.id WHERE r.median_relevance IS NOT NULL GROUP BY 1"""


@register("distance_by_class", _c(
    DIST_BY_CLASS_SQL.format(mn=O.r6("min(f)"), q1=O.r6("quantile_cont(f, 0.25)"),
                             md=O.r6("quantile_cont(f, 0.5)"), q3=O.r6("quantile_cont(f, 0.75)"),
                             mx=O.r6("max(f)")),
    NEEDED_CTE, dist_cte("dist", "npairs", "dfc"), "phr AS (" + phrase_sql("dist", rounded=False) + ")"))
def q_dist_by_class(spark, sf_dir):
    s, corp = _corpus(spark, sf_dir)
    rated = s.where(F.col("median_relevance").isNotNull())  # the corpus has the texts of all rows
    return C.distance_by_class(C.phrase_distance(rated, corp), rated)


# --- top terms and indicators ------------------------------------------------------

def sql_term_text(col: str, stop: bool) -> str:
    x = f"lower({col})"
    if stop:
        words = ", ".join("'" + w.replace("'", "''") + "'" for w in ENGLISH_STOPWORDS)
        x = f"array_to_string(list_filter(string_split({x}, ' '), lambda t: NOT list_contains([{words}], t)), ' ')"
    mark = "\ue000"
    for _ in range(2):
        x = f"regexp_replace({x}, '(\\w)-(\\w)', '\\1{mark}\\2', 'g')"
    x = f"regexp_replace({x}, '[[:punct:]]', '', 'g')"
    return f"replace({x}, '{mark}', '-')"


def top_terms_sql(col: str, n: int, lower: int, stop: bool, src: str = "srel") -> str:
    return f"""
SELECT term, count, cast(row_number() OVER (ORDER BY count DESC, term) AS integer) AS rank FROM (
  SELECT term, count(*) AS count FROM (
    SELECT unnest(string_split_regex({sql_term_text(col, stop)}, '{O.WS}')) AS term FROM {src})
  WHERE term <> '' GROUP BY term HAVING count(*) > {lower}
  ORDER BY count DESC, term LIMIT {n})"""


def _train(spark, sf_dir):
    return srel(spark, sf_dir).where(F.col("median_relevance").isNotNull())


@register("top_terms", O.with_rel(top_terms_sql("product_title", 250, 0, True, "train"),
                                  extra="train AS (SELECT * FROM srel WHERE median_relevance IS NOT NULL)"))
def q_top_terms(spark, sf_dir):
    return C.top_terms(_train(spark, sf_dir), "product_title", 250, 0, ENGLISH_STOPWORDS).withColumn(
        "rank", F.col("rank").cast("int"))


@register("top_terms_description", O.with_rel(
    top_terms_sql("product_description", 250, 0, True, "train"),
    extra="train AS (SELECT * FROM srel WHERE median_relevance IS NOT NULL)"))
def q_top_terms_desc(spark, sf_dir):
    return C.top_terms(_train(spark, sf_dir), "product_description", 250, 0, ENGLISH_STOPWORDS).withColumn(
        "rank", F.col("rank").cast("int"))


@register("top_terms_bounded", O.with_rel(top_terms_sql("product_title", 150, 20, False, "train"),
                                          extra="train AS (SELECT * FROM srel WHERE median_relevance IS NOT NULL)"))
def q_top_terms_150(spark, sf_dir):
    return C.top_terms(_train(spark, sf_dir), "product_title", 150, 20).withColumn(
        "rank", F.col("rank").cast("int"))


@register("term_indicators", O.with_rel(
    "SELECT s.id, 'pt_' || v.term AS term FROM srel s, vocab v "
    f"WHERE contains({sql_term_text('s.product_title', True)}, v.term)",
    extra="train AS (SELECT * FROM srel WHERE median_relevance IS NOT NULL), vocab AS ("
    + top_terms_sql("product_title", 250, 0, True, "train") + ")"))
def q_indicators(spark, sf_dir):
    s = srel(spark, sf_dir)
    vocab = [r["term"] for r in C.top_terms(_train(spark, sf_dir), "product_title", 250, 0,
                                            ENGLISH_STOPWORDS).select("term").collect()]  # <= 250 words
    return C.term_indicators(s, "product_title", vocab, "pt_", ENGLISH_STOPWORDS)
