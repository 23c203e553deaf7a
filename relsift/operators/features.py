"""Row-local query-title features and the per-query rating range.

Every operator here is ``DataFrame -> DataFrame`` keyed by ``id``. Row-local
features are one projection over the input (no explode, no shuffle, no UDF);
array columns needed by several features are built in a first projection that
Catalyst keeps separate (it does not inline non-trivial expressions twice).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pairs as P
from ..functions import text as T

# Output column names and order of the 70 distance features.
DISTANCE_HEADER = (
    "queryentropy,titleentropy,"
    "btitleinquery,longestprefix,longestsuffix,longestQueryPrefixPerc,longestQuerySuffixPerc,"
    "longestTitlePrefixPerc,longestTitleSuffixPerc,"
    "numtitledigits,numquerydigits,numdigitdiff,bindigiteq,charjaccardsim,charcossim,"
    "charquerycount3,chartitlecount3,charngcount3,charngjacc3,charngcos3,"
    "charquerycount4,chartitlecount4,charngcount4,charngjacc4,charngcos4,"
    "charquerycount5,chartitlecount5,charngcount5,charngjacc5,charngcos5,"
    "charquerycount6,chartitlecount6,charngcount6,charngjacc6,charngcos6,"
    "charquerycount7,chartitlecount7,charngcount7,charngjacc7,charngcos7,"
    "wordquerycount1,wordtitlecount1,wordngcount1,leftngcount1,wordngjacc1,wordngcos1,"
    "wordquerycount2,wordtitlecount2,wordngcount2,leftngcount2,wordngjacc2,wordngcos2,"
    "wordquerycount3,wordtitlecount3,wordngcount3,leftngcount3,wordngjacc3,wordngcos3,"
    "wordquerycount4,wordtitlecount4,wordngcount4,leftngcount4,wordngjacc4,wordngcos4,"
    "wordquerycount5,wordtitlecount5,wordngcount5,leftngcount5,wordngjacc5,wordngcos5"
).split(",")
CHAR_Q = range(3, 8)
WORD_BLOCKS = range(1, 6)


def scrub_table(rel: DataFrame, cols=("query", "product_title", "product_description"),
                markup: bool = False) -> DataFrame:
    """Replace the text columns by their scrubbed form."""
    return rel.withColumns({c: T.scrub(c, markup=markup) for c in cols})


def overlap_features(rel: DataFrame) -> DataFrame:
    """``X1`` distinct query words found in the title, ``X2``/``X3`` word counts with
    duplicates (white-space split keeping empties), ``X4 = X1/X2``."""
    w = rel.select("id", T.tokenize_ws("query").alias("_q"), T.tokenize_ws("product_title").alias("_t"))
    x1 = F.size(F.array_intersect("_q", "_t"))
    return w.select(
        "id",
        x1.cast("double").alias("X1"),
        F.size("_q").cast("double").alias("X2"),
        F.size("_t").cast("double").alias("X3"),
        P.safe_div(x1, F.size("_q")).alias("X4"),
    )


def query_rating_range(rel: DataFrame, label: str = "median_relevance") -> DataFrame:
    """Per query: ``maxr``/``minr`` of the label over train rows (partial aggregate)."""
    return (rel.where(F.col(label).isNotNull()).groupBy("query")
            .agg(F.max(label).cast("double").alias("maxr"), F.min(label).cast("double").alias("minr")))


def query_minmax_rating(rel: DataFrame, label: str = "median_relevance",
                        leave_one_out: bool = False) -> DataFrame:
    """Attach the per-query rating range of train to train and test rows.

    As in the reference, a train row sees its own label (a leak). With
    ``leave_one_out`` the range of the *other* train rows of the query is used
    instead, computed from per-(query, label) counts: at most one row per label
    value, so no window over a hot query is needed.
    """
    if not leave_one_out:
        ranges = query_rating_range(rel, label)
        return rel.select("id", "query").join(ranges, "query", "left").select("id", "maxr", "minr")
    # Per (query, label) counts: at most 4 rows per query, so the range without
    # one row comes from these counts without any window over a hot query.
    counts = (rel.where(F.col(label).isNotNull()).groupBy("query", label)
              .agg(F.count(F.lit(1)).alias("_n")))
    per_q = counts.groupBy("query").agg(
        F.collect_list(F.struct(F.col(label).alias("v"), F.col("_n").alias("n"))).alias("_vals"))
    rows = rel.select("id", "query", label).join(per_q, "query", "left")
    others = F.filter("_vals", lambda s: (s["v"] != F.col(label)) | (s["n"] > 1)
                      | F.col(label).isNull())
    vals = F.transform(others, lambda s: s["v"])
    return rows.select("id", F.array_max(vals).cast("double").alias("maxr"),
                       F.array_min(vals).cast("double").alias("minr"))


def distance_features(rel: DataFrame, query: str = "query", title: str = "product_title",
                      true_word_ngrams: bool = False, outcome: str | None = "median_relevance") -> DataFrame:
    """``id`` + the 70 pair features in reference order (+ ``outcome``), one pass.

    Three projections: (1) per item kind (characters, q-grams 3..7, stemmed
    words) the distinct query and title items and the counts with duplicates;
    (2) one intersection size per kind; (3) all set measures from the sizes
    (union = |Q|+|T|-|Q&T|, title-only = |T|-|Q&T|, leftover = |Q|-|Q&T|).
    Each array is built once and each kind needs one ``array_intersect``.

    Word blocks 1..5 are identical by default (the reference never builds word
    n-grams); ``true_word_ngrams=True`` uses word n-grams of size i in block i.
    """
    q, t = F.col(query), F.col(title)
    qw, tw = T.tokenize_word(q), T.tokenize_word(t)
    kinds = {"c": (T.chars(q), T.chars(t))}
    for n in CHAR_Q:
        kinds[str(n)] = (T.char_shingles(q, n), T.char_shingles(t, n))
    keep = ["id", query, title] + ([outcome] if outcome else [])
    stage = {}
    for k, (qa, ta) in kinds.items():
        stage[f"_nq{k}"] = F.size(qa)
        stage[f"_nt{k}"] = F.size(ta)
        stage[f"_dq{k}"] = F.array_distinct(qa)
        stage[f"_dt{k}"] = F.array_distinct(ta)
    stage["_qw"], stage["_tw"] = qw, tw
    a = rel.select(*keep, *[v.alias(name) for name, v in stage.items()])

    word_kinds = []
    extra = {}
    for i in WORD_BLOCKS:
        if true_word_ngrams:
            qa, ta = T.word_ngrams("_qw", i, i), T.word_ngrams("_tw", i, i)
            kk = f"w{i}"
        else:
            qa, ta = F.col("_qw"), F.col("_tw")
            kk = "w"
        if kk not in extra:
            extra[f"_nq{kk}"], extra[f"_nt{kk}"] = F.size(qa), F.size(ta)
            extra[f"_dq{kk}"], extra[f"_dt{kk}"] = F.array_distinct(qa), F.array_distinct(ta)
        word_kinds.append(kk)
    a = a.select("*", *[v.alias(name) for name, v in extra.items()])
    all_kinds = list(kinds) + sorted(set(word_kinds))
    b = a.select("*", *[F.size(F.array_intersect(f"_dq{k}", f"_dt{k}")).alias(f"_i{k}") for k in all_kinds])

    def sizes(k):
        return F.size(f"_dq{k}"), F.size(f"_dt{k}"), F.col(f"_i{k}")

    def union(k):
        nq, nt, i = sizes(k)
        return nq + nt - i

    def title_only(k):
        nq, nt, i = sizes(k)
        return P.safe_div(nt - i, nq + nt - i)

    def ochiai(k):
        nq, nt, i = sizes(k)
        return P.safe_div(i, F.sqrt((nq * nt).cast("double")))

    pre = P.common_prefix(query, title)
    suf = P.common_suffix(query, title)
    lq, lt = F.length(query), F.length(title)
    dq, dt = P.digit_count(query), P.digit_count(title)
    zero = F.lit(0.0)
    cols = [
        P.char_entropy(query), P.char_entropy(title),
        P.contains_flag(title, query), pre, suf,
        F.when(lq == 0, zero).otherwise(pre / lq), F.when(lq == 0, zero).otherwise(suf / lq),
        F.when(lt == 0, zero).otherwise(pre / lt), F.when(lt == 0, zero).otherwise(suf / lt),
        dt, dq, F.abs(dt - dq), F.when(dt == dq, 1).otherwise(0),
        title_only("c"), ochiai("c"),
    ]
    for n in CHAR_Q:
        k = str(n)
        cols += [F.col(f"_nq{k}"), F.col(f"_nt{k}"), union(k), title_only(k), ochiai(k)]
    for k in word_kinds:
        nq, nt, i = sizes(k)
        cols += [F.col(f"_nq{k}"), F.col(f"_nt{k}"), union(k), nq - i, title_only(k), ochiai(k)]
    out = [c.cast("double").alias(name) for c, name in zip(cols, DISTANCE_HEADER)]
    extra_out = [F.col(outcome).cast("double").alias("outcome")] if outcome else []
    return b.select("id", *out, *extra_out)


def _count_or_one(tokens, source: str):
    """Token count; a missing text counts as one word (splitting NA gives one element)."""
    return F.when(F.col(source).isNull(), F.lit(1)).otherwise(F.size(tokens))


def query_title_coverage(rel: DataFrame) -> DataFrame:
    """Features of the boosting scripts: ``qit`` (raw query found in the title,
    literal and case-insensitive), ``qc``/``qInT`` (share of query words found as
    substrings of the title), ``qInD`` (same on the description, null -> 0), word
    counts ``qw, ptw, pdw`` (single-space split; a null description counts 1) and
    the interactions ``qInT*qw``, ``qInT*ptw``, ``qInT*pdw``."""
    words = T.tokenize_space("query")
    lt = F.lower(F.col("product_title"))
    ld = F.lower(F.col("product_description"))
    base = rel.select(
        "id", "query", "product_title",
        words.alias("_w"),
        _count_or_one(T.tokenize_space("product_title"), "product_title").alias("ptw"),
        _count_or_one(T.tokenize_space("product_description"), "product_description").alias("pdw"),
        F.contains(lt, F.lower(F.col("query"))).alias("_qit"),
        F.size(F.filter(words, lambda w: F.contains(lt, F.lower(w)))).alias("_hit_t"),
        F.size(F.filter(words, lambda w: F.coalesce(F.contains(ld, F.lower(w)), F.lit(False))))
        .alias("_hit_d"),
    )
    qw = F.size("_w")
    q_in_t = P.safe_div(F.col("_hit_t"), qw)
    return base.select(
        "id",
        F.col("_qit").cast("int").alias("qit"),
        q_in_t.alias("qInT"),
        P.safe_div(F.col("_hit_d"), qw).alias("qInD"),
        qw.cast("double").alias("qw"),
        F.col("ptw").cast("double").alias("ptw"),
        F.col("pdw").cast("double").alias("pdw"),
        (q_in_t * qw).alias("qInT_qWords"),
        (q_in_t * F.col("ptw")).alias("qInT_ptWords"),
        (q_in_t * F.col("pdw")).alias("qInT_pdWords"),
    )


def query_in_title_regex(rel: DataFrame) -> DataFrame:
    """Opt-in regex form of ``qit``: the raw query as a case-insensitive pattern.
    Fails on an invalid pattern, as the reference would."""
    return rel.select("id", F.col("product_title").rlike(F.concat(F.lit("(?i)"), F.col("query")))
                      .cast("int").alias("qit"))
