"""Registered queries: text cleaning, tokens, vocabulary tables and TF-IDF
(SURVEY 2.2 and the TF-IDF rows of 2.5). Token operators run over the whole
``documents`` texts; TF-IDF runs over the ``rel`` documents (query + title)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.arrays import explode_rows
from ..functions.stopwords import ENGLISH_STOPWORDS
from ..operators import forms as FM
from ..operators import tfidf as TF
from ..sources.fixture import read_table
from ..session import materialize
from . import oracle as O
from .registry import register, srel, srel_shared

WS = O.WS
STOP_SQL = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in ENGLISH_STOPWORDS) + "]"


def docs(spark, sf_dir):
    return read_table(spark, sf_dir, "documents")


# --- row-local cleaning and tokens over whole documents -------------------------------

def _markup_sql() -> str:
    x = f"lower(regexp_replace(html, '{WS}', ' ', 'g'))"
    steps = [(r"\.[a-z]+" + WS, " "), (r"\b[a-z]+\.[a-z]+\b", " "), (r"\b[a-z-]+:[^;]+;", " "),
             (r"\b(li|ul|hr|h1|h2|h3|h4|h5|body|p|div|table)\b", " "), ("'", ""), (":", " "),
             (r"\.", " "), ("<[a-z]+>", ""), ("</[a-z]+>", "")]
    for pat, rep in steps:
        pat = pat.replace("'", "''")
        x = f"regexp_replace({x}, '{pat}', '{rep}', 'g')"
    x = f"regexp_replace({x}, '[^a-z 0-9-]', '', 'g')"
    x = f"regexp_replace({x}, ' +', ' ', 'g')"
    return f"SELECT page_id, regexp_replace({x}, '^ ', '') AS text FROM pages"



@register("scrub_markup", _markup_sql())
def q_scrub_markup(spark, sf_dir):
    pages = read_table(spark, sf_dir, "pages")
    return pages.select("page_id", T.scrub("html", markup=True).alias("text"))



@register("combine_text", O.with_rel(
    "SELECT id, concat_ws(' ', query, product_title) AS doc2, "
    "concat_ws(' ', query, product_title, product_description) AS doc3 FROM srel"))
def q_combine(spark, sf_dir):
    s = srel(spark, sf_dir)
    return s.select("id", T.combine_text("query", "product_title").alias("doc2"),
                    T.combine_text("query", "product_title", "product_description").alias("doc3"))


def _token_rows(spark, sf_dir, tokens):
    """``doc_id, pos, token`` of every document."""
    return docs(spark, sf_dir).select("doc_id", F.posexplode(tokens).alias("pos", "token"))


def _token_sql(tokens: str) -> str:
    return (f"SELECT doc_id, cast(unnest(range(0, len(t))) AS integer) AS pos, unnest(t) AS token "
            f"FROM (SELECT doc_id, {tokens} AS t FROM documents)")


@register("tokenize_ws", _token_sql(f"string_split_regex(text, '{WS}+')"))
def q_tok_ws(spark, sf_dir):
    return _token_rows(spark, sf_dir, T.tokenize_ws("text"))


@register("tokenize_space", _token_sql("string_split(text, ' ')"))
def q_tok_space(spark, sf_dir):
    return _token_rows(spark, sf_dir, T.tokenize_space("text"))


@register("tokenize_nonempty", _token_sql("list_filter(string_split(text, ' '), lambda x: x <> '')"))
def q_tok_nonempty(spark, sf_dir):
    return _token_rows(spark, sf_dir, T.tokenize_nonempty("text"))


@register("tokenize_word", _token_sql(O.sql_words('text')))
def q_tok_word(spark, sf_dir):
    return _token_rows(spark, sf_dir, T.tokenize_word("text"))


@register("normalize_text", f"""
SELECT doc_id, trim(regexp_replace(regexp_replace(lower(regexp_replace(text, '{WS}', ' ', 'g')),
       '[^\\p{{L}}\\p{{N}} ]', '', 'g'), ' +', ' ', 'g')) AS text FROM documents""")
def q_normalize(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.normalize_text("text").alias("text"))


@register("remove_stopwords", _token_sql(
    f"list_filter(string_split(lower(text), ' '), lambda t: NOT list_contains({STOP_SQL}, t))"))
def q_stopwords(spark, sf_dir):
    return _token_rows(spark, sf_dir, T.remove_stopwords(F.split(F.lower("text"), " ", -1), ENGLISH_STOPWORDS))


def _punct_sql(x: str) -> str:
    mark = "\ue000"
    for _ in range(2):
        x = f"regexp_replace({x}, '(\\w)-(\\w)', '\\1{mark}\\2', 'g')"
    return f"replace(regexp_replace({x}, '[[:punct:]]', '', 'g'), '{mark}', '-')"


@register("remove_punct_keep_dash", f"SELECT doc_id, {_punct_sql('text')} AS text FROM documents")
def q_punct(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.remove_punct_keep_dash("text").alias("text"))


# --- term tables ------------------------------------------------------------------------

def _tf_sql(src: str, terms: str) -> str:
    """(id, term, tf) from a term-list expression over ``src`` rows."""
    return f"SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({terms}) AS term FROM {src}) GROUP BY 1, 2"


def _nb_tokens_sql(c: str) -> str:
    norm = (f"trim(regexp_replace(regexp_replace(lower(regexp_replace({c}, '{WS}', ' ', 'g')), "
            f"'[^\\p{{L}}\\p{{N}} ]', '', 'g'), ' +', ' ', 'g'))")
    toks = f"list_filter(string_split_regex({norm}, '{WS}+'), lambda x: x <> '')"
    return f"list_transform({toks}, lambda w: {O.sql_stem('w')})"


def _bigrams_sql(toks: str) -> str:
    tagged = f"list_concat(list_concat(['<s>'], {toks}), ['</s>'])"
    return (f"list_transform(range(1, len({tagged})), "
            f"lambda i: {tagged}[i] || ' ' || {tagged}[i + 1])")


@register("word_bigrams_tagged", O.with_rel(_tf_sql(
    "(SELECT id, " + _nb_tokens_sql("query || ' ' || product_title") + " AS tk FROM srel)",
    _bigrams_sql("tk"))))
def q_bigrams(spark, sf_dir):
    s = srel(spark, sf_dir)
    toks = F.transform(F.filter(T.tokenize_ws(T.normalize_text(T.combine_text("query", "product_title"))),
                                lambda x: x != ""), T.s_stem)
    return TF.term_counts(TF.staged_terms(s, toks, T.word_bigrams_tagged), F.col("_terms"))


def _ngrams_sql(toks: str, n_min: int, n_max: int) -> str:
    parts = [f"CASE WHEN len({toks}) >= {n} THEN list_transform(range(1, len({toks}) - {n} + 2), "
             f"lambda i: array_to_string(list_slice({toks}, i, i + {n} - 1), ' ')) ELSE []::varchar[] END"
             for n in range(n_min, n_max + 1)]
    out = parts[0]
    for p in parts[1:]:
        out = f"list_concat({out}, {p})"
    return out


@register("word_ngrams", O.with_rel(_tf_sql(
    "(SELECT id, list_filter(string_split(query || ' ' || product_title, ' '), lambda x: x <> '') AS tk FROM srel)",
    _ngrams_sql("tk", 1, 3))))
def q_word_ngrams(spark, sf_dir):
    s = srel(spark, sf_dir)
    toks = T.tokenize_nonempty(T.combine_text("query", "product_title"))
    return TF.term_counts(TF.staged_terms(s, toks, lambda t: T.word_ngrams(t, 1, 3)), F.col("_terms"))


@register("char_shingles", O.with_rel(_tf_sql("srel", O.sql_shingles("product_title", 3))))
def q_shingles(spark, sf_dir):
    s = srel(spark, sf_dir)
    return TF.term_counts(s, T.char_shingles("product_title", 3))


def _char_wb_sql(src_doc: str, n_min: int = 1, n_max: int = 6) -> str:
    """(id, term, tf) of char_wb n-grams, one row per word first."""
    grams = []
    for n in range(n_min, n_max + 1):
        grams.append(f"CASE WHEN length(p) > {n} THEN list_transform(range(1, length(p) - {n} + 2), "
                     f"lambda i: substr(p, i, {n})) ELSE []::varchar[] END")
    grams.append(f"CASE WHEN length(p) <= {n_max} THEN [p] ELSE []::varchar[] END")
    g = grams[0]
    for x in grams[1:]:
        g = f"list_concat({g}, {x})"
    words = (f"(SELECT id, ' ' || w || ' ' AS p FROM (SELECT id, unnest(list_filter("
             f"string_split_regex(lower({src_doc}), '{WS}+'), lambda x: x <> '')) AS w FROM srel))")
    return f"SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({g}) AS term FROM {words}) GROUP BY 1, 2"


CHAR_WB_DOC = "query || ' ' || product_title"


@register("char_wb_ngrams", O.with_rel(_char_wb_sql(CHAR_WB_DOC)))
def q_char_wb(spark, sf_dir):
    s = srel(spark, sf_dir)
    return TF.count_terms(TF.char_wb_rows(s, T.combine_text("query", "product_title"), 1, 6))


def sql_lemma(t: str) -> str:
    rules = sorted(TF.NOUN_SUFFIX_RULES, key=lambda r: -len(r[0]))
    cases = []
    for suf, rep in rules:
        cond = f"suffix({t}, '{suf}') AND length({t}) >= {len(suf) + 2}"
        if suf == "s":
            cond += f" AND NOT regexp_matches({t}, '(ss|us|is)$')"
        cases.append(f"WHEN {cond} THEN substr({t}, 1, length({t}) - {len(suf)}) || '{rep}'")
    # Among equal-length suffixes only one can match, so the first longest match wins.
    return "(CASE " + " ".join(cases) + f" ELSE {t} END)"


WORD_TOKS_SQL = "list_filter(string_split_regex(trim(lower(text)), '[^a-z0-9_]+'), lambda x: x <> '')"


@register("stem_vocab", f"""
SELECT token, {O.sql_stem('token')} AS form FROM (SELECT DISTINCT unnest({WORD_TOKS_SQL}) AS token FROM documents)""")
def q_stem_vocab(spark, sf_dir):
    return TF.token_table(docs(spark, sf_dir), T.word_tokens("text"), T.s_stem)


@register("lemma_vocab", f"""
SELECT token, {sql_lemma('token')} AS form FROM (SELECT DISTINCT unnest({WORD_TOKS_SQL}) AS token FROM documents)""")
def q_lemma_vocab(spark, sf_dir):
    return TF.token_table(docs(spark, sf_dir), T.word_tokens("text"), TF.lemma_rule)


def _joined_forms(spark, sf_dir, rule):
    """Every word token with the form that the vocabulary table gives it, joined back."""
    d = docs(spark, sf_dir)
    return TF.join_forms(d, "doc_id", T.word_tokens("text"), TF.token_table(d, T.word_tokens("text"), rule))


def _forms_sql(form: str) -> str:
    return (f"SELECT doc_id, pos, {form} AS form FROM (SELECT doc_id, cast(unnest(range(0, len(t))) AS integer) AS pos, "
            f"unnest(t) AS token FROM (SELECT doc_id, {WORD_TOKS_SQL} AS t FROM documents))")


@register("stem_tokens", _forms_sql(O.sql_stem("token")))
def q_stem_tokens(spark, sf_dir):
    return _joined_forms(spark, sf_dir, T.s_stem)


@register("lemma_tokens", _forms_sql(sql_lemma("token")))
def q_lemma_tokens(spark, sf_dir):
    return _joined_forms(spark, sf_dir, TF.lemma_rule)


# --- stems and lemmas from a user's table ---------------------------------------------

# Suffix rules of the stand-in table (fixed values).
SUFFIX_RULES = [("*ing", ""), ("*ed", ""), ("*ly", ""), ("*ness", ""), ("*ment", ""), ("*er", ""), ("*est", ""),
                ("*ungen", "ung"), ("*en", ""), ("*mente", "")]


def user_forms(spark, sf_dir):
    """A table in the schema of a user's file: rows of three versions for tokens that end
    in s, and suffix rules. Written as a tab-separated file and read back."""
    from ..sources import files as IO
    token = F.col("token")
    d = explode_rows(docs(spark, sf_dir), T.word_tokens("text"), "token").where(token.endswith("s")).distinct()
    size = F.length("token")
    rules = spark.createDataFrame([(1, t, f) for t, f in SUFFIX_RULES], IO.FORM_TABLE)
    table = (d.where(size >= 4).select(F.lit(1).cast("long").alias("version"), "token", F.expr("left(token, length(token) - 1)").alias("form"))
             .unionByName(d.where((size >= 5) & token.endswith("ies")).select(
                 F.lit(2).cast("long").alias("version"), "token", F.expr("left(token, length(token) - 3) || 'y'").alias("form")))
             .unionByName(d.where(size == 5).select(F.lit(3).cast("long").alias("version"), "token", F.lit(None).cast("string").alias("form")))
             .unionByName(rules))
    return IO.read_form_table(spark, IO.write_form_table(table, IO.scratch_dir(spark, "forms")))


def _user_forms_sql(version: int) -> str:
    rules = ", ".join(f"(1, '{t}', '{f}')" for t, f in SUFFIX_RULES)
    return f"""
WITH occ AS (SELECT doc_id, cast(unnest(range(0, len(t))) AS integer) AS pos, unnest(t) AS token
  FROM (SELECT doc_id, {WORD_TOKS_SQL} AS t FROM documents)),
d AS (SELECT DISTINCT token FROM occ),
tab(version, token, form) AS (
  SELECT 1, token, left(token, length(token) - 1) FROM d WHERE ends_with(token, 's') AND length(token) >= 4
  UNION ALL SELECT 2, token, left(token, length(token) - 3) || 'y' FROM d WHERE ends_with(token, 'ies') AND length(token) >= 5
  UNION ALL SELECT 3, token, NULL FROM d WHERE ends_with(token, 's') AND length(token) = 5
  UNION ALL SELECT * FROM (VALUES {rules})),
held AS (SELECT token, form FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY version DESC, form NULLS LAST) AS k
  FROM tab WHERE version <= {version}) WHERE k = 1 AND form IS NOT NULL),
ruled AS (SELECT d.token, left(d.token, length(d.token) - length(h.token) + 1) || h.form AS form,
    row_number() OVER (PARTITION BY d.token ORDER BY length(h.token) DESC) AS k
  FROM d JOIN held h ON starts_with(h.token, '*') AND ends_with(d.token, substr(h.token, 2))
    AND length(d.token) - length(h.token) + 1 >= {FM.MIN_STEM}),
res AS (SELECT d.token, coalesce(e.form, r.form, d.token) AS form,
    CASE WHEN e.token IS NOT NULL THEN 'entry' WHEN r.token IS NOT NULL THEN 'suffix' ELSE 'none' END AS matched_by
  FROM d LEFT JOIN held e ON e.token = d.token LEFT JOIN ruled r ON r.token = d.token AND r.k = 1)"""


@register("form_table_tokens", _user_forms_sql(3)
          + " SELECT doc_id, pos, token, form, matched_by FROM occ JOIN res USING (token)")
def q_form_tokens(spark, sf_dir):
    """Every word token with its form by the user's table at version 3."""
    forms = FM.forms_at(user_forms(spark, sf_dir), 3)
    return FM.apply_forms(docs(spark, sf_dir), "doc_id", T.word_tokens("text"), forms)


@register("form_table_unmatched", _user_forms_sql(2) + """
SELECT token, count(*) AS n, count(DISTINCT doc_id) AS n_rows, cast(dense_rank() OVER (ORDER BY count(*) DESC) AS integer) AS rank
FROM occ JOIN res USING (token) WHERE matched_by = 'none' GROUP BY token""")
def q_form_unmatched(spark, sf_dir):
    """The tokens that the user's table at version 2 does not match."""
    forms = FM.forms_at(user_forms(spark, sf_dir), 2)
    return FM.unmatched_tokens(docs(spark, sf_dir), "doc_id", T.word_tokens("text"), forms)


# --- TF-IDF ------------------------------------------------------------------------------

TRAIN_CTE = "train AS (SELECT * FROM srel WHERE median_relevance IS NOT NULL)"


def _tfidf_sql(tf_all: str, tf_train: str, n_train: str, min_df: int, idf: str,
               max_df: str | None = None, sublinear: bool = False, l2: bool = False) -> str:
    bound = f" AND count(*) <= {max_df}" if max_df else ""
    t = "(ln(a.tf) + 1)" if sublinear else "a.tf"
    w = f"{t} * v.idf"
    weights = f"SELECT a.id, a.term, {w} AS weight FROM ({tf_all}) a JOIN vocab v ON v.term = a.term"
    if l2:
        weights = (f"SELECT id, term, CASE WHEN nrm > 0 THEN weight / nrm ELSE weight END AS weight FROM "
                   f"(SELECT *, sqrt(sum(weight * weight) OVER (PARTITION BY id)) AS nrm FROM ({weights}))")
    return f"""
SELECT id, term, {O.r6('weight')} AS weight FROM ({weights}) x""", f"""
ntrain AS ({n_train}),
vocab AS (SELECT term, {idf} AS idf FROM (
  SELECT term, count(*) AS df FROM ({tf_train}) GROUP BY term
  HAVING count(*) >= {min_df}{bound}) d, ntrain)"""


def _with_tfidf(body_and_ctes) -> str:
    body, ctes = body_and_ctes
    return O.with_rel(body, extra=TRAIN_CTE + "," + ctes)


SMOOTH = "ln((1 + ntrain.n) / (1 + d.df)) + 1"


def _charwb_train_sql() -> str:
    return _char_wb_sql(CHAR_WB_DOC).replace("FROM srel", "FROM train")


@register("tfidf_smooth", _with_tfidf(_tfidf_sql(
    _char_wb_sql(CHAR_WB_DOC), _charwb_train_sql(), "SELECT count(*) AS n FROM train", 3, SMOOTH)))
def q_tfidf_smooth(spark, sf_dir):
    s = materialize(srel(spark, sf_dir).select("id", "query", "product_title", "median_relevance"))
    train = s.where(F.col("median_relevance").isNotNull())
    return TF.char_wb_tfidf(train, s, T.combine_text("query", "product_title"), 1, 6, min_df=3)


def _lemma_terms_sql() -> str:
    toks = (f"list_filter(list_transform(list_filter(string_split_regex(trim(lower(query || ' ' || product_title)), "
            f"'[^a-z0-9_]+'), lambda x: x <> ''), lambda w: {sql_lemma('w')}), "
            f"lambda t: NOT list_contains({STOP_SQL}, t))")
    return toks


def _word_tfidf_terms(d):
    toks = T.remove_stopwords(TF.lemma_tokens(T.combine_text("query", "product_title")), ENGLISH_STOPWORDS)
    return toks, lambda t: T.word_ngrams(t, 1, 3)


def _word_tf_sql(src: str) -> str:
    return _tf_sql(f"(SELECT id, {_lemma_terms_sql()} AS tk FROM {src})", _ngrams_sql("tk", 1, 3))


@register("tfidf_word", _with_tfidf(_tfidf_sql(
    _word_tf_sql("srel"), _word_tf_sql("train"), "SELECT count(*) AS n FROM train", 2, SMOOTH)))
def q_tfidf_word(spark, sf_dir):
    s = srel_shared(spark, sf_dir)
    train = s.where(F.col("median_relevance").isNotNull())
    return TF.tfidf(train, s, _word_tfidf_terms, min_df=2, idf="smooth", nested=True)


def _sublinear_terms(d):
    toks = F.filter(T.word_tokens(T.combine_text("query", "product_title")), lambda t: F.length(t) >= 2)
    return T.remove_stopwords(toks, ENGLISH_STOPWORDS)


def _sublinear_tf_sql(src: str) -> str:
    toks = (f"list_filter(string_split_regex(trim(lower(query || ' ' || product_title)), '[^a-z0-9_]+'), "
            f"lambda x: length(x) >= 2 AND NOT list_contains({STOP_SQL}, x))")
    return _tf_sql(src, toks)


@register("tfidf_sublinear", _with_tfidf(_tfidf_sql(
    _sublinear_tf_sql("srel"), _sublinear_tf_sql("train"), "SELECT count(*) AS n FROM train", 1, SMOOTH,
    max_df="0.5 * (SELECT count(*) FROM train)", sublinear=True, l2=True)))
def q_tfidf_sublinear(spark, sf_dir):
    s = srel_shared(spark, sf_dir)
    train = s.where(F.col("median_relevance").isNotNull())
    return TF.tfidf(train, s, _sublinear_terms, max_df=0.5, idf="smooth", sublinear=True, norm="l2", nested=True)


def _query_terms(d):
    return F.filter(T.tokenize_nonempty("query"),
                    lambda t: (F.length(t) >= 3) & ~F.array_contains(
                        F.array(*[F.lit(w) for w in ENGLISH_STOPWORDS]), t))


def _query_tf_sql(src: str) -> str:
    return _tf_sql(src, f"list_filter(string_split(query, ' '), lambda t: length(t) >= 3 "
                        f"AND NOT list_contains({STOP_SQL}, t))")


@register("tfidf_query", _with_tfidf(_tfidf_sql(
    _query_tf_sql("srel"), _query_tf_sql("srel"), "SELECT count(*) AS n FROM srel", 1, "log2(ntrain.n / d.df)")))
def q_tfidf_query(spark, sf_dir):
    s = srel(spark, sf_dir)
    return TF.tfidf(s, s, _query_terms, min_df=1, idf="log2", nested=True)


def _nb_bag_sql(src: str) -> str:
    toks = _nb_tokens_sql("query || ' ' || product_title")
    return _tf_sql(f"(SELECT id, {toks} AS tk FROM {src})", f"list_concat(tk, {_bigrams_sql('tk')})")


def nb_bag(c):
    """(tokens, build): stemmed normalized tokens, then unigrams + tagged bigrams."""
    toks = F.transform(F.filter(T.tokenize_ws(T.normalize_text(c)), lambda x: x != ""), T.s_stem)
    return toks, lambda t: F.concat(t, T.word_bigrams_tagged(t))


def nb_counts(df):
    return TF.term_counts(TF.staged_terms(df, *nb_bag(T.combine_text("query", "product_title"))), F.col("_terms"))


@register("vocab_df_bounds", O.with_rel(
    f"SELECT term, count(*) AS df FROM ({_nb_bag_sql('train')}) GROUP BY term "
    "HAVING count(*) >= 3 AND count(*) <= 0.2 * (SELECT count(*) FROM train)", extra=TRAIN_CTE))
def q_vocab_bounds(spark, sf_dir):
    s = srel_shared(spark, sf_dir)
    train = s.where(F.col("median_relevance").isNotNull())
    return TF.vocab_df_bounds(nb_counts(train), TF.n_docs_of(train), 3, 0.2)


@register("term_frequency", O.with_rel(
    f"SELECT a.id, a.term, a.tf FROM ({_nb_bag_sql('srel')}) a WHERE a.term IN ("
    f"SELECT term FROM ({_nb_bag_sql('train')}) GROUP BY term "
    "HAVING count(*) >= 3 AND count(*) <= 0.2 * (SELECT count(*) FROM train))", extra=TRAIN_CTE))
def q_term_frequency(spark, sf_dir):
    s = srel_shared(spark, sf_dir)
    train = s.where(F.col("median_relevance").isNotNull())
    vocab = TF.vocab_df_bounds(nb_counts(train), TF.n_docs_of(train), 3, 0.2)
    return TF.term_frequency(nb_counts(s), vocab)
