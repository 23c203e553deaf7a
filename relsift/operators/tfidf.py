"""Vocabulary, term counts and TF-IDF in long form ``(id, term, value)``.

* Term counts are one hash aggregate by (id, term); a document's rows come from one
  task, so the map-side combine folds them before the shuffle. Where the train rows are
  part of the rows to weight, the counts are made once for both.
* Document frequency is a hash aggregate by term (partial aggregation makes a
  term that is in every document cheap).
* The idf table (one row per vocabulary term) is joined back by Spark's choice:
  broadcast by size, else a shuffle join that AQE splits on skew.
* L2 norms use a window per document (documents are bounded in size).

Weights follow the reference's vectorizer settings:
``smooth``: tf * (ln((1+N)/(1+df)) + 1); ``log2``: tf * log2(N/df);
sublinear tf: 1 + ln(tf); optional L2 normalisation per document.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.arrays import explode_rows
from ..session import materialize

# WordNet noun detachment rules (suffix -> replacement), used by
# the default lemma rule [pin]; the longest matching suffix wins.
NOUN_SUFFIX_RULES = [("s", ""), ("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"),
                     ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y")]


def lemma_rule(t: Column) -> Column:
    """[pin] Noun lemma without a dictionary: the longest WordNet noun suffix rule
    that leaves at least two characters; ``ss``/``us``/``is`` endings are kept."""
    out = t
    for suf, rep in sorted(NOUN_SUFFIX_RULES, key=lambda r: len(r[0])):
        hit = t.endswith(F.lit(suf)) & (F.length(t) >= len(suf) + 2)
        if suf == "s":
            hit = hit & ~t.rlike("(ss|us|is)$")
        out = F.when(hit, F.concat(F.substr(t, F.lit(1), F.length(t) - len(suf)), F.lit(rep))).otherwise(out)
    return out


def lemma_tokens(c) -> Column:
    """[pin] Tokens for the word analyzer: lower, word tokens, noun lemma rule."""
    return F.transform(T.word_tokens(c), lemma_rule)


def term_counts(df: DataFrame, terms: Column, id_col: str = "id") -> DataFrame:
    """``(id, term, tf)`` from an array of terms per row: explode, then a hash
    aggregate by (id, term). The rows of one document are produced in one task,
    so the map-side combine folds them before the shuffle (only distinct
    (id, term) pairs move)."""
    staged = df.select(F.col(id_col).alias("id"), terms.alias("_terms"))
    return count_terms(explode_rows(staged, F.col("_terms"), "term", "id"))


def count_terms(rows: DataFrame) -> DataFrame:
    """``(id, term, tf)`` from one row per term occurrence."""
    return rows.groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))


def char_wb_rows(df: DataFrame, text: Column, n_min: int = 1, n_max: int = 6, id_col: str = "id") -> DataFrame:
    """``(id, term)`` occurrences of character n-grams inside word bounds, built
    with generators only (words -> n -> positions), which stay in generated code.

    Per padded word of length L: every n-gram for n_min <= n < L (n <= n_max),
    and the whole padded word once if L <= n_max."""
    words = explode_rows(df.select(F.col(id_col).alias("id"), F.split(F.lower(text), T.WS_CLASS + "+", -1)
                                   .alias("_ws")), F.col("_ws"), "_w", "id").where(F.col("_w") != "")
    p = words.select("id", F.concat(F.lit(" "), "_w", F.lit(" ")).alias("_p")).withColumn("_L", F.length("_p"))
    L = F.col("_L")
    # n runs over n_min..min(n_max, L); a word shorter than n_min still gives itself once
    ns = F.when(L < n_min, F.array(F.lit(n_min))).otherwise(F.sequence(F.lit(n_min), F.least(F.lit(n_max), L)))
    pn = p.select("id", "_p", "_L", F.explode(ns).alias("_n"))
    n = F.col("_n")
    pos = F.when(n < L, F.sequence(F.lit(1), L - n + 1)).otherwise(F.array(F.lit(1)))
    g = pn.select("id", "_p", "_L", "_n", F.explode(pos).alias("_i"))
    return g.select("id", F.when(n < L, F.substr("_p", "_i", "_n")).otherwise(F.col("_p")).alias("term"))


# Words whose n-grams a task keeps, and terms or rows it holds before they are sent on.
HELD_WORDS, HELD_TERMS = 100_000, 200_000


def word_grams(word: str, n_min: int = 1, n_max: int = 6) -> list[str]:
    """The n-grams of one word as ``char_wb_rows`` gives them."""
    p = f" {word} "
    grams = [p[i:i + n] for n in range(n_min, min(n_max, len(p) - 1) + 1) for i in range(len(p) - n + 1)]
    return [*grams, p] if len(p) <= n_max else grams


def texts_by_id(df: DataFrame, text: Column, id_col: str = "id") -> DataFrame:
    """``(id, text)``, lower case, one row per id: the only shuffle that counting n-grams
    per id needs, and one of texts. N-grams stay inside words, so texts of an id are joined
    by a space."""
    return df.groupBy(F.col(id_col).alias("id")).agg(F.concat_ws(" ", F.collect_list(F.lower(text))).alias("text"))


def _gram_counts(texts, n_min: int, n_max: int):
    """A ``Counter`` of n-grams per text."""
    known: dict[str, list[str]] = {}
    split = re.compile(T.WS_CLASS + "+").split
    for text in texts:
        found: Counter = Counter()
        for word in split(text):
            if word:
                grams = known.get(word)
                if grams is None:
                    if len(known) >= HELD_WORDS:
                        known.clear()
                    grams = known[word] = word_grams(word, n_min, n_max)
                found.update(grams)
        yield found


def char_wb_counts(df: DataFrame, text: Column, n_min: int = 1, n_max: int = 6, id_col: str = "id") -> DataFrame:
    """``count_terms(char_wb_rows(...))``, counted where the text of an id is."""
    docs = texts_by_id(df, text, id_col)

    def count(batches):
        for batch in batches:
            ids, terms, tfs, lo = [], [], [], 0
            for at, found in enumerate(_gram_counts(batch.column("text").to_pylist(), n_min, n_max)):
                ids += [at] * len(found)
                terms += found.keys()
                tfs += found.values()
                if len(ids) >= HELD_TERMS or at + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(ids, pa.int64())), pa.array(terms, pa.string()), pa.array(tfs, pa.int64())], ["id", "term", "tf"])
                    ids, terms, tfs = [], [], []

    return docs.mapInArrow(count, f"id {dict(docs.dtypes)['id']}, term string, tf long")


def char_wb_frequency(df: DataFrame, text: Column, n_min: int = 1, n_max: int = 6, id_col: str = "id") -> DataFrame:
    """``document_frequency`` of the n-grams: tasks add up what their ids hold, so that
    terms travel once a task and not once an id."""
    def count(batches):
        held: Counter = Counter()
        for batch in batches:
            for found in _gram_counts(batch.column("text").to_pylist(), n_min, n_max):
                held.update(found.keys())
                if len(held) >= HELD_TERMS:
                    yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["term", "df"])
                    held = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["term", "df"])

    parts = texts_by_id(df, text, id_col).mapInArrow(count, "term string, df long")
    return parts.groupBy("term").agg(F.sum("df").alias("df"))


def char_wb_vocabulary(train: DataFrame, text: Column, n_min: int = 1, n_max: int = 6, min_df: int = 1,
                       idf: str = "smooth") -> DataFrame:
    """``fit_vocabulary`` of the n-grams. Rows without an id count in N only."""
    d = char_wb_frequency(train.where(F.col("id").isNotNull()), text, n_min, n_max)
    return idf_of(d.where(F.col("df") >= min_df), n_docs_of(train), idf)


#: Terms of a vocabulary that is sent to every task, at most.
BROADCAST_TERMS = 1_000_000


def char_wb_tfidf(train: DataFrame, rows: DataFrame, text: Column, n_min: int = 1, n_max: int = 6, min_df: int = 1,
                  idf: str = "smooth") -> DataFrame:
    """``tfidf`` of character n-grams (no norm) for train rows that are among ``rows``: texts
    are shuffled, n-grams are not, unless the vocabulary is too large to send to the tasks."""
    vocab = materialize(char_wb_vocabulary(train, text, n_min, n_max, min_df, idf))
    sent = F.broadcast(vocab) if vocab.count() <= BROADCAST_TERMS else vocab
    return tfidf_transform(char_wb_counts(rows, text, n_min, n_max), sent)


def char_wb_factors(train: DataFrame, rows: DataFrame, text: Column, n_min: int = 1, n_max: int = 6, min_df: int = 1,
                    idf: str = "smooth") -> tuple[DataFrame, DataFrame]:
    """The n-gram weights of ``tfidf`` (no norm) as a product of two small tables: ``(id,
    term, weight)``, how often a word is in a row, and ``(id, term, weight)``, the weights
    of a word's n-grams, the word being ``id``. Words without a term of the vocabulary are
    in neither. A row holds some dozen words but hundreds of n-grams."""
    vocab = char_wb_vocabulary(train, text, n_min, n_max, min_df, idf)
    words = explode_rows(rows.select("id", F.split(F.lower(text), T.WS_CLASS + "+", -1).alias("_ws")), F.col("_ws"), "term", "id")
    counts = materialize(words.where(F.col("term") != "").groupBy("id", "term").agg(F.count(F.lit(1)).cast("double").alias("weight")))
    distinct = counts.select("term").distinct()  # a word is one row, lower case already
    grams = materialize(tfidf_transform(char_wb_counts(distinct, F.col("term"), n_min, n_max, id_col="term"), vocab))
    return counts.join(grams.select(F.col("id").alias("term")).distinct(), "term", "left_semi").select("id", "term", "weight"), grams


def staged_terms(df: DataFrame, tokens: Column, build, id_col: str = "id") -> DataFrame:
    """Project ``tokens`` once as a column, then build the term array from it
    (``build`` takes the column); returns ``(id, _terms)``."""
    t = df.select(F.col(id_col).alias("id"), tokens.alias("_tok"))
    return t.select("id", build(F.col("_tok")).alias("_terms"))


def document_frequency(tf: DataFrame) -> DataFrame:
    """``(term, df)``: documents containing each term."""
    return tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def fit_vocabulary(tf_train: DataFrame, n_docs: Column, min_df: int = 1,
                   max_df: float | int | None = None, idf: str = "smooth") -> DataFrame:
    """``(term, df, idf)`` over the training documents. ``min_df``/``max_df``
    follow the usual vectorizer rules (an int is a document count, a float in
    (0, 1] a share of ``N``). ``n_docs`` is a scalar column (subquery)."""
    d = document_frequency(tf_train).where(F.col("df") >= min_df)
    if max_df is not None:
        bound = n_docs * F.lit(float(max_df)) if isinstance(max_df, float) else F.lit(max_df)
        d = d.where(F.col("df") <= bound)
    return idf_of(d, n_docs, idf)


def idf_of(d: DataFrame, n_docs: Column, idf: str = "smooth") -> DataFrame:
    """``(term, df, idf)`` of ``(term, df)``."""
    N = n_docs.cast("double")
    dfd = F.col("df").cast("double")
    if idf == "smooth":
        w = F.log((N + 1) / (dfd + 1)) + 1
    elif idf == "log2":
        w = F.log2(N / dfd)
    elif idf == "none":
        w = F.lit(1.0)
    else:
        raise ValueError(f"unknown idf {idf!r}")
    return d.select("term", "df", w.alias("idf"))


def tfidf_transform(tf: DataFrame, vocab: DataFrame, sublinear: bool = False,
                    norm: str | None = None) -> DataFrame:
    """``(id, term, weight)`` for terms of the vocabulary (others are dropped)."""
    j = tf.join(vocab.select("term", "idf"), "term", "inner")
    t = (F.log(F.col("tf").cast("double")) + 1) if sublinear else F.col("tf").cast("double")
    w = j.select("id", "term", (t * F.col("idf")).alias("weight"))
    if norm == "l2":
        doc = Window.partitionBy("id")
        w = w.withColumn("_n", F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(doc)))
        w = w.select("id", "term", F.when(F.col("_n") > 0, F.col("weight") / F.col("_n"))
                     .otherwise(F.col("weight")).alias("weight"))
    elif norm is not None:
        raise ValueError(f"unknown norm {norm!r}")
    return w


def n_docs_of(df: DataFrame) -> Column:
    """Number of rows of ``df`` as a scalar subquery column."""
    return df.agg(F.count(F.lit(1))).scalar()


def tfidf(train: DataFrame, apply_to: DataFrame, terms_fn, min_df: int = 1,
          max_df: float | int | None = None, idf: str = "smooth", sublinear: bool = False,
          norm: str | None = None, nested: bool = False) -> DataFrame:
    """Fit the vocabulary and idf on ``train`` and weight the terms of ``apply_to``.

    ``terms_fn`` maps a frame to its term-array column (e.g. char_wb n-grams). With
    ``nested`` the train rows are rows of ``apply_to`` (by ``id``) and terms are counted
    once for both."""
    if nested:
        tf_all = materialize(_tf_of(apply_to, terms_fn))
        tf_train = tf_all.join(train.select("id"), "id", "left_semi")
    else:
        tf_all, tf_train = _tf_of(apply_to, terms_fn), _tf_of(train, terms_fn)
    vocab = fit_vocabulary(tf_train, n_docs_of(train), min_df, max_df, idf)
    return tfidf_transform(tf_all, vocab, sublinear, norm)


def _tf_of(df: DataFrame, terms_fn) -> DataFrame:
    """Term counts of ``df``. ``terms_fn(df)`` gives a term-array column, a
    (tokens, build) pair, or a frame of ``(id, term)`` occurrences."""
    spec = terms_fn(df)
    if isinstance(spec, DataFrame):
        return count_terms(spec)
    if isinstance(spec, tuple):
        return term_counts(staged_terms(df, *spec), F.col("_terms"))
    return term_counts(df, spec)


def vocab_df_bounds(tf: DataFrame, n_docs: Column, min_df: int = 3, max_share: float = 0.2) -> DataFrame:
    """[pin] Dictionary with ``min_df <= df <= max_share * N``: ``(term, df)``."""
    return (document_frequency(tf).where((F.col("df") >= min_df) & (F.col("df") <= n_docs * F.lit(max_share))))


def term_frequency(tf: DataFrame, vocab: DataFrame) -> DataFrame:
    """Per-document counts of dictionary terms (terms outside are ignored)."""
    return tf.join(vocab.select("term"), "term", "left_semi")


def token_table(df: DataFrame, tokens: Column, rule) -> DataFrame:
    """``(token, form)`` for every distinct token: the rule runs once per
    distinct token (a table job), and callers join it back by token."""
    return (explode_rows(df, tokens, "token").distinct()
            .select("token", rule(F.col("token")).alias("form")))


def join_forms(df: DataFrame, id_col: str, tokens: Column, table: DataFrame) -> DataFrame:
    """``(id_col, pos, form)`` of every token. ``table`` is ``(token, form)``, made by
    ``token_table`` or given by the user; a token that it lacks keeps its own form. The
    token side is a plain scan, so Spark splits a frequent token's rows."""
    rows = df.select(id_col, F.posexplode(tokens).alias("pos", "token"))
    return rows.join(table, "token", "left").select(id_col, "pos", F.coalesce("form", "token").alias("form"))
