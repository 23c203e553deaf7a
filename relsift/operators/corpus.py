"""Corpus statistics as joins and aggregates.

Corpus A is the distinct set of titles and descriptions (one document per
distinct text); corpora B/C are the aligned queries/titles of ``rel`` (keyed by
``id``). All counts are hash aggregates with map-side partial aggregation, so
a frequent word (one key holding a large share of the rows) is combined in
every task before the shuffle.

Word pairs exist only inside one document. The words are cut into bands of about
``PAIR_BLOCK`` and paired band by band, so that the pairs of a long text, which grow with
the square of its words, spread over many tasks. The dictionary drops rare
words *before* pairs are built (exact: a pair count never exceeds either word's document
frequency), and the distances of given pairs count those pairs only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import explode_rows
from ..functions.text import WS_CLASS, remove_punct_keep_dash, remove_stopwords, tokenize_nonempty
from ..session import materialize
from .pair_counts import BROADCAST_WORDS, counted_pairs
from .skew import rank_within, topk_per_group

# Pruning thresholds of the reference dictionary.
MIN_COUNT = 20
MIN_WORD_LEN = 2
# Words of a band, about; the pairs of two bands are counted in one task.
PAIR_BLOCK = 16_384
# Given pairs whose partner lists are sent to every task, at most.
BROADCAST_PAIRS = 8_000_000
# Partners of a probe are looked up by bands of document frequency, each this factor wide.
BAND_BASE = 4


def corpus_a(rel: DataFrame, title: str = "product_title",
             description: str = "product_description", stored: bool = False) -> DataFrame:
    """Distinct titles and non-null descriptions: ``(doc, text)``, one row per
    document; ``doc`` is the content hash (md5) of the text, a stable key.

    Of a ``stored`` table, which may be read again, only the texts that come more than once
    are shuffled, as long as there are ``BROADCAST_WORDS`` of them at most."""
    # one pass over the rows, whatever their texts are made of
    texts = explode_rows(rel, F.array(title, description), "text").select(F.md5("text").alias("doc"), "text")
    if not stored:
        return texts.select("text").distinct().select(F.md5("text").alias("doc"), "text")
    again = materialize(texts.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc"))
    if again.count() > BROADCAST_WORDS:
        return corpus_a(rel, title, description)
    once = texts.join(F.broadcast(again), "doc", "left_anti")
    return once.unionByName(texts.join(F.broadcast(again), "doc", "left_semi").distinct())


def corpus_size(corpus: DataFrame) -> DataFrame:
    """``N`` as a one-row frame (stays in the plan; no driver round trip)."""
    return corpus.agg(F.count(F.lit(1)).alias("N"))


def _doc_words(corpus: DataFrame) -> DataFrame:
    return corpus.select("doc", F.array_distinct(tokenize_nonempty("text")).alias("words"))


def word_document_frequency(corpus: DataFrame) -> DataFrame:
    """``(word, n)``: number of documents containing the word."""
    return (explode_rows(_doc_words(corpus), F.col("words"), "word")
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")))


def word_cooccurrence(corpus: DataFrame, keep_words: DataFrame | None = None, min_n: int = 1) -> DataFrame:
    """``(word1, word2, n)`` with ``word1 < word2``: documents containing both.

    ``keep_words`` (a ``word`` column, and ``n`` as in ``word_document_frequency`` if it is
    known) restricts the words before pairs are built, and pairs of fewer than ``min_n`` documents are left out where they are counted. The words
    go to bands of about ``PAIR_BLOCK``; the pairs of two bands are counted in one task
    (see :mod:`.pair_counts`).
    """
    docs = _doc_words(corpus).select(F.monotonically_increasing_id().alias("doc"), "words")
    if keep_words is None:
        vocab = word_document_frequency(corpus)
    elif "n" in keep_words.columns:
        vocab = keep_words.groupBy("word").agg(F.max("n").alias("n"))
    else:
        vocab = word_document_frequency(corpus).join(keep_words.select("word"), "word", "left_semi")
    return counted_pairs(docs, materialize(vocab), PAIR_BLOCK, min_n)


def dictionary(df_counts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The reference dictionary layout: ``word1, word2, co``; blank ``word2`` rows
    are document frequencies."""
    return (df_counts.select(F.col("word").alias("word1"), F.lit("").alias("word2"), F.col("n").alias("co"))
            .unionByName(pairs.select("word1", "word2", F.col("n").alias("co"))))


def pruned_vocabulary(df_counts: DataFrame, min_count: int = MIN_COUNT,
                      min_len: int = MIN_WORD_LEN) -> DataFrame:
    return df_counts.where((F.col("n") >= min_count) & (F.length("word") >= min_len))


def cooccurrence_pruned(corpus: DataFrame, min_count: int = MIN_COUNT, min_len: int = MIN_WORD_LEN,
                        df_counts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Pruned dictionary as ``(df_counts, pairs)``: words with df >= min_count and
    length >= min_len, pairs with count >= min_count. Rare words leave before the
    pair explode, which is exact because a pair count <= each word's df."""
    dfc = df_counts if df_counts is not None else word_document_frequency(corpus)
    vocab = materialize(pruned_vocabulary(dfc, min_count, min_len))
    return vocab, word_cooccurrence(corpus, keep_words=vocab, min_n=min_count)


def normalized_distance(pairs: DataFrame, df_counts: DataFrame, n_docs: DataFrame) -> DataFrame:
    """``(word1, word2, distance)`` for every pair of the dictionary:
    ``(max(ln n1, ln n2) - ln n12) / (ln N - min(ln n1, ln n2))``; 0/0 -> null."""
    # the words, never the pairs, are sent to every task if there are not too many
    how = "broadcast" if df_counts.count() <= BROADCAST_WORDS else "merge"
    d1 = df_counts.select(F.col("word").alias("word1"), F.log(F.col("n").cast("double")).alias("l1")).hint(how)
    d2 = df_counts.select(F.col("word").alias("word2"), F.log(F.col("n").cast("double")).alias("l2")).hint(how)
    ln_n = n_docs.select(F.log(F.col("N").cast("double"))).scalar()  # scalar subquery
    j = pairs.join(d1, "word1").join(d2, "word2").withColumn("lN", ln_n)
    num = F.greatest("l1", "l2") - F.log(F.col("n").cast("double"))
    den = F.col("lN") - F.least("l1", "l2")
    return j.select("word1", "word2", F.when(den != 0, num / den).alias("distance"))


def _phrase_pairs(rel: DataFrame, query: str, title: str) -> DataFrame:
    """(id, w1, w2, mult): every (query word, title word) pair with duplicates."""
    # Row-local product of two short arrays: built per row, not a join on a hot key.
    both = rel.select("id", tokenize_nonempty(query).alias("_q"), tokenize_nonempty(title).alias("_t"))
    pairs = explode_rows(both, F.flatten(F.transform(
        "_q", lambda a: F.transform("_t", lambda b: F.struct(a.alias("w1"), b.alias("w2"))))), "p", "id")
    return (pairs.groupBy("id", F.col("p.w1").alias("w1"), F.col("p.w2").alias("w2"))
            .agg(F.count(F.lit(1)).alias("mult")))


def query_title_pairs(rel: DataFrame, query: str = "query", title: str = "product_title") -> DataFrame:
    """``(w1, w2)``: the distinct pairs of a query word and another word of its title."""
    return _phrase_pairs(rel, query, title).where(F.col("w1") != F.col("w2")).select("w1", "w2").distinct()


def pair_distance(given: DataFrame, corpus: DataFrame, pruned: bool = False, min_count: int = MIN_COUNT,
                  min_len: int = MIN_WORD_LEN, df_counts: DataFrame | None = None) -> DataFrame:
    """``(word1, word2, distance)`` for the distinct unordered pairs of ``given`` (``w1``,
    ``w2``): the normalized distance, ``+inf`` for a pair that never occurs together (or
    a word that occurs nowhere), null for 0/0.

    Only given pairs are counted, and only where both words occur: each word of a
    document meets the document's hubs (words that others look for) and the partners that
    ``given`` names for it; what is in both is counted in the task that has the document,
    before any shuffle. Up to ``BROADCAST_PAIRS`` given pairs the partners are broadcast,
    beyond that they are joined by word. ``pruned`` uses the pruned dictionary
    (df and pair counts >= ``min_count``, words of length >= ``min_len``)."""
    # the documents are numbered when written, so that short keys go through the shuffles
    docs = materialize(_doc_words(corpus).select(F.monotonically_increasing_id().alias("doc"), "words"))
    dfc = df_counts if df_counts is not None else (
        explode_rows(docs, F.col("words"), "word").groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    if pruned:
        dfc = pruned_vocabulary(dfc, min_count, min_len)
    dfc = materialize(dfc)
    n_docs = docs.agg(F.count(F.lit(1)).alias("N"))
    wanted = materialize(given.select(F.least("w1", "w2").alias("word1"), F.greatest("w1", "w2").alias("word2")).distinct())
    known = (wanted.join(dfc.select(F.col("word").alias("word1")), "word1", "left_semi")
             .join(dfc.select(F.col("word").alias("word2")), "word2", "left_semi"))
    # the word with fewer given pairs looks for the other, the hub: a word has at most
    # about the root of twice the pairs to look for, and few words are hubs
    pairs_of = materialize(known.select(F.explode(F.array("word1", "word2")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("m")))
    sized = (known.join(pairs_of.select(F.col("word").alias("word1"), F.col("m").alias("m1")), "word1")
             .join(pairs_of.select(F.col("word").alias("word2"), F.col("m").alias("m2")), "word2"))
    first = F.struct("m1", "word1") < F.struct("m2", "word2")
    lookups = materialize(sized.select(F.when(first, F.col("word1")).otherwise(F.col("word2")).alias("word"),
                                       F.when(first, F.col("word2")).otherwise(F.col("word1")).alias("hub")))
    hubs = materialize(lookups.select("hub").distinct().withColumn("hid", F.monotonically_increasing_id()))
    partners = lookups.join(hubs, "hub").groupBy("word").agg(F.collect_list("hid").alias("partners"))
    if lookups.count() <= BROADCAST_PAIRS:
        partners = F.broadcast(partners)
    here = explode_rows(docs, F.col("words"), "hub", "doc").join(hubs, "hub").groupBy("doc").agg(F.collect_list("hid").alias("here"))
    tok = explode_rows(docs.join(here, "doc"), F.col("words"), "word", "here")
    met = explode_rows(tok.join(partners, "word"), F.array_intersect("here", "partners"), "hid", "word")
    co = (met.groupBy("word", "hid").agg(F.count(F.lit(1)).alias("n")).join(hubs, "hid")
          .select(F.least("word", "hub").alias("word1"), F.greatest("word", "hub").alias("word2"), "n"))
    if pruned:
        co = co.where(F.col("n") >= min_count)
    dist = normalized_distance(co, dfc, n_docs).withColumn("_there", F.lit(True))
    return wanted.join(dist, ["word1", "word2"], "left").select(
        "word1", "word2", F.when(F.col("_there"), F.col("distance")).otherwise(F.lit(float("inf"))).alias("distance"))


def phrase_distance(rel: DataFrame, corpus: DataFrame, query: str = "query", title: str = "product_title",
                    pruned: bool = False, min_count: int = MIN_COUNT, min_len: int = MIN_WORD_LEN,
                    df_counts: DataFrame | None = None) -> DataFrame:
    """``(id, distance)``: mean finite normalized distance over all (query word,
    title word) pairs with duplicates; ``+inf`` when none is finite; 0 when the
    finite ones sum to 0. Equal (query, title) texts are scored once.

    ``pruned`` uses the pruned dictionary and skips equal words, as the R variant.
    """
    texts = rel.select(F.xxhash64(query, title).alias("id"), query, title).dropDuplicates(["id"])
    rows = materialize(_phrase_pairs(texts, query, title).where(F.col("w1") != F.col("w2")))  # no self pairs
    dist = pair_distance(rows, corpus, pruned, min_count, min_len, df_counts)
    scored = (rows.select("id", "mult", F.least("w1", "w2").alias("word1"), F.greatest("w1", "w2").alias("word2"))
              .join(dist.where(F.col("distance").isNotNull() & (F.col("distance") != F.lit(float("inf")))), ["word1", "word2"]))
    agg = scored.groupBy(F.col("id").alias("_text")).agg(F.sum("mult").alias("_num"), F.sum(F.col("distance") * F.col("mult")).alias("_sum"))
    out = rel.select("id", F.xxhash64(query, title).alias("_key")).join(agg, F.col("_key") == F.col("_text"), "left")
    return out.select("id", F.when(F.coalesce("_num", F.lit(0)) == 0, F.lit(float("inf")))
                      .when(F.col("_sum") == 0, F.lit(0.0))
                      .otherwise(F.col("_sum") / F.col("_num")).alias("distance"))


def closest_words(probes: DataFrame, pairs: DataFrame, df_counts: DataFrame, n_docs: DataFrame,
                  limit: int = 10) -> DataFrame:
    """Related words of each probe ``word``: the ``limit`` partners with the highest
    pair count (ties by partner word), with their distance, ranked by distance.

    A probe yields nothing unless it occurs in both dictionary columns (as the
    larger word of some pair and in ``word1``). The per-word top-k is exact and
    runs in two phases, so a word with very many partners is split first.
    """
    sym = (pairs.select(F.col("word1").alias("word"), F.col("word2").alias("partner"), "n")
           .unionByName(pairs.select(F.col("word2").alias("word"), F.col("word1").alias("partner"), "n")))
    p = probes.select("word").distinct()
    in_w2 = pairs.select(F.col("word2").alias("word")).distinct()
    in_w1 = (pairs.select(F.col("word1").alias("word"))
             .unionByName(df_counts.select("word")).distinct())
    ok = p.join(in_w2, "word", "left_semi").join(in_w1, "word", "left_semi")
    cand = sym.join(ok, "word", "left_semi")
    top = topk_per_group(cand, ["word"], [F.desc("n"), F.asc("partner")], limit, out="co_rank",
                         salt=F.xxhash64("partner"))
    return _with_distance(top, df_counts, n_docs)


def closest_words_of(probes: DataFrame, corpus: DataFrame, limit: int = 10, min_count: int = MIN_COUNT,
                     min_len: int = MIN_WORD_LEN) -> DataFrame:
    """``closest_words`` over the pruned dictionary of ``corpus``, without its pair table.

    Only the probes' own pairs are counted, against partners in falling document
    frequency, one band of frequencies (a factor of ``BAND_BASE``) after another. A pair
    count never exceeds the partner's frequency, so a probe is done when its ``limit``-th
    count is above the most frequent word of the next band, and a partner smaller than
    the probe was seen (which says that the probe is the larger word of some pair).
    Bands are folders of the token table, so a band that no probe needs is not read, and
    of the others only the documents that hold an open probe meet their words. Null, empty
    and unknown probes give nothing; an empty corpus gives no rows."""
    # the documents are numbered when written, so that short keys go through the shuffles
    docs = materialize(_doc_words(corpus).select(F.monotonically_increasing_id().alias("doc"), "words"))
    dfc = pruned_vocabulary(explode_rows(docs, F.col("words"), "word").groupBy("word")
                            .agg(F.count(F.lit(1)).alias("n")), min_count, min_len)
    band = F.floor(F.log("n") / math.log(BAND_BASE)).cast("int")
    vocab = materialize(dfc.withColumn("band", band))
    tokens = materialize(explode_rows(docs, F.col("words"), "word", "doc")
                         .join(vocab.select("word", "band"), "word").select("doc", "word", "band"), "band")
    asked = materialize(probes.select("word").distinct().join(vocab, "word", "left_semi"))
    held = materialize(tokens.join(asked, "word", "left_semi").select("doc", F.col("word").alias("probe")))
    # one row per power of BAND_BASE
    bands = vocab.groupBy("band").agg(F.max("n").alias("top")).orderBy(F.desc("band")).collect()
    order = [F.desc("n"), F.asc("partner")]
    best = smaller = None
    open_probes = asked
    for i, row in enumerate(bands):
        words = tokens.where(F.col("band") == row["band"]).select("doc", F.col("word").alias("partner"))
        now = held.join(open_probes.select(F.col("word").alias("probe")), "probe", "left_semi")
        co = materialize(now.join(words, "doc").where(F.col("probe") != F.col("partner"))
                         .groupBy(F.col("probe").alias("word"), "partner").agg(F.count(F.lit(1)).alias("n"))
                         .where(F.col("n") >= min_count))
        fresh = co.where(F.col("partner") < F.col("word")).select("word").distinct()
        smaller = materialize(fresh if smaller is None else smaller.unionByName(fresh).distinct())
        seen = co if best is None else best.select("word", "partner", "n").unionByName(co)
        best = materialize(topk_per_group(seen, ["word"], order, limit, out="co_rank", salt=F.xxhash64("partner")))
        if i + 1 == len(bands):
            break
        probe_counts = best.groupBy("word").agg(F.count(F.lit(1)).alias("_k"), F.min("n").alias("_least"))
        done = (probe_counts.where((F.col("_k") >= limit) & (F.col("_least") > bands[i + 1]["top"]))
                .join(smaller, "word", "left_semi"))
        open_probes = materialize(asked.join(done, "word", "left_anti"))
        if open_probes.isEmpty():
            break
    if best is None:  # no word is frequent enough
        best = asked.select("word", F.lit("").alias("partner"), F.lit(0).cast("long").alias("n"),
                            F.lit(0).alias("co_rank")).limit(0)
        smaller = asked
    top = best.join(smaller, "word", "left_semi")
    return _with_distance(top, vocab, docs.agg(F.count(F.lit(1)).alias("N")))


def _with_distance(top: DataFrame, df_counts: DataFrame, n_docs: DataFrame) -> DataFrame:
    """``(word, partner, n, co_rank, distance, dist_rank)`` of top partners."""
    dist = normalized_distance(
        top.select(F.least("word", "partner").alias("word1"), F.greatest("word", "partner").alias("word2"), "n")
        .distinct(), df_counts, n_docs)
    # at most ``limit`` rows per word
    by_distance = Window.partitionBy("word").orderBy(F.asc_nulls_last("distance"), "co_rank")
    return (top.select("word", "partner", "n", "co_rank",
                       F.least("word", "partner").alias("word1"), F.greatest("word", "partner").alias("word2"))
            .join(dist, ["word1", "word2"], "left").drop("word1", "word2")
            .withColumn("dist_rank", F.row_number().over(by_distance)))


def distance_by_class(dist: DataFrame, rel: DataFrame, label: str = "median_relevance") -> DataFrame:
    """Five-number summary and count of the finite distances per class.

    The quartiles interpolate between the two ranks around them. Ranks come from a
    range-partitioned sort by (class, distance), so a class is never in one task."""
    d = dist.join(rel.select("id", label), "id").where(F.col(label).isNotNull()).select(F.col(label).alias("class"), "id", "distance")
    finite = F.when(F.col("distance") != F.lit(float("inf")), F.col("distance"))
    counts = d.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.count(finite).alias("n_finite"),
                                    F.min(finite).alias("min"), F.max(finite).alias("max"))
    ranked = rank_within(d.where(finite.isNotNull()), ["class"], ["distance", "id"], out="rn")
    sides = ranked.join(counts.select("class", "n_finite"), "class")

    def quartile(q: float) -> Column:
        at = F.lit(q) * (F.col("n_finite") - 1)
        share = at - F.floor(at)
        here = (F.when(F.col("rn") - 1 == F.floor(at), F.col("distance") * (1 - share))
                .when(F.col("rn") - 1 == F.floor(at) + 1, F.col("distance") * share))
        return F.sum(here)

    q = sides.groupBy("class").agg(quartile(0.25).alias("q1"), quartile(0.5).alias("median"), quartile(0.75).alias("q3"))
    return counts.join(q, "class", "left").select("class", "n", "n_finite", "min", "q1", "median", "q3", "max")


def term_text(c, stopwords: list[str] | None = None) -> Column:
    """Lower case, optional stop words out, punctuation out (intra-word dashes kept)."""
    x = F.lower(F.col(c) if isinstance(c, str) else c)
    if stopwords:
        toks = remove_stopwords(F.split(x, " ", -1), stopwords)
        x = F.array_join(toks, " ")
    return remove_punct_keep_dash(x)


def top_terms(df: DataFrame, col: str, n: int = 250, lower: int = 0,
              stopwords: list[str] | None = None) -> DataFrame:
    """Most frequent words (total occurrences) of a text column with count >
    ``lower``: ``(term, count, rank)``. Global top-k (per-task top-k, then merge)."""
    words = explode_rows(df.select(term_text(col, stopwords).alias("_text")),
                         F.split("_text", WS_CLASS, -1), "term")
    counts = (words.where(F.col("term") != "").groupBy("term").agg(F.count(F.lit(1)).alias("count"))
              .where(F.col("count") > lower))
    top = counts.orderBy(F.desc("count"), F.asc("term")).limit(n)
    # ``top`` has at most n rows, so the unpartitioned window is bounded.
    return top.select("term", "count", F.row_number().over(
        Window.orderBy(F.desc("count"), F.asc("term"))).alias("rank"))


def term_indicators(df: DataFrame, col: str, vocabulary: list[str], prefix: str = "pt_",
                    stopwords: list[str] | None = None, long_form: bool = True) -> DataFrame:
    """0/1 hit of each vocabulary term as a fixed substring of the cleaned text.

    ``vocabulary`` is bounded (the collected top-k of ``top_terms``, fitted on
    train). Long form gives ``(id, term)`` for the hits; wide form one
    ``<prefix><term>`` column per term.
    """
    text = term_text(col, stopwords)
    if long_form:
        vocab = F.array(*[F.lit(w) for w in vocabulary])
        staged = df.select("id", text.alias("_text"))
        return (explode_rows(staged, F.filter(vocab, lambda w: F.contains(F.col("_text"), w)), "term", "id")
                .select("id", F.concat(F.lit(prefix), F.col("term")).alias("term")))
    # a missing text has no hits (0, not null)
    staged = df.select("id", text.alias("_text"))
    return staged.select("id", *[F.coalesce(F.contains(F.col("_text"), F.lit(w)).cast("int"), F.lit(0))
                                 .alias(prefix + w) for w in vocabulary])

