"""Relational multinomial naive Bayes with three text views and all CV folds
in one plan.

Model ``f`` (f = 1..k) is trained on the labelled rows outside fold ``f``;
model 0 on all labelled rows. Its counts are *totals minus the fold's own
counts*, so the training data is never copied k times:

    cnt_f(c, t) = cnt(c, t) - cnt_in_fold_f(c, t)
    df_f(t)     = df(t) - df_in_fold_f(t)

The dictionary has one row per (view, term): total counts by class, total document
frequency, and the at most ``k * classes`` counts by (fold, class). A view's equal texts
are one text: its terms are counted once and each model scores it once. Scoring joins a
text's terms with the dictionary once; both sides are plain table scans, so Spark splits
a frequent term's rows (skew join).

[pin] prior ``ln(n_c / N)``; add-one smoothing ``ln((cnt + 1) / (tot_c + |V|))``;
terms outside the dictionary are ignored; view probabilities are averaged
and the arg-max class wins (lowest class on ties).
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.arrays import explode_rows
from ..session import materialize

# The three views and their dictionary bounds (share of
# documents, minimum document frequency) as in the reference trainer.
VIEWS = {
    "QUERY": (1.0, 0),
    "TITLE": (1.0, 0),
    "QUERY_AND_TITLE": (0.2, 3),
}
CLASSES = (1, 2, 3, 4)


def view_text(view: str, query: str = "query", title: str = "product_title") -> Column:
    if view == "QUERY":
        return F.col(query)
    if view == "TITLE":
        return F.col(title)
    return F.concat(F.col(query), F.lit(" "), F.col(title))


def bag_tokens(c: Column) -> Column:
    """Normalized, white-space tokenized, stemmed tokens."""
    return F.transform(F.filter(T.tokenize_ws(T.normalize_text(c)), lambda x: x != ""), T.s_stem)


class Bag(NamedTuple):
    """``places``: ``(view, id, tid)``, the text that a row has in a view;
    ``terms``: ``(view, tid, term, tf)`` of each distinct text."""

    places: DataFrame
    terms: DataFrame


def bag_of_terms(docs: DataFrame, views: Sequence[str] = tuple(VIEWS)) -> Bag:
    """Unigrams plus tagged bigrams of each distinct text per view."""
    rows = docs.select("id", F.explode(F.array(*[F.struct(F.lit(v).alias("view"), view_text(v).alias("text")) for v in views])).alias("x"))
    rows = materialize(rows.select("x.view", "id", F.xxhash64("x.view", "x.text").alias("tid"), "x.text"))
    texts = rows.groupBy("view", "tid").agg(F.min("text").alias("text"))
    tokens = texts.select("view", "tid", bag_tokens(F.col("text")).alias("_tok"))
    words = explode_rows(tokens.select("view", "tid", F.concat("_tok", T.word_bigrams_tagged(F.col("_tok"))).alias("_terms")),
                         F.col("_terms"), "term", "view", "tid")
    return Bag(rows.select("view", "id", "tid"),
               materialize(words.groupBy("view", "tid", "term").agg(F.count(F.lit(1)).alias("tf"))))


def train_statistics(bag: Bag, labels: DataFrame, k: int, views: Sequence[str] = tuple(VIEWS),
                     classes: Sequence[int] = CLASSES) -> dict[str, DataFrame]:
    """``dict`` (see module docstring) and ``models``: per (view, f) the dictionary
    bounds, its size, and by class the term total and log prior.

    ``labels``: ``(id, label, fold)`` for the labelled rows, fold in 1..k.
    """
    spark = labels.sparkSession
    times = bag.places.join(labels, "id").groupBy("view", "tid", "fold", "label").agg(F.count(F.lit(1)).alias("m"))
    cells = (bag.terms.join(times, ["view", "tid"]).groupBy("view", "term", "fold", "label")
             .agg(F.sum(F.col("tf") * F.col("m")).alias("a"), F.sum("m").alias("d")))
    totals = F.array(*[F.sum(F.when(F.col("label") == c, F.col("a")).otherwise(0)) for c in classes])
    dictionary = materialize(cells.groupBy("view", "term").agg(
        F.sum("d").alias("dt"), totals.alias("at"), F.collect_list(F.struct("fold", "label", "a", "d")).alias("cells")))
    # labelled rows by fold and class: a table of k * classes rows
    ncf = labels.groupBy("fold", "label").agg(F.count(F.lit(1)).alias("n"))
    own = F.when(F.col("fold") != F.col("f"), F.col("n")).otherwise(0)
    by_class = [F.sum(F.when(F.col("label") == c, own).otherwise(0)).alias(f"n{c}") for c in classes]
    sizes = (ncf.withColumn("f", F.explode(F.sequence(F.lit(0), F.lit(k)))).groupBy("f")
             .agg(F.sum(own).alias("n_f"), *by_class))
    params = spark.createDataFrame([(v, float(VIEWS[v][0]), max(int(VIEWS[v][1]), 1)) for v in views], "view string, max_share double, min_df int")
    bounds = materialize(params.join(sizes).select(
        "view", "f", "min_df", (F.col("max_share") * F.col("n_f")).alias("hi"),
        F.array(*[F.when(F.col(f"n{c}") > 0, F.log(F.col(f"n{c}") / F.col("n_f"))) for c in classes]).alias("prior")))
    each = (dictionary.withColumn("f", F.explode(F.sequence(F.lit(0), F.lit(k)))).join(bounds, ["view", "f"]))
    each = _fold_counts(each, classes).where(_in_dictionary())
    sums = each.groupBy("view", "f").agg(F.count(F.lit(1)).alias("vsize"),
                                         F.array(*[F.sum(F.col("cnt")[i]) for i in range(len(classes))]).alias("tot"))
    zero = F.array(*[F.lit(0).cast("long") for _ in classes])
    models = materialize(bounds.join(sums, ["view", "f"], "left").select(
        "view", "f", "min_df", "hi", "prior", F.coalesce("vsize", F.lit(0)).alias("vsize"), F.coalesce("tot", zero).alias("tot")))
    return {"dict": dictionary, "models": models}


def _fold_counts(rows: DataFrame, classes: Sequence[int]) -> DataFrame:
    """``df`` and ``cnt`` (by class) of the term under model ``f`` of the row."""
    rows = rows.withColumn("_own", F.filter("cells", lambda x: x["fold"] == F.col("f")))
    zero = F.lit(0).cast("long")

    def own(c: int) -> Column:
        return F.aggregate(F.filter("_own", lambda x: x["label"] == c), zero, lambda s, x: s + x["a"])

    return rows.withColumn("df", F.col("dt") - F.aggregate("_own", zero, lambda s, x: s + x["d"])).withColumn(
        "cnt", F.array(*[F.col("at")[i] - own(c) for i, c in enumerate(classes)])).drop("_own", "cells")


def _in_dictionary() -> Column:
    return (F.col("df") >= F.col("min_df")) & (F.col("df") <= F.col("hi"))


def predict_views(bag: Bag, model_of: DataFrame, stats: dict[str, DataFrame],
                  classes: Sequence[int] = CLASSES) -> DataFrame:
    """``(view, id, p)``: class probabilities (an array in class order, null for a class
    without training rows) under model ``f`` of the row. ``model_of``: ``(id, f)``."""
    placed = materialize(bag.places.join(model_of, "id"))
    asked = placed.groupBy("view", "tid").agg(F.collect_set("f").alias("fs"))
    rows = materialize(bag.terms.join(asked, ["view", "tid"]))
    hits = (rows.join(stats["dict"], ["view", "term"]).withColumn("f", F.explode("fs"))
            .join(stats["models"].select("view", "f", "min_df", "hi"), ["view", "f"]))
    hits = _fold_counts(hits, classes).where(_in_dictionary())
    logs = F.array(*[F.sum(F.col("tf") * F.log(F.col("cnt")[i] + 1)) for i in range(len(classes))])
    found = hits.groupBy("view", "tid", "f").agg(F.sum("tf").alias("n"), logs.alias("x"))
    out = placed.join(found, ["view", "tid", "f"], "left").join(stats["models"].drop("min_df", "hi"), ["view", "f"])
    # a text without dictionary terms gets the priors
    score = F.transform(F.sequence(F.lit(0), F.lit(len(classes) - 1)), lambda i: (
        F.get("prior", i) + F.coalesce(F.get("x", i), F.lit(0.0))
        - F.coalesce("n", F.lit(0)) * F.log(F.get("tot", i) + F.col("vsize"))))
    out = out.select("view", "id", F.when(F.col("n").isNull(), F.col("prior")).otherwise(score).alias("s"))
    out = out.withColumn("e", F.transform("s", lambda v: F.exp(v - F.array_max("s"))))
    return out.select("view", "id", _shares("e").alias("p"))


def _shares(c: str) -> Column:
    total = F.aggregate(c, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    return F.transform(c, lambda x: x / total)


def average_probabilities(view_probs: DataFrame, classes: Sequence[int] = CLASSES) -> DataFrame:
    """``(id, p, prediction)``: sum of the view probabilities normalized to 1 (an array),
    and the class with the largest, the first of equal ones."""
    sums = view_probs.groupBy("id").agg(F.array(*[F.sum(F.col("p")[i]) for i in range(len(classes))]).alias("s"))
    p = sums.select("id", _shares("s").alias("p"))
    return p.withColumn("prediction", F.element_at(F.array(*[F.lit(c) for c in classes]), F.array_position("p", F.array_max("p")).cast("int")))


def by_label(probs: DataFrame, *keep: str, classes: Sequence[int] = CLASSES) -> DataFrame:
    """``keep, label, p``: one row per class that has a probability."""
    pairs = F.arrays_zip(F.array(*[F.lit(c) for c in classes]).alias("label"), F.col("p").alias("p"))
    return (probs.select(*keep, F.explode(pairs).alias("x")).select(*keep, F.col("x.label").alias("label"), F.col("x.p").alias("p"))
            .where(F.col("p").isNotNull()))


def nb_three_view(docs: DataFrame, folds: DataFrame, k: int, label: str = "median_relevance") -> DataFrame:
    """Whole train -> predict flow: out-of-fold predictions for labelled rows,
    the all-train model for unlabelled rows. ``docs``: (id, query, product_title);
    ``folds``: (id, label, fold) for labelled rows. Returns (id, p, prediction)."""
    labels = folds.select("id", F.col(label).cast("int").alias("label"), "fold")
    bag = bag_of_terms(docs)
    stats = train_statistics(bag, labels, k)
    model_of = (docs.select("id").join(labels.select("id", "fold"), "id", "left")
                .select("id", F.coalesce("fold", F.lit(0)).alias("f")))
    return average_probabilities(predict_views(bag, model_of, stats))


def nb_model_table(stats: dict[str, DataFrame], f: int = 0, classes: Sequence[int] = CLASSES) -> DataFrame:
    """Log-likelihood table of model ``f``: ``(view, label, term, log_lik)`` over
    its dictionary (fold ``f``'s own counts removed)."""
    rows = stats["dict"].withColumn("f", F.lit(f)).join(stats["models"], ["view", "f"])
    rows = _fold_counts(rows, classes).where(_in_dictionary())
    lik = F.transform(F.arrays_zip("cnt", "tot"), lambda x: F.log((x["cnt"] + 1) / (x["tot"] + F.col("vsize"))))
    return by_label(rows.select("view", "term", lik.alias("p")), "view", "term", classes=classes).withColumnRenamed("p", "log_lik")
