"""Validation and evaluation: stratified folds, QWK, confusion tables.

QWK uses the moment identity (the (K-1)^2 weight scale cancels):

    qwk = 1 - E[(a-b)^2] / (E[a^2] + E[b^2] - 2 E[a] E[b])

so it is one global aggregate (partial sums per task), no K x K matrix and no
driver loop. A zero denominator gives ``null``.
"""

from __future__ import annotations

from pyspark.ml.evaluation import Evaluator
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .skew import rank_within


def stratified_folds(df: DataFrame, label: str = "median_relevance", k: int = 10,
                     seed: int = 0, id_col: str = "id", out: str = "fold") -> DataFrame:
    """Assign labelled rows to folds 1..k with equal class shares.

    Within each class rows are ordered by ``md5('<seed>:<id>')`` (then id) and
    dealt round-robin, so every fold gets its share of every class (within one
    row). The per-class order is computed skew-safely (see ``rank_within``).
    """
    lab = df.where(F.col(label).isNotNull()).withColumn(
        "_h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string"))))
    ranked = rank_within(lab, [label], ["_h", id_col], out="_rn")
    return ranked.withColumn(out, (F.pmod(F.col("_rn") - 1, F.lit(k)) + 1).cast("int")).drop("_h", "_rn")


def fold_split(folds: DataFrame, k: int, fold_col: str = "fold") -> DataFrame:
    """Every row once per fold i = 1..k, flagged ``is_test`` when it is in fold i
    (train part = all other folds). A generator, not a join."""
    return (folds.withColumn("fold_i", F.explode(F.sequence(F.lit(1), F.lit(k))))
            .withColumn("is_test", (F.col(fold_col) == F.col("fold_i")).cast("int")))


def _qwk_expr(a: Column, b: Column) -> Column:
    a, b = a.cast("double"), b.cast("double")
    num = F.avg((a - b) * (a - b))
    den = F.avg(a * a) + F.avg(b * b) - 2 * F.avg(a) * F.avg(b)
    return F.when(den != 0, 1 - num / den)


def qwk(df: DataFrame, actual: str = "median_relevance", predicted: str = "prediction",
        groups: list[str] | None = None) -> DataFrame:
    """Quadratic weighted kappa, over all rows or per group."""
    expr = _qwk_expr(F.col(actual), F.col(predicted)).alias("qwk")
    n = F.count(F.lit(1)).alias("n")
    if groups:
        return df.groupBy(*groups).agg(expr, n)
    return df.agg(expr, n)


def qwk_fixed_range(df: DataFrame, actual: str = "median_relevance", predicted: str = "prediction",
                    min_rating: int = 1, max_rating: int = 4) -> DataFrame:
    """QWK with a fixed rating range; values are cast to integer first. The range
    does not change the value (the weight scale cancels), it only validates."""
    a = F.col(actual).cast("int")
    b = F.col(predicted).cast("int")
    checked = df.select(
        F.when((a < min_rating) | (a > max_rating) | (b < min_rating) | (b > max_rating),
               F.raise_error(F.lit("rating out of range"))).otherwise(a).alias("_a"), b.alias("_b"))
    return checked.agg(_qwk_expr(F.col("_a"), F.col("_b")).alias("qwk"))


def fold_qwk(df: DataFrame, fold_col: str = "fold", actual: str = "median_relevance",
             predicted: str = "prediction") -> DataFrame:
    """QWK per fold, then min, quartiles, median, mean and max over the folds
    (quartiles by linear interpolation, as R's ``summary``)."""
    per_fold = qwk(df, actual, predicted, groups=[fold_col])
    k = F.col("qwk")
    return per_fold.agg(
        F.count(F.lit(1)).alias("folds"),
        F.min(k).alias("min"),
        F.percentile(k, 0.25).alias("q1"),
        F.percentile(k, 0.5).alias("median"),
        F.avg(k).alias("mean"),
        F.percentile(k, 0.75).alias("q3"),
        F.max(k).alias("max"),
    )


def _rating_range(df: DataFrame, cols: list[str]) -> DataFrame:
    lo = [F.min(c) for c in cols]
    hi = [F.max(c) for c in cols]
    return df.agg((F.least(*lo) if len(lo) > 1 else lo[0]).cast("int").alias("lo"),
                  (F.greatest(*hi) if len(hi) > 1 else hi[0]).cast("int").alias("hi"))


def rating_histogram(df: DataFrame, col: str = "median_relevance",
                     min_rating: int | None = None, max_rating: int | None = None) -> DataFrame:
    """Count of every rating in [min, max] (zeros included). The range is one
    aggregate row; the ratings come from a generator over it."""
    if min_rating is None or max_rating is None:
        rng = _rating_range(df.where(F.col(col).isNotNull()), [col])
    else:
        rng = df.sparkSession.range(1).select(F.lit(min_rating).alias("lo"), F.lit(max_rating).alias("hi"))
    ratings = rng.select(F.explode(F.sequence("lo", "hi")).alias("rating"))
    counts = df.where(F.col(col).isNotNull()).groupBy(F.col(col).cast("int").alias("rating")).count()
    return (ratings.join(counts, "rating", "left")
            .select("rating", F.coalesce("count", F.lit(0)).alias("n")))


def confusion_matrix(df: DataFrame, a: str = "median_relevance", b: str = "prediction") -> DataFrame:
    """Dense counts ``(a, b, n)`` over [min, max]^2 of both ratings."""
    rated = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    rng = _rating_range(rated, [a, b])
    grid = (rng.select(F.explode(F.sequence("lo", "hi")).alias("a"), "lo", "hi")
            .select("a", F.explode(F.sequence("lo", "hi")).alias("b")))
    counts = rated.groupBy(F.col(a).cast("int").alias("a"), F.col(b).cast("int").alias("b")).count()
    return grid.join(counts, ["a", "b"], "left").select("a", "b", F.coalesce("count", F.lit(0)).alias("n"))


def confusion_pct(df: DataFrame, obs: str = "median_relevance", pred: str = "prediction") -> DataFrame:
    """Shares of each (observed, predicted) cell over all held-out rows."""
    counts = df.groupBy(F.col(obs).alias("obs"), F.col(pred).alias("pred")).count()
    total = Window.partitionBy()  # the table has at most K*K rows
    return counts.select("obs", "pred", (F.col("count") / F.sum("count").over(total)).alias("share"))


def class_proportions(df: DataFrame, col: str) -> DataFrame:
    """Share of each class (labels or predictions)."""
    counts = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("class")).count()
    return counts.select("class", (F.col("count") / F.sum("count").over(Window.partitionBy())).alias("share"))


def search_report(scores: DataFrame, setting: str = "setting", score: str = "score",
                  top: int = 5) -> DataFrame:
    """Mean and population std of fold scores per setting, best ``top`` settings."""
    agg = scores.groupBy(setting).agg(F.avg(score).alias("mean_score"),
                                      F.stddev_pop(score).alias("std_score"),
                                      F.count(F.lit(1)).alias("folds"))
    return agg.orderBy(F.desc("mean_score"), F.asc(setting)).limit(top)


class KappaEvaluator(Evaluator):
    """QWK as an MLlib evaluator (larger is better), for CrossValidator."""

    predictionCol = Param(Params._dummy(), "predictionCol", "prediction column",
                          typeConverter=TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "label column", typeConverter=TypeConverters.toString)

    def __init__(self, predictionCol: str = "prediction", labelCol: str = "label"):
        super().__init__()
        self._setDefault(predictionCol="prediction", labelCol="label")
        self._set(predictionCol=predictionCol, labelCol=labelCol)

    def _evaluate(self, dataset: DataFrame) -> float:
        p, l_ = self.getOrDefault(self.predictionCol), self.getOrDefault(self.labelCol)
        row = dataset.agg(_qwk_expr(F.col(l_), F.col(p)).alias("q")).first()
        return float(row["q"]) if row["q"] is not None else 0.0

    def isLargerBetter(self) -> bool:
        return True
