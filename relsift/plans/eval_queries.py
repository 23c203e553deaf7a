"""Registered queries: folds, QWK and confusion tables.

Until a model is involved, the prediction of a train row is the query's
maximum train rating (``maxr``), a deterministic stand-in.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as EV
from ..operators import features as FE
from . import oracle as O
from .registry import register, srel

K = 10
SEED = 0

SCORED_CTE = """
scored AS (
  SELECT s.id, s.median_relevance, cast(r.maxr AS integer) AS prediction
  FROM srel s JOIN (SELECT query, max(median_relevance) AS maxr FROM srel
                    WHERE median_relevance IS NOT NULL GROUP BY query) r ON r.query = s.query
  WHERE s.median_relevance IS NOT NULL)"""

FOLDS_CTE = f"""
folds AS (
  SELECT *, cast((row_number() OVER (PARTITION BY median_relevance
                   ORDER BY md5('{SEED}:' || cast(id AS varchar)), id) - 1) % {K} + 1 AS integer) AS fold
  FROM scored)"""


def scored(spark, sf_dir):
    s = srel(spark, sf_dir)
    mm = FE.query_minmax_rating(s)
    return (s.where(F.col("median_relevance").isNotNull()).join(mm, "id")
            .select("id", "median_relevance", F.col("maxr").cast("int").alias("prediction")))


def scored_folds(spark, sf_dir):
    return EV.stratified_folds(scored(spark, sf_dir), k=K, seed=SEED)


def _w(body: str, folds: bool = False, more: str = "") -> str:
    extra = SCORED_CTE + ("," + FOLDS_CTE if folds else "") + ("," + more if more else "")
    return O.with_rel(body, extra=extra)


@register("stratified_folds", _w("SELECT id, median_relevance, fold FROM folds", folds=True))
def q_folds(spark, sf_dir):
    return scored_folds(spark, sf_dir).select("id", "median_relevance", "fold")


@register("fold_split", _w(
    "SELECT f.id, i.fold_i, cast(CASE WHEN f.fold = i.fold_i THEN 1 ELSE 0 END AS integer) AS is_test "
    f"FROM folds f, (SELECT unnest(range(1, {K} + 1)) AS fold_i) i", folds=True))
def q_fold_split(spark, sf_dir):
    return EV.fold_split(scored_folds(spark, sf_dir), K).select("id", "fold_i", "is_test")


# Oracle QWK by the confusion-matrix definition (independent of the moment form).
QWK_MATRIX = """
SELECT {qwk} AS qwk, (SELECT count(*) FROM scored) AS n"""
_QWK_DEN = ("(SELECT sum((ha.a - hb.b) * (ha.a - hb.b) * ha.c * hb.c) / (SELECT count(*) FROM scored)"
            "    FROM (SELECT median_relevance AS a, count(*) AS c FROM scored GROUP BY 1) ha,"
            "         (SELECT prediction AS b, count(*) AS c FROM scored GROUP BY 1) hb)")
QWK_EXPR = ("CASE WHEN " + _QWK_DEN + " = 0 THEN NULL ELSE 1 - (SELECT sum((median_relevance - prediction) * "
            "(median_relevance - prediction)) FROM scored) / " + _QWK_DEN + " END")


@register("qwk", _w(QWK_MATRIX.format(qwk=O.r6(QWK_EXPR))))
def q_qwk(spark, sf_dir):
    return EV.qwk(scored(spark, sf_dir))


@register("qwk_fixed_range", _w("SELECT " + O.r6(QWK_EXPR) + " AS qwk"))
def q_qwk_fixed(spark, sf_dir):
    return EV.qwk_fixed_range(scored(spark, sf_dir))


FOLD_QWK_SQL = """
SELECT count(*) AS folds, {mn} AS min, {q1} AS q1, {md} AS median, {mean} AS mean, {q3} AS q3, {mx} AS max
FROM (
  SELECT o.fold, CASE WHEN e.s = 0 THEN NULL ELSE 1 - o.s / e.s END AS qwk
  FROM (SELECT fold, sum((median_relevance - prediction) * (median_relevance - prediction)) AS s
        FROM folds GROUP BY fold) o
  JOIN (SELECT ha.fold, sum((ha.a - hb.b) * (ha.a - hb.b) * ha.c * hb.c) / max(n.n) AS s
        FROM (SELECT fold, median_relevance AS a, count(*) AS c FROM folds GROUP BY 1, 2) ha
        JOIN (SELECT fold, prediction AS b, count(*) AS c FROM folds GROUP BY 1, 2) hb ON ha.fold = hb.fold
        JOIN (SELECT fold, count(*) AS n FROM folds GROUP BY 1) n ON n.fold = ha.fold
        GROUP BY ha.fold) e ON e.fold = o.fold)"""


@register("fold_qwk", _w(FOLD_QWK_SQL.format(
    mn=O.r6("min(qwk)"), q1=O.r6("quantile_cont(qwk, 0.25)"), md=O.r6("quantile_cont(qwk, 0.5)"),
    mean=O.r6("avg(qwk)"), q3=O.r6("quantile_cont(qwk, 0.75)"), mx=O.r6("max(qwk)")), folds=True))
def q_fold_qwk(spark, sf_dir):
    return EV.fold_qwk(scored_folds(spark, sf_dir))


@register("rating_histogram", _w(
    "SELECT r.rating, coalesce(c.n, 0) AS n FROM "
    "(SELECT cast(unnest(range(min(median_relevance), max(median_relevance) + 1)) AS integer) AS rating "
    " FROM scored) r LEFT JOIN (SELECT median_relevance AS rating, count(*) AS n FROM scored GROUP BY 1) c "
    "ON c.rating = r.rating"))
def q_histogram(spark, sf_dir):
    return EV.rating_histogram(scored(spark, sf_dir))


@register("confusion_matrix", _w(
    "SELECT g.a, g.b, coalesce(c.n, 0) AS n FROM g LEFT JOIN "
    "(SELECT median_relevance AS a, prediction AS b, count(*) AS n FROM scored GROUP BY 1, 2) c "
    "ON c.a = g.a AND c.b = g.b",
    more="rng AS (SELECT least(min(median_relevance), min(prediction)) AS lo, "
    "greatest(max(median_relevance), max(prediction)) AS hi FROM scored), "
    "g AS (SELECT cast(a.a AS integer) AS a, cast(b.b AS integer) AS b FROM "
    "(SELECT unnest(range(lo, hi + 1)) AS a FROM rng) a, (SELECT unnest(range(lo, hi + 1)) AS b FROM rng) b)"))
def q_confusion(spark, sf_dir):
    return EV.confusion_matrix(scored(spark, sf_dir))


@register("confusion_pct", _w(
    "SELECT median_relevance AS obs, prediction AS pred, "
    + O.r6("count(*) / sum(count(*)) OVER ()") + " AS share FROM scored GROUP BY 1, 2"))
def q_confusion_pct(spark, sf_dir):
    return EV.confusion_pct(scored(spark, sf_dir))


@register("class_proportions", _w(
    "SELECT 'label' AS kind, median_relevance AS class, "
    + O.r6("count(*) / sum(count(*)) OVER ()") + " AS share FROM scored GROUP BY 2 "
    "UNION ALL SELECT 'prediction' AS kind, prediction AS class, "
    + O.r6("count(*) / sum(count(*)) OVER ()") + " AS share FROM scored GROUP BY 2"))
def q_proportions(spark, sf_dir):
    s = scored(spark, sf_dir)
    return (EV.class_proportions(s, "median_relevance").select(F.lit("label").alias("kind"), "class", "share")
            .unionByName(EV.class_proportions(s, "prediction")
                         .select(F.lit("prediction").alias("kind"), "class", "share")))
