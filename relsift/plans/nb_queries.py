"""Registered queries: three-view naive Bayes with 10 stratified folds
(SURVEY 2.7 nb_* rows). The oracle trains every fold model explicitly on its
own training rows (an independent formulation of the count subtraction)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as EV
from ..operators import naive_bayes as NB
from ..sources.fixture import relevance_table
from . import oracle as O
from ..session import materialize
from .registry import register
from .text_queries import _bigrams_sql, _nb_tokens_sql

K = 10
SEED = 0


def _inputs(spark, sf_dir):
    rel = materialize(relevance_table(spark, sf_dir).select("id", "query", "product_title", "median_relevance"))
    folds = EV.stratified_folds(rel.select("id", "median_relevance"), k=K, seed=SEED)
    docs = rel.select("id", "query", "product_title")
    labels = materialize(folds.select("id", F.col("median_relevance").cast("int").alias("label"), "fold"))
    return docs, labels


def _model(spark, sf_dir):
    docs, labels = _inputs(spark, sf_dir)
    bag = NB.bag_of_terms(docs)
    stats = NB.train_statistics(bag, labels, K)
    model_of = (docs.select("id").join(labels.select("id", "fold"), "id", "left")
                .select("id", F.coalesce("fold", F.lit(0)).alias("f")))
    return bag, stats, model_of, labels


def _view_sql(view: str) -> str:
    text = {"QUERY": "query", "TITLE": "product_title", "QUERY_AND_TITLE": "query || ' ' || product_title"}[view]
    return f"SELECT '{view}' AS view, id, {_nb_tokens_sql(text)} AS tk FROM rel"


NB_CTES = f"""
bagv AS ({' UNION ALL '.join(_view_sql(v) for v in NB.VIEWS)}),
bag AS (SELECT view, id, term, count(*) AS tf FROM (
          SELECT view, id, unnest(list_concat(tk, {_bigrams_sql('tk')})) AS term FROM bagv) GROUP BY ALL),
nbfolds AS (SELECT id, median_relevance AS label,
            cast((row_number() OVER (PARTITION BY median_relevance
                  ORDER BY md5('{SEED}:' || cast(id AS varchar)), id) - 1) % {K} + 1 AS integer) AS fold
            FROM rel WHERE median_relevance IS NOT NULL),
params AS (SELECT * FROM (VALUES ('QUERY', 1.0, 1), ('TITLE', 1.0, 1), ('QUERY_AND_TITLE', 0.2, 3)) p(view, share, mindf)),
models AS (SELECT unnest(range(0, {K} + 1)) AS f),
tr AS (SELECT m.f, l.id, l.label FROM models m JOIN nbfolds l ON l.fold <> m.f),
nf AS (SELECT f, count(*) AS n FROM tr GROUP BY f),
prior AS (SELECT f, label, ln(count(*) / max(n)) AS lp FROM tr JOIN nf USING (f) GROUP BY f, label),
cnt AS (SELECT b.view, t.f, b.term, t.label, sum(b.tf) AS cnt FROM bag b JOIN tr t USING (id) GROUP BY ALL),
dff AS (SELECT b.view, t.f, b.term, count(*) AS df FROM bag b JOIN tr t USING (id) GROUP BY ALL),
voc AS (SELECT d.view, d.f, d.term FROM dff d JOIN nf USING (f) JOIN params p USING (view)
        WHERE d.df >= p.mindf AND d.df <= p.share * nf.n),
vsz AS (SELECT view, f, count(*) AS v FROM voc GROUP BY ALL),
tot AS (SELECT c.view, c.f, c.label, sum(c.cnt) AS tot FROM cnt c JOIN voc USING (view, f, term) GROUP BY ALL),
scoring AS (SELECT r.id, coalesce(l.fold, 0) AS f FROM rel r LEFT JOIN nbfolds l USING (id)),
cls AS (SELECT unnest([1, 2, 3, 4]) AS label),
views AS (SELECT unnest(['QUERY', 'TITLE', 'QUERY_AND_TITLE']) AS view),
docterms AS (SELECT b.view, s.id, s.f, b.term, b.tf FROM bag b JOIN scoring s USING (id) JOIN voc USING (view, f, term)),
llt AS (SELECT d.view, d.id, c.label, sum(d.tf * ln((coalesce(cn.cnt, 0) + 1) / (tt.tot + vz.v))) AS s
        FROM docterms d CROSS JOIN cls c
        LEFT JOIN cnt cn ON cn.view = d.view AND cn.f = d.f AND cn.term = d.term AND cn.label = c.label
        JOIN tot tt ON tt.view = d.view AND tt.f = d.f AND tt.label = c.label
        JOIN vsz vz ON vz.view = d.view AND vz.f = d.f GROUP BY ALL),
sc AS (SELECT s.id, vw.view, c.label, pr.lp + coalesce(lt.s, 0) AS s
       FROM scoring s CROSS JOIN views vw CROSS JOIN cls c
       JOIN prior pr ON pr.f = s.f AND pr.label = c.label
       LEFT JOIN llt lt ON lt.view = vw.view AND lt.id = s.id AND lt.label = c.label),
pv0 AS (SELECT *, exp(s - max(s) OVER (PARTITION BY id, view)) AS e FROM sc),
pv AS (SELECT id, view, label, e / sum(e) OVER (PARTITION BY id, view) AS p FROM pv0),
avgp AS (SELECT id, label, sum(p) AS sp FROM pv GROUP BY ALL),
fin AS (SELECT id, label, sp / sum(sp) OVER (PARTITION BY id) AS p FROM avgp)"""


def _nb(body: str) -> str:
    return O.with_rel(body, extra=NB_CTES)


@register("nb_three_view", _nb(
    "SELECT DISTINCT id, first_value(label) OVER (PARTITION BY id ORDER BY p DESC, label) AS prediction FROM fin"))
def q_nb_three_view(spark, sf_dir):
    bag, stats, model_of, _ = _model(spark, sf_dir)
    return NB.average_probabilities(NB.predict_views(bag, model_of, stats)).select("id", "prediction")


@register("average_probabilities", _nb("SELECT id, label, " + O.r6("p") + " AS p FROM fin"))
def q_avg_probs(spark, sf_dir):
    bag, stats, model_of, _ = _model(spark, sf_dir)
    return NB.by_label(NB.average_probabilities(NB.predict_views(bag, model_of, stats)), "id")


@register("nb_predict", _nb("SELECT view, id, label, " + O.r6("p") + " AS p FROM pv"))
def q_nb_predict(spark, sf_dir):
    bag, stats, model_of, _ = _model(spark, sf_dir)
    return NB.by_label(NB.predict_views(bag, model_of, stats), "view", "id")


@register("nb_train", _nb(
    "SELECT v.view, c.label, v.term, " + O.r6("ln((coalesce(cn.cnt, 0) + 1) / (tt.tot + vz.v))") + " AS log_lik "
    "FROM voc v CROSS JOIN cls c "
    "LEFT JOIN cnt cn ON cn.view = v.view AND cn.f = v.f AND cn.term = v.term AND cn.label = c.label "
    "JOIN tot tt ON tt.view = v.view AND tt.f = v.f AND tt.label = c.label "
    "JOIN vsz vz ON vz.view = v.view AND vz.f = v.f WHERE v.f = 0"))
def q_nb_train(spark, sf_dir):
    stats = _model(spark, sf_dir)[1]
    return NB.nb_model_table(stats, 0)


@register("nb_fold_qwk", _nb(
    "SELECT count(*) AS folds, " + O.r6("min(q)") + " AS min, " + O.r6("avg(q)") + " AS mean, "
    + O.r6("max(q)") + " AS max FROM ("
    "SELECT l.fold, CASE WHEN avg(l.label * l.label) + avg(p.prediction * p.prediction) "
    "- 2 * avg(l.label) * avg(p.prediction) = 0 THEN NULL ELSE "
    "1 - avg((l.label - p.prediction) * (l.label - p.prediction)) / "
    "(avg(l.label * l.label) + avg(p.prediction * p.prediction) - 2 * avg(l.label) * avg(p.prediction)) END AS q "
    "FROM nbfolds l JOIN (SELECT DISTINCT id, first_value(label) OVER (PARTITION BY id ORDER BY p DESC, label) "
    "AS prediction FROM fin) p USING (id) GROUP BY l.fold)"))
def q_nb_fold_qwk(spark, sf_dir):
    bag, stats, model_of, labels = _model(spark, sf_dir)
    pred = NB.average_probabilities(NB.predict_views(bag, model_of, stats)).select("id", "prediction")
    per_fold = EV.qwk(labels.join(pred, "id"), "label", "prediction", groups=["fold"])
    return per_fold.agg(F.count(F.lit(1)).alias("folds"), F.min("qwk").alias("min"),
                        F.avg("qwk").alias("mean"), F.max("qwk").alias("max"))
