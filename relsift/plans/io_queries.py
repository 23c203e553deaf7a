"""Registered queries: augmentation, file sources and sinks
(SURVEY 2.1) as round trips through the shared scratch folder, and the
streaming form of the pair features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import augment as AU
from ..operators import corpus as C
from ..operators import evaluate as EV
from ..operators import features as FE
from ..sources import files as IO
from ..sources import lines as LI
from ..sources.fixture import read_table, relevance_table
from ..streaming.features import start_pair_feature_sink
from . import oracle as O
from .corpus_queries import NEEDED_CTE, _c, dist_cte, phrase_sql
from .nb_queries import NB_CTES
from .registry import ORACLE, register, srel, srel_shared

NORM = ("trim(regexp_replace(regexp_replace(lower(regexp_replace({x}, '" + O.WS + "', ' ', 'g')), "
        "'[^\\p{{L}}\\p{{N}} ]', '', 'g'), ' +', ' ', 'g'))")

HARVEST_SQL = f"""
SELECT page_id, pos, title AS product_title FROM (
  SELECT page_id, pos, {NORM.format(x="trim(lower(t))")} AS title FROM (
    SELECT page_id, unnest(l) AS t, unnest(range(0, len(l))) AS pos
    FROM (SELECT page_id, regexp_extract_all(html, '{AU.RESULT_PATTERN}', 1) AS l FROM pages))
  WHERE pos BETWEEN 1 AND {AU.TOP_K_RESULTS})
WHERE title <> ''"""


@register("harvest_results", HARVEST_SQL)
def q_harvest(spark, sf_dir):
    return AU.harvest_results(read_table(spark, sf_dir, "pages"))


PSEUDO_SQL = f"""
SELECT cast({AU.START_ID} + row_number() OVER (ORDER BY h.page_id, h.pos) - 1 AS bigint) AS id, q.query,
       h.product_title, '' AS product_description, 4 AS median_relevance, 0.0::double AS relevance_variance
FROM ({HARVEST_SQL}) h JOIN (SELECT page_id, {NORM.format(x="regexp_extract(html, '" + AU.TITLE_PATTERN + "', 1)")}
                             AS query FROM pages) q USING (page_id)"""


@register("pseudo_label_rows", PSEUDO_SQL)
def q_pseudo(spark, sf_dir):
    return AU.pseudo_label_rows(read_table(spark, sf_dir, "pages"))


@register("augment_train", O.with_rel(
    "SELECT id, query, product_title, product_description, median_relevance, relevance_variance "
    "FROM srel WHERE median_relevance IS NOT NULL UNION ALL SELECT id - " + str(AU.START_ID)
    + " + 1 + (SELECT max(id) FROM srel WHERE median_relevance IS NOT NULL) AS id, query, product_title, "
    "product_description, median_relevance, relevance_variance FROM (" + PSEUDO_SQL + ")"))
def q_augment(spark, sf_dir):
    train = srel(spark, sf_dir).where(F.col("median_relevance").isNotNull())
    return AU.augment_train(train, read_table(spark, sf_dir, "pages"))


# --- sources and sinks as round trips ------------------------------------------------------

@register("src_csv", O.with_rel(
    "SELECT id, query, product_title, product_description, median_relevance, relevance_variance FROM rel",
    scrubbed=False))
def q_src_csv(spark, sf_dir):
    path = IO.write_csv(relevance_table(spark, sf_dir), IO.scratch_dir(spark, "rel-csv"))
    return LI.read_csv_splits(spark, path, IO.REL_SCHEMA)


@register("src_corpus_aligned", O.with_rel(
    "SELECT row_number() OVER (ORDER BY id) AS line, id, product_title AS text FROM srel"))
def q_src_aligned(spark, sf_dir):
    """Titles and ids as two plain line files in one order, read back by line number and
    joined on it."""
    rows = srel(spark, sf_dir).select("id", "product_title").orderBy("id")
    titles, ids = IO.scratch_dir(spark, "titles"), IO.scratch_dir(spark, "ids")
    rows.select("product_title").write.text(titles)
    rows.select(F.col("id").cast("string")).write.text(ids)
    left = LI.read_numbered_lines(spark, ids, "line_id")
    right = LI.read_numbered_lines(spark, titles, "text")
    return left.join(right, "id").select(F.col("id").alias("line"), F.col("line_id").cast("long").alias("id"), "text")


@register("src_corpus_lines", O.with_rel(
    "SELECT id * 2 AS id, product_title AS text FROM srel UNION ALL "
    "SELECT id * 2 + 1 AS id, product_description AS text FROM srel WHERE product_description IS NOT NULL"))
def q_src_corpus(spark, sf_dir):
    """Titles (even ids) and descriptions (odd ids) as lines, written and read back."""
    s = srel(spark, sf_dir)
    corp = s.select((F.col("id") * 2).alias("id"), F.col("product_title").alias("text")).unionByName(
        s.where(F.col("product_description").isNotNull()).select((F.col("id") * 2 + 1).alias("id"), F.col("product_description").alias("text")))
    path = IO.write_lines(corp, IO.scratch_dir(spark, "corpus"), "text")
    return IO.read_corpus_lines(spark, path)


@register("src_distance_lines", _c(phrase_sql("dist"), NEEDED_CTE, dist_cte("dist", "npairs", "dfc")))
def q_src_distance(spark, sf_dir):
    s = srel_shared(spark, sf_dir)
    dist = C.phrase_distance(s, C.corpus_a(s, stored=True))
    path = IO.write_lines(dist, IO.scratch_dir(spark, "distances"), "distance")
    return IO.read_distance_lines(spark, path)


K = 10
FOLD_DIR_SQL = O.with_rel(
    "SELECT f.id, i.fold_i, CASE WHEN f.fold = i.fold_i THEN 'test' ELSE 'train' END AS part "
    f"FROM folds f, (SELECT unnest(range(1, {K} + 1)) AS fold_i) i",
    extra=f"folds AS (SELECT id, cast((row_number() OVER (PARTITION BY median_relevance "
          f"ORDER BY md5('0:' || cast(id AS varchar)), id) - 1) % {K} + 1 AS integer) AS fold "
          "FROM srel WHERE median_relevance IS NOT NULL)")


@register("src_fold_dir", FOLD_DIR_SQL)
def q_src_folds(spark, sf_dir):
    s = srel(spark, sf_dir).where(F.col("median_relevance").isNotNull())
    split = EV.fold_split(EV.stratified_folds(s.select("id", "median_relevance"), k=K, seed=0), K)
    path = IO.write_fold_dir(split.select("id", "fold_i", "is_test"), IO.scratch_dir(spark, "folds"))
    return IO.read_fold_dir(spark, path).select("id", F.col("fold_i").cast("int").alias("fold_i"), "part")


@register("sink_features_csv", ORACLE["distance_features"])
def q_sink_features(spark, sf_dir):
    feats = FE.distance_features(srel(spark, sf_dir))
    path = IO.write_csv(feats, IO.scratch_dir(spark, "features"))
    return spark.read.option("header", True).schema(feats.schema).csv(path)


@register("sink_submission", O.with_rel(
    "SELECT s.id, cast(coalesce(m.maxr, 4) AS integer) AS prediction FROM srel s LEFT JOIN (SELECT query, "
    "max(median_relevance) AS maxr FROM srel WHERE median_relevance IS NOT NULL GROUP BY query) m USING (query) "
    "WHERE s.median_relevance IS NULL"))
def q_sink_submission(spark, sf_dir):
    s = srel(spark, sf_dir)
    pred = FE.query_minmax_rating(s).select("id", F.coalesce("maxr", F.lit(4.0)).alias("prediction"))
    path = IO.sink_submission(pred.join(s.where(F.col("median_relevance").isNull()).select("id"), "id"),
                              IO.scratch_dir(spark, "submission"))
    return spark.read.option("header", True).schema("id long, prediction int").csv(path)


@register("sink_probabilities", O.with_rel(
    "SELECT id, " + ", ".join(O.r6(f"max(CASE WHEN label = {c} THEN p END)") + f" AS L{c}" for c in (1, 2, 3, 4))
    + " FROM fin GROUP BY id", extra=NB_CTES))
def q_sink_probs(spark, sf_dir):
    from .nb_queries import _model
    from ..operators import naive_bayes as NB
    bag, stats, model_of, _ = _model(spark, sf_dir)
    p = NB.average_probabilities(NB.predict_views(bag, model_of, stats))
    wide = p.select("id", *[F.col("p")[i].alias(f"L{i + 1}") for i in range(4)])
    path = IO.sink_probabilities(wide, IO.scratch_dir(spark, "probabilities"))
    return spark.read.parquet(path)


# --- streaming ---------------------------------------------------------------------------------

@register("stream_distance_features", ORACLE["distance_features"])
def q_stream(spark, sf_dir):
    src = IO.scratch_dir(spark, "stream-src")
    relevance_table(spark, sf_dir).select(*[f.name for f in IO.REL_SCHEMA.fields]).write.parquet(src)
    sink, ckpt = IO.scratch_dir(spark, "stream-sink"), IO.scratch_dir(spark, "stream-ckpt")
    q = start_pair_feature_sink(spark, src, sink, ckpt, available_now=True)
    q.awaitTermination()
    return spark.read.parquet(sink)

