"""Augmentation: result titles harvested from stored result pages become
pseudo-labelled train rows.

The network crawl itself is not rebuilt; the ``pages`` table stands in for the
fetched result pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_text
from .skew import rank_within

# Fixed values of the crawler: results kept per page, first pseudo-row id,
# the label and variance given to harvested rows.
TOP_K_RESULTS = 10
START_ID = 326680
PSEUDO_RELEVANCE = 4
PSEUDO_VARIANCE = 0.0

# [pin] A result title is the text of a list-item link of the stored page.
RESULT_PATTERN = r'<li><a href="[^"]*">([^<]*)</a></li>'
TITLE_PATTERN = r"<title>([^<]*)</title>"


def harvest_results(pages: DataFrame, k: int = TOP_K_RESULTS) -> DataFrame:
    """``(page_id, pos, product_title)``: result positions 1..k (position 0 is
    skipped), normalized (lower, trim, letters/digits/spaces), empty ones dropped."""
    links = pages.select("page_id", F.regexp_extract_all("html", F.lit(RESULT_PATTERN), 1).alias("_l"))
    pos = links.select("page_id", F.posexplode_outer("_l").alias("pos", "_t")).where(F.col("_t").isNotNull())
    kept = pos.where((F.col("pos") >= 1) & (F.col("pos") <= k))
    norm = kept.select("page_id", "pos", normalize_text(F.trim(F.lower("_t"))).alias("product_title"))
    return norm.where(F.col("product_title") != "")


def page_queries(pages: DataFrame) -> DataFrame:
    """[pin] The query a stored page answers: its normalized ``<title>``."""
    return pages.select("page_id", normalize_text(F.regexp_extract("html", TITLE_PATTERN, 1)).alias("query"))


def pseudo_label_rows(pages: DataFrame, start_id: int = START_ID, after: DataFrame | None = None) -> DataFrame:
    """Harvested titles as train rows: blank description, relevance 4, variance 0,
    ids ``start_id + rank - 1`` in (page_id, pos) order (a skew-safe global rank
    instead of the crawler's racy counter). With ``after`` (rows with an ``id``) the ids
    start behind the largest of these, so none repeats."""
    res = harvest_results(pages).join(page_queries(pages), "page_id")
    ranked = rank_within(res, [], ["page_id", "pos"], out="_rn")
    first = F.lit(start_id)
    if after is not None:
        first = after.agg(F.coalesce(F.max("id") + 1, F.lit(start_id))).scalar()
    return ranked.select(
        (first + F.col("_rn") - 1).cast("long").alias("id"),
        "query", "product_title",
        F.lit("").alias("product_description"),
        F.lit(PSEUDO_RELEVANCE).cast("int").alias("median_relevance"),
        F.lit(PSEUDO_VARIANCE).cast("double").alias("relevance_variance"),
    )


def augment_train(train: DataFrame, pages: DataFrame) -> DataFrame:
    """Train rows plus pseudo-labelled rows, whose ids follow the largest train id."""
    return train.unionByName(pseudo_label_rows(pages, after=train))

