"""Driver tables and the ``rel`` fixture (train + test relevance table).

``rel`` maps the driver's ``documents``/``labels`` onto the contest schema
``(id, query, product_title, product_description, median_relevance,
relevance_variance)`` as specified in FIXTURES.md:

* query        = first 3 words of the lowest-id document of the same (lang, source)
* title        = words 1..12, description = all words from 13 on (null if none)
* relevance    = 1 + 2*quality + (1 - toxic); null (test row) without a label
* variance     = (id % 5) * 0.25 on train rows
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import WS_CHARS, WS_CLASS
from ..session import materialize

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; Catalyst prunes columns and pushes filters into the scan."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# Runs of white space that are not one space already.
WS_RUNS = r"[\t\n\x0B\f\r]" + WS_CLASS + "*| " + WS_CLASS + "+"


def _joined(words: str, n: int):
    """The first ``n`` words, joined by a space."""
    return F.array_join(F.filter(F.slice(words, 1, n), lambda x: x != ""), " ")


def relevance_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``rel`` fixture over whole texts. The query of each (lang, source) comes from
    its lowest id, found without reading ``text``; only these documents' texts are split
    besides the one pass over all. The lowest ids and the queries have one row per
    (lang, source); they are stored, so that Spark knows their size before it plans the
    joins and no text is shuffled to meet them where they are small."""
    docs = read_table(spark, sf_dir, "documents")
    labels = read_table(spark, sf_dir, "labels")
    # The first words are split off, the rest stays one text: a title costs no array of all words.
    head = F.split(F.ltrim("text", F.lit(WS_CHARS)), WS_CLASS + "+", 13)
    anchors = materialize(docs.groupBy("lang", "source").agg(F.min("doc_id").alias("doc_id")))
    queries = materialize(docs.select("doc_id", "text").join(anchors, "doc_id").select("lang", "source", head.alias("w"))
                          .select("lang", "source", _joined("w", 3).alias("query")))
    rows = docs.select("doc_id", "lang", "source", head.alias("w")).join(queries, ["lang", "source"])
    rest = F.rtrim(F.regexp_replace(F.get("w", F.lit(12)), WS_RUNS, " "))
    labelled = rows.join(labels.withColumn("_labelled", F.lit(True)), "doc_id", "left")
    return labelled.select(
        F.col("doc_id").alias("id"),
        "query",
        _joined("w", 12).alias("product_title"),
        F.when(F.size("w") > 12, F.nullif(rest, F.lit(""))).alias("product_description"),
        (1 + 2 * F.col("quality") + (1 - F.col("toxic"))).cast("int").alias("median_relevance"),
        F.when(F.col("_labelled"), (F.col("doc_id") % 5) * F.lit(0.25))
        .cast("double").alias("relevance_variance"),
    )


def part_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second pair source of short strings: query ``p_name``, title name+brand+type."""
    part = read_table(spark, sf_dir, "part")
    return part.select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("query"),
        F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("product_title"),
    )
