"""URL filters: a dated block list joined to captures as of their fetch time. DataFrame functions only.

List entries ``(pattern, category, action, listed_at)`` say that a host, a domain
(``*.domain``) or a path prefix (``host/path``) was added to or removed from the
list at a time. ``validity_intervals`` turns the entries of a pattern into
intervals ``[valid_from, valid_to)``; ``filter_urls`` joins every capture to the
intervals that hold at its fetch time by the keys that its URL can match: the host,
each parent domain, and each path prefix cut at ``/`` that is no deeper than the
deepest path of the list. Hosts and paths are compared in lower case.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Longest host name in the domain name system; a longer one is malformed.
MAX_HOST = 253


def validity_intervals(entries: DataFrame) -> DataFrame:
    """``pattern, category, valid_from, valid_to`` (null: open) of the added spans.

    ``action`` is ``add`` or ``remove``; anything else, a null pattern and a null
    time are ignored. At one time a remove outranks an add. Repeated adds give
    consecutive spans, so at any time one span of a (pattern, category) holds."""
    clean = (entries.select(F.lower(F.trim("pattern")).alias("pattern"), "category", "action", "listed_at")
             .where(F.col("pattern").isNotNull() & F.col("listed_at").isNotNull() & F.col("action").isin("add", "remove")))
    # one row per time; 'remove' > 'add'
    clean = clean.groupBy("pattern", "category", "listed_at").agg(F.max("action").alias("action"))
    w = Window.partitionBy("pattern", "category").orderBy("listed_at")
    return (clean.withColumn("valid_to", F.lead("listed_at").over(w))
            .where(F.col("action") == "add")
            .select("pattern", "category", F.col("listed_at").alias("valid_from"), "valid_to"))


def _host(url):
    """Lower-case host without user, port and trailing dot; null for no host."""
    raw = F.lower(F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#\\\s]*)", 1))
    bare = F.regexp_replace(F.regexp_replace(raw, r"^.*@", ""), r"(?::\d*)?\.?$", "")
    return F.when((F.length(bare) > 0) & (F.length(bare) <= MAX_HOST), bare)


def _depth(pattern):
    """Number of path steps of a pattern; 0 for a host or a domain."""
    return F.size(F.filter(F.split(pattern, "/"), lambda s: s != "")) - 1


def _keys(host, labels, steps):
    """Every pattern the URL can match: host, ``*.domain`` of host and parents, and
    ``host/path`` prefixes of the given path ``steps``."""
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)),
                          lambda i: F.concat(F.lit("*."), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    prefixes = F.when(F.size(steps) > 0, F.transform(
        F.sequence(F.lit(1), F.size(steps)),
        lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(steps, F.lit(1), i), "/")))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(host), domains, prefixes))


def filter_urls(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url",
                time_col: str = "fetched_at") -> DataFrame:
    """Per capture: ``<id>, url, host, fetched_at, malformed, blocked, n_matches, pattern, category, valid_from``.

    The reported entry is the most specific (longest) pattern, then the smallest
    pattern and category. A null or hostless URL is malformed, a capture without a
    time matches nothing; neither is blocked by the list. Repeated captures (same
    id, URL and time) give one row. A listed host that holds a third of the
    captures is a skewed join key whose list side is a few rows: both sides are
    plain shuffle inputs, which Spark splits. Empty lists and tables work. A longer
    path than any of the list has no more keys than the list's deepest path, so the
    keys of a very long URL are as many as those of a short one."""
    cap = captures.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"),
                          F.col(f"`{time_col}`").alias("at"))
    cap = cap.withColumn("host", _host(F.col("url")))
    path = F.lower(F.regexp_extract("url", r"^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#\\\s]*([^?#\s]*)", 1))
    spans = validity_intervals(entries)
    # one number for the whole list, as a scalar subquery
    deepest = F.coalesce(spans.agg(F.greatest(F.max(_depth(F.col("pattern"))), F.lit(0))).scalar(), F.lit(0))
    # columns of their own: the lambdas of _keys read them once for each key
    cap = cap.withColumn("labels", F.split("host", r"\.")).withColumn(
        "steps", F.slice(F.filter(F.split(path, "/"), lambda s: s != ""), F.lit(1), deepest))
    keyed = cap.select("id", "url", "at", "host", F.explode_outer(
        F.when(F.col("host").isNotNull(), _keys(F.col("host"), F.col("labels"), F.col("steps")))).alias("key"))
    holds = ((keyed["key"] == spans["pattern"]) & (keyed["at"] >= spans["valid_from"])
             & (spans["valid_to"].isNull() | (keyed["at"] < spans["valid_to"])))
    hits = keyed.join(spans, holds, "left")
    best = F.struct((-F.length("pattern")).alias("l"), F.col("pattern").alias("pattern"),
                    F.col("category").alias("category"), F.col("valid_from").alias("valid_from"))
    one = (hits.groupBy("id", "url", "at", "host")
           .agg(F.count("pattern").alias("n_matches"), F.min(F.when(F.col("pattern").isNotNull(), best)).alias("_b")))
    return one.select(
        F.col("id").alias(id_col), F.col("url").alias(url_col), "host", F.col("at").alias(time_col),
        F.col("host").isNull().alias("malformed"), (F.col("n_matches") > 0).alias("blocked"), "n_matches",
        F.col("_b.pattern").alias("pattern"), F.col("_b.category").alias("category"), F.col("_b.valid_from").alias("valid_from"))
