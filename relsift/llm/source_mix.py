"""Mixing sources to target weights by systematic sampling. DataFrame functions only.

A document's size is its number of words. The sources, in code-point order with
null last, get the weights 5, 2, 1, repeating. Together they share
``budget`` (150 %) of all words in proportion to weight; a source stops at
``max_repeat`` (2) times its own size and what it leaves is shared again by weight
among the others. The final shares have a closed form: sort the sources by
``max_repeat * size / weight``; each source whose ratio lies under the share rate
left by the sources before it is full, the rest get ``rate * weight``.

Documents of a source all have the expected number of copies
``target / source_size``. Their prefix sums run in an order by size class, so that
a source's words come out close to its target; a document is emitted once for each
integer that its step crosses after one random offset per source is added.

Ranks inside a source never need the source in one task: rows are ranked inside
``(source, size class, hash bucket)``, and a small count table per source gives
each bucket its offset. The layout depends on the rows alone, so a recomputed task
gives the same rows again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, written

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MAX_REPEAT = 2.0
#: Rows of one (source, size class, hash bucket) stay near this number or below.
BUCKET_ROWS = 250_000
MIN_BUCKETS = 64
SEED = 20240607


def source_targets(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET,
                   max_repeat: float = MAX_REPEAT) -> DataFrame:
    """One row per source: ``source, src, no_src, source_size, n_docs, target``.

    ``sizes`` has ``src`` (the source, '' for null), ``no_src`` (it is null) and
    ``size``. The windows run over the source table, one row per source."""
    per = (sizes.groupBy("src", "no_src")
           .agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")))
    by_name = Window.orderBy("no_src", "src")
    w = F.array(*[F.lit(float(x)) for x in weights])
    per = per.withColumn("_w", F.element_at(w, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
    everything = Window.partitionBy(F.lit(0))
    per = per.withColumn("_cap", F.lit(max_repeat) * F.col("source_size")).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    order = Window.partitionBy(F.lit(0)).orderBy("_ratio", "no_src", "src")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    per = per.withColumn("_rate", (F.lit(budget) * F.sum("source_size").over(everything)
                                   - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(onward))
    per = per.withColumn("_full", F.col("_ratio") < F.col("_rate"))
    rate = F.min_by(F.when(~F.col("_full"), F.col("_rate")), F.when(~F.col("_full"), F.col("_ratio"))).over(everything)
    return per.select(
        F.when(~F.col("no_src"), F.col("src")).alias("source"), "src", "no_src", "source_size", "n_docs",
        F.when(F.col("_full"), F.col("_cap")).otherwise(rate * F.col("_w")).alias("target"))


def mix_sources(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, max_repeat: float = MAX_REPEAT,
                seed: int = SEED) -> DataFrame:
    """``doc_id, size, source, source_size, target, copies, taken`` for every row of ``docs``.

    ``docs`` needs ``doc_id, text, source``. Null or empty texts have size 0 and
    take 0 words. A null source is a source of its own, last in order. Rows without an
    id are dealt to buckets by their text. Repeated rows are documents of their own and are sampled each. An empty table gives no
    rows. Reruns agree: order, offset and buckets are functions of the rows."""
    sizes = written(docs.select(
        "doc_id", F.coalesce("source", F.lit("")).alias("src"), F.col("source").isNull().alias("no_src"),
        F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64("text").alias("tie")), "mix-sizes")
    # targets: one row per source
    targets = source_targets(sizes, weights, budget, max_repeat)
    per_class = (sizes.groupBy("src", "no_src", _size_class().alias("cls"))
                 .agg(F.count(F.lit(1)).alias("_n")))
    buckets = written(per_class.select("src", "no_src", "cls", F.greatest(
        F.lit(MIN_BUCKETS), F.ceil(F.col("_n") / BUCKET_ROWS)).cast("long").alias("_buckets")), "mix-buckets")
    # written, so that the ranking deals rows out by bucket and not as this join left them
    rows = written(sizes.withColumn("cls", _size_class()).join(buckets, ["src", "no_src", "cls"])
                   .withColumn("part", _scattered(F.col("doc_id"), F.col("tie")) % F.col("_buckets")).drop("_buckets"), "mix-rows")
    key = ["src", "no_src", "cls", "part"]
    inside = Window.partitionBy(*key).orderBy("size", "doc_id", "tie")
    counts = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.partitionBy("src", "no_src").orderBy("cls", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*key, F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_start"))
    drawn = F.md5(F.concat(F.col("src"), F.lit("|"), F.col("no_src").cast("int"), F.lit(f"|{seed}")))
    offset = F.conv(F.substring(drawn, 1, 5), 16, 10).cast("long") / F.lit(float(1 << 20))
    starts = (starts.join(targets, ["src", "no_src"])
              .withColumn("_step", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
              .withColumn("_offset", offset))
    ranked = rows.withColumn("_rank", F.row_number().over(inside)).join(starts, key)
    end = F.col("_start") + F.col("_rank")
    crossed = (F.floor(end * F.col("_step") + F.col("_offset"))
               - F.floor((end - 1) * F.col("_step") + F.col("_offset")))
    copies = F.least(crossed, F.ceil(F.col("_step"))).cast("int")
    return ranked.select("doc_id", "size", "source", "source_size", "target", copies.alias("copies"),
                         (copies * F.col("size")).cast("long").alias("taken"), F.col("tie").alias("text_hash"))


def _size_class():
    """The size's number of bits and its next three: classes some 12 % wide or less, so
    documents of one class have nearly one size."""
    bits = F.length(F.bin("size"))
    top = F.expr("cast(shiftright(size, length(bin(size)) - 4) as int)")
    return F.when(F.col("size") < 8, F.col("size").cast("int")).otherwise((bits - 3) * 8 + top - 8).cast("int")


def _scattered(doc_id, tie):
    """A fixed pseudo-random number below 2**31 - 1 for an id, for the text's hash where
    the id is null, so that rows without an id spread over all buckets."""
    m = F.lit((1 << 31) - 1)
    return F.pmod(F.pmod(F.coalesce(doc_id.cast("long"), tie), m) * 48271, m)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with each row emitted as often as the mix takes it (0, 1 or 2 times).

    The decision is joined back by ``doc_id`` and text hash; equal rows share
    their copies evenly, the remainder going to one of them."""
    choice = mix_sources(docs, **options)
    per = choice.groupBy("doc_id", "text_hash", F.col("source").alias("_source")).agg(
        F.sum("copies").alias("_copies"), F.count(F.lit(1)).alias("_rows"))
    names = docs.columns
    left = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_doc"),
                       F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_tie"), F.col("source").alias("_src"))
    twins = Window.partitionBy("_id", "_tie", "_src").orderBy(F.lit(0))
    joined = left.join(per, left["_id"].eqNullSafe(per["doc_id"]) & (left["_tie"] == per["text_hash"])
                       & left["_src"].eqNullSafe(per["_source"]))
    single = joined.where(F.col("_rows") == 1).select("_doc", F.col("_copies").cast("int").alias("_n"))
    nth = F.row_number().over(twins) - 1
    repeated = joined.where(F.col("_rows") > 1).select("_doc", (
        F.floor(F.col("_copies") / F.col("_rows")) + F.when(nth < F.col("_copies") % F.col("_rows"), 1).otherwise(0)).cast("int").alias("_n"))
    return (single.unionByName(repeated).where(F.col("_n") > 0)
            .select("_doc", F.explode(F.sequence(F.lit(1), F.col("_n")))).select("_doc.*"))
