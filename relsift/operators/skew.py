"""Skew-safe building blocks used by the other operators.

* ``rank_within``: ``row_number() over (partition by g order by o)`` without
  putting a whole group in one task: a range-partitioned sort spreads a hot
  group over many tasks, then per-partition offsets are added.
* ``topk_per_group``: exact top-k per group in two phases (salted pieces first,
  then at most ``buckets * k`` candidates per group).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

def _cols(cols: Sequence) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def rank_within(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence,
                out: str = "rn") -> DataFrame:
    """1-based row number per group in the given (total) order, skew-safe.

    The frame is range-sorted (hot groups span many partitions), tagged with the
    partition id and the local position, and checkpointed so both uses below see
    one layout. Offsets come from a (partition, group) count table whose size is
    about #groups + #partitions.
    """
    group_cols = list(group_cols)
    tagged = materialize(
        df.orderBy(*_cols(group_cols), *_cols(order_cols))
        .withColumn("_mid", F.monotonically_increasing_id()))
    pid = F.shiftright(F.col("_mid"), 33)
    loc = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    stats = (tagged.groupBy(pid.alias("_pid"), *group_cols)
             .agg(F.count(F.lit(1)).alias("_n"), F.min(loc).alias("_lo")))
    w = Window.partitionBy(*group_cols).orderBy("_pid")
    stats = stats.withColumn("_off", F.sum("_n").over(w) - F.col("_n")).drop("_n")
    joined = tagged.withColumn("_pid", pid).join(stats, ["_pid", *group_cols])
    return (joined.withColumn(out, F.col("_off") + (loc - F.col("_lo")) + 1)
            .drop("_pid", "_lo", "_off", "_mid"))


def topk_per_group(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence,
                   k: int, out: str = "rank", buckets: int = 256,
                   salt: Column | None = None) -> DataFrame:
    """Exact top-k rows per group by ``order_cols`` (a total order), in two phases."""
    group_cols = list(group_cols)
    order = _cols(order_cols)
    if salt is None:
        salt = F.xxhash64(*[F.col(c) for c in df.columns if c not in group_cols])
    piece = F.pmod(salt, F.lit(buckets))
    w1 = Window.partitionBy(*group_cols, "_salt").orderBy(*order)
    cand = (df.withColumn("_salt", piece).withColumn("_r1", F.row_number().over(w1))
            .where(F.col("_r1") <= k).drop("_r1", "_salt"))
    w2 = Window.partitionBy(*group_cols).orderBy(*order)
    return cand.withColumn(out, F.row_number().over(w2)).where(F.col(out) <= k)
