"""Embedding tables: usable rows and dealing them out in shards and query blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id, v`` (double array): ids and vectors not null, every component finite.

    An id stands for one vector; if it repeats, the smallest vector (in array order)
    counts, so repeated rows change nothing."""
    raw = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (raw.where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(F.coalesce(finite, F.lit(False)))
            .groupBy("id").agg(F.min("v").alias("v")))


def pieces(rows: int, most: int) -> int:
    return max(1, -(-rows // most))


def dealt(df: DataFrame, own: str, own_parts: int, other: str, other_parts: int, key) -> DataFrame:
    """Rows with their own part (by a hash of ``key``), repeated for each part of the
    other side: a query set against all rows, in blocks of bounded size."""
    return (df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(own_parts)).cast("int"))
            .withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(other_parts - 1)))))


def matrix(column: pa.ChunkedArray, rows: int, dtype=np.float64) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    flat = column.combine_chunks()
    flat = pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(rows, -1)


def best_per_query(found: DataFrame, k: int) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k highest scores, ties to the smaller id.
    The rank filter runs before the shuffle too, so a query sends k rows per task."""
    from pyspark.sql import Window

    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
