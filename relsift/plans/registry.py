"""Registered queries: one Spark callable (spark, sf_dir) -> DataFrame per
operator of the inventory, plus the DuckDB oracle text where one exists.

Each callable reads the driver tables (through the ``rel`` fixture or
directly), runs the operator on the whole table, and rounds doubles to 6
places so the value hash can be compared with the oracle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

from ..operators import features as FE
from ..session import materialize
from ..sources.fixture import relevance_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column and element of a double array (and fold -0.0 into 0.0)
    for hash comparison. NaN in an array is how a vector holds a null; it becomes one."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, ArrayType) and isinstance(f.dataType.elementType, (DoubleType, FloatType)):
            cols.append(F.transform(F.col(f.name), lambda x: F.when(~F.isnan(x), F.round(x, digits) + F.lit(0.0))).alias(f.name))
            continue
        if isinstance(f.dataType, (DoubleType, FloatType)):
            cols.append((F.round(F.col(f.name), digits) + F.lit(0.0)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = lambda spark, sf_dir: rounded(fn(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def srel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FE.scrub_table(relevance_table(spark, sf_dir))


def srel_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scrubbed fixture materialized once, for queries that read it in
    several branches (a frame used twice is otherwise computed twice)."""
    return materialize(srel(spark, sf_dir))
