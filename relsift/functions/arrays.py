"""Array helpers.

``explode_rows`` uses ``explode_outer`` and drops the null rows afterwards.
A plain ``explode`` lets the optimizer infer ``size(array) > 0`` and push that
predicate below projections and joins with the whole array expression inlined;
for arrays built by higher-order functions that re-evaluates the expression
per element of every lambda, which is quadratic or worse per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_rows(df: DataFrame, arr: Column, alias: str, *keep) -> DataFrame:
    """One row per array element, with the ``keep`` columns; no null rows."""
    return (df.select(*keep, F.explode_outer(arr).alias(alias))
            .where(F.col(alias).isNotNull()))
