"""Query-title pair measures as column expressions (row-local, no shuffle).

The set measures take two arrays (items of the query, items of the title) and
follow the reference's arithmetic, including its misleading names:

* ``title_only_share`` (called Jaccard there) = |set(t) - set(q)| / |set(q) u set(t)|
* ``union_count`` (called matches there)      = |set(q) u set(t)|
* ``ochiai`` (called cosine there)            = |q n t| / sqrt(|set(q)| * |set(t)|)
* ``leftover``                                = |set(q) - set(t)|

Undefined ratios (0/0) are ``null`` [pin].
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import chars


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(num: Column, den: Column) -> Column:
    """``num / den`` as double, null when ``den`` is 0 (no ANSI error)."""
    return F.when(den != 0, num.cast("double") / den.cast("double"))


def char_entropy(c) -> Column:
    """Shannon entropy in bits of the characters of a string; '' -> 0."""
    s = _c(c)
    n = F.length(s).cast("double")

    def step(acc, ch):
        p = (F.length(s) - F.length(F.replace(s, ch, F.lit("")))).cast("double") / n
        return acc - p * F.log2(p)

    ent = F.aggregate(F.array_distinct(chars(s)), F.lit(0.0).cast("double"), step)
    return F.when(F.length(s) == 0, F.lit(0.0)).otherwise(ent)


def common_prefix(a, b) -> Column:
    """Length of the common prefix."""
    a, b = _c(a), _c(b)
    m = F.least(F.length(a), F.length(b))
    first_diff = F.array_min(F.filter(F.sequence(F.lit(1), m),
                                      lambda i: F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1))))
    return F.when(m == 0, F.lit(0)).otherwise(F.coalesce(first_diff - 1, m))


def common_suffix(a, b) -> Column:
    """Length of the common suffix; 0 when the strings are identical (reference quirk)."""
    a, b = _c(a), _c(b)
    return F.when(a == b, F.lit(0)).otherwise(common_prefix(F.reverse(a), F.reverse(b)))


def digit_count(c) -> Column:
    """Number of ASCII digits."""
    return F.length(F.regexp_replace(_c(c), "[^0-9]", ""))


def union_count(q, t) -> Column:
    return F.size(F.array_union(_c(q), _c(t)))


def leftover(q, t) -> Column:
    return F.size(F.array_except(_c(q), _c(t)))


def title_only_share(q, t) -> Column:
    q, t = _c(q), _c(t)
    return safe_div(F.size(F.array_except(t, q)), F.size(F.array_union(q, t)))


def ochiai(q, t) -> Column:
    q, t = _c(q), _c(t)
    nq = F.size(F.array_distinct(q))
    nt = F.size(F.array_distinct(t))
    return safe_div(F.size(F.array_intersect(q, t)), F.sqrt((nq * nt).cast("double")))


def contains_flag(t, q) -> Column:
    """1 if ``t`` contains ``q`` literally (empty ``q`` -> 1), else 0."""
    return F.when(F.contains(_c(t), _c(q)), 1).otherwise(0)
