"""Stems and lemmas from a user's table of forms.

A form table has rows ``(version, token, form)``. ``version`` is a number: a row holds
from its version on, until a later row of the same token replaces it; a null ``form``
takes the token out. A ``token`` that begins with ``*`` is a suffix rule: ``*ies`` with
the form ``y`` turns ``parties`` into ``party``. A token's form is that of its own row,
else that of the longest suffix rule that leaves at least ``MIN_STEM`` characters, else
the token itself.

Rules and rows meet the *distinct* tokens of a corpus only, as equi-joins: each token
offers its suffixes no longer than the longest rule, so the work per token is bounded by
the table and no rule is tried against every token.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import explode_rows
from ..session import materialize

#: First character of a suffix rule's token.
SUFFIX_MARK = "*"
#: Characters that a suffix rule must leave.
MIN_STEM = 2


def forms_at(table: DataFrame, version: int | None = None) -> DataFrame:
    """``(token, form)`` of the rows that hold at ``version`` (null: the last).

    Rows with a null version or token, an empty token or a bare ``*`` are ignored. Of
    rows with one version and token the smallest form holds, null last. A row whose form
    is null leaves no entry."""
    rows = table.select(F.col("version").cast("long").alias("version"), "token", "form").where(
        F.col("version").isNotNull() & (F.col("token") != "") & (F.col("token") != SUFFIX_MARK))
    if version is not None:
        rows = rows.where(F.col("version") <= version)
    # the latest version first, then the smallest form: one row per token, combined map-side
    last = F.struct((-F.col("version")).alias("v"), F.col("form").isNull().alias("gone"), F.col("form").alias("form"))
    return (rows.groupBy("token").agg(F.min(last).alias("_r")).where(~F.col("_r.gone"))
            .select("token", F.col("_r.form").alias("form")))


def resolve_forms(tokens: DataFrame, forms: DataFrame, min_stem: int = MIN_STEM) -> DataFrame:
    """``(token, form, matched_by)`` of every distinct ``token``: ``entry``, ``suffix``
    or ``none``. ``forms`` is ``(token, form)`` as from ``forms_at``. Null and empty
    tokens are left out."""
    distinct = tokens.select("token").where(F.col("token") != "").distinct()
    is_rule = F.col("token").startswith(SUFFIX_MARK)
    entries = forms.where(~is_rule).select("token", F.col("form").alias("_own"))
    rules = forms.where(is_rule).select(F.substring("token", 2, 1 << 30).alias("_suffix"), F.col("form").alias("_rep"))
    longest = F.coalesce(rules.agg(F.max(F.length("_suffix"))).scalar(), F.lit(0))
    known = distinct.join(entries, "token", "left")
    open_tokens = known.where(F.col("_own").isNull()).select(
        "token", F.least(longest, F.length("token") - min_stem).alias("_most"))
    offered = open_tokens.where(F.col("_most") > 0).select(
        "token", F.explode(F.sequence(F.lit(1), "_most")).alias("_len")).select(
        "token", "_len", F.expr("right(token, _len)").alias("_suffix"))
    hit = (offered.join(rules, "_suffix").groupBy("token")
           .agg(F.max(F.struct("_len", "_rep")).alias("_hit")))
    by_rule = F.concat(F.expr("left(token, length(token) - _hit._len)"), F.col("_hit._rep"))
    return known.join(hit, "token", "left").select(
        "token", F.coalesce("_own", by_rule, "token").alias("form"),
        F.when(F.col("_own").isNotNull(), "entry").when(F.col("_hit").isNotNull(), "suffix").otherwise("none").alias("matched_by"))


def apply_forms(df: DataFrame, id_col: str, tokens: Column, forms: DataFrame,
                min_stem: int = MIN_STEM) -> DataFrame:
    """``(id_col, pos, token, form, matched_by)`` of every non-empty token of the array
    ``tokens``. The forms of the distinct tokens are a table of their own, joined back
    to a plain scan of the occurrences, whose frequent tokens Spark splits."""
    # occurrences are built twice (for the distinct tokens, for the join), not written
    rows = df.select(id_col, F.posexplode_outer(tokens).alias("pos", "token")).where(F.col("token") != "")
    table = materialize(resolve_forms(rows, forms, min_stem))
    return rows.join(table, "token").select(id_col, "pos", "token", "form", "matched_by")


def unmatched_tokens(df: DataFrame, id_col: str, tokens: Column, forms: DataFrame,
                     min_stem: int = MIN_STEM) -> DataFrame:
    """``(token, n, n_rows, rank)``: the tokens that neither an entry nor a rule
    matches, with their occurrences and the rows they are in, most frequent first (ties
    by token). ``rank`` is dense: tokens as frequent as each other share it."""
    per_row = (explode_rows(df.select(id_col, tokens.alias("_tokens")), F.col("_tokens"), "token", id_col)
               .groupBy("token", id_col).agg(F.count(F.lit(1)).alias("_n")))
    counts = materialize(per_row.where(F.col("token") != "").groupBy("token").agg(
        F.sum("_n").alias("n"), F.count(F.lit(1)).alias("n_rows")))
    none = resolve_forms(counts, forms, min_stem).where(F.col("matched_by") == "none").select("token")
    left = materialize(counts.join(none, "token"))
    # ranks of the distinct counts, which are far fewer than the tokens
    ranks = left.select("n").distinct().withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"))))
    return left.join(ranks, "n").select("token", "n", "n_rows", "rank")
