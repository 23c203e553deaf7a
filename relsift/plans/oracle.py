"""DuckDB oracle SQL for the registered queries.

Written separately from the Spark operators (independent formulas), over the
driver's pre-registered views. Shared pieces are CTE text; repeated feature
blocks are generated from one small table of formulas per block.
"""

from __future__ import annotations

WS = r"[ \t\n\x0B\f\r]"

REL_CTES = rf"""
toks AS (
  SELECT doc_id, lang, source,
         list_filter(string_split_regex(text, '{WS}+'), lambda x: x <> '') AS w
  FROM documents),
anchor AS (SELECT lang, source, min(doc_id) AS a FROM documents GROUP BY lang, source),
qq AS (SELECT an.lang, an.source, array_to_string(list_slice(t.w, 1, 3), ' ') AS query
       FROM anchor an JOIN toks t ON t.doc_id = an.a),
rel AS (
  SELECT t.doc_id AS id, qq.query,
         array_to_string(list_slice(t.w, 1, 12), ' ') AS product_title,
         nullif(array_to_string(list_slice(t.w, 13, len(t.w)), ' '), '') AS product_description,
         cast(1 + 2*l.quality + (1 - l.toxic) AS integer) AS median_relevance,
         cast(CASE WHEN l.doc_id IS NOT NULL THEN (t.doc_id % 5) * 0.25 END AS double) AS relevance_variance
  FROM toks t JOIN qq ON qq.lang = t.lang AND qq.source = t.source
  LEFT JOIN labels l ON l.doc_id = t.doc_id)"""


def scrub_sql(c: str) -> str:
    return (f"regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace({c}, '{WS}', ' ', 'g')),"
            f" '[^a-z 0-9-]', '', 'g'), ' +', ' ', 'g'), '^ ', '')")


SREL_CTE = f"""
srel AS (
  SELECT id, {scrub_sql('query')} AS query, {scrub_sql('product_title')} AS product_title,
         {scrub_sql('product_description')} AS product_description,
         median_relevance, relevance_variance
  FROM rel)"""


def with_rel(body: str, scrubbed: bool = True, extra: str = "") -> str:
    ctes = REL_CTES + ("," + SREL_CTE if scrubbed else "") + ("," + extra if extra else "")
    return "WITH " + ctes + "\n" + body


def r6(expr: str) -> str:
    """Round a double to 6 places and fold -0.0 into 0.0."""
    return f"(round(cast({expr} AS double), 6) + 0.0)"


# --- pair-feature building blocks (DuckDB lambdas) -------------------------

def sql_chars(s: str) -> str:
    return f"(CASE WHEN length({s}) = 0 THEN []::varchar[] ELSE string_split({s}, '') END)"


def sql_shingles(s: str, n: int) -> str:
    return (f"(CASE WHEN length({s}) < {n} THEN [{s}] "
            f"ELSE list_transform(range(1, length({s}) - {n} + 2), lambda i: substr({s}, i, {n})) END)")


def sql_stem(t: str) -> str:
    return (f"(CASE WHEN length({t}) > 3 AND regexp_matches({t}, '[^ae]ies$') THEN regexp_replace({t}, 'ies$', 'y') "
            f"WHEN length({t}) > 3 AND regexp_matches({t}, '[^aeo]es$') THEN regexp_replace({t}, 'es$', 'e') "
            f"WHEN length({t}) > 3 AND regexp_matches({t}, '[^us]s$') THEN regexp_replace({t}, 's$', '') "
            f"ELSE {t} END)")


def sql_words(s: str) -> str:
    toks = f"list_filter(string_split_regex(trim(lower({s})), '[^a-z0-9_]+'), lambda x: x <> '')"
    return f"list_transform({toks}, lambda w: {sql_stem('w')})"


def sql_nd(a: str) -> str:
    return f"len(list_distinct({a}))"


def sql_union(a: str, b: str) -> str:
    return f"len(list_distinct(list_concat({a}, {b})))"


def sql_common(a: str, b: str) -> str:
    return f"len(list_filter(list_distinct({a}), lambda x: list_contains({b}, x)))"


def sql_only(a: str, b: str) -> str:
    """Distinct items of a that are not in b."""
    return f"len(list_filter(list_distinct({a}), lambda x: NOT list_contains({b}, x)))"


def sql_div(n: str, d: str) -> str:
    return f"(CASE WHEN ({d}) = 0 THEN NULL ELSE cast({n} AS double) / ({d}) END)"


def sql_prefix(a: str, b: str) -> str:
    m = f"least(length({a}), length({b}))"
    return (f"(CASE WHEN {m} = 0 THEN 0 ELSE coalesce(list_min(list_filter(range(1, {m} + 1), "
            f"lambda i: substr({a}, i, 1) <> substr({b}, i, 1))) - 1, {m}) END)")


def sql_entropy(s: str) -> str:
    p = f"((length({s}) - length(replace({s}, c, ''))) / length({s}))"
    return (f"(CASE WHEN length({s}) = 0 THEN 0.0 ELSE "
            f"list_sum(list_transform(list_distinct(string_split({s}, '')), lambda c: -{p} * log2({p}))) END)")


def sql_digits(s: str) -> str:
    return f"length(regexp_replace({s}, '[^0-9]', '', 'g'))"


def distance_select(q: str = "query", t: str = "product_title") -> list[tuple[str, str]]:
    """(name, expr) of the 70 features over array columns built in ``arr``."""
    pre, suf = sql_prefix(q, t), f"(CASE WHEN {q} = {t} THEN 0 ELSE {sql_prefix(f'reverse({q})', f'reverse({t})')} END)"
    lq, lt = f"length({q})", f"length({t})"
    dq, dt = sql_digits(q), sql_digits(t)
    cols = [
        ("queryentropy", sql_entropy(q)), ("titleentropy", sql_entropy(t)),
        ("btitleinquery", f"CASE WHEN contains({t}, {q}) THEN 1 ELSE 0 END"),
        ("longestprefix", pre), ("longestsuffix", suf),
        ("longestQueryPrefixPerc", f"CASE WHEN {lq} = 0 THEN 0 ELSE {pre} / {lq} END"),
        ("longestQuerySuffixPerc", f"CASE WHEN {lq} = 0 THEN 0 ELSE {suf} / {lq} END"),
        ("longestTitlePrefixPerc", f"CASE WHEN {lt} = 0 THEN 0 ELSE {pre} / {lt} END"),
        ("longestTitleSuffixPerc", f"CASE WHEN {lt} = 0 THEN 0 ELSE {suf} / {lt} END"),
        ("numtitledigits", dt), ("numquerydigits", dq), ("numdigitdiff", f"abs({dt} - {dq})"),
        ("bindigiteq", f"CASE WHEN {dt} = {dq} THEN 1 ELSE 0 END"),
        ("charjaccardsim", sql_div(sql_only("tc", "qc"), sql_union("qc", "tc"))),
        ("charcossim", sql_div(sql_common("qc", "tc"), f"sqrt({sql_nd('qc')} * {sql_nd('tc')})")),
    ]
    for n in range(3, 8):
        qa, ta = f"q{n}", f"t{n}"
        cols += [
            (f"charquerycount{n}", f"len({qa})"), (f"chartitlecount{n}", f"len({ta})"),
            (f"charngcount{n}", sql_union(qa, ta)),
            (f"charngjacc{n}", sql_div(sql_only(ta, qa), sql_union(qa, ta))),
            (f"charngcos{n}", sql_div(sql_common(qa, ta), f"sqrt({sql_nd(qa)} * {sql_nd(ta)})")),
        ]
    for i in range(1, 6):
        cols += [
            (f"wordquerycount{i}", "len(qw)"), (f"wordtitlecount{i}", "len(tw)"),
            (f"wordngcount{i}", sql_union("qw", "tw")), (f"leftngcount{i}", sql_only("qw", "tw")),
            (f"wordngjacc{i}", sql_div(sql_only("tw", "qw"), sql_union("qw", "tw"))),
            (f"wordngcos{i}", sql_div(sql_common("qw", "tw"), f"sqrt({sql_nd('qw')} * {sql_nd('tw')})")),
        ]
    return cols


def distance_features_sql(src: str = "srel", q: str = "query", t: str = "product_title",
                          outcome: str | None = "median_relevance") -> str:
    arrs = [f"{sql_chars(q)} AS qc", f"{sql_chars(t)} AS tc", f"{sql_words(q)} AS qw", f"{sql_words(t)} AS tw"]
    for n in range(3, 8):
        arrs += [f"{sql_shingles(q, n)} AS q{n}", f"{sql_shingles(t, n)} AS t{n}"]
    oc = f", {outcome}" if outcome else ""
    arr_cte = f"arr AS (SELECT id, {q}, {t}{oc}, {', '.join(arrs)} FROM {src})"
    sel = ", ".join(f"{r6(e)} AS {name}" for name, e in distance_select(q, t))
    out = f", {r6(outcome)} AS outcome" if outcome else ""
    return arr_cte, f"SELECT id, {sel}{out} FROM arr"
