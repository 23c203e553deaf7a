"""Row-local text cleaning and tokenizing as Spark column expressions.

Everything here returns a ``Column`` built from built-in functions and
higher-order functions, so it runs inside the JVM (no Python workers) and
fuses into one projection with the caller's other columns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's behaviour -----------------
# White space as written out (Java's \s and DuckDB's \s differ on \x0B).
WS_CLASS = r"[ \t\n\x0B\f\r]"
WS_CHARS = " \t\n\x0b\f\r"
# The same without the space itself.
WS_CHANGED = r"[\t\n\x0B\f\r]"
# Classes of single characters: the pattern engine looks them up in one bit set, where
# ranges are compared one by one (8 times slower over whole texts).
_ALNUM = "abcdefghijklmnopqrstuvwxyz0123456789"
# Runs of characters that the scrubber drops.
SCRUB_DROP = f"[^{_ALNUM} -]+"
# Runs of characters between word tokens.
NON_WORD = f"[^{_ALNUM}_]+"
# Tag words removed by the (disabled) markup variant of the scrubber.
MARKUP_TAG_WORDS = ["li", "ul", "hr", "h1", "h2", "h3", "h4", "h5", "body", "p", "div", "table"]
# Start and end tags around the word sequence before bigrams ([pin]).
START_TAG = "<s>"
END_TAG = "</s>"
# Stand-in for a dash between word characters while punctuation is dropped.
_DASH_MARK = "\ue000"
# --------------------------------------------------------------------------


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def scrub(c, markup: bool = False) -> Column:
    """White space -> ' ', lower, (markup rules), drop chars outside ``[a-z 0-9-]``,
    collapse spaces, drop one leading space. A trailing space stays.

    The patterns match only what changes (a space is not replaced by a space), so the
    cost of a text is that of reading it, not of a match per word."""
    x = F.lower(F.regexp_replace(_c(c), WS_CHANGED, " "))
    if markup:
        x = scrub_markup_rules(x)
    x = F.regexp_replace(x, SCRUB_DROP, "")
    return F.ltrim(F.regexp_replace(x, " {2,}", " "))  # at most one leading space is left


def scrub_markup_rules(x: Column) -> Column:
    """The CSS/HTML removal steps of the disabled scrubber variant, in order."""
    x = F.regexp_replace(x, r"\.[a-z]+" + WS_CLASS, " ")
    x = F.regexp_replace(x, r"\b[a-z]+\.[a-z]+\b", " ")
    x = F.regexp_replace(x, r"\b[a-z-]+:[^;]+;", " ")
    x = F.regexp_replace(x, r"\b(" + "|".join(MARKUP_TAG_WORDS) + r")\b", " ")
    x = F.regexp_replace(x, "'", "")
    x = F.regexp_replace(x, ":", " ")
    x = F.regexp_replace(x, r"\.", " ")
    x = F.regexp_replace(x, "<[a-z]+>", "")
    return F.regexp_replace(x, "</[a-z]+>", "")


def combine_text(*cols) -> Column:
    """``a + ' ' + b [+ ' ' + c]``; null parts are skipped."""
    return F.concat_ws(" ", *[_c(c) for c in cols])


def tokenize_ws(c) -> Column:
    """Split on runs of white space, keeping empty tokens (trailing space -> '')."""
    return F.split(_c(c), WS_CLASS + "+", -1)


def tokenize_space(c) -> Column:
    """Split on single spaces, keeping empty tokens."""
    return F.split(_c(c), " ", -1)


def tokenize_nonempty(c) -> Column:
    """Split on spaces and drop empty tokens."""
    return F.filter(F.split(_c(c), " ", -1), lambda t: t != "")


def normalize_text(c) -> Column:
    """[pin] Lower case; white space -> ' '; keep letters, digits and spaces;
    collapse and trim spaces."""
    x = F.lower(F.regexp_replace(_c(c), WS_CLASS, " "))
    x = F.regexp_replace(x, r"[^\p{L}\p{N} ]", "")
    return F.trim(F.regexp_replace(x, " +", " "))


def s_stem(t: Column) -> Column:
    """[pin] Light plural stemmer (Harman's S-stemmer, 1991), first rule that applies:
    ``-ies`` -> ``-y`` unless ``-eies``/``-aies``; ``-es`` -> ``-e`` unless
    ``-aes``/``-ees``/``-oes``; ``-s`` -> '' unless ``-us``/``-ss``. Words of
    three characters or less are kept as they are."""
    long_enough = F.length(t) > 3
    return (F.when(long_enough & t.rlike("[^ae]ies$"), F.regexp_replace(t, "ies$", "y"))
            .when(long_enough & t.rlike("[^aeo]es$"), F.regexp_replace(t, "es$", "e"))
            .when(long_enough & t.rlike("[^us]s$"), F.regexp_replace(t, "s$", ""))
            .otherwise(t))


def word_tokens(c) -> Column:
    """[pin] lower + trim, split on non-word characters, drop empty tokens."""
    return F.filter(F.split(F.trim(F.lower(_c(c))), NON_WORD, -1), lambda t: t != "")


def tokenize_word(c, stem: bool = True) -> Column:
    """Word tokens, each stemmed with :func:`s_stem`."""
    toks = word_tokens(c)
    return F.transform(toks, s_stem) if stem else toks


def remove_stopwords(tokens, stopwords: list[str]) -> Column:
    """Drop the listed words from a token array."""
    stop = F.array(*[F.lit(w) for w in stopwords])
    return F.filter(_c(tokens), lambda t: ~F.array_contains(stop, t))


def remove_punct_keep_dash(c) -> Column:
    """Drop ASCII punctuation but keep a dash that stands between word characters.
    Two passes of the protecting rule make it safe for ``a-b-c``."""
    x = _c(c)
    for _ in range(2):
        x = F.regexp_replace(x, r"(\w)-(\w)", "$1" + _DASH_MARK + "$2")
    x = F.regexp_replace(x, r"\p{Punct}", "")
    return F.regexp_replace(x, _DASH_MARK, "-")


def word_bigrams_tagged(tokens) -> Column:
    """Tag start and end, then all adjacent word pairs as ``'w1 w2'``."""
    a = F.concat(F.array(F.lit(START_TAG)), _c(tokens), F.array(F.lit(END_TAG)))
    return F.transform(F.sequence(F.lit(1), F.size(a) - 1),
                       lambda i: F.concat_ws(" ", F.element_at(a, i), F.element_at(a, i + 1)))


def _slice_join(a: Column, n: int):
    # A one-argument lambda: PySpark reads a second parameter as the element index.
    return lambda i: F.array_join(F.slice(a, i, n), " ")


def _substr_at(p: Column, n: int):
    return lambda i: F.substr(p, i, F.lit(n))


def word_ngrams(tokens, n_min: int = 1, n_max: int = 3) -> Column:
    """All word n-grams for n in [n_min, n_max], joined by a space, shorter n first."""
    a = _c(tokens)
    parts = []
    for n in range(n_min, n_max + 1):
        grams = F.transform(F.sequence(F.lit(1), F.size(a) - n + 1), _slice_join(a, n))
        parts.append(F.when(F.size(a) >= n, grams).otherwise(F.array().cast("array<string>")))
    return F.concat(*parts)


def char_shingles(c, q: int) -> Column:
    """Sliding character q-grams; a string shorter than q gives itself as one token."""
    s = _c(c)
    # at each character the q from there on, in one pass of the pattern engine
    grams = F.regexp_extract_all(s, F.lit(f"(?s)(?=(.{{{q}}}))."), F.lit(1))
    return F.when(F.length(s) < q, F.array(s)).otherwise(grams)


def chars(c) -> Column:
    """Characters of a string as an array (empty string -> empty array)."""
    s = _c(c)
    return F.when(F.length(s) == 0, F.array().cast("array<string>")).otherwise(F.split(s, ""))


def char_wb_ngrams(c, n_min: int = 1, n_max: int = 6) -> Column:
    """Character n-grams inside word bounds: lower, split on white space, pad each
    word with one space on both sides; per padded word of length L all n-grams for
    n < L, and the whole padded word once if L <= n_max."""
    words = F.filter(F.split(F.lower(_c(c)), WS_CLASS + "+", -1), lambda t: t != "")

    def per_word(w):
        p = F.concat(F.lit(" "), w, F.lit(" "))
        L = F.length(p)
        parts = []
        for n in range(n_min, n_max + 1):
            grams = F.transform(F.sequence(F.lit(1), L - n + 1), _substr_at(p, n))
            parts.append(F.when(L > n, grams).otherwise(F.array().cast("array<string>")))
        parts.append(F.when(L <= n_max, F.array(p)).otherwise(F.array().cast("array<string>")))
        return F.concat(*parts)

    return F.flatten(F.transform(words, per_word))
