"""Registered queries of the subpackage and their DuckDB SQL.

Each query applies its operator with production parameters to the whole intended
table and keeps the columns that the result calls for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, hnsw, language_id, license_scan, merkle_fingerprint, ngram_join, pivot_topk, prefix_trie, sentencepiece_codec, source_mix, suffix_dedup, toxicity, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

WORD_COUNT_SQL = r"len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))"


def register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def held_out(modulus: int, remainder: int):
    """Whether crc32 of the id's text has this remainder; a null id is like ''."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % modulus == remainder


def model_path() -> str:
    """The public tokenizer's file, at the same place on every machine."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@register("op1_pivot_topk", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256.0::DOUBLE * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_topk.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)


@register("op2_sentencepiece")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_documents(table(spark, sf_dir, "documents"), model_path(), with_ids=False)


@register("op3_hnsw")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


@register("op4_suffix_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("_row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@register("op5_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    weights = toxicity.train(docs, table(spark, sf_dir, "labels"), held_out_modulus=5)
    scored = toxicity.score_toxicity(docs, weights)
    return scored.select("doc_id", held_out(5, 0).alias("held_out"), "score", "predicted", "sentences")


@register("op6_ngram_join", r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w),
t AS (SELECT doc_id, unnest(s) AS token FROM s),
n AS (SELECT doc_id, len(s) AS n FROM s),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM t a JOIN t b ON a.token = b.token AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM n UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other)
SELECT n.doc_id, n.n AS n_shingles, min(other) AS component_id FROM n JOIN reach USING (doc_id) GROUP BY ALL""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"), n=4, num=85, den=100)


@register("op7_source_mix", rf"""
WITH sized AS (SELECT doc_id, source, coalesce({WORD_COUNT_SQL}, 0) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT + 1]::DOUBLE AS w FROM s),
r AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / w AS ratio FROM w),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate FROM r),
f AS (SELECT min_by(rate, ratio) FILTER (NOT ratio < rate) AS rate FROM l),
t AS (SELECT source, source_size, CASE WHEN ratio < l.rate THEN cap ELSE f.rate * w END AS target,
        ('0x' || substr(md5(coalesce(source, '') || '|' || (source IS NULL)::INT || '|{source_mix.SEED}'), 1, 5))::BIGINT
          / {1 << 20}::DOUBLE AS off FROM l, f),
e AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS step FROM t),
c AS (SELECT *, CASE WHEN size < 8 THEN size ELSE (length(bin(size)) - 3) * 8 + (size >> (length(bin(size)) - 4)) - 8 END AS cls,
        ((((coalesce(doc_id, 0) % 2147483647) + 2147483647) % 2147483647) * 48271) % 2147483647 AS scattered FROM sized),
b AS (SELECT source, cls, greatest({source_mix.MIN_BUCKETS}, ceil(count(*) / {source_mix.BUCKET_ROWS}.0))::BIGINT AS buckets FROM c GROUP BY source, cls),
k AS (SELECT doc_id, size, e.*, row_number() OVER (PARTITION BY c.source ORDER BY c.cls, scattered % buckets, size, doc_id) AS rn
      FROM c JOIN e ON c.source IS NOT DISTINCT FROM e.source JOIN b ON c.source IS NOT DISTINCT FROM b.source AND c.cls = b.cls)
SELECT doc_id, size, source_size, target,
  (size * least(floor(rn * step + off) - floor((rn - 1) * step + off), ceil(step)))::BIGINT AS taken FROM k""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix_sources(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


@register("op8_language_id")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs, ~held_out(4, 2))
    return language_id.identify(docs, model).select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score")


_SENTENCES_SQL = ", ".join(f"('{s}', '{i}')" for s, i in sorted(license_scan.known_sentences().items()))
_RULES_SQL = ", ".join(f"('{name}', '{license_scan.rule_pattern(ids)}')" for name, ids in license_scan.RULES)


@register("op9_license_scan", rf"""
WITH known(sentence, sentence_id) AS (VALUES {_SENTENCES_SQL}),
rules(license, pattern) AS (VALUES {_RULES_SQL}),
kw AS (SELECT sentence_id, sentence, string_split(sentence, ' ') AS w, len(string_split(sentence, ' ')) AS n FROM known),
los AS (SELECT *, unnest(range(0, n)) AS lo FROM kw),
his AS (SELECT *, unnest(range(lo + 1, n + 1)) AS hi FROM los),
runs AS (SELECT sentence_id, sentence, n, lo, array_to_string(w[lo + 1:hi], ' ') AS piece FROM his),
docs AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
parts AS (SELECT r, doc_id, string_split_regex(regexp_replace(lower(replace(text, chr(9), ' ')), '([.!?]) +', '\1' || chr(10), 'g'), '[\n\r]+') AS p FROM docs),
cut AS (SELECT r, doc_id, unnest(p) AS raw, generate_subscripts(p, 1) - 1 AS pos FROM parts),
fine AS (SELECT r, doc_id, pos, string_split_regex(raw, ': +') AS q FROM cut),
small AS (SELECT r, doc_id, pos, unnest(q) AS raw, generate_subscripts(q, 1) AS sub FROM fine),
pieces AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY pos, sub) AS nth FROM (SELECT r, doc_id, pos, sub,
             trim(regexp_replace(raw, '[^a-z0-9]+', ' ', 'g')) AS piece FROM small) WHERE piece <> ''),
matched AS (SELECT r, doc_id, pos, nth, piece, len(string_split(piece, ' ')) AS words, sentence_id, sentence, n, lo FROM pieces JOIN runs USING (piece)),
laid AS (SELECT r, nth, nth - row_number() OVER w AS stretch, sum(words) OVER w - words AS before
       FROM (SELECT DISTINCT r, nth, words FROM matched) WINDOW w AS (PARTITION BY r ORDER BY nth)),
whole AS (SELECT r, doc_id, stretch, sentence_id, before - lo AS start, n, list(nth ORDER BY nth) AS nths, min(pos) AS pos
          FROM matched JOIN laid USING (r, nth) GROUP BY ALL HAVING sum(words) = n),
own AS (SELECT *, max(n) OVER (PARTITION BY r, k) AS longest FROM (SELECT *, unnest(nths) AS k FROM whole)),
hits AS (SELECT r, doc_id, pos, nths[1] AS nth, sentence_id FROM own GROUP BY r, doc_id, stretch, sentence_id, start, n, nths, pos HAVING max(longest) = n),
seq AS (SELECT doc_id, CASE WHEN doc_id IS NULL THEN r ELSE 0 END AS alone, count(*) AS n_sentences, min(pos)::INT AS first_pos, max(pos)::INT AS last_pos,
          string_agg(sentence_id, ',' ORDER BY pos, nth, sentence_id) AS sentence_ids FROM hits GROUP BY ALL),
found AS (SELECT seq.doc_id, alone, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses
          FROM seq JOIN rules ON regexp_matches(',' || sentence_ids || ',', pattern) GROUP BY ALL)
SELECT seq.doc_id, n_sentences, first_pos, last_pos, sentence_ids, coalesce(licenses, '') AS licenses
FROM seq LEFT JOIN found ON seq.doc_id IS NOT DISTINCT FROM found.doc_id AND seq.alone = found.alone""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(spark, table(spark, sf_dir, "documents"))


def captures(pages: DataFrame) -> DataFrame:
    """Pages with a fetch time; the table has none, so it follows from ``page_id``."""
    at = F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.col("page_id") * 7919, F.lit(730)) * 86400)
    return pages.select("page_id", "url", at.cast("timestamp_ntz").alias("fetched_at"))


def list_entries(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts of the pages: hosts whose name speaks of casinos or
    trackers are listed early on, each third other host by its name's length and first
    letter, and half of those are taken off again."""
    host = F.regexp_extract("url", "^[a-z]+://([^/?#:]+)", 1)
    hosts = pages.select(host.alias("host")).where("host != ''").distinct()
    code = F.length("host") * 31 + F.ascii(F.element_at(F.split("host", r"\."), -3)) * 7
    day = lambda n: F.timestamp_seconds(F.lit(1704067200) + n * 86400).cast("timestamp_ntz")
    bad = F.col("host").rlike("casino|ads|track|porn|pill")
    added = hosts.where(bad | (code % 3 == 0)).select(
        F.when(bad, F.concat(F.lit("*."), F.col("host"))).otherwise(F.col("host")).alias("pattern"),
        F.when(bad, F.lit("spam")).otherwise(F.lit("listed")).alias("category"), F.lit("add").alias("action"),
        day(F.when(bad, F.lit(30)).otherwise(code % 600)).alias("listed_at"))
    removed = hosts.where(~bad & (code % 6 == 0)).select(
        F.col("host").alias("pattern"), F.lit("listed").alias("category"), F.lit("remove").alias("action"), day(code % 600 + 90).alias("listed_at"))
    paths = hosts.where(code % 5 == 1).select(
        F.concat("host", F.lit("/de")).alias("pattern"), F.lit("path").alias("category"), F.lit("add").alias("action"), day(code % 400).alias("listed_at"))
    return added.unionByName(removed).unionByName(paths)


@register("op10_url_filter", r"""
WITH hosts AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host FROM pages),
coded AS (SELECT host, length(host) * 31 + ascii(string_split(host, '.')[-3]) * 7 AS code,
            regexp_matches(host, 'casino|ads|track|porn|pill') AS bad FROM hosts WHERE host <> ''),
entries AS (
  SELECT CASE WHEN bad THEN '*.' || host ELSE host END AS pattern, CASE WHEN bad THEN 'spam' ELSE 'listed' END AS category,
    'add' AS action, TIMESTAMP '2024-01-01' + to_days((CASE WHEN bad THEN 30 ELSE code % 600 END)::INT) AS listed_at
    FROM coded WHERE bad OR code % 3 = 0
  UNION ALL SELECT host, 'listed', 'remove', TIMESTAMP '2024-01-01' + to_days((code % 600 + 90)::INT) FROM coded WHERE NOT bad AND code % 6 = 0
  UNION ALL SELECT host || '/de', 'path', 'add', TIMESTAMP '2024-01-01' + to_days((code % 400)::INT) FROM coded WHERE code % 5 = 1),
cap AS (SELECT page_id, url, TIMESTAMP '2024-01-01' + to_days(((page_id * 7919) % 730)::INT) AS fetched_at,
    regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)), ':\d*$', '') AS host,
    lower(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1)) AS path FROM pages),
state AS (SELECT page_id, url, cap.host AS host, fetched_at, pattern, category, action, listed_at,
    row_number() OVER (PARTITION BY page_id, url, pattern, category ORDER BY listed_at DESC, action DESC) AS rn
  FROM cap JOIN entries e ON listed_at <= fetched_at AND (pattern = host OR pattern = host || '/de' AND (path = '/de' OR starts_with(path, '/de/'))
       OR starts_with(pattern, '*.') AND (pattern = '*.' || host OR ends_with(host, substr(pattern, 2))))),
active AS (SELECT * FROM state WHERE rn = 1 AND action = 'add'),
best AS (SELECT *, count(*) OVER (PARTITION BY page_id, url) AS n_matches,
    row_number() OVER (PARTITION BY page_id, url ORDER BY length(pattern) DESC, pattern, category) AS k FROM active)
SELECT cap.page_id, cap.url, cap.host, cap.fetched_at, false AS malformed, best.page_id IS NOT NULL AS blocked,
  coalesce(n_matches, 0) AS n_matches, pattern, category, listed_at AS valid_from
FROM (SELECT DISTINCT * FROM cap) cap LEFT JOIN best ON best.page_id = cap.page_id AND best.url = cap.url AND k = 1""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.filter_urls(captures(pages), list_entries(pages))


@register("op11_merkle_fingerprint")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_fingerprint.edited_fingerprints(table(spark, sf_dir, "documents"))


#: CRC32 of a decimal number's text, bit by bit.
_CRC32_SQL = """xor(list_reduce(flatten(list_transform(string_split({x}::VARCHAR, ''), lambda ch: [ascii(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END, 4294967295::BIGINT), 4294967295::BIGINT)"""


@register("op12_prefix_trie", rf"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, {WORD_COUNT_SQL.replace('text', "coalesce(text, '')")} AS words,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT DISTINCT conv_id, {_CRC32_SQL.format(x="conv_id")} % 4 AS h, conv_id - conv_id % 20 AS base FROM t),
r AS (SELECT c.conv_id, 0 AS part, t.pos, role, text, words FROM c JOIN t ON t.conv_id = base AND t.pos <= h
  UNION ALL SELECT c.conv_id, 1, t.pos, role, text, words FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > h),
o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS d, words,
    md5(length(role) || ':' || role || text) AS turn FROM r),
p AS (SELECT conv_id, d, words, md5(string_agg(turn, '' ORDER BY d) OVER (PARTITION BY conv_id ORDER BY d)) AS path FROM o
  UNION ALL SELECT conv_id, 0, 0, 'root' FROM c),
len AS (SELECT conv_id, max(d) AS n FROM p GROUP BY conv_id),
n AS (SELECT path, min(conv_id) AS conv_id, min(d) AS depth, min(words) AS words, count(*) AS n_convs FROM p GROUP BY path),
up AS (SELECT n.path, a.path AS above FROM n JOIN p a ON a.conv_id = n.conv_id AND a.d = n.depth - 1),
kids AS (SELECT above AS path, count(*) AS n_children FROM up GROUP BY above),
full_n AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (path)),
below AS (SELECT a.path, sum((n.n_children = 0)::INT) AS n_leaves, sum((n.n_convs - 1) * n.words) AS saved_tokens
  FROM full_n n JOIN p a ON a.conv_id = n.conv_id AND a.d <= n.depth GROUP BY a.path),
ends AS (SELECT path, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM p JOIN len USING (conv_id) WHERE d = len.n GROUP BY path)
SELECT f.conv_id, f.depth::BIGINT AS depth, q.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves::BIGINT AS n_leaves,
  saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM full_n f JOIN below USING (path) LEFT JOIN ends USING (path) LEFT JOIN up USING (path) LEFT JOIN n q ON q.path = up.above""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


@register("op13_collocations", rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, k, list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' ')) AS phrases
  FROM w, range(1, {collocations.LONGEST + 1}) r(k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS a FROM (SELECT lang, k, unnest(phrases) AS phrase FROM g) GROUP BY ALL),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= {collocations.LEAST}),
cut AS (SELECT lang, k, phrase, a, m, array_to_string(w[1:m], ' ') AS first, array_to_string(w[m + 1:], ' ') AS rest FROM c, range(1, 5) r(m) WHERE m < k),
scored AS (SELECT cut.*, x.a AS l, y.a AS r, n, (1000::HUGEINT * cut.a * n) // (x.a::HUGEINT * y.a) AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = first JOIN f y ON y.lang = cut.lang AND y.phrase = rest JOIN n ON n.lang = cut.lang),
weakest AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, m) AS pick FROM scored),
inside AS (SELECT DISTINCT c.lang, array_to_string(c.w[i:i + j - 1], ' ') AS phrase, c.a
  FROM c, range(1, 5) s(i), range(2, 5) e(j) WHERE j < c.k AND i + j - 1 <= c.k),
kept AS (SELECT s.* FROM weakest s WHERE pick = 1 AND NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = s.lang AND i.phrase = s.phrase AND 100 * i.a >= 100 * s.a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked WHERE rank <= {collocations.TOP}""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))
