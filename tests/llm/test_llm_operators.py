"""Small cases of the llm operators: brute force, round trips, held-out accuracy, and
nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import textwrap
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from relsift.llm import (components, hnsw, kernels, language_id, license_scan, ngram_join, pivot_topk,
                         queries, sentencepiece_codec, source_mix, suffix_dedup, toxicity, url_filter)

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, size int, id int"


def documents(spark, texts, source=None, ids=None):
    """Rows with columns that clash with names the operators use inside."""
    rows = [(ids[i] if ids else i, t, "en", source[i] if source else "s", len(t or ""), 0.5, 3, 9) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score double, shard int")


# -- kernels --------------------------------------------------------------------------

def test_words_and_hashes():
    texts = ["", "  ", "Ab c\x0bd", "ab C", None, "x" * 50, "é ü z"]
    data, offsets = kernels.column_bytes(pa.array(texts))
    starts, ends, first = kernels.words(data, offsets)
    got = [[bytes(data[starts[j]:ends[j]]).decode() for j in range(first[i], first[i + 1])] for i in range(len(texts))]
    assert got == [[], [], ["Ab", "c", "d"], ["ab", "C"], [], ["x" * 50], ["é ü", "z"]]
    h, first = kernels.word_hashes(data, offsets)
    assert h[first[2]] == h[first[3]] and h[first[2] + 1] == h[first[3] + 1]
    assert len(set(h.tolist())) == len(h) - 2


def test_column_bytes_of_a_slice():
    column = pa.array(["a", None, "ccc", "dd"]).slice(1, 3)
    data, offsets = kernels.column_bytes(column)
    assert bytes(data) == b"cccdd" and offsets.tolist() == [0, 0, 3, 5]


def test_hashes_do_not_depend_on_blocks(monkeypatch):
    text = " ".join(f"w{i % 37}" for i in range(400))
    data, offsets = kernels.column_bytes(pa.array([text]))
    whole, _ = kernels.word_hashes(data, offsets)
    monkeypatch.setattr(kernels, "BLOCK_BYTES", 64)
    assert (kernels.word_hashes(data, offsets)[0] == whole).all()


# -- 1 and 3: vectors -------------------------------------------------------------------

def brute_top(rows, queries_of, k, quantised):
    keep = {}
    for i, v, *_ in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            keep[i] = min(keep.get(i, v), v)
    out = {}
    for q, v in keep.items():
        if not queries_of(q):
            continue
        a = np.array(v, np.float64)
        found = []
        for i, w in keep.items():
            if i != q and len(w) == len(v):
                b = np.array(w, np.float64)
                score = int((np.floor(256 * a) * np.floor(256 * b)).sum()) if quantised else float((a * b).sum())
                found.append((-score, i))
        out[q] = [(i, -s) for s, i in sorted(found)[:k]]
    return out


def vector_rows(n=120, d=6, seed=3):
    rng = np.random.default_rng(seed)
    f32 = lambda v: [float(np.float32(x)) for x in v]
    rows = [(i, f32(rng.normal(size=d)), 0.1, 7) for i in range(n)]
    rows += [(n + j, rows[0][1], 0.1, 7) for j in range(30)]  # ties
    rows += [(500, None, 0.0, 0), (550, [1.0] * (d - 1) + [None], 0.0, 0), (600, [float("nan")] * d, 0.0, 0), (650, [float("inf")] * d, 0.0, 0),
             (700, [1.0, 2.0], 0.0, 0), (None, [1.0] * d, 0.0, 0), (10, rows[10][1], 0.1, 7)]
    return rows


def test_pivot_topk_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(pivot_topk, "SHARD_ROWS", 40)
    monkeypatch.setattr(pivot_topk, "BLOCK_ROWS", 2)
    rows = vector_rows()
    got = {}
    for r in pivot_topk.top_k(vectors(spark, rows), F.col("id") % 10 == 0, k=5).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = {q: v for q, v in brute_top(rows, lambda i: i % 10 == 0, 5, True).items() if v}
    assert got == want


def test_pivot_bounds_stop_early_and_stay_exact():
    rng = np.random.default_rng(1)
    x = rng.integers(-200, 200, (500, 8))
    pivots = pivot_topk.choose_pivots(x[:100].astype(float), 16)
    ids = np.arange(500)
    a, b, s = pivot_topk.search_block(ids[:20], x[:20], pivot_topk.distances(x[:20], pivots), ids, x, pivot_topk.distances(x, pivots), 3)
    full = x[:20] @ x.T
    for i in range(20):
        want = sorted(((-full[i, j], j) for j in range(500) if j != i))[:3]
        assert [(-v, j) for j, v in zip(b[a == i], s[a == i])] == want
    wide = x.astype(np.int64) * (1 << 40)  # beyond exact doubles
    a, b, s = pivot_topk.search_block(ids[:3], wide[:3], np.zeros((3, 0)), ids, wide, np.zeros((500, 0)), 2)
    assert [int(v) for v in s[a == 0]] == sorted((int(p) << 80 for p in full[0, 1:]), reverse=True)[:2]


def test_vector_searches_of_empty_tables(spark):
    empty = vectors(spark, [])
    assert pivot_topk.top_k(empty, F.col("id") % 50 == 0).collect() == []
    assert hnsw.nearest(empty, F.col("id") % 20 == 0).collect() == []
    alone = vectors(spark, [(0, [1.0, 0.0], 0.0, 0), (20, [0.0, 0.0], 0.0, 0)])
    assert hnsw.nearest(alone, F.col("id") % 20 == 0).collect() == []  # no candidate, zero takes no part


def test_hnsw_small_table_is_whole(spark):
    rows = [r for r in vector_rows() if r[0] != 700] + [(900, [0.0] * 6, 0.0, 0)]
    got = {}
    for r in hnsw.nearest(vectors(spark, rows), F.col("id") % 20 == 0, k=8).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = brute_top([r for r in rows if r[0] != 900], lambda i: i % 20 == 0, 8, False)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert all(abs(a[1] - b[1]) < 1e-12 for q in want for a, b in zip(got[q], want[q]))


def test_hnsw_recall_on_the_embeddings(spark):
    v = np.array([r[0] for r in queries.table(spark, "/root/testdata/sf0.1", "embeddings").select("embedding").collect()], np.float64)
    g = hnsw.Graph(hnsw.same_length(v)).build()
    q = v[::20]
    found = g.search(np.concatenate([q, np.zeros((len(q), 1))], axis=1))[:, :20]
    best = np.argsort(-(q @ v.T), axis=1, kind="stable")[:, :20]
    assert np.mean([len(set(a) & set(b)) / 20 for a, b in zip(found.tolist(), best.tolist())]) >= 0.95
    assert all((a[m] < len(v)).all() for a, m in zip(g.links, g.members))


# -- 2: SentencePiece ---------------------------------------------------------------------

def test_codec_equals_the_library(spark, monkeypatch):
    sp = sentencepiece_codec.load_processor(queries.model_path())
    rng = random.Random(5)
    alphabet = [" ", "  ", "▁", "a", "b", "\n", "\t", "é", "𝔘", "\x00", "<s>", "́", "ﬁ", " ", ".", "hello", "ß", "<0x41>", "　"]
    texts = [None, "", " ", "   ", "a", "x" * 5000, "word " * 3000] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(300)]
    monkeypatch.setattr(sentencepiece_codec, "BLOCK_CHARS", 50)
    monkeypatch.setattr(sentencepiece_codec, "TABLE_CHUNKS", 100)
    rows = sentencepiece_codec.encode_documents(documents(spark, texts + ["twice"], ids=[*range(len(texts)), 0]), queries.model_path(), with_text=True).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        if r["doc_id"] == 0 and r["n_tokens"] > 2:
            continue
        ids = sp.encode(texts[r["doc_id"]] or "", add_bos=True, add_eos=True)
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["decoded"] == sp.decode(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    assert sentencepiece_codec.encode_documents(documents(spark, []), queries.model_path()).count() == 0


# -- 4: suffix dedup ----------------------------------------------------------------------

def brute_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i:i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        mask = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                mask[i:i + length] = b"\1" * length
        kept = bytes(x for x, m in zip(b, mask) if not m)
        spans = sum(1 for i in range(len(mask)) if mask[i] and (i == 0 or not mask[i - 1]))
        out.append((len(b), sum(mask), spans, hashlib.sha256(kept).hexdigest()))
    return out


def repeat_texts():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage = prose(30)
    base = prose(80)
    texts = [None, "", "short", "a" * 700, "ab" * 300, prose(60), passage, prose(10) + passage + prose(5) + passage, base, base]
    for i in range(40):  # near copies
        w = base.split(" ")
        w[rng.randrange(len(w))] = word()
        texts.append(" ".join(w))
    return texts + [prose(20) + passage[:rng.randint(30, len(passage))] for _ in range(20)]


@pytest.mark.parametrize("split", [128, 2])
def test_suffix_dedup_equals_brute_force(spark, monkeypatch, split):
    monkeypatch.setattr(suffix_dedup, "SPLIT", split)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 3000)
    monkeypatch.setattr(suffix_dedup, "RANGE_WINDOWS", 200)
    texts = repeat_texts()
    got = {r["i"]: tuple(r)[1:] for r in suffix_dedup.remove_repeats(documents(spark, texts), 60).select(
        F.col("_row.doc_id").alias("i"), "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts, 60)


def test_suffix_dedup_of_long_texts_in_pieces(monkeypatch):
    rng = random.Random(2)
    text = bytes(rng.choice(b"ab c") for _ in range(5000))
    data = np.frombuffer(text, np.uint8)
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 900)
    covered = []
    for lo, hi, start, stop in suffix_dedup._text_blocks(np.array([0, len(text)]), 100):
        _, first, windows, _ = suffix_dedup.segments(data[start:stop], np.array([0, stop - start]), 100)
        covered += [start + a + j for a, w in zip(first.tolist(), windows.tolist()) for j in range(w)]
    assert covered == list(range(len(text) - 99))


def test_suffix_order_and_common_prefixes():
    rng = random.Random(4)
    text = bytes(rng.choice(b"ab") for _ in range(300)) * 2
    symbols = np.append(np.frombuffer(text, np.uint8).astype(np.uint16) + 1, 0).astype(np.uint16)
    order, key, _ = suffix_dedup.suffix_order(symbols, len(symbols))
    raw = symbols.tolist()
    assert order.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
    lcp = suffix_dedup.common_prefixes(symbols, key, order, np.ones(len(symbols), bool), 250)
    for a, b in zip(order, order[1:]):
        n = 0
        while max(a, b) + n < len(raw) and raw[a + n] == raw[b + n]:
            n += 1
        assert lcp[b] == min(n, 250)


def test_suffix_dedup_repeated_rows_null_ids_and_empty_table(spark):
    text = " ".join(str(i) for i in range(100))
    docs = documents(spark, [text, text, "other " + text[:50], None], ids=[None, None, 1, 2])
    rows = suffix_dedup.remove_repeats(docs, 60, whole_characters=True).select("_row.doc_id", "n_removed", "n_bytes").collect()
    assert sorted((r[0] is None, r[1] == r[2]) for r in rows) == [(False, False), (False, True), (True, True), (True, True)]
    assert suffix_dedup.remove_repeats(documents(spark, []), 60).count() == 0
    assert suffix_dedup.on_characters(np.array([1, 4]), np.frombuffer("éaé".encode(), np.uint8)).tolist() == [2, 3]


# -- 5: toxicity --------------------------------------------------------------------------

def test_toxicity_on_held_out_rows(spark):
    docs, labels = (queries.table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    weights = toxicity.train(docs, labels)
    scored = toxicity.score_toxicity(docs, weights).join(labels, "doc_id").where(queries.held_out(5, 0))
    table = {(r[0], r[1]): r[2] for r in scored.groupBy("toxic", "predicted").count().collect()}
    assert table[1, 1] / (table[1, 1] + table.get((1, 0), 0)) >= 0.75
    assert table.get((0, 1), 0) / table[0, 0] <= 0.01


def test_toxicity_edges(spark):
    rng = random.Random(1)
    calm = ["red blue green. soft calm day! " * rng.randint(1, 3) + f"w{i}" for i in range(300)]
    foul = [c + " you vile oaf. fine" for c in calm[:60]]
    docs = documents(spark, calm + foul)
    labels = spark.createDataFrame([(i, int(i >= 300)) for i in range(360)] + [(None, 1), (4, None)], "doc_id long, toxic int")
    w = toxicity.train(docs, labels)
    odd = documents(spark, [None, "", "...", "soft calm. what a vile oaf. blue", "soft calm day", "calm " * 200000, "soft calm day"], ids=[0, 1, 2, 3, 4, 5, 4])
    rows = {r["doc_id"]: r for r in toxicity.score_toxicity(odd, w).collect()}
    assert [rows[i]["predicted"] for i in range(6)] == [0, 0, 0, 1, 0, rows[5]["predicted"]]
    assert rows[3]["sentences"] == ["what a vile oaf."] and rows[0]["score"] == rows[2]["score"] == 0.0
    assert toxicity.score_toxicity(odd, w).count() == 7
    assert toxicity.score_toxicity(documents(spark, []), w).count() == 0
    assert toxicity.train(documents(spark, []), labels.limit(0)) is None
    assert toxicity.score_toxicity(odd, None).agg(F.max("score")).first()[0] == 0.0
    kept = toxicity.score_toxicity(odd, w, keep_row=True).where("predicted = 0").select("_row.*")
    assert kept.columns == odd.columns


# -- 6: n-gram join -----------------------------------------------------------------------

def brute_components(texts, n, num, den):
    sets = []
    for t in texts:
        w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").replace("\t", " ").replace("\n", " ").split(" ") if x]
        sets.append({tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    comp = list(range(len(texts)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i
    for i in range(len(sets)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * inter >= num * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                comp[b] = a
    return [(len(s), root(i)) for i, s in enumerate(sets)]


def near_copies():
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(400)}"
    texts = [None, "", " \n", "one two", "One TWO", "one two three", "a b c d", "a b c d e"]
    for _ in range(12):
        base = [word() for _ in range(rng.randint(20, 90))]
        for _ in range(rng.randint(1, 14)):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w + [word()] * rng.randint(0, 2)))
    line = " ".join(f"common{i}" for i in range(12))
    texts += [line + " " + " ".join(word() for _ in range(rng.randint(1, 40))) for _ in range(30)] + [line, line]
    return texts


@pytest.mark.parametrize("rows", [256, 4])
def test_ngram_join_equals_brute_force(spark, monkeypatch, rows):
    monkeypatch.setattr(ngram_join, "GROUP_ROWS", rows)
    monkeypatch.setattr(ngram_join, "ORDER_SAMPLE", 2)
    texts = near_copies()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(documents(spark, texts), 4, 85, 100).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts, 4, 85, 100)


def test_ngram_join_edges(spark):
    text = " ".join(f"t{i}" for i in range(40))
    docs = documents(spark, [text, text, text + " x", None, "long " * 50000, ""], ids=[7, 7, 3, 1, 5, None])
    rows = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["component_id"] if r["component_id"] is not None else -1) for r in ngram_join.near_duplicates(docs).collect())
    assert rows == [(False, 1, 1), (False, 3, 3), (False, 5, 5), (False, 7, 3), (False, 7, 3), (True, 0, -1)]
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in kept.collect()) == [-1, 1, 3, 5]
    assert ngram_join.near_duplicates(documents(spark, [])).count() == 0


@pytest.mark.parametrize("rows", [2, 256])
def test_ngram_join_near_copies_without_ids(spark, monkeypatch, rows):
    monkeypatch.setattr(ngram_join, "GROUP_ROWS", rows)
    w = [f"t{i}" for i in range(200)]
    near = lambda k: " ".join(w[k:k + 100])
    other = [f"o{i}" for i in range(60)]
    # 5 and 9 link only through the null row between; three null rows link with each other alone
    texts = [near(0), near(8), near(16), " ".join(other), " ".join(other), " ".join(other[:-1]), "one text by itself", "one text by itself", "yet another"]
    docs = documents(spark, texts, ids=[9, None, 5, None, None, None, None, None, None])
    got = Counter((r["doc_id"], r["component_id"]) for r in ngram_join.near_duplicates(docs).collect())
    assert got == {(9, 5): 1, (None, 5): 1, (5, 5): 1, (None, None): 6}
    kept = [(r["doc_id"], r["text"]) for r in ngram_join.keep_one(docs).collect()]
    groups = [{(5, near(16))}, {(None, texts[3]), (None, texts[5])}, {(None, texts[6])}, {(None, texts[8])}]
    assert len(kept) == 4 and all(len(g & set(kept)) == 1 for g in groups)


def test_keep_one_with_two_texts_under_one_id(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    docs = documents(spark, [a, b, b + " x", b], ids=[7, 7, 3, 7])
    assert sorted((r["doc_id"], r["text"]) for r in ngram_join.keep_one(docs).collect()) == [(3, b + " x"), (7, a)]


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)] + [(5, 5)]
    comp = {}

    def root(i):
        while comp.setdefault(i, i) != i:
            i = comp[i]
        return i
    for a, b in links:
        if a != b:
            x, y = sorted((root(a), root(b)))
            comp[y] = x
    got = {r[0]: r[1] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: root(i) for i in comp}


# -- 7: source mix ------------------------------------------------------------------------

def test_mix_targets_and_copies(spark):
    rng = random.Random(6)
    names = ["a"] * 900 + ["b"] * 200 + ["c"] * 150 + ["d"] * 20 + [None] * 30
    texts = ["w " * rng.randint(1, 40) for _ in names]
    docs = documents(spark, texts, names)
    rows = source_mix.mix_sources(docs).collect()
    again = source_mix.mix_sources(docs.repartition(7)).collect()
    key = lambda r: (r["doc_id"], r["taken"])
    assert sorted(map(key, rows)) == sorted(map(key, again))
    size, target, taken = Counter(), {}, Counter()
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    order = ["a", "b", "c", "d", None]
    weight = dict(zip(order, (5, 2, 1, 5, 2)))
    left, full, want = 1.5 * sum(size.values()), set(), {}
    while True:  # share by weight, stop at twice the size, share again
        rate = left / sum(weight[s] for s in order if s not in full)
        over = [s for s in order if s not in full and rate * weight[s] > 2 * size[s]]
        if not over:
            break
        for s in over:
            full.add(s)
            want[s] = 2.0 * size[s]
            left -= want[s]
    want |= {s: rate * weight[s] for s in order if s not in full}
    for s in order:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - target[s]) <= max(60, 0.02 * target[s])


def test_mix_edges(spark):
    assert source_mix.mix_sources(documents(spark, [])).count() == 0
    blank = source_mix.mix_sources(documents(spark, [None, "", " \t"])).collect()
    assert [(r["size"], r["taken"], r["target"]) for r in blank] == [(0, 0, 0.0)] * 3
    docs = documents(spark, ["a b c"] * 6 + ["d"], ids=[1, 1, 2, 2, 3, None, 4])
    copies = source_mix.mix_sources(docs)
    out = source_mix.mixed_documents(docs)
    assert out.columns == docs.columns and out.count() == copies.agg(F.sum("copies")).first()[0]


# -- 8: language --------------------------------------------------------------------------

def test_language_on_held_out_rows(spark):
    docs = queries.table(spark, "/root/testdata/sf0.01", "documents")
    model = language_id.train(docs, ~queries.held_out(4, 2))
    assert model.members == {"germanic": ["de", "en"], "romance": ["es", "fr"]}
    rows = language_id.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(queries.held_out(4, 2))
    right, n = rows.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count(F.lit(1))).first()
    assert right / n >= 0.97


def test_language_edges(spark):
    docs = documents(spark, [None, "", "123 !", "the cat and the dog", "the " * 100000, "a"])
    model = language_id.train(docs, F.lit(True))
    rows = {r["doc_id"]: r for r in language_id.identify(docs, model).collect()}
    assert [rows[i]["lang_pred"] for i in range(6)] == ["und"] * 3 + ["en"] * 3
    assert all(0 <= r["score"] <= 1 for r in rows.values()) and rows[0]["score"] == 0
    nothing = language_id.train(docs.limit(0), F.lit(True))
    assert {r["lang_pred"] for r in language_id.identify(docs, nothing).collect()} == {"und"}
    assert language_id.identify(documents(spark, []), model).count() == 0
    assert language_id.family_of("pt-BR") == "romance" and language_id.family_of("xx") == "xx"


# -- 9: licences --------------------------------------------------------------------------

def test_license_rules(spark):
    mit = license_scan.SENTENCES["mit-1"] + "\n\n" + license_scan.SENTENCES["mit-2"]
    texts = [None, "", "no licence", mit, license_scan.SENTENCES["mit-2"] + "\n" + license_scan.SENTENCES["mit-1"],
             "x. RELEASED under  the MIT-License! Licensed under CC BY-NC 4.0. y", "word " * 50000 + "\nReleased under the MIT License."]
    rows = {r["doc_id"]: r for r in license_scan.scan_licenses(spark, documents(spark, texts)).collect()}
    assert {i: r["licenses"] for i, r in rows.items()} == {3: "MIT", 4: "", 5: "CC-BY-NC-4.0,MIT", 6: "MIT"}
    assert rows[3]["sentence_ids"] == "mit-1,mit-2" and rows[5]["n_sentences"] == 2 and rows[5]["first_pos"] == 1
    assert license_scan.scan_licenses(spark, documents(spark, [])).count() == 0
    assert license_scan.scan_licenses(spark, documents(spark, [mit, mit], ids=[1, 1])).first()["n_sentences"] == 4


def test_license_wrapped_headers_and_null_ids(spark):
    known = license_scan.SENTENCES

    def lay(parts, mark="", width=72, first=""):
        return "\n".join(f"{mark}{line}".rstrip() for p in parts for line in [*textwrap.wrap(first + p, width), ""])

    mit = [known["mit-1"], known["mit-2"]]
    apache = ("Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\n"
              "You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law")
    gpl = [known["gpl-header-1"], "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY.  " + known["gpl-header-2"]]
    bsd = [known["bsd-1"], *(f"{i}. {known[k]}" for i, k in ((1, "bsd-2"), (3, "bsd-3")))]
    texts = [lay(mit), lay(mit, " * "), apache, "# " + apache.replace("\n", "\n# "), lay(gpl, "// "), lay(bsd, "-- ", 70),
             " ".join(mit), lay([" ".join(mit)], "; ", 40), "a\r\n" + lay(mit, width=20).replace("\n", "\r\n"),
             "Licensed under the Apache License, Version 2.0\n(the \"License\"); you may not use this file except in compliance with the License.",
             "Released under the MIT\nLicenses.", "We say that it is Released\nunder the MIT License.", "End.\nReleased\nunder the MIT License.\n\nAll rights\nreserved."]
    rows = {r["doc_id"]: r for r in license_scan.scan_licenses(spark, documents(spark, texts)).collect()}
    assert {i: r["licenses"] for i, r in rows.items()} == {0: "MIT", 1: "MIT", 2: "Apache-2.0", 3: "Apache-2.0", 4: "GPL-3.0", 5: "BSD-2-Clause,BSD-3-Clause",
                                                         6: "MIT", 7: "MIT", 8: "MIT", 9: "", 12: "MIT"}
    assert rows[5]["sentence_ids"] == "bsd-1,bsd-2,bsd-3" and rows[9]["sentence_ids"] == "apache2-header-1"
    assert (rows[12]["first_pos"], rows[12]["last_pos"], rows[12]["sentence_ids"]) == (1, 3, "mit-released,all-rights")
    none = license_scan.scan_licenses(spark, documents(spark, ["All rights reserved.", "SPDX-License-Identifier: MIT"], ids=[None, None])).collect()
    assert sorted((r["doc_id"], r["n_sentences"], r["licenses"]) for r in none) == [(None, 1, ""), (None, 1, "MIT")]


# -- 10: URLs -----------------------------------------------------------------------------

def test_url_filter_as_of(spark):
    entries = spark.createDataFrame([
        ("bad.com", "ads", "add", "2024-01-05"), ("bad.com", "ads", "remove", "2024-02-01"), ("bad.com", "ads", "add", "2024-03-01"),
        ("*.evil.org", "spam", "add", "2024-01-01"), ("ok.net/private", "path", "add", "2024-01-01"),
        ("same.com", "x", "add", "2024-01-01"), ("same.com", "x", "remove", "2024-01-01"), (None, "x", "add", "2024-01-01"), ("odd.com", "x", "what", "2024-01-01")],
        "pattern string, category string, action string, listed_at string").withColumn("listed_at", F.to_timestamp("listed_at"))
    urls = [(1, "http://bad.com/a", "2024-01-04"), (2, "https://user@BAD.com:80./a?x=//y", "2024-01-05"), (3, "http://bad.com", "2024-02-01"),
            (4, "http://bad.com/", "2024-04-01"), (5, "http://a.b.evil.org/x", "2024-05-01"), (6, "http://notevil.org/x", "2024-05-01"),
            (7, "http://ok.net/private/x", "2024-05-01"), (8, "http://ok.net/privately", "2024-05-01"), (9, None, "2024-05-01"), (10, "nonsense", "2024-05-01"),
            (11, "http://same.com/", "2024-06-01"), (12, "http://bad.com/", None), (1, "http://bad.com/a", "2024-01-04"), (13, "http://" + "a." * 300 + "com/", "2024-01-01")]
    captures = spark.createDataFrame(urls, "page_id int, url string, fetched_at string").withColumn("fetched_at", F.to_timestamp("fetched_at")).withColumn("pattern", F.lit("clash"))
    rows = {r["page_id"]: r for r in url_filter.filter_urls(captures, entries).collect()}
    assert {i for i, r in rows.items() if r["blocked"]} == {2, 4, 5, 7}
    assert {i for i, r in rows.items() if r["malformed"]} == {9, 10, 13}
    assert len(rows) == 13 and rows[5]["pattern"] == "*.evil.org" and rows[2]["host"] == "bad.com"
    assert url_filter.filter_urls(captures.limit(0), entries).count() == 0
    assert url_filter.filter_urls(captures, entries.limit(0)).where("blocked").count() == 0


# -- pipeline -----------------------------------------------------------------------------

def test_pipeline_stages(spark):
    import corpus_pipeline as P
    from relsift.llm.common import written

    sf = "/root/testdata/sf0.001"
    docs = queries.table(spark, sf, "documents")
    columns = docs.columns
    counts = [docs.count()]
    for name, stage in P.STAGES[:-1]:
        docs = written(stage(spark, docs, sf), f"test-{name}")
        assert docs.columns == columns, name
        counts.append(docs.count())
    assert counts[0] >= counts[1] >= counts[2] == counts[3] and counts[4] > 0
    assert P.STAGES[-1][1](spark, docs, sf).count() == counts[4]
    assert [n for n, _ in P.STAGES] == ["toxicity", "ngram_join", "suffix_dedup", "source_mix", "sentencepiece"]
