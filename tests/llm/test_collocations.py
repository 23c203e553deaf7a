"""Collocations against brute force, the tile counts against a Counter."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from relsift.llm import collocations as co

DOCS = "doc_id long, text string, lang string, n long, id long, chunk long, words array<string>"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, 5, 5, 5, ["x"]) for i, (t, lang) in enumerate(rows)], DOCS)


def brute(rows, least, top):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i:i + k])) for k in range(1, 6) for i in range(len(w) - k + 1))
    out = []
    for (lang, w), a in f.items():
        if len(w) < 2 or a < least:
            continue
        longer = [p for (other, p), b in f.items() if other == lang and len(w) < len(p) <= 5 and b >= least and 100 * b >= 100 * a
                  and any(p[i:i + len(w)] == w for i in range(len(p)))]
        if longer:
            continue
        score, _, left, right = min((1000 * a * n[lang] // (f[lang, w[:m]] * f[lang, w[m:]]), m, f[lang, w[:m]], f[lang, w[m:]]) for m in range(1, len(w)))
        out.append((lang, " ".join(w), a, left, right, n[lang], score))
    ranked = []
    for lang in n:
        some = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        ranked += [(r[0], i, *r[1:]) for i, r in enumerate(some, 1)]
    return sorted(ranked)


def corpus(seed, n=150):
    rng = random.Random(seed)
    fixed = ["New York City hall of fame", "once upon a time", "a a a a a a", "Ünïcode Straße ÉA", "of the of the", "x" * 60, "tab\tsep  two"]
    vocabulary = [f"w{int(rng.paretovariate(0.6))}" for _ in range(60)]
    rows = []
    for i in range(n):
        parts = [rng.choice(fixed) if rng.random() < 0.5 else " ".join(rng.choices(vocabulary, k=rng.randrange(1, 9))) for _ in range(rng.randrange(0, 12))]
        text = "".join(p + rng.choice([" ", " ", ". ", ",", "\n", "\x0b", "\r\n", " ; ", "\x1c", "\x85 "]) for p in parts)
        rows.append((text, rng.choice(["en", "en", "en", "de", None, "und"])))
    return rows


@pytest.mark.parametrize("least,chunk_words,top", [(5, 60, 1000), (3, 10**6, 7)])
def test_equals_brute_force(spark, least, chunk_words, top):
    rows = corpus(least) + [(None, "en"), ("", None), ("...", "de")]
    got = sorted(tuple(r) for r in co.collocations(documents(spark, rows), least=least, chunk_words=chunk_words, top=top).collect())
    assert got == brute(rows, least, top) and len(got) > 10


def test_copies_and_a_very_long_text(spark, monkeypatch):
    monkeypatch.setattr(co, "SLICE_BYTES", 700)
    rows = [("Buy now and save big, buy now", "en")] * 300 + [("one two three four five six " * 5000, "en"), ("z" * 5000 + " end of it", "en")]
    got = sorted(tuple(r) for r in co.collocations(documents(spark, rows)).collect())
    assert got == brute(rows, 100, 2000) and got


def test_nothing_to_report(spark):
    assert co.collocations(documents(spark, [])).collect() == []
    assert co.collocations(documents(spark, [("a b c", "en"), (None, None)])).collect() == []


@pytest.mark.parametrize("dense", [1, 30, 10**9])
def test_tile_counts(dense):
    rng = np.random.default_rng(dense % 97)
    units = np.concatenate([rng.integers(-1, 9, 800), rng.integers(0, 60, 300), [2**40, 3, 2**40, 3, -1, 2**40]])
    i, j, c = co.tile_counts(units, tile_bits=2, dense=dense)
    want = Counter((int(a), int(b)) for a, b in zip(units[:-1], units[1:]) if a >= 0 and b >= 0)
    assert {(x, y): z for x, y, z in zip(i.tolist(), j.tolist(), c.tolist())} == want and len(i) == len(want)


def test_exact_beyond_64_bits(spark):
    big = 4 * 10**15
    row = spark.createDataFrame([(["a", "b"], big, 9 * big, [2 * big, big], [3 * big, big])], "words array<string>, a long, n long, starts array<long>, ends array<long>")
    got = row.selectExpr(co._WEAKEST + " as w").first().w
    assert got.score == 1000 * big * 9 * big // (2 * big * 3 * big) and got.l == 2 * big and got.r == 3 * big
