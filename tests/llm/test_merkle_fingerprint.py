"""Merkle fingerprints: the tree's rules, and neighbours against a plain sorted list."""

import hashlib
import random

import pytest

from relsift.llm import merkle_fingerprint as mf

DOCS = "doc_id long, text string, lang string, block int, peek int, k0 long, fingerprint string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", 1, 2, 3, "x") for i, t in rows], DOCS)


def prose(rng, n):
    return "".join(rng.choice(["alpha ", "beta ", "gamma, ", "delta. ", "epsilon\n", "zeta\n\n"]) + rng.choice(["", "", f"{rng.random()} "]) for _ in range(n))


def test_runs_keep_every_character():
    rng = random.Random(5)
    for text in ["", " ", "\n\n", "a", "x" * 5000, "  a\tb c  ", "é" * 70 + " " * 90, prose(rng, 400)]:
        cut = mf._PARAGRAPH.findall(text)
        assert "".join(cut) == text and "".join(r for p in cut for r in mf.runs(p)) == text


def test_equal_texts_and_no_others():
    rng = random.Random(6)
    texts = ["", " ", "a", "a ", "a\n", "\na", "a b", "ab", "a\n\nb", "a\nb", *[prose(rng, n) for n in range(1, 60)]]
    prints = {mf.fingerprint(t) for t in texts}
    assert len(prints) == len(set(texts)) and mf.fingerprint(None) == mf.fingerprint("")
    assert all(mf.fingerprint(t, known) == mf.fingerprint(t) for known in [{}] for t in texts)


def test_likeness_and_place_of_an_edit():
    rng = random.Random(7)
    lines = [f"line {i} has {rng.random()} and some more words of its own kind\n" for i in range(200)]
    a = "".join(lines)
    b = "".join(lines[:90] + ["another line altogether\n"] + lines[91:])
    fa, fb = mf.fingerprint(a), mf.fingerprint(b)
    assert mf.likeness(fa, fa) == 1.0 and 0.98 < mf.likeness(fa, fb) < 1.0 and mf.likeness(fa, fb) == mf.likeness(fb, fa)
    (section, paragraph), = mf.edited_paragraphs(fa, fb)
    ends = [p.count(".") + 1 for p in fa[mf.ROOT_DIGITS + 1:].split("/")]
    assert sum(ends[:section]) + paragraph == 90
    assert mf.edited_paragraphs(fa, fa) == []
    shifted = mf.fingerprint("a new first line\n" + a)
    assert mf.likeness(fa, shifted) > 0.98 and mf.edited_paragraphs(fa, shifted) == []
    assert mf.likeness(mf.fingerprint(""), fa) == 0.0 and mf.likeness(mf.fingerprint(""), mf.fingerprint(None)) == 1.0
    assert mf.likeness(mf.fingerprint("wholly other words here\n"), fa) < 0.05
    half = mf.half_replaced(a, "".join(f"and {rng.random()} that\n" for _ in range(500)))
    assert 0.4 < mf.likeness(fa, mf.fingerprint(half)) < 0.6
    one = "just one line of about fifteen words so that runs of words are what is shared here by both"
    assert mf.likeness(mf.fingerprint(one), mf.fingerprint(mf.half_replaced(one, "QQ " * 40))) > 0.25


def brute(rows):
    texts = sorted(((i is not None, i or 0, t or "") for i, t in rows), key=lambda r: r[:2])
    out = []
    for at, (there, i, t) in enumerate(texts):
        nxt = texts[(at + 1) % len(texts)][2]
        half = len(t) // 2
        edited = t[:len(t) - half] + nxt[:half]
        out.append((i if there else None, len(t), hashlib.sha256(edited.encode()).hexdigest(), mf.fingerprint(t), mf.fingerprint(edited),
                    mf.likeness(mf.fingerprint(t), mf.fingerprint(edited)), mf.likeness(mf.fingerprint(t), mf.fingerprint(nxt))))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_rows", [7, 40, 100000])
def test_neighbours(spark, block_rows):
    rng = random.Random(block_rows)
    ids = rng.sample(range(-10**12, 10**12), 300)
    rows = [(i, prose(rng, rng.choice([0, 1, 2, 30]))) for i in ids] + [(2**62, None), (-2**63, "lowest id"), (2**63 - 1, "é" * 20)]
    got = mf.edited_fingerprints(documents(spark, rows).repartition(5), block_rows)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


@pytest.mark.parametrize("hot", [None, 5])
def test_a_third_of_rows_alike(spark, hot):
    rows = [(i, f"text {i}") for i in range(200)] + [(hot, "the same\ntext")] * 150
    if hot is not None:
        rows = [r for r in rows if r[0] != hot or r[1] != f"text {hot}"]
    got = mf.edited_fingerprints(documents(spark, rows).repartition(4), 10)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_equal_ids_stand_in_one_fixed_order(spark):
    rows = [(3, f"text {i}") for i in range(60)] + [(None, f"no id {i}") for i in range(60)] + [(9, "z")]
    got = [tuple(r) for r in mf.edited_fingerprints(documents(spark, rows).repartition(3), 8).collect()]
    again = [tuple(r) for r in mf.edited_fingerprints(documents(spark, rows[::-1]), 1000).collect()]
    assert len(got) == 121 and sorted(got, key=str) == sorted(again, key=str)


def test_alone_empty_and_very_long(spark):
    (row,) = mf.edited_fingerprints(documents(spark, [(4, "abc def")])).collect()
    assert row.edited_sha256 == hashlib.sha256(b"abc abc").hexdigest() and row.near_next == 1.0
    assert mf.edited_fingerprints(documents(spark, [])).collect() == []
    rows = [(1, "word " * 300_000), (2, "y" * 1_000_000), (3, "\n" * 100_000), (4, "")]
    got = mf.edited_fingerprints(documents(spark, rows))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_fingerprints_of_a_table(spark):
    rows = [(1, "a b"), (1, "a b"), (None, None), (2, "")]
    got = [tuple(r) for r in mf.fingerprints(documents(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted([(1, 3, mf.fingerprint("a b"))] * 2 + [(None, 0, mf.fingerprint("")), (2, 0, mf.fingerprint(""))], key=str)
