"""Copies without an id must cost what copies with ids cost."""

import hashlib

from relsift.llm import suffix_dedup


def test_many_copies_without_an_id(spark):
    text = " ".join(f"word{i * 7919 % 1000}" for i in range(300))
    rows = [(None, text)] * 500 + [(7, text)] * 20 + [(i, f"{i} alone") for i in range(8, 12)] + [(None, None), (None, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    runs = suffix_dedup.repeated_runs(docs, 400).collect()
    with_ids = suffix_dedup.repeated_runs(spark.createDataFrame([(i, text) for i in range(520)], "doc_id long, text string"), 400).collect()
    assert len(runs) == 2 and {len(r.runs) for r in runs} == {len(r.runs) for r in with_ids}
    got = suffix_dedup.remove_repeats(docs, 400).collect()
    gone = [r for r in got if r._row.text == text]
    assert len(gone) == 520 and all(r.n_removed == r.n_bytes == len(text) and r.kept_sha256 == hashlib.sha256(b"").hexdigest() for r in gone)
    assert all(r.n_removed == 0 for r in got if r._row.text != text) and len(got) == len(rows)
