"""Common prefixes of suffixes that tie at the sorted depth."""

import random

import numpy as np

from relsift.llm import suffix_dedup


def test_repeated_windows_match_brute_force_on_long_shared_runs():
    draw, length = random.Random(3), 20
    for _ in range(30):
        base = ["".join(draw.choice("abc") for _ in range(90)) for _ in range(3)]
        texts = []
        for _ in range(40):
            t = draw.choice(base)
            cut = draw.randrange(len(t))
            t = (t[:cut] + draw.choice("abcd") + t[cut:])[draw.randrange(30):]
            texts.append(t.encode())
        texts = sorted(set(texts))
        windows = np.array([len(t) - length + 1 for t in texts], np.int64)
        hit, start, _ = suffix_dedup.repeated_windows(texts, windows, np.ones(len(texts), np.int64), length)
        seen = [t[i: i + length] for t in texts for i in range(len(t) - length + 1)]
        often = {w for w in seen if seen.count(w) > 1}
        for t, a, w in zip(texts, start, windows, strict=False):
            assert hit[a: a + w].tolist() == [t[i: i + length] in often for i in range(w)]
