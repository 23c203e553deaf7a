"""The prefix trie against brute force, with small segments and shards."""

import hashlib
import random
import re
import zlib

import pytest

from relsift.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, band int, idx int, n long, shard long, p1 long"


def table(spark, rows):
    return spark.createDataFrame([(*r, 7, 7, 7, 7, 7, 7) for r in rows], SCHEMA)


def rebuilt(rows, shared=True):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    convs = {c: [(r, t) for _, _, r, _, t in sorted(v)] for c, v in convs.items()}
    if not shared:
        return convs
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def brute(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    out = set()
    for node, m in members.items():
        below = [u for u in members if u[:len(node)] == node]
        kids = {u for u in members if len(u) == len(node) + 1 and u[:-1] == node}
        parents = {u[:-1] for u in below if len(u) > len(node)}
        saved = sum((len(members[u]) - 1) * count(u[-1][1]) for u in below if u)
        ends = sorted(c for c in m if len(convs[c]) == len(node))
        out.add((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(kids),
                 sum(u not in parents for u in below), saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return out


def found(df):
    rows = [tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def many(seed=1, n=120):
    rng = random.Random(seed)
    rows = []
    for c in range(-30, n):
        if c % 20 == 0 and c % 40:
            continue  # some bases are absent
        for t in range(rng.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c, t, rng.choice(["user", "bot"]), rng.choice(["a", "b c", "a  b\nc", "", "x" * 50])))
    for c in range(200, 230):  # exact copies and growing beginnings of one long conversation
        rows += [(c, t, "user", f"turn {t} of it") for t in range(min(c - 196, 20))]
    for c in range(300, 340):
        rows += [(c, t, "user", f"copy {t % 3}") for t in range(7)]
    return rows


@pytest.mark.parametrize("sizes", [(3, 4, 10), (1, 1, 1), (1024, 1024, 65536), (2, 64, 1000)])
def test_equals_brute_force(spark, sizes):
    rows = many()
    got = prefix_trie.conversation_trie(table(spark, rows), segment=sizes[0], shard_segments=sizes[1], shard_turns=sizes[2])
    assert found(got) == brute(rebuilt(rows))


def test_odd_rows(spark):
    rows = [(None, 0, "user", "no conversation"), (5, None, None, None), (5, 0, "user", "b"), (5, 0, "user", "a"), (5, 0, "user", "a"),
            (6, None, None, ""), (6, 0, "user", "a"), (6, 0, "user", "a"), (6, 0, "user", "b"), (41, 3, "user", None), (41, -2, None, "w " * 60000),
            (-7, 1, "", "ab"), (-8, 1, "a", "b"), (2**62, 0, "user", "big id"), (2**62 + 19, 0, "user", "big id")]
    assert found(prefix_trie.conversation_trie(table(spark, rows), segment=2)) == brute(rebuilt(rows))


def test_one_conversation_with_most_turns(spark):
    rows = [(1, t, "user", f"t{t}") for t in range(900)] + [(2, t, "user", f"t{t}") for t in range(905)] + [(3, 0, "user", "x")]
    turn_rows = prefix_trie.turns(table(spark, rows))
    convs = rebuilt(rows, shared=False)
    got = {tuple(r) for r in prefix_trie.trie(turn_rows, segment=16, shard_segments=8, shard_turns=50).select(
        "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens").collect()}
    want = {(1, d, 2, 1, 1, 900 - d + 1) for d in range(1, 901)}
    want |= {(2, d, 1, int(d < 905), 1, 0) for d in range(901, 906)} | {(3, 1, 1, 0, 1, 0), (1, 0, 3, 2, 2, 900)}
    assert got == want
    assert len(convs[1]) == 900


def test_empty_table(spark):
    assert prefix_trie.conversation_trie(table(spark, [])).collect() == []
