"""The conversation trie against plain Python."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from quayline.llm.prefix_trie import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, print string, level string, n_convs string"


def plain(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    members = defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 6
        path = own.get(c - c % 100, [])[:h] + own[c][h:]
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append((c, d == len(path)))
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    leaves, saved, out = {}, {}, []
    for path in sorted(members, key=len, reverse=True):
        found = members[path]
        leaves[path] = sum(leaves[k] for k in children[path]) if children[path] else 1
        saved[path] = sum(saved[k] for k in children[path]) + ((len(found) - 1) * len(path[-1][1]) if path else 0)
        ends = ",".join(str(c) for c, end in found if end)
        out.append((found[0][0], len(path), members[path[:-1]][0][0] if path else None, len(found), len(children[path]), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows, **more):
    df = spark.createDataFrame([(*r, 5, "p", "l", "n") for r in rows], SCHEMA)
    got = prefix_trie(df, **more)
    cols = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    assert sorted((tuple(r[c] for c in cols) for r in got.collect()), key=str) == plain(rows)


def talk(seed, convs, turns, words):
    rng = random.Random(seed)
    ids = rng.sample(range(700), convs)
    return [(c, t, rng.choice(["user", "tool"]), rng.choice(words)) for c in ids for t in range(rng.randint(1, turns))]


MESSY = [
    (3, None, "user", "first"), (3, 1, None, None), (3, 1, None, None), (3, 1, "a", "b"), (3, 1, "ab", ""),
    (None, 0, "user", "nobody's"), (None, None, None, None),
    (150, 0, "user", "no block"), (151, 0, "user", "no block"), (152, 4, "user", "é😀 " * 3000), (153, 4, "user", "é😀 " * 3000),
    ((1 << 53) + 1, 0, "user", "big"), ((1 << 53) + 2, 0, "user", "big"), ((1 << 53) + 3, 2, "user", "big"),
]


@pytest.mark.parametrize("mask", [-1, 3])
def test_equals_plain_python(spark, mask):
    rows = talk(1, 60, 9, ["yes", "no", "well", ""]) + [(c, t, "user", "hello") for c in (0, 100, 200) for t in range(9)]
    check(spark, rows + MESSY, mask=mask)  # with two bits nearly all candidates collide and are split


def test_copies_and_hot_first_turns(spark):
    rows = [(c, t, "user", f"same {t}") for c in range(1000, 1150) for t in range(7)] + [(c, t, "user", "hot" if t == 0 else f"{c} {t}") for c in range(2000, 2100) for t in range(3)]
    check(spark, rows)


def test_deep_chains_and_long_conversations(spark):
    # each conversation shares one turn more with the one before, so chains hang from chains
    rows = [(100 * k, t, "u", f"{min(t, k)}" if t <= k else f"own {k} {t}") for k in range(1, 14) for t in range(16)]
    check(spark, rows + [(5000, t, "u", str(t % 7)) for t in range(3000)] + [(5100, t, "u", str(t % 7)) for t in range(2000)])


def test_no_conversations(spark):
    check(spark, [])
    check(spark, [(None, 1, "user", "x")])
