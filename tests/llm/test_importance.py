"""Importance resampling against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pandas as pd
import pytest

from quayline.llm import importance

TARGET = ["How many apples does Tom have", "How MANY pears: many, many", None]


def plain(rows, target, run, least_words, percent):
    def features(text):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        return len(ws), [zlib.crc32(" ".join(ws[i : i + n]).encode()) % importance.BUCKETS for n in range(1, run + 1) for i in range(len(ws) - n + 1)]

    source, aim = (Counter(b for t in texts for b in features(t)[1]) for texts in ([r[1] for r in rows], target))
    s_all, t_all = source.total(), aim.total()
    gain = lambda b: math.floor(1000 * math.log((aim[b] + 1) * (s_all + 10_000) / ((source[b] + 1) * (t_all + 10_000))))
    out, able = [], []
    for i, text, *_ in rows:
        n, found = features(text)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, found))
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))
        out.append([i, len(found), weight, score, None])
        if n >= least_words:
            able.append(out[-1])
    able.sort(key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1]))
    for k, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = k
    return sorted(map(tuple, out), key=str)


def as_rows(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in df.collect()), key=str)


@pytest.mark.parametrize(("run", "percent", "nodes"), [(1, 10, 1 << 18), (3, 50, 50), (2, 100, 7)])
def test_equals_plain_python(spark, make, messy, monkeypatch, run, percent, nodes):
    monkeypatch.setattr(importance, "NODES", nodes)  # tries are emptied in between
    rows = [(i, f"How many {w} does café Δelta {w * k} 12 have", "en", "a") for i, (w, k) in enumerate([(w, k) for w in ("apples", "pears", "plums") for k in range(9)])]
    rows += [tuple(r[c] for c in ("doc_id", "text", "lang", "source")) for r in messy.collect()]
    target = spark.createDataFrame([(k, t) for k, t in enumerate(TARGET)], "item_id long, text string")
    got = importance.resample(make(rows), target, run=run, percent=percent, least_words=5)
    assert as_rows(got) == plain(rows, TARGET, run, 5, percent)


def test_repeated_rows_are_each_drawn_and_empty_tables_give_nothing(spark, make):
    rows = [(7, "same words again and again here", "en", "a")] * 40 + [(None, "same words again", "en", None)] * 10
    target = spark.createDataFrame([], "item_id long, text string")
    got = importance.resample(make(rows), target, percent=50, least_words=3)
    assert as_rows(got) == plain(rows, [], 1, 3, 50)
    assert sorted(r["rank"] for r in got.collect() if r["rank"]) == list(range(1, 26))
    assert importance.resample(make([]), target).count() == 0


def test_ranks_do_not_depend_on_the_estimated_bound(spark, make, monkeypatch):
    rows = [(i, "a b c " * (i % 5 + 1), "en", "a") for i in range(200)]
    target = spark.createDataFrame([(0, "a b")], "item_id long, text string")
    want = plain(rows, ["a b"], 1, 3, 10)
    monkeypatch.setattr(importance.F, "percentile_approx", lambda *a: importance.F.max("score"))  # far too high
    assert as_rows(importance.resample(make(rows), target, least_words=3)) == want


@pytest.mark.parametrize("run", [1, 2, 3])
@pytest.mark.parametrize(("nodes", "piece"), [(5, 1), (5, 7), (0, 2), (40, 64), (1 << 18, 3)])
def test_counts_stay_whole_when_a_trie_is_emptied_within_a_text(monkeypatch, run, nodes, piece):
    monkeypatch.setattr(importance, "NODES", nodes)  # in this process: workers of a session don't see it
    monkeypatch.setattr(importance, "PIECE", piece)
    texts = [" ".join(f"w{k * k % 23}" for k in range(200)), None, "one", " ".join(f"w{k % 9}" for k in range(90))]
    found = pd.concat(importance._count(iter([pd.DataFrame({"text": texts[:2]}), pd.DataFrame({"text": texts[2:]})]), run, importance.BUCKETS))
    want = Counter()
    for ws in (t.split() for t in texts if t):
        want.update(zlib.crc32(" ".join(ws[i : i + n]).encode()) % importance.BUCKETS for n in range(1, run + 1) for i in range(len(ws) - n + 1))
    assert dict(zip(found["bucket"], found["n"])) == want


def test_a_text_of_more_words_than_a_trie_holds(spark, make):
    ws = [f"n{k}" for k in range(importance.NODES + 5_000)]
    rows = [(1, " ".join(ws + ws[:50_000] * 2), "en", "a"), (2, " ".join(ws[:30_000]), "en", "a")]
    target = spark.createDataFrame([(0, " ".join(ws[:40_000]))], "item_id long, text string")
    assert as_rows(importance.resample(make(rows), target, percent=50)) == plain(rows, [r["text"] for r in target.collect()], 1, 20, 50)
