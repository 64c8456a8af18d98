"""Toxicity, licences, language model, token counts and nearest neighbours."""

import base64
import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from quayline.llm import ann, licenses, lm, token_counts, toxicity

from .conftest import prose


def test_marginals_equal_enumeration_and_the_plain_recursion():
    rng = np.random.default_rng(2)
    trans, start = np.array([[1.2, 0.4], [0.7, 1.9]]), 0.6
    counts = np.array([5, 0, 3, 1, 64, 65, 300, 128, 2])
    psi = rng.random(counts.sum()) * 2
    got, end = toxicity.marginals(psi, counts, trans, start), np.cumsum(counts)
    for n, e in zip(counts, end, strict=True):
        row, own = psi[e - n : e], got[e - n : e]
        ahead, back = np.zeros((n, 2)), np.ones((n, 2))
        for k in range(n):
            a = np.array([1.0, start]) if not k else ahead[k - 1] @ trans
            ahead[k] = a * [1, row[k]]
            ahead[k] /= ahead[k].sum()
        for k in range(n - 2, -1, -1):
            back[k] = trans @ (back[k + 1] * [1, row[k + 1]])
            back[k] /= back[k].sum()
        both = ahead * back
        assert np.allclose(own, both[:, 1] / both.sum(1)) if n else len(own) == 0
        if 0 < n <= 5:
            total, hot = 0.0, np.zeros(n)
            for labels in itertools.product((0, 1), repeat=int(n)):
                p = start if labels[0] else 1.0
                for k, y in enumerate(labels):
                    p *= row[k] if y else 1.0
                    if k:
                        p *= trans[labels[k - 1], y]
                total += p
                hot += p * np.array(labels)
            assert np.allclose(own, hot / total)


def test_evidence_passes_along_a_long_text():
    psi = np.ones(200)
    psi[0] = 50.0
    sticky = np.array([[1.0, 0.0], [0.0, 1.0]])
    assert np.allclose(toxicity.marginals(psi, np.array([200]), sticky, 1.0), 50 / 51)


@pytest.fixture(scope="module")
def toxic_corpus(spark, make):
    rng, bad, rows, marks = random.Random(5), ["snarkle", "snarkles", "grumbod", "grumboda"], [], []
    for i in range(900):
        words = prose(2000 + i, 60).split()
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words), "en", "a"))
        if i % 4 < 3:
            marks.append((i, int(toxic)))
    return make(rows), spark.createDataFrame(marks, "doc_id long, toxic int")


def test_toxic_documents_are_found_and_clean_ones_left(toxic_corpus, messy, make):
    docs, labels = toxic_corpus
    model = toxicity.fit_toxicity(toxicity.training_rows(docs), toxicity.training_rows(labels))
    out = toxicity.score_toxicity(docs, labels, model).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in out)
    right = [r["predicted"] == int(r["doc_id"] % 5 == 0) for r in out]
    assert np.mean(right) > 0.98
    assert all(r["predicted"] == (r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in out)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    first = next(r for r in out if r["n_toxic"] == 3)
    assert all(texts[first["doc_id"]][int(a) : int(b)].lower().startswith(("snark", "grumb")) for a, b in (s.split(":") for s in first["spans"].split(",")))
    assert toxicity.score_toxicity(messy, labels, model).count() == messy.count()
    kept = toxicity.reject_toxic(docs, labels, model)
    assert kept.columns == docs.columns and abs(kept.count() - 720) < 10
    assert toxicity.score_toxicity(make([]), labels.limit(0)).count() == 0


BSD = """Copyright (c) 2020, Some Author
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

* Neither the name of the copyright holder nor the names of its
  contributors may be used to endorse or promote products derived from
  this software without specific prior written permission."""
LGPL = """ * This library is free software; you can redistribute it and/or modify it
 * under the terms of the GNU Lesser General Public License as
 * published by the Free Software Foundation; either version 2.1 of
 * the License, or (at your option) any later version."""
MIT = """Permission is hereby granted, free of charge, to any person obtaining
a copy of this software and associated documentation files (the "Software"),
to deal in the Software without restriction."""


@pytest.fixture(scope="module")
def licence_docs(make):
    rows = [(k, prose(3000 + k, 200), "en", "a") for k in range(60)]
    rows += [
        (100, prose(1, 40) + "\n\nReleased under the MIT License.\n" + prose(2, 40), "en", "a"),
        (101, "Licensed under the Apache License, Version 2.0. " + prose(3, 200), "en", "a"),
        (102, "THIS WORK IS LICENSED UNDER THE GNU GENERAL PUBLIC LICENSE, VERSION 3.", "en", "a"),
        (103, prose(4, 30) + "\nAll rights reserved.", "en", "a"),
        (104, BSD, "en", "a"),
        (105, prose(5, 50) + "\n" + LGPL, "en", "a"),
        (106, MIT, "en", "a"),
        (2**53 + 1, "Released under a BSD license and nothing else", "en", "a"),
        (None, "Licensed under CC BY 4.0", "en", "a"),
    ]
    return make(rows)


def test_licence_paragraphs(licence_docs, make, messy):
    model = licenses.fit_licences(licence_docs)
    out = {}
    for r in licenses.scan_licences(licence_docs, model).collect():
        out.setdefault(r["doc_id"], []).append(r)
    want = {100: {"mit"}, 101: {"apache-2.0"}, 102: {"gpl-3.0"}, 103: {"unknown"}, 104: {"unknown", "bsd"}, 105: {"lgpl"}, 106: {"mit"}, 2**53 + 1: {"bsd"}, None: {"cc-by"}}
    assert {i: {r["family"] for r in rows} for i, rows in out.items()} == want
    assert sorted(r["paragraph"] for r in out[104]) == [0, 1, 2] and len(out[105]) == 1
    text = {r["doc_id"]: r["text"] for r in licence_docs.collect()}
    first = out[100][0]
    assert text[100][first["start"] : first["end"]] == "Released under the MIT License" and first["paragraph"] == 1
    assert licenses.scan_licences(messy, model).count() == 0
    assert licenses.scan_licences(make([])).count() == 0


def test_licence_scan_equals_brute_force(licence_docs):
    """Each sentence by itself, split and weighed by plain loops, with the model's numbers."""
    import re

    model = licenses.fit_licences(licence_docs)
    memo, number = licenses._Tokens(), {int(g): k for k, g in enumerate(model.vocabulary)}

    def judge(tokens):
        codes = [memo[w] for w in tokens]
        grams = []
        for k, c in enumerate(codes):
            pair = (codes[k - 1] * 0x9E3779B97F4A7C15 ^ c if k else c * 0xD1B54A32D192ED03) % 2**64
            for x in (c, pair):
                x = (x ^ x >> 31) * 0xBF58476D1CE4E5B9 % 2**64
                grams.append(x >> 24)
        z = (sum((model.weights[number[g]].astype(float) for g in grams if g in number), np.zeros(len(model.bias))) / len(grams) ** 0.5 + model.bias) / model.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        likely = (1 - p[0]) / (1 - p[0] + licenses.PRIOR * p[0])
        if p[0] >= 0.5 or len(codes) < 2:
            return []
        able = {f: x for f, x in zip(licenses.CLASSES[1:], p[1:]) if x >= licenses.ALSO and f != "unknown"}
        held = {f: max(len(set(grams) & t) / len(t) for t in ts) for f, ts in model.templates.items()}
        stands = [(f, held[f]) for f in able if held[f] >= licenses.CONFIRM or (sum(able.values()) >= licenses.SURE and likely >= 0.5)]
        return stands or ([("unknown", max(held.values()))] if likely >= 0.5 else [])

    want = set()
    for r in licence_docs.collect():
        for no, paragraph in enumerate(x for x in re.split(r"\n(?:[^\w\n]*\n)+", r["text"]) if re.search(r"\w", x)):
            found, sentence = set(), [[]]
            for m in [*licenses.TOKEN.finditer(paragraph), None]:
                if m is None or m.group() in ".!?":
                    lines = [x for x in sentence if x]
                    whole = judge(sum(lines, [])) if len(lines) > 1 else []
                    sure = any(f != "unknown" for f, _ in whole)
                    found |= {f for f, _ in whole} | {f for line in lines for f, share in judge(line) if not sure or share >= licenses.ALONE}
                    sentence = [[]]
                elif m.group() == "\n":
                    sentence.append([])
                else:
                    sentence[-1].append(m.group())
            want |= {(r["doc_id"], no, f) for f in (found - {"unknown"} or found)}
    got = {(r["doc_id"], r["paragraph"], r["family"]) for r in licenses.scan_licences(licence_docs, model).collect()}
    assert got == want and len(want) >= 11


NOTICES = {
    "This code is MIT licensed, see LICENSE.": {"mit"},
    "SPDX-License-Identifier: Apache-2.0": {"apache-2.0"},
    "Dual-licensed under MIT and Apache 2.0": {"mit", "apache-2.0"},
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED': {"mit"},
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED': {"bsd"},
    "Distributed under the Boost Software License, Version 1.0.": {"boost"},
    "Dieses Projekt ist unter der MIT-Lizenz lizenziert.": {"mit"},
    "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file": {"bsd", "unknown"},
}


def test_notices_that_the_list_does_not_hold(licence_docs, make):
    model = licenses.fit_licences(licence_docs)
    rows = make([(k, t, "en", "a") for k, t in enumerate(NOTICES)] + [(99, "Mit. Free software for all. " + prose(77, 60), "de", "a")])
    got = {}
    for r in licenses.scan_licences(rows, model).collect():
        got.setdefault(r["doc_id"], set()).add(r["family"])
    assert set(got) == set(range(len(NOTICES)))
    assert all(got[k] <= want for k, want in enumerate(NOTICES.values()))
    assert got[2] == NOTICES["Dual-licensed under MIT and Apache 2.0"]


def test_what_is_no_licence_is_counted_over_all_texts(licence_docs):
    model = licenses.fit_licences(licence_docs)
    counts = licenses.corpus_counts(licence_docs, model.vocabulary)
    words, lengths, memo = Counter(), Counter(), licenses._Tokens()
    for r in licence_docs.collect():
        for line in r["text"].split("\n"):
            sentence = []
            for t in [*licenses.TOKEN.findall(line), "."]:
                if t in ".!?":
                    if sentence:
                        lengths[min(len(sentence), licenses.LENGTHS)] += 1
                    words.update(memo[w] for w in sentence)
                    sentence = []
                else:
                    sentence.append(t)
    number = {int(g): k for k, g in enumerate(model.vocabulary)}
    want = np.zeros(len(number) + 1)
    for c, n in words.items():
        want[number.get(((c ^ c >> 31) * 0xBF58476D1CE4E5B9 % 2**64) >> 24, -1)] += n
    np.testing.assert_allclose(counts["word"], want / want.sum())
    np.testing.assert_allclose(counts["length"], np.array([lengths[k] for k in range(licenses.LENGTHS + 1)]) / lengths.total())


def words(text):
    return (text or "").encode().lower().split()


def test_language_model_base_is_exact_and_model_is_normalised(make, messy):
    docs = make([(1000 + k, prose(k % 7 + 4000, 120), "en", "a") for k in range(60)]).unionByName(messy)
    rows = docs.select("doc_id", "text").collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    c = Counter()
    for r in rows:
        if not held(r["doc_id"]):
            c.update([*words(r["text"]), b"\n"])
    n, norm = sum(c.values()), sum(c.values()) + 0.5 * (len(c) + 1)
    out = lm.score_texts(docs).collect()
    assert len(out) == len(rows)
    want = {}
    for r in rows:
        t = [*words(r["text"]), b"\n"]
        want.setdefault(r["doc_id"], (len(t), sum(c[w] > 0 for w in t), sum(np.log10((c[w] + 0.5) / norm) for w in t)))
    for r in out:
        size, known, base = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (size, known, n, held(r["doc_id"]))
        assert abs(r["base_score"] - base) < 1e-6 * max(1, abs(base)) and r["score"] < 0
    assert lm.score_texts(make([])).count() == 0


def test_log_probabilities_sum_to_one():
    counts = np.concatenate([[0], np.arange(3000, 0, -1)])
    v = lm.Vocabulary({}, counts, int(counts.sum()), 3000)
    model = lm.Model.initial(v)
    h = model.hidden(np.array([v.size, v.size, 5, 3, 0]))
    total = np.exp(lm.log_probabilities(model, np.repeat(h, v.size, 0), np.arange(v.size))).sum()
    assert abs(total - 1) < 1e-4
    assert lm.Vocabulary({}, counts, 1, 10**8).size > lm.Vocabulary({}, counts, 1, 10**6).size > v.size  # grows with the corpus


def test_gradient_of_the_training_step_equals_differences():
    rng = np.random.default_rng(3)
    side, size = 4, 64
    noise = rng.random(size) + 0.1
    trainer = lm._Trainer(rng.normal(0, 0.3, lm.Model.length(side)).astype(np.float32), side, noise / noise.sum(), 0.0)
    tokens, at = lm.padded(rng.integers(0, size, 40), np.array([15, 1, 24]), size)
    start = trainer.model.flat.astype(np.float64)

    def loss(flat):
        m, total = lm.Model(flat, side), 0.0
        for p in at:
            h = sum(m.q[tokens[p - k]] * m.c[k - 1] for k in range(1, 5))
            y = tokens[p]
            for level in range(3):
                prefix, choice = y // side ** (3 - level), y // side ** (2 - level) % side
                r, n = m.r[level][prefix], lm.NOISE * lm._choices(noise / noise.sum(), side)[level][prefix]
                p1 = 1 / (1 + np.exp(-(r[:, :-1] @ h + r[:, -1] - np.log(n))))
                total -= np.log(p1[choice]) + (n * np.log(1 - p1)).sum()
        return total / len(at)

    trainer.step(tokens, at)
    for k in rng.integers(0, len(start), 60):
        up, down = start.copy(), start.copy()
        up[k] += 1e-5
        down[k] -= 1e-5
        assert abs((loss(up) - loss(down)) / 2e-5 - trainer.grad.flat[k]) < 1e-3


def test_the_model_beats_the_base_on_held_out_texts(make):
    rng, words = random.Random(12), [prose(k, 1).lower().rstrip(".") for k in range(60)]
    follow = {w: rng.sample(words, 3) for w in words}
    rows = []
    for i in range(1500):
        t = [rng.choice(words)]
        while len(t) < 120:
            t.append(rng.choice(follow[t[-1]]))
        rows.append((i, " ".join(t), "en", "a"))
    out = [r for r in lm.score_texts(make(rows)).collect() if r["held_out"]]
    n = sum(r["n_tokens"] for r in out)
    assert sum(r["score"] for r in out) / n > sum(r["base_score"] for r in out) / n + 0.2


def test_token_counts_equal_the_tokenizer(messy, make):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(f"{token_counts.TOKENIZERS}/{token_counts.VOCABULARY}", "rb"))}
    plain = tiktoken.Encoding("t", pat_str=token_counts.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = messy.filter("doc_id <> 9 or doc_id is null").unionByName(make([(2**53 + 1, "a b", "en", "a"), (None, "c d e", "en", "a")]))
    want = sorted((str(r["doc_id"]), len(plain.encode_ordinary(r["text"] or ""))) for r in docs.collect())
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in token_counts.document_token_counts(docs).collect()) == want
    assert token_counts.document_token_counts(make([])).count() == 0


@pytest.mark.parametrize("group", [2, 4096])
def test_separator_scan_stitches_blocks(spark, tmp_path, monkeypatch, group):
    monkeypatch.setattr(token_counts, "GROUP", group)
    rng = np.random.default_rng(4)
    for k, size in enumerate((0, 1, 999, 5000)):
        ids = rng.integers(0, 9, size).astype("<u2")
        ids[ids == 0] = 7
        (tmp_path / f"{k}.bin").write_bytes(ids.tobytes())
    uris = [f"file://{tmp_path}/{k}.bin" for k in range(4)]
    out = token_counts.count_tokens(token_counts.read_token_files(spark, uris, block_tokens=3), end_id=7).collect()
    for k in range(4):
        ids = np.frombuffer((tmp_path / f"{k}.bin").read_bytes(), "<u2")
        cuts = np.flatnonzero(ids == 7)
        want = [(n, b - a - 1, True) for n, (a, b) in enumerate(zip([-1, *cuts], cuts, strict=False))]
        rest = len(ids) - (cuts[-1] + 1 if len(cuts) else 0)
        want += [(len(want), rest, False)] if rest else []
        assert sorted((r["ordinal"], r["n_tokens"], r["ended"]) for r in out if r["file"] == k) == want


def test_neighbours_equal_brute_force_on_a_small_table(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 8)).astype(np.float32)
    x[50:120] = x[40]  # many rows of one vector
    rows = [(k, [float(v) for v in x[k]], 1) for k in range(400)]
    odd = [(400, None, 1), (401, [0.0] * 8, 1), (402, [float("nan")] + [1.0] * 7, 1), (403, [None] + [1.0] * 7, 1), (404, [1.0] * 3, 1), (None, [1.0] * 8, 1)]
    df = spark.createDataFrame(rows + odd + rows[:5], "vec_id long, embedding array<float>, rank int")
    out = ann.nearest_neighbours(df).collect()
    y = x.astype(float)
    for q in range(0, 400, 20):
        s = y @ y[q]
        order = sorted((k for k in range(400) if k != q), key=lambda k: (-round(s[k], 9), k))[:20]
        got = sorted((r["rank"], r["vec_id"], r["score"]) for r in out if r["query_id"] == q)
        assert [g[1] for g in got] == order and np.allclose([g[2] for g in got], s[order])
    assert {r["query_id"] for r in out} == set(range(0, 400, 20))
    twice = spark.createDataFrame([*rows, (7, [9.0] * 8, 1)], df.schema)  # one id on two vectors: the smaller counts
    assert ann.nearest_neighbours(twice).orderBy("query_id", "rank").collect() == ann.nearest_neighbours(spark.createDataFrame(rows, df.schema)).orderBy("query_id", "rank").collect()
    few = spark.createDataFrame(rows[:3], df.schema)
    assert ann.nearest_neighbours(few).count() == 2
    assert ann.nearest_neighbours(few.limit(0)).count() == 0


def test_trees_grow_with_the_table():
    x = np.random.default_rng(1).normal(size=(4000, 8))
    depths = [ann.fit_forest(x, 100.0, n, 20).depth for n in (10, 1000, 10_000, 100_000)]
    assert depths == sorted(depths) and depths[0] == 2 and depths[1] == 4 and depths[-1] == 9


def test_forest_reaches_the_recall_it_measures():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(6000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    forest = ann.fit_forest(x, 1.0, 6000, 20)
    leaf, q = forest.assign(x), x[1::60]
    opened = forest.opened(q)
    top = np.argsort(-(q @ x.T), axis=1)[:, :20]
    hit = np.zeros(top.shape, bool)
    for t in range(ann.TREES):
        hit |= np.take_along_axis(opened[:, t], leaf[top, t], 1)
    assert hit.mean() > 0.93 and opened.mean() < 0.6


def test_neighbours_come_from_the_opened_leaves_alone(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(k, x[k].tolist()) for k in range(len(x))], "vec_id long, embedding array<double>")
    queries = df.filter("vec_id % 100 = 0")
    fit = ann.fit_forest

    def recall(leaves=None):
        def fitted(*args):
            forest = fit(*args)
            forest.leaves = leaves or forest.leaves
            return forest

        monkeypatch.setattr(ann, "fit_forest", fitted)
        out = ann.nearest_neighbours(df, queries).toPandas()
        assert (out.groupby("query_id").size() == 20).all() and out["query_id"].nunique() == 30
        hits = 0
        for q, own in out.groupby("query_id"):
            s = x @ x[q]
            s[q] = -9
            hits += len(set(np.argsort(-s)[:20]) & set(own["vec_id"]))
        return hits / 600

    assert recall(1) < 0.9 < recall()
    forest = fit(x, 1.0, len(x), 20)
    assert forest.leaves < ann.TREES << forest.depth
