"""Licence families of paragraphs: n-gram logistic regression, confirmed by comparison with templates."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: fixed values: wordings by which licences are named or opened
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License",
        "distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
        "This project is available under the Apache License 2.0",
    ],
    "mit": [
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "This project is licensed under the terms of the MIT license",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT',
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or at your option any later version",
        "Licensed under the GPL version 3",
        "You should have received a copy of the GNU General Public License along with this program",
    ],
    "gpl-2.0": ["This program is licensed under the GNU General Public License, version 2", "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or at your option any later version", "Licensed under the GPL version 2"],
    "lgpl": ["Licensed under the GNU Lesser General Public License", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or at your option any later version"],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Licensed under the BSD 3-Clause License",
        "Released under a BSD license",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED',
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE",
    ],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Licensed under the Mozilla Public License 2.0"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "available under CC BY-NC-SA 4.0"],
    "cc-by": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "Licensed under the ISC License"],
    "agpl-3.0": ["Licensed under the GNU Affero General Public License", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or at your option any later version"],
    "unlicense": ["This is free and unencumbered software released into the public domain", "Released under the Unlicense"],
    "cc0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "Released under the CC0 1.0 Universal public domain dedication"],
    "epl-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "Licensed under the Eclipse Public License"],
    "zlib": ["This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software", "Licensed under the zlib License"],
    "boost": [
        "Distributed under the Boost Software License, Version 1.0",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the Software",
    ],
    "unknown": [
        "All rights reserved",
        "This software is provided under a proprietary license agreement",
        "See the license file for the terms of use",
        "Use of this work is governed by the license of its owner",
        "licensed under the terms of the vendor license",
        "Copyright by the authors, licence on request",
    ],
}
#: fixed values: the names that families go by, and how notices are worded in several languages
NAMES = {
    "apache-2.0": ["Apache License 2.0", "Apache License, Version 2.0", "Apache 2.0", "Apache-2.0", "Apache license", "ASL 2.0"],
    "mit": ["MIT", "MIT License", "MIT-style", "MIT/X11", "Expat"],
    "gpl-3.0": ["GPLv3", "GPL-3.0-or-later", "GPL-3.0-only", "GNU GPL version 3", "GNU General Public License v3", "GPL 3"],
    "gpl-2.0": ["GPLv2", "GPL-2.0-or-later", "GPL-2.0-only", "GNU GPL version 2", "GNU General Public License v2", "GPL 2"],
    "lgpl": ["LGPL", "LGPLv3", "LGPL-2.1-or-later", "GNU LGPL", "GNU Lesser General Public License v2.1"],
    "bsd": ["BSD", "BSD-3-Clause", "BSD-2-Clause", "3-clause BSD", "Simplified BSD", "New BSD"],
    "mpl-2.0": ["MPL 2.0", "MPL-2.0", "Mozilla Public License", "Mozilla Public License 2.0"],
    "cc-by-nc": ["CC BY-NC 4.0", "CC-BY-NC-4.0", "CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial"],
    "cc-by": ["CC BY 4.0", "CC-BY-4.0", "CC BY", "Creative Commons Attribution 4.0"],
    "cc-by-sa": ["CC BY-SA 4.0", "CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike"],
    "isc": ["ISC", "ISC License"],
    "agpl-3.0": ["AGPLv3", "AGPL-3.0-or-later", "GNU AGPL", "Affero General Public License"],
    "unlicense": ["Unlicense", "The Unlicense"],
    "cc0-1.0": ["CC0", "CC0-1.0", "CC0 1.0 Universal"],
    "epl-2.0": ["EPL-2.0", "EPL 2.0", "Eclipse Public License"],
    "zlib": ["Zlib", "zlib License", "zlib/libpng"],
    "boost": ["BSL-1.0", "Boost Software License", "Boost Software License 1.0", "Boost"],
    "unknown": ["vendor", "Acme Software License", "commercial", "proprietary", "house", "company", "in-house terms", "enterprise agreement"],
}
WORDINGS = (
    "SPDX-License-Identifier: {}",
    "Licensed under {}",
    "Licensed under the {} license",
    "This code is {} licensed, see LICENSE",
    "Released under the terms of the {}",
    "License: {}",
    "{} License",
    "Copyright the authors, {} licence",
    "This program is free software under the {}",
    "is distributed under the {} licence, see COPYING for details",
    "You may use it under the {} licence",
    "available under {}",
    "The source is covered by the {} license",
    "published as open source under {}",
    "Use is subject to the {} license terms",
    "Lizenziert unter der {} Lizenz",
    "Dieses Programm steht unter der {}-Lizenz",
    "Veröffentlicht unter {}",
    "Ce logiciel est distribué sous licence {}",
    "Publié sous la licence {}",
    "Bajo la licencia {}",
    "Este programa se distribuye con licencia {}",
)
DUAL = ("Dual-licensed under {} and {}", "Licensed under either of {} or {} at your option", "{} OR {}", "available under both the {} and the {} license")
CLASSES = ("none", *TEMPLATES)
TOKEN = re.compile(r"\w+(?:[.\-]\w+)*|[.!?\n]")
PLAIN = 15_000  # sentences drawn from the counts of the whole corpus; they teach what is no licence
LENGTHS = 64  # words of a drawn sentence at most
PRIOR = 50.0  # plain sentences for each licence sentence; counts where no template confirms
ALSO = 0.3  # probability from which a second family is named beside the first
SURE = 0.8  # probability from which a family needs no template
CONFIRM = 0.6  # share of a template's words and word pairs that confirms a less sure prediction
ALONE = 0.9  # share that a line must hold to count beside the wrapped sentence, a confirmed one, that it is part of
BATCH_CHARS = 2_000_000
_END, _LINE = 1, 2


class _Tokens(dict):
    """Hash and flags of each token seen by this worker; emptied when it has grown large."""

    def __missing__(self, token: str) -> int:
        if len(self) > 500_000:
            self.clear()
        flags = _END | _LINE if token == "\n" else _END if token in ".!?" else 0
        value = self[token] = xxhash.xxh3_64_intdigest(token.lower()) & ~3 | flags
        return value


@dataclass
class Sentences:
    """Sentences of consecutive texts, with their hashed n-grams laid end to end."""

    text: np.ndarray
    paragraph: np.ndarray  # number of the paragraph within the text
    lines: np.ndarray  # lines that it spans
    first: np.ndarray  # first and last token of the sentence within the text
    last: np.ndarray
    grams: np.ndarray  # 40-bit hashes of its features, sentence after sentence: a word, then the pair that it ends
    start: np.ndarray  # where each sentence's begin


def sentences(texts: list[str], memo: _Tokens, wrapped: bool = False) -> Sentences:
    """Sentences end at sentence marks and line breaks, or, ``wrapped``, at marks and blank lines.

    Paragraphs are the runs of lines between blank lines (lines without words). Features are hashed
    words and word pairs.
    """
    found = [TOKEN.findall(t) for t in texts]
    size = np.array([len(f) for f in found], dtype=np.int64)
    codes = np.fromiter(map(memo.__getitem__, chain.from_iterable(found)), dtype=np.uint64, count=int(size.sum()))
    text = np.repeat(np.arange(len(texts)), size)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(size) - size, size)
    breaks = (codes & np.uint64(_LINE)) > 0
    ends = (codes & np.uint64(_END)) > 0
    word = ~ends
    line = np.cumsum(breaks)
    held = np.flatnonzero(word)
    blank = np.zeros(len(codes), np.int64)  # a word after two breaks or more without a word between opens a paragraph
    blank[held[1:]] = (line[held[1:]] - line[held[:-1]] > 1) & (text[held[1:]] == text[held[:-1]])
    blank = np.cumsum(blank)
    if wrapped:
        number = np.cumsum(ends & ~breaks) + blank
    else:
        number = np.cumsum(ends) - ends
    codes, text, place, number, blank, line = codes[word], text[word], place[word], number[word], blank[word], line[word]
    new = np.ones(len(codes), bool)
    new[1:] = (number[1:] != number[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(codes)))
    pair = np.zeros_like(codes)
    if len(codes):
        pair[1:] = (codes[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ codes[1:]
        pair[at] = codes[at] * np.uint64(0xD1B54A32D192ED03)  # the opening word
    mixed = np.stack([codes, pair], 1).ravel()
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    of = text[at]
    opening = np.searchsorted(text, of)  # first word of the sentence's text
    return Sentences(of, blank[at] - blank[opening] if len(at) else blank[at], line[at + count - 1] - line[at] + 1 if len(at) else at, place[at], place[at + count - 1] if len(at) else at, (mixed >> np.uint64(24)).astype(np.int64), 2 * at)


def _numbered(grams: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """Numbers of the hashes in the sorted vocabulary; what it lacks gets the number past its end, whose weight is 0."""
    at = np.searchsorted(vocabulary, grams)
    at[vocabulary[np.minimum(at, len(vocabulary) - 1)] != grams] = len(vocabulary)
    return at


def _logits(numbers: np.ndarray, start: np.ndarray, weights: np.ndarray, bias: np.ndarray, n: np.ndarray | None = None) -> np.ndarray:
    if not len(start):
        return np.zeros((0, len(bias)))
    n = np.diff(np.append(start, len(numbers))) if n is None else n
    return np.add.reduceat(weights[numbers], start) / np.sqrt(n)[:, None] + bias


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(1, keepdims=True))
    return x / x.sum(1, keepdims=True)


@dataclass
class LicenceModel:
    vocabulary: np.ndarray  # sorted hashes of the words and word pairs of all notices
    weights: np.ndarray  # one row each, and a row of zeros
    bias: np.ndarray
    temperature: float = 1.0
    templates: dict[str, list[set[int]]] = field(default_factory=dict)

    def containment(self, family: str, grams: np.ndarray) -> float:
        """Largest share of one of the family's templates that the sentence holds."""
        own = set(grams.tolist())
        return max((len(own & t) / len(t) for t in self.templates[family]), default=0.0)


def _count(parts: Iterator[pd.DataFrame], vocabulary: np.ndarray) -> Iterator[pd.DataFrame]:
    """A task's counts of the vocabulary's words and pairs, of all others, and of sentence lengths."""
    memo, size = _Tokens(), len(vocabulary) + 1
    sums = {"word": np.zeros(size, np.int64), "pair": np.zeros(size, np.int64), "length": np.zeros(LENGTHS + 1, np.int64)}
    for part in parts:
        sizes = part["text"].str.len().cumsum() // BATCH_CHARS
        for _, some in part.groupby(sizes.to_numpy(), sort=False):
            found = sentences(some["text"].tolist(), memo)
            numbers = _numbered(found.grams, vocabulary)
            sums["word"] += np.bincount(numbers[0::2], minlength=size)
            sums["pair"] += np.bincount(numbers[1::2], minlength=size)
            n = np.diff(np.append(found.start, len(found.grams))) // 2
            sums["length"] += np.bincount(np.minimum(n, LENGTHS), minlength=LENGTHS + 1)
    yield pd.concat([pd.DataFrame({"kind": k, "place": np.flatnonzero(v), "n": v[v > 0]}) for k, v in sums.items()])


def corpus_counts(docs: DataFrame, vocabulary: np.ndarray, text_col: str = "text") -> dict[str, np.ndarray]:
    """Shares of the vocabulary's words and pairs (the last: of all others) and of sentence lengths, over all texts."""
    texts = docs.select(F.col(text_col).alias("text")).filter(F.col("text").isNotNull())
    counted = texts.mapInPandas(lambda parts: _count(parts, vocabulary), "kind string, place long, n long")
    rows = counted.groupBy("kind", "place").agg(F.sum("n").alias("n")).toPandas()  # no more than the vocabulary twice
    out = {"word": np.zeros(len(vocabulary) + 1), "pair": np.zeros(len(vocabulary) + 1), "length": np.zeros(LENGTHS + 1)}
    for kind, place, n in rows.itertuples(index=False):
        out[kind][place] = n
    for kind, empty in (("word", len(vocabulary)), ("pair", len(vocabulary)), ("length", 8)):
        if not out[kind].any():
            out[kind][empty] = 1
    return {k: v / v.sum() for k, v in out.items()}


def _notices() -> list[tuple[str, tuple[str, ...], int]]:
    """Texts that name licences: the text, its families, and the number of its wording."""
    out = [(t, (f,), -1) for f, texts in TEMPLATES.items() for t in texts]
    out += [(w.format(n), (f,), k) for f, names in NAMES.items() for n in names for k, w in enumerate(WORDINGS)]
    known = [f for f in NAMES if f != "unknown"]
    for k, w in enumerate(DUAL):
        out += [(w.format(NAMES[f][j % len(NAMES[f])], NAMES[g][(j + k) % len(NAMES[g])]), (f, g), len(WORDINGS) + k) for j, f in enumerate(known) for g in known if f != g]
    return out


def _hashed(texts: list[str], memo: _Tokens) -> list[np.ndarray]:
    """Each text's n-grams as those of one sentence."""
    found = sentences([re.sub(r"[.!?\n](?=\s|$)", " ", t) for t in texts], memo)
    cuts = np.append(found.start, len(found.grams))
    out = [np.zeros(0, np.int64)] * len(texts)
    for t, a, b in zip(found.text, cuts, cuts[1:], strict=False):
        out[t] = np.concatenate([out[t], found.grams[a:b]])
    return out


def _drawing(vocabulary: np.ndarray, counts: dict[str, np.ndarray], memo: _Tokens, rng: np.random.Generator) -> Callable[[int], np.ndarray]:
    """Draws numbers of words of the corpus: a pair of the vocabulary brings its word, other words come at the rate that is left."""
    size = len(vocabulary)
    word_of = np.full(size + 1, size)
    for grams in _hashed([t for t, _, _ in _notices()], memo):
        word_of[_numbered(grams[1::2], vocabulary)] = _numbered(grams[0::2], vocabulary)
    rest = np.maximum(counts["word"] - np.bincount(word_of[:size], weights=counts["pair"][:size], minlength=size + 1), 0)
    rest = rest / rest.sum() if rest.sum() > 0 else np.eye(size + 1)[size]

    def around(n: int) -> np.ndarray:
        pairs = rng.choice(size + 1, n, p=counts["pair"])
        words = np.where(pairs < size, word_of[pairs], rng.choice(size + 1, n, p=rest))
        return np.stack([words, pairs], 1).ravel()

    return around


def fit_licences(docs: DataFrame, text_col: str = "text", plain: int = PLAIN) -> LicenceModel:
    """Train on worded notices and licence bodies against sentences drawn from the counts of the whole corpus; calibrate on wordings held back.

    A notice is a licence's name in one of the WORDINGS, or a sentence of its text, with words dropped
    and words of the corpus around it. What is no licence is learned from every text: words, pairs
    and lengths are counted over all sentences, and ``plain`` sentences are drawn from these counts.
    Every fifth wording teaches nothing but the temperature, so that certainty is measured on
    wordings that the weights have not seen.
    """
    memo, rng = _Tokens(), np.random.default_rng(5)
    vocabulary = np.unique(np.concatenate(_hashed([t for t, _, _ in _notices()], memo)))
    counts = corpus_counts(docs, vocabulary, text_col)
    model = LicenceModel(vocabulary, np.zeros((len(vocabulary) + 1, len(CLASSES)), np.float32), np.zeros(len(CLASSES)))
    for family, texts in TEMPLATES.items():
        model.templates[family] = [set(g.tolist()) for g in _hashed([t.replace(". ", " ") for t in texts], memo)]
    around = _drawing(vocabulary, counts, memo, rng)
    texts, families, back = [], [], []
    for text, held, wording in _notices():
        copies = 24 if wording < 0 else 4 if len(held) == 1 else 1
        for k in range(copies):
            words = [w for w in text.split() if k == 0 or rng.random() > 0.06]
            texts.append((" ".join(words) or text).upper() if rng.random() < 0.05 else " ".join(words) or text)
            families.append(held)
            back.append(wording >= 0 and wording % 5 == 4)
    grams = [np.concatenate([_numbered(g, vocabulary), around(int(rng.integers(0, 10)) * (k % 2))]) for k, g in enumerate(_hashed(texts, memo))]
    lengths = np.maximum(rng.choice(LENGTHS + 1, plain, p=counts["length"]), 1)
    grams += [around(int(n)) for n in lengths]
    back = np.array(back + (rng.random(plain) < 0.2).tolist())
    target = np.zeros((len(grams), len(CLASSES)))
    for row, held in zip(target, families):
        row[[CLASSES.index(f) for f in held]] = 1 / len(held)
    target[len(families) :, 0] = 1

    n = np.array([len(g) for g in grams])
    grams = [np.append(len(vocabulary), g[g < len(vocabulary)]) for g in grams]  # what weighs nothing counts in the length alone
    held = np.array([len(g) for g in grams])
    start, numbers = np.cumsum(held) - held, np.concatenate(grams)
    main = target.argmax(1)
    share = np.bincount(main[~back], minlength=len(CLASSES))
    weight = np.where(back, 0.0, 1.0 / np.maximum(share[main], 1))
    weight[main == 0] *= 6
    weight /= weight.sum()
    row = np.repeat(np.arange(len(grams)), held)
    w, b = np.zeros((len(vocabulary) + 1, len(CLASSES))), np.zeros(len(CLASSES))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for r in range(1, 101):
        off = (_softmax(_logits(numbers, start, w, b, n)) - target) * weight[:, None]
        scaled = off / np.sqrt(n)[:, None]
        grad = np.stack([np.bincount(numbers, weights=scaled[row, k], minlength=len(w)) for k in range(len(CLASSES))], 1) + 1e-6 * w
        grad[-1] = 0
        m, v = 0.9 * m + 0.1 * grad, 0.98 * v + 0.02 * grad**2
        w -= 0.2 * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.98**r)) + 1e-8)
        b -= 0.5 * off.sum(0)
    model.weights, model.bias = w.astype(np.float32), b
    logits = _logits(numbers, start, model.weights, b, n)[back]
    if len(logits):
        loss = lambda t: -(target[back] * np.log(_softmax(logits / t) + 1e-12)).sum(1).mean()
        model.temperature = float(min(np.geomspace(0.25, 4, 33), key=loss))
    return model


FOUND = "id string, paragraph int, start int, end int, family string, probability double, containment double"


def named(p: np.ndarray, share: Callable[[str], float]) -> list[tuple[str, float, float, bool]]:
    """What a sentence's calibrated probabilities name: family, probability, containment, whether it is a known family.

    A known family stands if it is SURE, or at least ALSO likely and confirmed by a template. Without one, a
    sentence that is more likely than not a licence, with plain ones PRIOR times as frequent, is unknown.
    """
    if p[0] >= 0.5:
        return []
    likely = (1 - p[0]) / max(1 - p[0] + PRIOR * p[0], 1e-300)
    out = []
    for k in np.flatnonzero(p[1:] >= ALSO) + 1:
        family = CLASSES[k]
        held = share(family) if family != "unknown" else 0.0
        several = sum(p[j] for j in range(1, len(CLASSES)) if p[j] >= ALSO and CLASSES[j] != "unknown")
        if family != "unknown" and (held >= CONFIRM or (several >= SURE and likely >= 0.5)):
            out.append((family, float(p[k]), held, True))
    return out or ([("unknown", float(likely), max(map(share, TEMPLATES)), False)] if likely >= 0.5 else [])


def _judged(found: Sentences, m: LicenceModel) -> list[tuple]:
    """Sentences that name a licence: text, paragraph, known, probability, first, last, family, containment."""
    p = _softmax(_logits(_numbered(found.grams, m.vocabulary), found.start, m.weights, m.bias) / m.temperature) if len(found.start) else np.zeros((0, len(CLASSES)))
    cuts = np.append(found.start, len(found.grams))
    rows = []
    for k in np.flatnonzero((p[:, 0] < 0.5) & (found.last > found.first)).tolist():  # one word alone is no notice
        grams = found.grams[cuts[k] : cuts[k + 1]]
        for family, probability, share, known in named(p[k], lambda f: m.containment(f, grams)):  # noqa: B023
            rows.append((int(found.text[k]), int(found.paragraph[k]), known, probability, int(found.first[k]), int(found.last[k]), family, share))
    return rows


def _only(found: Sentences, keep: np.ndarray) -> Sentences:
    """Those sentences alone."""
    n = np.diff(np.append(found.start, len(found.grams)))
    return Sentences(found.text[keep], found.paragraph[keep], found.lines[keep], found.first[keep], found.last[keep], found.grams[np.repeat(keep, n)], np.cumsum(n[keep]) - n[keep])


def scan_licences(docs: DataFrame, model: LicenceModel | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Paragraphs that name a licence: doc_id, paragraph, start, end, family, probability, containment.

    A paragraph is a run of lines up to a blank line. Every sentence of every whole text is
    classified, cut at each line break and, where it goes on over a line break, also as a whole, so
    hard-wrapped notices are found. A paragraph gives one row for each family that one of its
    sentences names, with the code points of the surest such sentence (end exclusive); ties go to
    the earlier one. A line of a confirmed wrapped sentence counts beside it only if it holds ALONE
    of a template. A family stands if its calibrated probability is SURE, or lower and the sentence
    holds CONFIRM of one of its templates (see ``named``); a paragraph without such a family that is
    more likely a licence than not is ``unknown``. containment is the largest share of a template.

    Null and empty texts give no rows; repeated rows give theirs each; ids pass through as text, so
    null and large ones stay; empty tables give no rows. Other columns are ignored.
    """
    model = model or fit_licences(docs, text_col)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo, m = _Tokens(), held.value
        for part in parts:
            sizes = part["text"].str.len().cumsum() // BATCH_CHARS
            for _, some in part.groupby(sizes.to_numpy(), sort=False):
                texts = some["text"].tolist()
                several = [k for k, t in enumerate(texts) if "\n" in t]
                whole = sentences([texts[k] for k in several], memo, wrapped=True)
                wrapped = [(several[r[0]], *r[1:]) for r in _judged(_only(whole, whole.lines > 1), m)]
                within: dict[int, list[tuple]] = {}
                for r in wrapped:
                    if r[2]:
                        within.setdefault(r[0], []).append(r[4:6])
                lines = _judged(sentences(texts, memo), m)
                judged = wrapped + [r for r in lines if r[7] >= ALONE or not any(a <= r[4] and r[5] <= b for a, b in within.get(r[0], ()))]
                sure = {r[:2] for r in judged if r[2]}
                best: dict[tuple, tuple] = {}
                for r in judged:
                    key = (*r[:2], r[6])
                    if (r[2] or r[:2] not in sure) and (key not in best or (r[3], -r[4]) > (best[key][3], -best[key][4])):
                        best[key] = r
                rows, spans, at = [], [], -1
                for t, paragraph, _, prob, first, last, family, share in sorted(best.values(), key=lambda r: (r[0], r[1], r[4])):
                    if t != at:
                        spans, at = [x.span() for x in TOKEN.finditer(texts[t])], t
                    rows.append((some["id"].iat[t], paragraph, spans[first][0], spans[last][1], family, prob, share))
                yield pd.DataFrame(rows, columns=["id", "paragraph", "start", "end", "family", "probability", "containment"])

    named = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull())
    found = named.mapInPandas(run, FOUND)
    return found.select(F.col("id").cast("long").alias("doc_id"), *[c for c in found.columns if c != "id"])
