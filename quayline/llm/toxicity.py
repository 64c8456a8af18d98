"""Toxic spans and document scores by a linear-chain conditional random field."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"\w+")
DIM = 1 << 18  # hashed features
BLOCK = 64  # tokens whose products are taken together when messages pass along a text
ROWS_PER_CLASS = 2000  # bound of the labelled sample that the model is fitted on, per class
THRESHOLD = 0.7
SCORE = "score double, predicted int, n_toxic int, spans string"


def fold(key: Column, n: int) -> Column:
    """crc32 of the key's text, modulo n."""
    return F.crc32(key.cast("string").cast("binary")) % n


def word_features(word: str) -> list[int]:
    """Word, prefixes and suffix of one token, hashed."""
    w = word.lower()
    named = ("w" + w, "3" + w[:3], "4" + w[:4], "5" + w[:5], "6" + w[:6], "s" + w[-3:])
    return [crc32(f.encode()) % DIM for f in named]


@dataclass
class ToxicityModel:
    """CRF with labels clean (0) and toxic (1); potentials are relative to clean."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(DIM, np.float32))
    bias: float = -6.0
    trans: np.ndarray = field(default_factory=lambda: np.ones((2, 2)))
    start: float = 1.0
    calibration: tuple[float, float, float] = (-4.0, 0.0, 0.0)

    def emission(self, word: str) -> float:
        return float(self.weights[word_features(word)].sum() + self.bias)


def messages(psi: np.ndarray, counts: np.ndarray, trans: np.ndarray, start: float) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward messages of consecutive texts, each one chain from its first token to its last.

    psi holds the token potentials of label 1 against 0, counts the tokens of each text. With two
    labels a message is a ratio, and a token maps (a0, a1) to (t00 a0 + t10 a1, psi (t01 a0 + t11 a1)).
    The products of BLOCK tokens' maps carry the messages from block to block, then all blocks are
    filled in at once; the result is that of the token-by-token recursion, at any length.
    """
    (t00, t01), (t10, t11) = trans
    blocks = -(-counts // BLOCK)
    total = int(blocks.sum())
    begin = np.cumsum(blocks) - blocks  # first block of each text
    tokens = np.cumsum(counts) - counts
    at = np.arange(len(psi)) - np.repeat(tokens, counts) + np.repeat(begin * BLOCK, counts)
    real = np.zeros(total * BLOCK, bool)
    real[at] = True
    grid = np.ones(total * BLOCK)
    grid[at] = psi
    grid, real = np.ascontiguousarray(grid.reshape(total, BLOCK).T), np.ascontiguousarray(real.reshape(total, BLOCK).T)
    opens = np.zeros(total, bool)
    opens[begin[counts > 0]] = True

    # the block's product; a text's first token has no transition before it, places behind its last do nothing
    p00, p01, p10, p11 = np.ones(total), np.zeros(total), np.zeros(total), np.ones(total)
    for k in range(BLOCK):
        g, some = grid[k], real[k] if k else real[k] & ~opens
        c00, c10 = t00 * p00 + t10 * p10, g * (t01 * p00 + t11 * p10)
        c01, c11 = t00 * p01 + t10 * p11, g * (t01 * p01 + t11 * p11)
        scale = c00 + c01 + c10 + c11
        p00, p01, p10, p11 = (np.where(some, c / scale, p) for c, p in ((c00, p00), (c01, p01), (c10, p10), (c11, p11)))
        if not k:
            p11 = np.where(opens, g, p11)

    enter, leave = np.full(total, float(start)), np.ones(total)  # ratio before each block; backward ratio behind it
    order = np.argsort(-blocks, kind="stable")
    longest = int(blocks.max(initial=0))
    alive = np.searchsorted(-blocks[order], -np.arange(1, longest + 1), side="right")  # texts with that many blocks
    for k in range(1, longest):
        now = begin[order[: alive[k]]] + k
        r = enter[now - 1]
        enter[now] = (p10[now - 1] + p11[now - 1] * r) / (p00[now - 1] + p01[now - 1] * r)
    for k in range(1, longest):
        some = order[: alive[k]]
        now = begin[some] + blocks[some] - 1 - k
        q = leave[now + 1]
        leave[now] = (p01[now + 1] + p11[now + 1] * q) / (p00[now + 1] + p10[now + 1] * q)

    ahead, back = np.empty_like(grid), np.empty_like(grid)
    r = enter
    for k in range(BLOCK):
        step = grid[k] * (t01 + r * t11) / (t00 + r * t10)
        if not k:
            step = np.where(opens, grid[0] * r, step)
        ahead[k] = r = np.where(real[k], step, r)
    b = leave
    for k in range(BLOCK - 1, -1, -1):
        back[k] = b
        q = grid[k] * b
        b = np.where(real[k], (t10 + t11 * q) / (t00 + t01 * q), b)
    return ahead.T.ravel()[at], back.T.ravel()[at]


def marginals(psi: np.ndarray, counts: np.ndarray, trans: np.ndarray, start: float) -> np.ndarray:
    """Posterior of label 1 of every token of consecutive texts."""
    ahead, back = messages(psi, counts, trans, start)
    odds = ahead * back
    return odds / (1 + odds)


class _Emissions(dict):
    """Potential of each word seen by this worker; emptied when it has grown large."""

    def __init__(self, model: ToxicityModel):
        self.model = model

    def __missing__(self, word: str) -> float:
        if len(self) > 150_000:
            self.clear()
        value = self[word] = float(np.exp(min(self.model.emission(word), 30.0)))
        return value


def _document_features(p: np.ndarray) -> tuple[float, float]:
    top = float(np.clip(p.max(initial=0.0), 1e-6, 1 - 1e-6))
    return float(np.log(top / (1 - top))), float(np.log1p(p[p > 0.5].sum()))


def _score_texts(texts: list[str], model: ToxicityModel, memo: _Emissions) -> list[tuple]:
    tokens = [TOKEN.findall(t) for t in texts]
    counts = np.array([len(t) for t in tokens], dtype=np.int64)
    psi = np.fromiter((memo[w] for t in tokens for w in t), dtype=np.float64, count=int(counts.sum()))
    p = marginals(psi, counts, model.trans, model.start)
    a, b, c = model.calibration
    out, end = [], 0
    for text, n in zip(texts, counts, strict=True):
        own, end = p[end : end + n], end + n
        x, y = _document_features(own)
        score = float(1 / (1 + np.exp(-np.clip(a + b * x + c * y, -30, 30))))
        hits = np.flatnonzero(own > 0.5)
        spans = ""
        if len(hits):
            wanted = set(hits.tolist())
            spans = ",".join(f"{m.start()}:{m.end()}" for k, m in enumerate(TOKEN.finditer(text)) if k in wanted)
        out.append((score, int(score >= THRESHOLD), len(hits), spans))
    return out


def score_column(model: ToxicityModel, text: Column) -> Column:
    """struct(score, predicted, n_toxic, spans) of each whole text; null reads as empty."""

    @F.pandas_udf(SCORE)
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        memo = _Emissions(model)
        for part in parts:
            texts, rows, held, size = ["" if t is None else t for t in part], [], [], 0
            for t in texts:  # a few MB of text at a time
                held.append(t)
                size += len(t)
                if size > 2_000_000:
                    rows += _score_texts(held, model, memo)
                    held, size = [], 0
            rows += _score_texts(held, model, memo)
            yield pd.DataFrame(rows, columns=["score", "predicted", "n_toxic", "spans"])

    return scored(text)


@dataclass
class _Sample:
    """Labelled texts as word numbers laid end to end."""

    words: list[str]
    ids: np.ndarray
    counts: np.ndarray
    toxic: np.ndarray

    @staticmethod
    def of(texts: list[str], toxic: np.ndarray) -> _Sample:
        number: dict[str, int] = {}
        counts = np.zeros(len(texts), np.int64)
        parts = []
        for k, t in enumerate(texts):
            parts.append(np.array([number.setdefault(w, len(number)) for w in TOKEN.findall(t.lower())], np.int32))
            counts[k] = len(parts[-1])
        return _Sample(list(number), np.concatenate([*parts, np.zeros(0, np.int32)]), counts, toxic)

    def runs(self, most: int = 400_000) -> Iterator[tuple[int, int, int, int]]:
        """Texts and tokens of runs of whole texts of about so many tokens."""
        ends = np.cumsum(self.counts)
        lo = 0
        while lo < len(self.counts):
            begin = int(ends[lo] - self.counts[lo])
            hi = max(lo + 1, int(np.searchsorted(ends, begin + most, side="right")))
            yield lo, hi, begin, int(ends[hi - 1])
            lo = hi


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(31))


def _evidence(sample: _Sample) -> np.ndarray:
    """Which words toxic documents hold, they or their stems, far more often than clean ones.

    Occurrences count once for each pair of neighbours, so copies of a text don't add evidence.
    A unit must pass a likelihood-ratio test whose level allows for the number of units tested.
    """
    ids, edge = sample.ids.astype(np.uint64) + np.uint64(1), np.zeros(len(sample.ids), bool)
    first = (np.cumsum(sample.counts) - sample.counts)[sample.counts > 0]
    edge[first] = True
    before, after = np.zeros_like(ids), np.zeros_like(ids)
    before[1:], after[:-1] = ids[:-1], ids[1:]
    before[edge] = 0
    after[:-1][edge[1:]] = 0
    near = _mixed(_mixed(before) + after)
    y = np.repeat(sample.toxic > 0, sample.counts)
    stems: dict[str, int] = {}
    stem = np.array([stems.setdefault(w[:5], len(stems)) if len(w) > 5 else -1 for w in sample.words], np.int64)
    n1, n0 = max(int(y.sum()), 1), max(int((~y).sum()), 1)
    seen = []  # words, then stems: distinct neighbours in clean and in toxic documents
    for unit, n in ((sample.ids.astype(np.int64), len(sample.words)), (stem[sample.ids], len(stems))):
        row = []
        for label in (False, True):
            own = (y == label) & (unit >= 0)
            _, at = np.unique(_mixed(near[own] ^ _mixed(unit[own].astype(np.uint64) + np.uint64(7))), return_index=True)
            row.append(np.bincount(unit[own][at], minlength=n))
        seen.append(row)
    level = 2 * np.log(max(sum(int((row[1] >= 3).sum()) for row in seen), 1)) + 6
    good = []
    for b, a in seen:
        e1, e0 = (a + b) * n1 / (n1 + n0), (a + b) * n0 / (n1 + n0)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = 2 * (np.where(a > 0, a * np.log(a / e1), 0) + np.where(b > 0, b * np.log(b / e0), 0))
        good.append((a >= 3) & (b * 20 * n1 <= a * n0) & (ratio > level))
    return good[0] | ((stem >= 0) & np.append(good[1], False)[stem])


def _train(sample: _Sample, gold: np.ndarray, rounds: int = 60) -> ToxicityModel:
    """Maximum likelihood of the labelled texts, each a whole chain, by Adam on exact forward-backward gradients."""
    ids, counts, words = sample.ids, sample.counts, len(sample.words)
    features = np.array([word_features(w) for w in sample.words], dtype=np.int32).reshape(words, -1)
    opens = np.zeros(len(ids), bool)
    opens[(np.cumsum(counts) - counts)[counts > 0]] = True
    inner = ~opens[1:]
    before, after = gold[:-1][inner], gold[1:][inner]
    told = np.array([(~before & ~after).sum(), (~before & after).sum(), (before & ~after).sum(), (before & after).sum()], float)
    by_label, firsts = np.bincount(ids, weights=gold, minlength=words), gold[opens].sum()
    del before, after, inner
    model = ToxicityModel(bias=-4.0)
    theta = np.concatenate([np.zeros(DIM), [-4.0, 0.0, 0.0, 0.0, 0.0, 0.0]])  # weights, bias, start, transitions
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    scale = max(1.0, len(ids) / BLOCK)
    for r in range(1, rounds + 1):
        w, (bias, start), trans = theta[:DIM], theta[DIM : DIM + 2], np.exp(theta[DIM + 2 :].reshape(2, 2))
        (t00, t01), (t10, t11) = trans
        potential = np.exp(np.minimum(w[features].sum(1) + bias, 30))
        grad, by_word = np.zeros_like(theta), -by_label
        for lo, hi, i, j in sample.runs():
            own, first = ids[i:j], opens[i:j]
            psi = potential[own]
            ahead, back = messages(psi, counts[lo:hi], trans, float(np.exp(start)))
            psi *= back
            back *= ahead
            p = back / (1 + back)
            follows = ~first[1:]
            x, q = ahead[:-1][follows], psi[1:][follows]
            cells = np.stack([np.full_like(q, t00), t01 * q, x * t10, t11 * x * q])
            grad[DIM + 2 :] += (cells / cells.sum(0)).sum(1)
            grad[DIM + 1] += p[first].sum()
            by_word += np.bincount(own, weights=p, minlength=words)
        np.add.at(grad, features.ravel(), np.repeat(by_word, features.shape[1]))
        grad[DIM] = by_word.sum()
        grad[DIM + 1] -= firsts
        grad[DIM + 2 :] -= told
        grad = grad / scale + 1e-5 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.98 * v + 0.02 * grad**2
        theta = theta - 0.25 * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.98**r)) + 1e-6)
    model.weights, model.bias, model.start = theta[:DIM].astype(np.float32), float(theta[DIM]), float(np.exp(theta[DIM + 1]))
    model.trans = np.exp(theta[DIM + 2 :].reshape(2, 2))
    return model


def _calibrate(model: ToxicityModel, sample: _Sample, weight: np.ndarray) -> tuple[float, float, float]:
    """Ridge logistic regression of the label on the two document features, by Newton steps."""
    potential = np.array([np.exp(min(model.emission(w), 30.0)) for w in sample.words])
    x = np.ones((len(sample.counts), 3))
    for lo, hi, i, j in sample.runs():
        p, end = marginals(potential[sample.ids[i:j]], sample.counts[lo:hi], model.trans, model.start), 0
        for k in range(lo, hi):
            begin, end = end, end + int(sample.counts[k])
            x[k, 1:] = _document_features(p[begin:end])
    beta = np.zeros(3)
    ridge = np.diag([1e-3, 0.05, 0.05])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge
        beta += np.linalg.solve(h, x.T @ (weight * (sample.toxic - p)) - ridge @ beta)
    beta[1:] = np.maximum(beta[1:], 0.0)
    return tuple(float(b) for b in beta)


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows_per_class: int = ROWS_PER_CLASS) -> ToxicityModel:
    """Fit the CRF on a bounded sample of labelled rows.

    The sample holds at most ``rows_per_class`` whole texts of each label, chosen by the hash of their
    id: a threshold found from the number of labelled rows lets through few more, of which the
    smallest hashes stay, so no task sends many rows. Labels mark documents; tokens are labelled from them: in a
    toxic document those of the words and stems are toxic that set such documents apart. Rows
    without label, id or text take no part; an id labelled twice counts as toxic if either says so.
    Without both labels the model rates every text as clean.
    """
    marks = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).dropna().groupBy("_id").agg(F.max("_y").alias("_y"))
    # ids are joined and ranked without their texts; the texts of the bounded sample are looked up after that
    rows = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id")).distinct()
    rows = rows.join(marks, "_id").withColumn("_h", F.xxhash64(F.col("_id").cast("string")))
    held = dict(rows.groupBy("_y").count().collect())
    parts = []
    for y in (1, 0):
        share = min(1.0, 1.5 * (rows_per_class + 20) / max(held.get(y, 0), 1))
        parts.append(rows.filter((F.col("_y") == y) & (F.col("_h") <= min(2**63 - 1, int(share * 2**64) - 2**63))).orderBy("_h", "_id").limit(rows_per_class).select("_id", "_y"))
    chosen = docs.sparkSession.createDataFrame(parts[0].unionByName(parts[1]).toPandas(), parts[0].schema)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).filter(F.col("_text").isNotNull())
    sample = texts.join(F.broadcast(chosen), "_id").groupBy("_id", "_y").agg(F.min("_text").alias("_text")).toPandas()
    toxic = sample["_y"].to_numpy(dtype=float) if len(sample) else np.zeros(0)
    if not (0 < toxic.sum() < len(toxic)):
        return ToxicityModel()
    sample = _Sample.of(sample["_text"].tolist(), toxic)
    good = _evidence(sample)
    model = _train(sample, good[sample.ids] & np.repeat(toxic > 0, sample.counts))
    totals = dict(marks.groupBy("_y").count().collect())
    weight = np.where(toxic > 0, totals.get(1, 1) / toxic.sum(), totals.get(0, 1) / (len(toxic) - toxic.sum()))
    model.calibration = _calibrate(model, sample, weight * len(toxic) / (weight.sum() or 1))
    return model


def training_rows(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows whose labels may be learned from: crc32(id) mod 3 is not 1."""
    return df.filter(fold(F.col(id_col), 3) != 1)


def score_toxicity(docs: DataFrame, labels: DataFrame, model: ToxicityModel | None = None) -> DataFrame:
    """Score every whole text: doc_id, held_out, score, predicted, n_toxic, spans.

    n_toxic counts the tokens with a marginal over a half; spans gives their code points as
    start:end. Null and empty texts score as texts without tokens; repeated rows are scored alike;
    a null id is not held out; empty tables give no rows. Other columns are ignored.
    """
    model = model or fit_toxicity(training_rows(docs), training_rows(labels))
    scored = docs.select("doc_id", F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), score_column(model, F.col("text")).alias("_s"))
    return scored.select("doc_id", "held_out", "_s.*")


def reject_toxic(docs: DataFrame, labels: DataFrame, model: ToxicityModel | None = None) -> DataFrame:
    """docs without those predicted toxic; columns as they came."""
    model = model or fit_toxicity(training_rows(docs), training_rows(labels))
    packed = docs.select(F.struct(*docs.columns).alias("_doc"))  # no column name of the input can clash
    return packed.withColumn("_s", score_column(model, F.col("_doc.text"))).filter(F.col("_s.predicted") == 0).select("_doc.*")
