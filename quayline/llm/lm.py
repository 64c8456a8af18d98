"""Log-bilinear language model, trained by noise-contrastive estimation, with normalised scores."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayline.llm.toxicity import fold
from quayline.storage import materialise

LEVELS = 3  # a word is found by three choices of one in ``side``
GROWTH, LEAST_SIDE = 0.2, 8  # side is the distinct words to this power: the vocabulary grows with the corpus
DIM, CONTEXT = 32, 4
NOISE = 16.0  # noise words to each true one
SPLITS = 4  # input splits that train one model
HOT = 250_000  # words whose counts travel to the tasks; all others are joined
END = "\n"
UNKNOWN = 0
CHUNK = 4096  # floats of the model in one row
FAN_IN = 256  # partial models that one task adds up


def words_of(text: str | None) -> list[bytes]:
    """Words between spaces, tabs and line breaks, with A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def count_words(docs: DataFrame, text_col: str) -> DataFrame:
    """word, c over all texts, the end of each text counted as a word; summed in the tasks first."""

    def counted(held: Counter) -> pd.DataFrame:
        words = pd.Series([w.decode("utf-8", "replace") for w in held], dtype=object)
        return pd.DataFrame({"word": words, "c": np.fromiter(held.values(), np.int64, len(held))})

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()
        for part in parts:
            for text in part["text"]:
                held.update(words_of(text))
                if len(held) > 400_000:
                    yield counted(held)
                    held = Counter()
            yield pd.DataFrame({"word": [END], "c": [len(part)]})
        yield counted(held)

    return docs.select(F.col(text_col).alias("text")).mapInPandas(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """The HOT commonest words; the first ``size`` of them, with the unknown word, are the model's own."""

    hot: dict[bytes, int]  # word -> number, from 1
    counts: np.ndarray  # by number
    total: int
    distinct: int

    @property
    def side(self) -> int:
        return max(LEAST_SIDE, int(np.ceil(self.distinct**GROWTH)))

    @property
    def size(self) -> int:
        return self.side**LEVELS

    @property
    def base_norm(self) -> float:
        return self.total + 0.5 * (self.distinct + 1)

    @property
    def rare_norm(self) -> float:
        """Mass of the words outside the model's vocabulary, with one place for unseen words."""
        inside = self.counts[1 : self.size]
        return float(self.total - inside.sum() + 0.5 * (self.distinct - len(inside) + 1))


def unigram(vocabulary: Vocabulary) -> np.ndarray:
    """Smoothed share of each vocabulary entry."""
    c = np.full(vocabulary.size, 0.5)
    inside = vocabulary.counts[1 : vocabulary.size]
    c[1 : 1 + len(inside)] += inside
    c[UNKNOWN] += vocabulary.total - inside.sum()
    return c / c.sum()


def _choices(p: np.ndarray, side: int) -> list[np.ndarray]:
    """Share of each choice under every prefix, level by level: (side ** level, side)."""
    out = []
    for level in range(LEVELS):
        sums = p.reshape(side ** (level + 1), -1).sum(1).reshape(-1, side)
        out.append(sums / sums.sum(1, keepdims=True))
    return out


class Model:
    """Parameters as one flat array; the named parts are views.

    q holds the context vectors (the last row stands for the time before a text), c the weights of
    the context places, r the vectors of the choices of each level, each with its bias behind it.
    """

    def __init__(self, flat: np.ndarray, side: int):
        self.flat, self.side = flat, side
        shapes = [(side**LEVELS + 1, DIM), (CONTEXT, DIM), *[(side**k, side, DIM + 1) for k in range(LEVELS)]]
        cuts = np.cumsum([0, *[int(np.prod(x)) for x in shapes]])
        self.q, self.c, *self.r = [flat[i:j].reshape(x) for i, j, x in zip(cuts, cuts[1:], shapes, strict=False)]

    @staticmethod
    def length(side: int) -> int:
        return (side**LEVELS + 1 + CONTEXT) * DIM + sum(side ** (k + 1) * (DIM + 1) for k in range(LEVELS))

    @staticmethod
    def initial(vocabulary: Vocabulary) -> Model:
        """Small fixed vectors; biases give the unigram distribution."""
        rng = np.random.default_rng(7)
        side = vocabulary.side
        model = Model(rng.normal(0, 0.1, Model.length(side)).astype(np.float32), side)
        model.c[:] = np.array([1.0, 0.8, 0.6, 0.5], np.float32)[:, None]
        for r, p in zip(model.r, _choices(unigram(vocabulary), side), strict=True):
            r[..., DIM] = np.log(p)
        return model

    def hidden(self, tokens: np.ndarray) -> np.ndarray:
        """Predicted vector, with a one for the biases, of every place but the first CONTEXT ones."""
        n = len(tokens) - CONTEXT
        out = np.ones((n, DIM + 1), np.float32)
        own = self.q * self.c[0]
        np.take(own, tokens[CONTEXT - 1 : CONTEXT - 1 + n], axis=0, out=(h := np.empty((n, DIM), np.float32)), mode="clip")
        more = np.empty_like(h)
        for k in range(2, CONTEXT + 1):
            np.take(np.multiply(self.q, self.c[k - 1], out=own), tokens[CONTEXT - k : CONTEXT - k + n], axis=0, out=more, mode="clip")
            h += more
        out[:, :DIM] = h
        return out


def padded(ids: np.ndarray, size: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Consecutive texts' tokens with CONTEXT start marks before each text, and where the tokens are.

    Context k of the token at place p is what stands at p - k, so contexts are shifts and never
    reach into the text before. size counts the end token.
    """
    text = np.repeat(np.arange(len(size)), size)
    out = np.full(len(ids) + CONTEXT * len(size), start, np.int32)
    at = np.arange(len(ids)) + CONTEXT * (text + 1)
    out[at] = ids
    return out, at


def _groups(target: np.ndarray, side: int, level: int) -> Iterator[tuple[int, int, int]]:
    """Runs of rows that share a prefix of the level; target is sorted."""
    prefix = target // side ** (LEVELS - level)
    cuts = np.concatenate([[0], np.flatnonzero(prefix[1:] != prefix[:-1]) + 1, [len(prefix)]])
    return ((int(prefix[i]), int(i), int(j)) for i, j in zip(cuts, cuts[1:], strict=False) if j > i)


def _by_target(target: np.ndarray, side: int) -> np.ndarray:
    """Stable order by target; short integers are sorted by radix."""
    return np.argsort(target.astype(np.uint16) if side**LEVELS < 1 << 16 else target, kind="stable")


def log_probabilities(model: Model, hidden: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Natural log of the product of the three normalised choices that lead to each target."""
    side, order = model.side, _by_target(target, model.side)
    h, y, at = hidden[order], target[order], np.arange(len(target))
    total = np.zeros(len(y), np.float32)
    s = np.empty((len(y), side), np.float32)
    for level in range(LEVELS):
        for prefix, i, j in _groups(y, side, level):
            np.matmul(h[i:j], model.r[level][prefix].T, out=s[i:j])
        s -= s.max(1, keepdims=True)
        total += s[at, y // side ** (LEVELS - 1 - level) % side]
        np.exp(s, out=s)
        total -= np.log(s.sum(1))
    out = np.empty(len(y))
    out[order] = total
    return out


class _Trainer:
    """Adagrad on batches of one task's positions."""

    def __init__(self, flat: np.ndarray, side: int, noise: np.ndarray, rate: float):
        self.model, self.rate = Model(flat.copy(), side), np.float32(rate)
        self.grad, self.square = Model(np.zeros_like(flat), side), np.full_like(flat, 1e-8)
        self.noise = [(NOISE * p).astype(np.float32) for p in _choices(noise, side)]
        self.log_noise = [np.log(p) for p in self.noise]
        self.seen = 0

    def step(self, tokens: np.ndarray, at: np.ndarray) -> None:
        """One batch: tokens with start marks, and the places that are predicted.

        NCE's loss of each choice takes the noise by its expectation over all outcomes: with noise
        weight k P(o) an outcome's gradient is k P(o) p(o), less 1 - p(o) for the true one, where p
        is the probability of being data.
        """
        m, g = self.model, self.grad
        side, n = m.side, len(at)
        g.flat[:] = 0
        order = _by_target(tokens[at], side)
        place = at[order]
        y, h, rows = tokens[place], m.hidden(tokens)[place - CONTEXT], np.arange(n)
        dh, more, s = np.zeros((n, DIM + 1), np.float32), np.empty((n, DIM + 1), np.float32), np.empty((n, side), np.float32)
        for level in range(LEVELS):
            runs = list(_groups(y, side, level))
            against = m.r[level].copy()
            against[..., DIM] -= self.log_noise[level]
            for prefix, i, j in runs:
                np.matmul(h[i:j], against[prefix].T, out=s[i:j])
            np.clip(s, -30, 30, out=s)
            np.negative(s, out=s)
            np.exp(s, out=s)
            s += 1
            np.reciprocal(s, out=s)
            choice = y // side ** (LEVELS - 1 - level) % side
            true = 1 - s[rows, choice]
            for prefix, i, j in runs:
                s[i:j] *= self.noise[level][prefix]
            s[rows, choice] -= true
            for prefix, i, j in runs:
                np.matmul(s[i:j].T, h[i:j], out=g.r[level][prefix])
                np.matmul(s[i:j], m.r[level][prefix], out=more[i:j])
            dh += more
        # what each place is told by the four that it helped to predict, dimension by dimension
        spread = np.zeros((DIM, len(tokens) + CONTEXT), np.float32)
        spread[:, place] = dh[:, :DIM].T
        for d in range(DIM):
            own = np.zeros(len(tokens), np.float32)
            for k in range(1, CONTEXT + 1):
                own += m.c[k - 1, d] * spread[d, k : k + len(tokens)]
            g.q[:, d] = np.bincount(tokens, weights=own, minlength=len(m.q))
            column = m.q[:, d][tokens]
            g.c[:, d] = [column @ spread[d, k : k + len(tokens)] for k in range(1, CONTEXT + 1)]
        g.flat /= np.float32(n)
        self.square += g.flat**2
        m.flat -= self.rate * g.flat / np.sqrt(self.square)
        self.seen += n


def _numbers(texts, hot: dict[bytes, int]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Words of each text, hot number of every token with the end (0: none), tokens a text."""
    end = hot.get(END.encode(), 0)
    words = [words_of(t) for t in texts]
    size = np.array([len(w) + 1 for w in words], dtype=np.int64)
    stream = chain.from_iterable(chain(map(hot.get, w, repeat(0)), (end,)) for w in words)
    return words, np.fromiter(stream, dtype=np.int64, count=int(size.sum())), size


def _pieces(texts: list, most: int = 2_000_000) -> Iterator[tuple[int, list]]:
    """Runs of texts of a few MB together."""
    lo = total = 0
    for k, t in enumerate(texts):
        total += len(t or "")
        if total > most:
            yield lo, texts[lo : k + 1]
            lo, total = k + 1, 0
    if lo < len(texts):
        yield lo, texts[lo:]


def learn_vocabulary(counts: DataFrame) -> Vocabulary:
    """The commonest words, HOT at most, and the corpus totals.

    How many words have each count tells the count above which at most HOT words lie; those alone
    go to the driver. Words of one count are in or out together; the end of text is always in.
    """
    total, distinct = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
    levels = counts.groupBy("c").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("c")).limit(HOT).toPandas()
    inside = levels[levels["n"].cumsum() <= HOT]
    least = int(inside["c"].min()) if len(inside) else int(total or 0) + 1
    top = counts.filter((F.col("c") >= least) | (F.col("word") == END)).toPandas()
    top = top.sort_values(["c", "word"], ascending=[False, True]).reset_index(drop=True)
    first = top.index[top["word"] == END].tolist()
    if first and first[0] >= LEAST_SIDE**LEVELS - 1:  # the end of text is always in the model's own vocabulary
        order = [first[0], *[k for k in range(len(top)) if k != first[0]]]
        top = top.iloc[order].reset_index(drop=True)
    hot = {w.encode("utf-8", "surrogatepass"): k + 1 for k, w in enumerate(top["word"])}
    return Vocabulary(hot, np.concatenate([[0], top["c"].to_numpy(dtype=np.int64)]), int(total or 0), int(distinct))


def train(docs: DataFrame, vocabulary: Vocabulary, text_col: str, rate: float = 0.1, batch: int = 32_768) -> np.ndarray:
    """One pass over every position of the training texts: each task trains from the same start, models are averaged.

    The average weighs a task by its positions. A task trains on SPLITS input splits, so that fewer
    partial models travel than there are splits. Models are added up in two rounds, FAN_IN at a
    time, in rows of CHUNK floats, so neither a task nor the driver holds more than a few MB of them.
    """
    start = Model.initial(vocabulary).flat
    side, size = vocabulary.side, vocabulary.size
    small = {w: n for w, n in vocabulary.hot.items() if n < size}
    context = docs.sparkSession.sparkContext
    held = context.broadcast((start, small, unigram(vocabulary)))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        flat, known, noise = held.value
        trainer = _Trainer(flat, side, noise, rate)
        for part in parts:
            for _, texts in _pieces(part["text"].tolist()):
                _, ids, sizes = _numbers(texts, known)
                tokens, at = padded(ids, sizes, size)
                for lo in range(0, len(at), batch):
                    some = at[lo : lo + batch]
                    begin = int(some[0]) - CONTEXT
                    trainer.step(tokens[begin : int(some[-1]) + 1], some - begin)
        if trainer.seen:
            out = trainer.model.flat * np.float32(trainer.seen)
            rows = [(k, out[k * CHUNK : (k + 1) * CHUNK].tobytes()) for k in range(-(-len(out) // CHUNK))]
            yield pd.DataFrame({"part": TaskContext.get().partitionId(), "chunk": [r[0] for r in rows], "seen": float(trainer.seen), "sums": [r[1] for r in rows]})

    def add(part: pd.DataFrame) -> pd.DataFrame:
        sums = np.sum([np.frombuffer(b, np.float32) for b in part["sums"]], axis=0, dtype=np.float64).astype(np.float32)
        return pd.DataFrame({"part": [int(part["part"].iloc[0]) // FAN_IN], "chunk": [part["chunk"].iloc[0]], "seen": [part["seen"].sum()], "sums": [sums.tobytes()]})

    kind = "part int, chunk int, seen double, sums binary"
    texts = docs.select(F.col(text_col).alias("text"))
    splits = texts.rdd.getNumPartitions()  # of the plan; nothing runs
    texts = texts.coalesce(max(min(splits, context.defaultParallelism), splits // SPLITS, 1))
    parts = texts.mapInPandas(run, kind)
    parts = parts.groupBy((F.col("part") / FAN_IN).cast("int").alias("_p"), "chunk").applyInPandas(add, kind)
    summed = parts.groupBy("chunk").applyInPandas(add, kind).toPandas().sort_values("chunk")
    if not len(summed):
        return start
    return np.concatenate([np.frombuffer(b, np.float32) / np.float32(n) for b, n in zip(summed["sums"], summed["seen"], strict=True)])


_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_hot", pa.int64()), ("base_hot", pa.float64()), ("model_part", pa.float64()), ("rare", pa.list_(pa.string())), ("times", pa.list_(pa.int64()))])


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5) -> DataFrame:
    """Log10 probability of every whole text under the model and under the smoothed unigram base.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. Learns from the
    rows whose crc32(id) mod ``folds`` is not 1. Corpus counts cover all of their tokens and the
    training passes over every position of their texts. A word outside the model's
    vocabulary has the probability of the unknown word in its context times its smoothed share of
    such words, with one place for all unseen words, so probabilities of all words sum to one.

    The counts of the HOT commonest words travel to the tasks; other words of a document are joined
    with the counts, one row for each distinct word. Null and empty texts are the end token alone;
    repeated rows are scored each; a null id is not held out; an empty
    table gives no rows. Other columns are ignored.
    """
    held_out = F.coalesce(fold(F.col(id_col), folds) == 1, F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out.alias("held_out"), F.col(text_col).alias("text"))
    learn = rows.filter(~F.col("held_out"))
    counts = materialise(count_words(learn, "text"), "lm-counts")
    vocabulary = learn_vocabulary(counts)
    flat = train(learn, vocabulary, "text")
    held = docs.sparkSession.sparkContext.broadcast((vocabulary, flat))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, flat = held.value
        model, size_ = Model(flat, known.side), known.size
        base = np.log10((known.counts + 0.5) / known.base_norm)
        rare = np.log10((known.counts + 0.5) / known.rare_norm)
        rare[:size_] = 0.0
        for part in parts:
            ids_col, out_col = part.column("doc_id"), part.column("held_out")
            for lo, texts in _pieces(part.column("text").to_pylist()):
                words, ids, size = _numbers(texts, known.hot)
                tokens, at = padded(np.where(ids < size_, ids, UNKNOWN), size, size_)
                logs = np.empty(len(at))
                for k in range(0, len(at), 65_536):
                    some = at[k : k + 65_536]
                    begin = int(some[0]) - CONTEXT
                    h = model.hidden(tokens[begin : int(some[-1]) + 1])
                    logs[k : k + 65_536] = log_probabilities(model, h[some - begin - CONTEXT], tokens[some])
                logs = logs / np.log(10) + rare[ids]
                first = np.cumsum(size) - size
                hot = ids > 0
                names, times, lengths = [], [], []
                missing = np.flatnonzero(~hot)
                cut = np.searchsorted(missing, np.append(first, len(ids)))
                for k, w in enumerate(words):
                    own = Counter(w[i] for i in (missing[cut[k] : cut[k + 1]] - first[k]).tolist() if i < len(w))
                    names += [x.decode("utf-8", "replace") for x in own]
                    times += own.values()
                    lengths.append(len(own))
                offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        ids_col.slice(lo, len(texts)),
                        out_col.slice(lo, len(texts)),
                        pa.array(size),
                        pa.array(np.add.reduceat(hot, first).astype(np.int64)),
                        pa.array(np.add.reduceat(np.where(hot, base[ids], 0.0), first)),
                        pa.array(np.add.reduceat(logs, first)),
                        pa.ListArray.from_arrays(offsets, pa.array(names, pa.string())),
                        pa.ListArray.from_arrays(offsets, pa.array(times, pa.int64())),
                    ],
                    schema=_OUT,
                )

    kind = "doc_id long, held_out boolean, n_tokens long, n_hot long, base_hot double, model_part double, rare array<string>, times array<long>"
    scored = materialise(rows.mapInArrow(run, kind).withColumn("_row", F.monotonically_increasing_id()), "lm-scored")
    pairs = scored.select("_row", F.explode(F.arrays_zip("rare", "times")).alias("p")).select("_row", F.col("p.rare").alias("word"), F.col("p.times").alias("n"))
    c = F.coalesce("c", F.lit(0))
    rest = pairs.join(counts, "word", "left").groupBy("_row").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("known"),
        F.sum(F.col("n") * F.log10((c + 0.5) / F.lit(vocabulary.base_norm))).alias("base"),
        F.sum(F.col("n") * F.log10((c + 0.5) / F.lit(vocabulary.rare_norm))).alias("part"),
    )
    return scored.drop("rare", "times").join(rest, "_row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_hot") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(vocabulary.total).cast("long").alias("train_tokens"),
        (F.col("base_hot") + F.coalesce("base", F.lit(0.0))).alias("base_score"),
        (F.col("model_part") + F.coalesce("part", F.lit(0.0))).alias("score"),
    )
