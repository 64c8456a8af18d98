"""Importance resampling towards a target text, by word tries that carry CRC states."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayline.operators.scans import ranked
from quayline.storage import materialise

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BUCKETS, RUN, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
PIECE = 1 << 12  # words that a trie takes in before it may be emptied
NODES = 1 << 18  # of a trie before it is emptied into its totals: bounds a task's memory, not what it counts
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: str | None) -> list[str]:
    """Words of a text in lower case (A to Z only)."""
    return WORD.findall(text.translate(_LOWER)) if text else []


class Node(dict):
    """A run of words: its children by the next word, the CRC state of its bytes, its count or its gain."""

    __slots__ = ("crc", "count", "gain", "trie")

    def __init__(self, trie: Trie, crc: int | None):
        self.trie, self.crc, self.count, self.gain = trie, crc, 0, None

    def __missing__(self, word: str) -> Node:
        more = word.encode("utf-8", "surrogatepass")
        child = self[word] = Node(self.trie, zlib.crc32(more) if self.crc is None else zlib.crc32(b" " + more, self.crc))
        self.trie.nodes.append(child)
        return child


class Trie:
    """The runs that a task has met. A child goes on from its parent's CRC state, so no run is hashed from its start."""

    def __init__(self, run: int, emptied: Callable[[list[Node]], None] = lambda nodes: None):
        self.run, self.emptied = run, emptied
        self.clear()

    def clear(self) -> None:
        self.nodes: list[Node] = []
        self.root = Node(self, None)

    def empty(self) -> None:
        """Hand over all nodes and begin anew."""
        self.emptied(self.nodes)
        self.clear()

    def walk(self, ws: list[str]) -> Iterator[Node]:
        """The node of every run of 1 to ``run`` words.

        A full trie is emptied between pieces of the text alone, and every piece begins at the new root: no node that
        was handed over is met again.
        """
        for i in range(0, len(ws), PIECE):
            if len(self.nodes) > NODES:
                self.empty()
            if self.run == 1:
                yield from map(self.root.__getitem__, ws[i : i + PIECE])
                continue
            paths: list[Node] = []
            for k in range(max(0, i - self.run + 1), min(i + PIECE, len(ws))):
                w = ws[k]
                paths = [self.root[w], *(p[w] for p in paths[: self.run - 1])]
                if k >= i:
                    yield from paths


def _count(batches: Iterator[pd.DataFrame], run: int, buckets: int) -> Iterator[pd.DataFrame]:
    """Totals by bucket of one task's texts."""
    totals = np.zeros(buckets, np.int64)

    def add(nodes: list[Node]) -> None:
        at = np.fromiter((n.crc % buckets for n in nodes), np.int64, len(nodes))
        np.add.at(totals, at, np.fromiter((n.count for n in nodes), np.int64, len(nodes)))

    trie = Trie(run, add)
    for batch in batches:
        for text in batch["text"]:
            for node in trie.walk(words(text)):
                node.count += 1
    trie.empty()
    met = np.flatnonzero(totals)
    yield pd.DataFrame({"bucket": met, "n": totals[met]})


def bucket_totals(texts: DataFrame, run: int = RUN, buckets: int = BUCKETS) -> DataFrame:
    """How many features of all texts (column text) fall in each bucket: bucket, n. A task sends at most one row a bucket."""
    counted = texts.select("text").mapInPandas(partial(_count, run=run, buckets=buckets), "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """A bucket's gain: floor of 1000 times the log ratio of its smoothed shares: bucket, gain; buckets without features too."""
    spark = source.sparkSession
    s, t = source.select("bucket", F.col("n").alias("s")), target.select("bucket", F.col("n").alias("t"))
    both = spark.range(buckets).withColumnRenamed("id", "bucket").join(s, "bucket", "left").join(t, "bucket", "left").fillna(0)
    sums = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    d = lambda name, more: F.col(name).cast("double") + F.lit(float(more))
    ratio = (d("t", 1) * d("all_s", buckets)) / (d("s", 1) * d("all_t", buckets))
    return both.crossJoin(sums).select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("gain"))


def _score(batches: Iterator[pd.DataFrame], run: int, gains: np.ndarray) -> Iterator[pd.DataFrame]:
    """Words, features and weight of each text; a node looks its gain up once."""
    trie, table = Trie(run), gains.tolist()
    for batch in batches:
        out = []
        for text in batch["text"]:
            ws, n, weight = words(text), 0, 0
            for n, node in enumerate(trie.walk(ws), 1):
                if node.gain is None:
                    node.gain = table[node.crc % len(table)]
                weight += node.gain
            out.append((len(ws), n, weight))
        yield batch.drop(columns="text").assign(**dict(zip(("n_words", "n_features", "weight"), np.array(out, np.int64).reshape(-1, 3).T)))


def _noise(key: Column, seed: int) -> Column:
    """Gumbel noise of an id in thousandths, from the first 32 bits of its SHA-256."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(
    docs: DataFrame,
    target: DataFrame,
    run: int = RUN,
    buckets: int = BUCKETS,
    least_words: int = LEAST_WORDS,
    percent: int = PERCENT,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Every document's importance for the target texts, and the rank of those drawn.

    Returns doc_id, n_features, weight, score, rank. Features are all runs of 1 to ``run`` words;
    each falls in the bucket of its CRC-32. A bucket's gain compares its share in the target with
    that in all documents; a text's weight sums its features' gains, its score adds Gumbel noise of
    its id, and the highest ``percent`` of 100 scores of texts with ``least_words`` words are drawn.

    Two passes over the texts, each in tasks that hold one trie; between them one row a task and
    bucket travels, after them numbers alone. Ranks come from range partitions of the rows near
    the top, whose share is checked: no window over all rows.

    Null and empty texts have no words (weight 0); a null id has the noise of an empty one; ties
    go to the smaller id (null first), then to fewer features. Repeated rows are rows of their own:
    each counts and is drawn for itself. An empty target gives all features the same share. Empty
    tables give no rows. Other columns are ignored.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    own = materialise(bucket_totals(texts, run, buckets), "importance-source")  # read twice below: the texts are counted once
    aim = materialise(bucket_totals(target.select(F.col(text_col).alias("text")), run, buckets), "importance-target")
    gained = bucket_gains(own, aim, buckets).toPandas()
    gains = np.zeros(buckets, np.int64)
    gains[gained["bucket"].to_numpy()] = gained["gain"].to_numpy()

    kind = texts.schema["doc_id"].dataType.simpleString()
    scored = texts.mapInPandas(partial(_score, run=run, gains=gains), f"doc_id {kind}, n_words long, n_features long, weight long")
    scored = materialise(scored.withColumn("score", F.col("weight") + _noise(F.col("doc_id"), seed)), "importance-scored")
    return _drawn(scored, least_words, percent)


def _drawn(scored: DataFrame, least_words: int, percent: int) -> DataFrame:
    """Rank the highest scores of the eligible rows; a bound that surely lies below them keeps the rest out of the sort."""
    long_enough = F.col("n_words") >= least_words
    n, bound = scored.filter(long_enough).agg(F.count(F.lit(1)), F.percentile_approx("score", F.lit(max(0.0, 1 - 1.1 * percent / 100)), F.lit(10_000))).first()
    draw = percent * n // 100
    if bound is None or scored.filter(long_enough & (F.col("score") >= bound)).count() < draw:
        bound = -(1 << 63)  # the estimate was too high: sort them all
    near = long_enough & (F.col("score") >= F.lit(bound))
    cols = ("doc_id", "n_features", "weight", "score")
    top = ranked(scored.filter(near).select(*cols), [F.desc("score"), F.asc("doc_id"), F.asc("n_features")], "_rank", "importance-top")
    top = top.select(*cols, F.when(F.col("_rank") <= draw, F.col("_rank")).alias("rank"))
    return scored.filter(~near).select(*cols, F.lit(None).cast("long").alias("rank")).unionByName(top)


ORACLE_SQL = r"""
WITH crc_table AS (
  SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS crcs
  FROM (SELECT unnest(range(256)) AS b)),
words AS (
  SELECT d.row_no, unnest(regexp_extract_all(translate(d.text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
  FROM (SELECT row_number() OVER () AS row_no, text FROM documents) d),
aims AS (
  SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
  FROM benchmark),
vocabulary AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(octet_length(encode(word))), lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::BIGINT)),
                   lambda c, b: xor(crcs[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 10000 AS bucket
  FROM (SELECT word FROM words UNION SELECT word FROM aims), crc_table),
s AS (SELECT bucket, count(*) AS s FROM words JOIN vocabulary USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM aims JOIN vocabulary USING (word) GROUP BY bucket),
gains AS (
  SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * ((SELECT sum(s) FROM s) + 10000)::DOUBLE)
                                 / ((coalesce(s, 0) + 1)::DOUBLE * (coalesce((SELECT sum(t) FROM t), 0) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM (SELECT unnest(range(10000)) AS bucket) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
weights AS (
  SELECT row_no, count(*) AS n_features, sum(gain)::BIGINT AS weight
  FROM words JOIN vocabulary USING (word) JOIN gains USING (bucket) GROUP BY row_no),
scored AS (
  SELECT doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT)::BIGINT AS score
  FROM (SELECT row_number() OVER () AS row_no, doc_id FROM documents) LEFT JOIN weights USING (row_no)),
ranks AS (
  SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS FIRST, n_features) END AS r
  FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= (SELECT 10 * count(*) // 100 FROM scored WHERE n_features >= 20) THEN r END AS rank
FROM ranks
"""
