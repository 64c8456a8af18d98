"""Nearest neighbours by inner product: a forest of random-projection trees and exact reranking."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quayline.storage import materialise

TREES = 4
LEAF = 64  # trees grow until a leaf holds about so many vectors, or SPLIT of the sample
DEEPEST, SPLIT = 14, 4
SAMPLE, SAMPLE_BYTES = 20_000, 32 << 20  # bounds of the vectors the trees are fitted on, which travel to the tasks
TRIALS = 256  # sample queries that set the leaf budget
RECALL = 0.95  # recall that the budget has to reach on the sample
LEAST = 16  # a query goes on opening leaves until it meets so many times k + 1 vectors
ROWS_PER_BLOCK, QUERIES_PER_CHUNK = 8192, 16_384


@dataclass
class Forest:
    """Trees as heaps of hyperplanes over vectors lengthened to one norm; leaves to open per query."""

    normals: np.ndarray  # (TREES, nodes, dim + 1)
    cuts: np.ndarray  # (TREES, nodes)
    norm2: float
    depth: int
    leaves: int = 0  # to open for a query
    least: int = 0  # vectors of the sample that the opened leaves must hold

    def lengthened(self, x: np.ndarray) -> np.ndarray:
        """One more component makes all norms equal, so the largest inner product is the nearest point."""
        rest = np.sqrt(np.maximum(self.norm2 - (x * x).sum(1), 0.0))
        return np.concatenate([x, rest[:, None]], 1)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """(rows, TREES) leaf of each vector."""
        x = self.lengthened(x)
        out = np.zeros((len(x), TREES), np.int64)
        for t in range(TREES):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                right = np.einsum("ij,ij->i", x, self.normals[t, node]) > self.cuts[t, node]
                node = 2 * node + 1 + right
            out[:, t] = node - ((1 << self.depth) - 1)
        return out

    def ranks(self, q: np.ndarray) -> np.ndarray:
        """(queries, TREES, leaves) place of each leaf in the query's order of opening.

        All trees share one queue. A node's priority falls by the squared distance to each hyperplane
        crossed on the way to it, so along a path priorities only fall and the queue pops the leaves
        in the order of their own priorities.
        """
        q = np.concatenate([q, np.zeros((len(q), 1))], 1)
        ranks = []
        for t in range(TREES):
            margin = q @ self.normals[t].T - self.cuts[t]
            p = np.zeros((len(q), 1))
            for level in range(self.depth):
                a = (1 << level) - 1
                m = margin[:, a : a + (1 << level)]
                p = np.stack([p - np.maximum(m, 0) ** 2, p - np.maximum(-m, 0) ** 2], 2).reshape(len(q), -1)
            ranks.append(p)
        p = np.stack(ranks, 1).reshape(len(q), -1)
        out = np.empty(p.shape, np.int32)
        np.put_along_axis(out, np.argsort(-p, axis=1, kind="stable"), np.arange(p.shape[1], dtype=np.int32)[None], 1)
        return out.reshape(len(q), TREES, -1)

    def opened(self, q: np.ndarray) -> np.ndarray:
        """(queries, TREES, leaves) which leaves the budget opens: the first ``leaves`` of the order."""
        return self.ranks(q) < self.leaves


def reached(ranks: np.ndarray, leaf: np.ndarray) -> np.ndarray:
    """(queries, rows) place in the order of opening at which a query first meets each row."""
    out = ranks[:, 0][:, leaf[:, 0]]
    for t in range(1, TREES):
        np.minimum(out, ranks[:, t][:, leaf[:, t]], out=out)
    return out


def fit_forest(sample: np.ndarray, norm2: float, total: int, k: int, seed: int = 11) -> Forest:
    """Random hyperplanes cut at the sample's medians; the leaf budget is measured on the sample.

    The depth grows with the logarithm of the table's rows.
    """
    rng = np.random.default_rng(seed)
    depth = max(2, min(DEEPEST, math.ceil(math.log2(max(total, 1) / LEAF)) if total > LEAF else 2, int(math.log2(max(len(sample) / SPLIT, 4)))))
    nodes = (1 << depth) - 1
    forest = Forest(np.zeros((TREES, nodes, sample.shape[1] + 1)), np.zeros((TREES, nodes)), norm2, depth, TREES << depth)
    x = forest.lengthened(sample)
    for t in range(TREES):
        at = np.zeros(len(x), np.int64)
        for node in range(nodes):
            own = np.flatnonzero(at == node)
            normal = rng.normal(size=x.shape[1])
            normal /= np.linalg.norm(normal)
            place = x[own] @ normal
            forest.normals[t, node] = normal
            forest.cuts[t, node] = np.median(place) if len(own) else 0.0
            at[own] = 2 * node + 1 + (place > forest.cuts[t, node])
    forest.least = min(LEAST * (k + 1), total)
    k = min(k, len(sample) - 1)
    if not k:
        return forest
    trial = np.linspace(0, len(sample) - 1, min(TRIALS, len(sample))).astype(int)
    score = sample[trial] @ sample.T
    score[np.arange(len(trial)), trial] = -np.inf  # finding itself is no success
    nearest = np.argpartition(-score, k - 1, axis=1)[:, :k]
    place = np.take_along_axis(reached(forest.ranks(sample[trial]), forest.assign(sample)), nearest, 1)
    for share in np.arange(0.02, 1.01, 0.02):
        forest.leaves = max(TREES, int(share * (TREES << depth)))
        if (place < forest.leaves).mean() >= RECALL:
            break
    return forest


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column]) if len(column) else np.zeros((0, 1))


def nearest_neighbours(vectors: DataFrame, queries: DataFrame | None = None, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest found for each query, by largest inner product: query_id, rank, vec_id, score.

    ``queries`` (default: the rows whose id is divisible by 20) are rows like those of ``vectors``;
    a query's own id is no candidate. Equal vectors are searched once: only the k + 1 smallest ids of
    a vector can be among the k nearest, ties going to the smaller id, so that loses nothing and a
    vector that a third of all rows hold is one row of the index.

    The forest is fitted on at most SAMPLE vectors (SAMPLE_BYTES of them), chosen by hash; every
    vector is indexed. On the sample, the number of leaves that a query opens is raised until RECALL
    of the true neighbours is found. A query whose leaves hold fewer than LEAST x (k + 1) vectors of
    the sample opens more, so it never has too few candidates. All answers come out of opened leaves,
    at every size. Neighbouring leaves make blocks of about ROWS_PER_BLOCK vectors; a block's vectors
    meet the queries that open any of its leaves, at most about QUERIES_PER_CHUNK at a time, and the
    products at least as large as the query's k + 1 best among the sample's vectors in its opened
    leaves go on to the merge. What is best there is multiplied out once more on the original
    vectors, in the order of the components, so equal vectors score alike and ties are exact.

    Vectors that are null, zero, of another length than most, or hold null, NaN or infinite
    components take no part, as queries either; rows without id neither. Repeated rows of one id
    are one candidate and one query; of several vectors of one id the smallest counts. With fewer
    than k candidates all are returned; empty tables give no rows. Other columns are ignored.
    """
    floats = F.col("v").cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    nonzero = F.exists("v", lambda x: x != 0.0)

    def valid(df: DataFrame) -> DataFrame:
        return df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).dropna().withColumn("v", floats).filter(finite & nonzero)

    rows = valid(vectors)
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    length = length[0]["n"] if length else 0
    of_length = F.size("v") == length

    def by_id(df: DataFrame) -> DataFrame:
        return df.filter(of_length).groupBy("id").agg(F.min("v").alias("v"))

    asked = by_id(valid(vectors.filter(F.col(id_col) % 20 == 0) if queries is None else queries))
    same = Window.partitionBy("v").orderBy("id")
    few = by_id(rows).withColumn("_n", F.row_number().over(same)).filter(F.col("_n") <= k + 1)
    index = materialise(few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("rep"), "ids", "v"), "ann-index")
    first = asked.groupBy("v").agg(F.min("id").alias("q"))
    members = materialise(asked.join(first, "v").select("id", "q", "v"), "ann-queries")
    total, asked_total, norm2 = index.count(), members.select("q").distinct().count(), index.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()[0]
    out = "q long, rep long, score double"
    if not total or not asked_total:
        return members.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("q").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    wanted = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * length)))
    spread = F.pmod(F.xxhash64("rep"), F.lit(1 << 40))
    sample = index.filter(spread < int(min(1.0, 1.2 * (wanted + 50) / total) * (1 << 40))).select("v", spread.alias("h"), "rep").toPandas().sort_values(["h", "rep"])
    points = _matrix(sample["v"].iloc[:wanted])
    forest = fit_forest(points, float(norm2), total, k)
    held = vectors.sparkSession.sparkContext.broadcast((forest, points))
    bits = min(forest.depth, max(0, math.ceil(math.log2(total / ROWS_PER_BLOCK))))  # blocks of leaves
    shift, width = forest.depth - bits, 1 << (forest.depth - bits)
    row_chunks = max(1, math.ceil(total / (1 << bits) / (4 * ROWS_PER_BLOCK)))  # where the trees are not deep enough
    query_chunks = max(1, math.ceil(asked_total / QUERIES_PER_CHUNK))

    def dealt(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest = held.value[0]
        for part in parts:
            leaf = forest.assign(_matrix(part["v"]))
            for t in range(TREES):
                yield pd.DataFrame({"tree": t, "block": leaf[:, t] >> shift, "leaf": leaf[:, t], "rep": part["rep"], "v": part["v"]})

    def opened(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Per query, a row for each block that it opens."""
        forest, points = held.value
        own = forest.assign(points)
        least = min(max(forest.least, 1), len(points))
        for part in parts:
            for lo in range(0, len(part), 256):
                some = part.iloc[lo : lo + 256]
                q = _matrix(some["v"])
                ranks = forest.ranks(q)
                place = reached(ranks, own)
                budget = np.maximum(forest.leaves, np.partition(place, least - 1, axis=1)[:, least - 1] + 1)
                floor = np.full(len(q), -np.inf)
                if len(points) > k:
                    near = np.where(place < budget[:, None], q @ points.T, -np.inf)
                    # products of other chunks may differ in the last bits
                    floor = -np.partition(-near, k, axis=1)[:, k] - 1e-9 * np.sqrt(forest.norm2 * (q * q).sum(1))
                leaves = (ranks < budget[:, None, None]).reshape(len(q), TREES, -1, width)
                at, tree, block = np.nonzero(leaves.any(3))
                yield pd.DataFrame({"q": some["q"].to_numpy()[at], "tree": tree, "block": block, "v": some["v"].to_numpy()[at], "floor": floor[at], "leaves": [np.flatnonzero(m).astype(np.int32) for m in leaves[at, tree, block]]})

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"q": np.zeros(0, np.int64), "rep": np.zeros(0, np.int64), "score": np.zeros(0)})
        x, leaf, reps = _matrix(left["v"]), left["leaf"].to_numpy() % width, left["rep"].to_numpy()
        frames = []
        for lo in range(0, len(right), 256):
            some = right.iloc[lo : lo + 256]
            mask = np.zeros((len(some), width), bool)
            for i, own in enumerate(some["leaves"]):
                mask[i, own] = True
            s = np.where(mask[:, leaf], _matrix(some["v"]) @ x.T, -np.inf)
            floor = some["floor"].to_numpy()
            if s.shape[1] > k + 1:
                floor = np.maximum(floor, -np.partition(-s, k, axis=1)[:, k])
            i, j = np.nonzero((s >= floor[:, None]) & (s > -np.inf))
            frames.append(pd.DataFrame({"q": some["q"].to_numpy()[i], "rep": reps[j], "score": s[i, j]}))
        return pd.concat(frames)

    distinct = first.select("q", "v")
    plan = materialise(distinct.mapInPandas(opened, "q long, tree int, block int, v array<double>, floor double, leaves array<int>"), "ann-plan")
    left = index.select("rep", "v").mapInPandas(dealt, "tree int, block int, leaf int, rep long, v array<double>")
    left = left.withColumn("ic", F.pmod(F.xxhash64("rep"), F.lit(row_chunks))).withColumn("qc", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(query_chunks - 1).cast("long"))))
    right = plan.withColumn("qc", F.pmod(F.xxhash64("q"), F.lit(query_chunks))).withColumn("ic", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(row_chunks - 1).cast("long"))))
    keys = ["tree", "block", "ic", "qc"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, out)
    found = found.groupBy("q", "rep").agg(F.max("score").alias("score"))
    best_first = Window.partitionBy("q").orderBy(F.desc("score"), "rep")
    found = found.withColumn("_n", F.row_number().over(best_first))
    # products of other block shapes may differ in the last bits: what lies that near the last place stays for the exact ones
    last = F.max(F.when(F.col("_n") == k + 1, F.col("score"))).over(Window.partitionBy("q"))
    found = found.withColumn("last", last).filter(F.col("last").isNull() | (F.col("score") >= F.col("last") - 1e-9 * float(norm2)))
    own = members.select("q", "v").dropDuplicates(["q"])
    found = found.join(index.select("rep", "ids", F.col("v").alias("w")), "rep").join(own, "q")
    exact = F.aggregate(F.zip_with("v", "w", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    best = found.select("q", exact.alias("score"), F.explode("ids").alias("vec_id")).withColumn("_n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).filter(F.col("_n") <= k + 1)
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    answer = members.select(F.col("id").alias("query_id"), "q").join(best.drop("_n"), "q").filter("vec_id != query_id").withColumn("rank", F.row_number().over(ranked))
    return answer.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
