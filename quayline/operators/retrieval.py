"""Chunking, keyword and vector scoring, hybrid merge, decay and diversity re-ranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quayline.functions import numeric, text as texts
from quayline.operators.markup import trimmed


def paragraphs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Blank-line separated paragraphs with 1-based line numbers: id, start_line, end_line, content."""
    lines = docs.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("no", "line"))
    order = Window.partitionBy(id_col).orderBy("no")
    blank = trimmed(F.col("line")) == ""
    grouped = lines.withColumn("grp", F.sum(blank.cast("int")).over(order)).filter(~blank)
    out = grouped.groupBy(id_col, "grp").agg(F.min("no").alias("a"), F.max("no").alias("b"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "line"))), lambda s: s["line"]), "\n").alias("content"))
    return out.select(id_col, (F.col("a") + 1).alias("start_line"), (F.col("b") + 1).alias("end_line"), trimmed(F.col("content")).alias("content"))


def chunks(docs: DataFrame, id_col: str, text_col: str, tokens: int = 400, overlap: int = 80, keep: tuple[str, ...] = (), bare: bool = False) -> DataFrame:
    """Greedy chunks of whole paragraphs: id, the columns ``keep``, chunk, start_line, end_line, content, content_hash.

    A chunk takes paragraphs while they fit in ``tokens`` x 3.5 characters and at least one; the next
    one begins with the trailing paragraphs that fit in the overlap, but never with all of them.
    ``bare`` gives a text without chunks one row with nulls.
    """
    budget, carry = int(tokens * 3.5), int(overlap * 3.5)

    def cut(text: str) -> Iterator[tuple[int, int, str]]:
        parts, at, held = [], 0, []
        for no, line in enumerate([*text.split("\n"), ""], 1):
            if line.strip():
                held.append(line)
            elif held:
                parts.append((no - len(held), no - 1, "\n".join(held).strip()))
                held = []
        while at < len(parts):
            end, size = at, 0
            while end < len(parts) and (end == at or size + len(parts[end][2]) + 2 <= budget):
                size += len(parts[end][2]) + 2
                end += 1
            yield parts[at][0], parts[end - 1][1], "\n\n".join(p[2] for p in parts[at:end])
            if end == len(parts):
                return
            back, size = end, 0
            while back - 1 > at and size + len(parts[back - 1][2]) + 2 <= carry:
                back -= 1
                size += len(parts[back][2]) + 2
            at = back

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for *own, t in batch[[id_col, *keep, text_col]].itertuples(index=False):
                cuts = [(*own, k, *c) for k, c in enumerate(cut(t))] if t else []
                rows += cuts or [(*own, None, None, None, None)] * bare
            out = pd.DataFrame(rows, columns=[id_col, *keep, "chunk", "start_line", "end_line", "content"])
            yield out.astype({c: "Int32" for c in ("chunk", "start_line", "end_line")})

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in (id_col, *keep))
    out = docs.select(id_col, *keep, text_col).mapInPandas(run, f"{kinds}, chunk int, start_line int, end_line int, content string")
    return out.withColumn("content_hash", F.sha2("content", 256))


def vector_scores(items: DataFrame, query_vector: list[float], vector_col: str = "embedding") -> DataFrame:
    """items with ``vector_score``, their cosine with one query vector."""
    q = F.array(*[F.lit(float(x)) for x in query_vector])
    return items.withColumn("vector_score", numeric.cosine(F.col(vector_col), q))


WORD = r"[\p{L}\p{N}_]"


def keyword_matches(items: DataFrame, words: list[str], text_col: str = "text") -> DataFrame:
    """The items that hold every word, with BM25 in ``bm25`` (k1 1.2, b 0.75).

    Words are counted where they stand, without splitting texts; only texts that contain every word
    as a substring are looked at a second time.
    """
    low, names = F.lower(text_col), [w.lower() for w in words]
    length = F.regexp_count(low, F.lit(WORD + "+"))
    often = [F.when(low.contains(n), F.regexp_count(low, F.lit(rf"(?<!{WORD})\Q{n}\E(?!{WORD})"))).otherwise(0) for n in names]
    seen = items.select(length.alias("n"), *[(c > 0).alias(f"w{k}") for k, c in enumerate(often)])
    totals = seen.agg(F.count(F.lit(1)).alias("_n"), F.avg("n").alias("_avg"), *[F.count_if(f"w{k}").alias(f"_df{k}") for k in range(len(names))])
    held = items
    for n in names:
        held = held.filter(low.contains(n))
    held = held.withColumns({"_len": length, **{f"_tf{k}": c for k, c in enumerate(often)}}).crossJoin(F.broadcast(totals))  # one row of totals
    score, hit = F.lit(0.0), F.lit(True)
    for k in range(len(names)):
        tf, df = F.col(f"_tf{k}"), F.col(f"_df{k}")
        hit = hit & (tf > 0)
        idf = F.log((F.col("_n") - df + 0.5) / (df + 0.5) + 1)
        score = score + idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * F.col("_len") / F.col("_avg")))
    drop = ["_len", "_n", "_avg", *[f"_{c}{k}" for c in ("tf", "df") for k in range(len(names))]]
    return held.filter(hit).withColumn("bm25", score).drop(*drop)


def best_keywords(items: DataFrame, words: list[str], key: str, most: int, text_col: str = "text") -> DataFrame:
    """The ``most`` best matches by BM25, ties to the smaller key: key, bm25, keyword_score (1 for every match)."""
    hits = keyword_matches(items.select(key, text_col), words, text_col).orderBy(F.desc("bm25"), key).limit(most)
    return hits.select(key, "bm25", F.lit(1.0).alias("keyword_score"))


def hybrid(vector: DataFrame, keyword: DataFrame, key: str, weights: tuple[float, float] = (0.7, 0.3), least: float = 0.1) -> DataFrame:
    """key, score, found_by: weighted sum of both scores, where it reaches ``least``.

    Where one search found nothing the other has the whole weight. The candidates are few: both
    searches are cut to a number.
    """
    a, b = weights if sum(weights) > 0 else (0.7, 0.3)
    merged = vector.select(key, "vector_score").join(keyword.select(key, "keyword_score"), key, "full_outer")
    every = Window.partitionBy()
    ran = lambda c, w: F.when(F.count(c).over(every) > 0, F.lit(float(w))).otherwise(0.0)
    merged = merged.withColumns({"_a": ran("vector_score", a), "_b": ran("keyword_score", b)}).fillna(0.0, ["vector_score", "keyword_score"])
    label = F.when((F.col("vector_score") > 0) & (F.col("keyword_score") > 0), "both").when(F.col("vector_score") > 0, "vector").otherwise("keyword")
    score = (F.col("vector_score") * F.col("_a") + F.col("keyword_score") * F.col("_b")) / (F.col("_a") + F.col("_b"))
    return merged.select(key, score.alias("score"), label.alias("found_by")).filter(F.col("score") >= least)


def rerank_mmr(hits: DataFrame, group: str, key: str, score: str, text: str, k: int = 6, weight: float = 0.7) -> DataFrame:
    """Greedy maximal marginal relevance over each query's few candidates: group, key, rank.

    Relevance is the score scaled to 0..1 within the query (all equal: 1); similarity is the Jaccard
    of word sets; ties go to the higher score, then to the smaller key. A group is one query's
    candidates, which the search has already cut to a small number.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values([score, key], ascending=[False, True])
        s = part[score].to_numpy(dtype=float)
        relevance = (s - s.min()) / (s.max() - s.min()) if s.max() > s.min() else np.ones(len(s))
        words = [set(w) for w in part["_words"]]
        left, chosen = list(range(len(s))), []
        while left and len(chosen) < k:
            def value(i: int) -> float:
                near = max((len(words[i] & words[j]) / len(words[i] | words[j]) if words[i] | words[j] else 1.0 for j in chosen), default=0.0)
                return weight * relevance[i] - (1 - weight) * near
            best = max(left, key=lambda i: (value(i), s[i], -i))
            chosen.append(best)
            left.remove(best)
        return pd.DataFrame({group: part[group].iloc[chosen], key: part[key].iloc[chosen], "rank": range(1, len(chosen) + 1)})

    kinds = {c: hits.schema[c].dataType.simpleString() for c in (group, key)}
    return hits.select(group, key, score, texts.word_set(text).alias("_words")).groupBy(group).applyInPandas(run, f"{group} {kinds[group]}, {key} {kinds[key]}, rank int")
