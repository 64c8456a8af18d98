"""Substring dedup: hashes of line pieces, grouped over the corpus; the earliest occurrence stays."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayline.llm import bitfilter
from quayline.storage import materialise

TOKEN = re.compile(r"\w+|[.!?\n]")
APART = re.compile(f"({TOKEN.pattern})")  # splits a text into what stands between tokens and the tokens, in turn
LONG = 16  # pieces of more words between marks are cut further, at words chosen by their hashes
REACH = 8  # of any so many consecutive words of a long piece, one ends a piece
MIN_WORDS = 8  # shorter runs of repeated pieces within a line stay; repeated lines go at any length
FILTER_BITS = 1 << 26  # 8 MB
BATCH_CHARS = 4_000_000
_MARK, _LINE = 1, 2
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(0xD1B54A32D192ED03)


class _Tokens(dict):
    """Hash and flags of each token seen by this worker; emptied when it has grown large."""

    def __missing__(self, token: str) -> int:
        if len(self) > 500_000:
            self.clear()
        flags = 0 if token not in ".!?\n" else _LINE if token == "\n" else _MARK
        value = self[token] = xxhash.xxh3_64_intdigest(token.lower()) & ~7 | flags
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _winnowed(codes: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Words after which a long piece is cut: the last smallest hash of every REACH consecutive words of it.

    The choice rests on words of the piece within reach alone, so a passage is cut alike wherever it stands.
    """
    cut = np.zeros(len(codes), bool)
    size = np.bincount(number)
    inside = np.flatnonzero(size[number] > LONG)
    if not len(inside):
        return cut
    h, piece = _mix(codes[inside] ^ _ODD), number[inside]
    n = len(inside) - REACH + 1
    whole = np.flatnonzero(piece[:n] == piece[REACH - 1 :])
    best, at = h[whole].copy(), whole.copy()
    for k in range(1, REACH):
        low = h[whole + k] <= best
        best[low], at[low] = h[whole + k][low], whole[low] + k
    cut[inside[at]] = True
    return cut


def units(found: list[list[str]], memo: _Tokens, unit: str) -> pd.DataFrame:
    """Units of consecutive texts, which come as their tokens: text, unit, h1, h2, words, first and last token, and whether a unit is a whole line.

    ``line`` units are lines. ``passage`` cuts lines further, at sentence marks and, where more than
    LONG words stand between marks, at words chosen by their hashes; a line of fewer than MIN_WORDS
    words is a unit of its own kind. Words are lower-cased runs of word characters; all else is
    dropped. A unit's two hashes add up its words' hashes mixed with their place, 128 bits in all.
    """
    size = np.array([len(f) for f in found], dtype=np.int64)
    codes = np.fromiter(map(memo.__getitem__, chain.from_iterable(found)), dtype=np.uint64, count=int(size.sum()))
    text = np.repeat(np.arange(len(found)), size)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(size) - size, size)
    flags = (codes & np.uint64(7)).astype(np.int64)
    opens = place == 0
    line = np.cumsum(np.concatenate([[0], flags[:-1] == _LINE])[: len(codes)] | opens)
    word = flags == 0
    # a token that ends a unit belongs to it
    ends = np.concatenate([[False], flags[:-1] > 0])[: len(codes)] | opens
    piece = np.cumsum(ends)[word] if len(codes) else np.zeros(0, np.int64)
    codes, text, place, line = codes[word], text[word], place[word], line[word]
    if not len(codes):
        return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("text", "unit", "h1", "h2", "words", "first", "last", "whole")})
    in_line = np.bincount(line)
    if unit == "line":
        number, whole = line, np.ones(len(codes), bool)
    else:
        whole = in_line[line] < MIN_WORDS
        cut = _winnowed(codes, piece) & ~whole
        behind = np.concatenate([[False], cut[:-1]])
        change = np.concatenate([[True], np.where(whole[1:] & whole[:-1], line[1:] != line[:-1], piece[1:] != piece[:-1])])
        number = np.cumsum(change | behind | np.concatenate([[True], whole[1:] != whole[:-1]]))
    new = np.concatenate([[True], (number[1:] != number[:-1]) | (text[1:] != text[:-1])])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(codes)))
    inside = (np.arange(len(codes)) - np.repeat(at, count) + 1).astype(np.uint64)
    h1 = np.add.reduceat(_mix(codes + inside * _GOLD), at)
    h2 = np.add.reduceat(_mix((codes ^ _ODD) + inside * _ODD), at)
    of, kind = text[at], whole[at]
    start = np.concatenate([[True], of[1:] != of[:-1]])
    no = np.arange(len(at)) - np.repeat(np.flatnonzero(start), np.diff(np.append(np.flatnonzero(start), len(at))))
    salt = np.where(kind & (unit != "line"), np.uint64(1 << 40), np.uint64(0))
    return pd.DataFrame({"text": of, "unit": no, "h1": _mix(h1 + count.astype(np.uint64) + salt).view(np.int64), "h2": h2.view(np.int64), "words": count, "first": place[at], "last": place[at + count - 1], "whole": kind})


def _in_batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        sizes = part["text"].str.len().cumsum() // BATCH_CHARS
        for _, some in part.groupby(sizes.to_numpy(), sort=False):
            yield some.reset_index(drop=True)


def _spans(apart: list[list[str]], found: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Where units begin and end in their texts, which are split at tokens."""
    text, first, last = (found[c].to_numpy() for c in ("text", "first", "last"))
    starts, ends = np.zeros(len(found), np.int32), np.zeros(len(found), np.int32)
    cuts = np.r_[np.flatnonzero(np.r_[True, text[1:] != text[:-1]]), len(text)] if len(text) else []
    for i, j in zip(cuts, cuts[1:]):
        pieces = apart[text[i]]
        behind = np.cumsum(np.fromiter(map(len, pieces), np.int32, len(pieces)))
        starts[i:j], ends[i:j] = behind[2 * first[i:j]], behind[2 * last[i:j] + 1]
    return starts, ends


def _row_key(id_col: str, text_col: str) -> Column:
    """Names a row by its id and text."""
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col))


def _passages(docs: DataFrame, unit: str, min_words: int, id_col: str, text_col: str) -> DataFrame:
    """repeated_passages with the rows' keys."""
    named = docs.select(F.col(id_col).cast("long").cast("string").alias("id"), _row_key(id_col, text_col).alias("row"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull())

    def digests(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = _Tokens()
        for some in _in_batches(parts):
            found = units([TOKEN.findall(t) for t in some["text"]], memo, unit)
            yield pd.DataFrame({"id": some["id"].to_numpy(dtype=object)[found["text"]], "row": some["row"].to_numpy()[found["text"]], "unit": found["unit"].astype(np.int32), "h1": found["h1"], "h2": found["h2"]})

    rank = F.struct(F.col("id").cast("long").alias("id"), "row", "unit")  # a null id comes first
    earliest = (
        named.mapInPandas(digests, "id string, row long, unit int, h1 long, h2 long")
        .groupBy("h1", "h2")
        .agg(F.min(rank).alias("low"), F.max(rank).alias("high"))
        .filter((F.col("low.row") != F.col("high.row")) | (F.col("low.unit") != F.col("high.unit")))
        .select("h1", "h2", F.col("low.id").alias("kept_id"), F.col("low.row").alias("kept_row"), F.col("low.unit").alias("kept_unit"))
    )
    earliest = materialise(earliest, "repeats")
    held = docs.sparkSession.sparkContext.broadcast(bitfilter.build(earliest, "h1", FILTER_BITS))

    def placed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits, memo = held.value, _Tokens()
        for some in _in_batches(parts):
            apart = [APART.split(t) for t in some["text"]]
            found = units([p[1::2] for p in apart], memo, unit)
            found = found[bitfilter.passes(bits, found["h1"].to_numpy().view(np.uint64))]
            starts, ends = _spans(apart, found)
            out = pd.DataFrame({"id": some["id"].to_numpy(dtype=object)[found["text"]], "row": some["row"].to_numpy()[found["text"]], "unit": found["unit"].astype(np.int32), "h1": found["h1"], "h2": found["h2"], "words": found["words"].astype(np.int32), "whole": found["whole"].astype(bool)})
            yield out.assign(start=starts, end=ends)

    hits = named.mapInPandas(placed, "id string, row long, unit int, h1 long, h2 long, words int, whole boolean, start int, end int")
    repeats = hits.join(earliest, ["h1", "h2"]).filter((F.col("row") != F.col("kept_row")) | (F.col("unit") != F.col("kept_unit")))
    repeats = repeats.dropDuplicates(["row", "id", "unit"])
    run = F.col("unit") - F.row_number().over(Window.partitionBy("row", "id").orderBy("unit"))
    return (
        repeats.withColumn("run", run)
        .groupBy("row", "id", "run")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n_units"), F.sum("words").alias("n_words"), F.min_by("kept_id", "unit").alias("kept_doc_id"), F.bool_or("whole").alias("whole"), F.sort_array(F.collect_list(F.when(F.col("whole"), F.struct("unit", "start", "end", "words", "kept_id")))).alias("lines"))
        .select("row", F.col("id").cast("long").alias("doc_id"), F.explode(_kept_runs(min_words)).alias("p"))
        .select("row", "doc_id", "p.*")
    )


def _kept_runs(min_words: int) -> Column:
    """A run of enough words as it is; of a shorter one, the whole lines in it."""
    one = F.struct("start", "end", "n_units", F.col("n_words").cast("long").alias("n_words"), "kept_doc_id")
    line = lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(1).cast("long").alias("n_units"), x["words"].cast("long").alias("n_words"), x["kept_id"].alias("kept_doc_id"))
    return F.when(F.col("n_words") >= min_words, F.array(one)).otherwise(F.transform("lines", line))


def repeated_passages(docs: DataFrame, unit: str = "passage", min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The passages to remove: doc_id, start, end, n_units, n_words, kept_doc_id.

    A unit is a repeat if the same words stand at an earlier rank (smaller id, then row, then earlier
    in the text). Neighbouring repeats make one passage. Repeated lines are removed at any length;
    repeats within a line, if ``min_words`` words of them stand together. start and end are code
    points of the original text, end exclusive; kept_doc_id is where the first unit of the passage
    is kept.

    Digests are grouped with the smallest rank in partial sums, so a line of a third of all
    documents meets as one row a task. A bit filter of fixed size then drops units that occur once
    before anything else is shuffled; the join decides. Null and empty texts have no units; rows
    alike in id and text count as one document, so they are no repeats of each other; one id on two
    texts is two documents; rows with a null id rank first; empty tables give no rows. Other columns
    are ignored.
    """
    return _passages(docs, unit, min_words, id_col, text_col).drop("row")


def remove_repeats(docs: DataFrame, unit: str = "passage", min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", spans_col: str = "removed") -> DataFrame:
    """docs with the repeated passages cut out of their texts, and their offsets in ``spans_col``.

    The row travels packed, so no other column's name can clash; a column of the name ``spans_col`` is replaced.
    """
    spans = _passages(docs, unit, min_words, id_col, text_col).groupBy("row", "doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    packed = docs.select(F.struct(*docs.columns).alias("doc"), F.col(id_col).cast("long").alias("own_id"), _row_key(id_col, text_col).alias("own_row"))
    text = F.col("doc").getField(text_col)
    cut = F.aggregate(
        "spans",
        F.struct(F.lit("").alias("out"), F.lit(0).alias("pos")),
        lambda a, s: F.struct(F.concat(a["out"], F.substring(text, a["pos"] + 1, s["start"] - a["pos"])).alias("out"), s["end"].alias("pos")),
        lambda a: F.concat(a["out"], F.substring(text, a["pos"] + 1, F.length(text))),
    )
    joined = packed.join(spans, (F.col("own_row") == F.col("row")) & F.col("own_id").eqNullSafe(F.col("doc_id")), "left")
    doc = F.col("doc").withField(text_col, F.when(F.col("spans").isNull(), text).otherwise(cut)).withField(spans_col, F.col("spans"))
    return joined.select(doc.alias("doc")).select("doc.*")
