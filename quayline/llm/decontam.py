"""Benchmark decontamination by template canonicalisation and hash-joined template windows."""

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

WINDOW = 5  # tokens of a template window
SHORTEST = 3  # items of fewer template tokens match whole documents alone
COVERAGE = 0.8  # share of an item's windows that a document must hold
FILTER_BITS = np.uint64(1 << 24)  # bits of the benchmark's filter: 2 MB, whatever the benchmark's size
BATCH_CHARS = 2_000_000

#: fixed values: unit words
UNITS = frozenset(
    "mm cm m km in ft yd mi mg g kg t lb oz ml l s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years "
    "inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres gram grams kilogram kilograms pound pounds "
    "liter liters litre litres dollar dollars cent cents euro euros usd eur percent degree degrees mph kmh hz khz mhz ghz kb mb gb tb w kw mw v".split()
)
_TOKEN = re.compile(r"\w+(?:[.,]\d+)*|[.!?\n]")
#: what a token can be, in the low bits of its hash
_WORD, _DIGITS, _MARK, _CAPITAL, _UNIT_WORD = 0, 1, 2, 4, 8
_FLAGS = np.uint64(15)
_NUMBER, _UNIT, _NAME = (np.uint64(k << 4 | 3) for k in (1, 2, 3))  # hashes of the placeholders
_SLOT_NAMES = {int(_NUMBER): "number", int(_UNIT): "unit", int(_NAME): "name"}


class _Tokens(dict):
    """Hash and flags of each token seen by this worker; emptied when it has grown large."""

    def __missing__(self, token: str) -> int:
        if len(self) > 150_000:
            self.clear()
        low = token.lower()
        if token in ".!?\n":
            flags = _MARK
        elif any(c.isdigit() for c in token):
            flags = _DIGITS
        else:
            capital = token[0] != low[0] and token[1:] == low[1:]
            flags = _CAPITAL * capital | _UNIT_WORD * (low in UNITS)
        value = self[token] = (xxhash.xxh3_64_intdigest(low) | 64) & ~15 | flags
        return value


def canonical(texts: list[str], memo: _Tokens) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]]:
    """Readings of consecutive texts: template hashes, text number and raw-token number of each, raw tokens.

    Tokens with a digit are numbers; a unit word after a number is a unit; a word that begins with a
    capital, is not all capitals and does not open a sentence is a name, and a run of names is one
    slot; all others are lower-cased words. Sentence marks end up in no token. The second reading
    holds the texts in which a word that opens a sentence stands capitalised within a sentence too:
    there such an opening word is a name as well.
    """
    found = [_TOKEN.findall(t) for t in texts]
    raw = list(chain.from_iterable(found))
    codes = np.fromiter(map(memo.__getitem__, raw), dtype=np.uint64, count=len(raw))
    text = np.repeat(np.arange(len(texts)), [len(f) for f in found])
    flags = (codes & _FLAGS).astype(np.int64)
    first = np.ones(len(raw), bool)
    first[1:] = text[1:] != text[:-1]
    opens = first.copy()
    opens[1:] |= flags[:-1] == _MARK
    keep = np.flatnonzero(flags != _MARK)
    codes, flags, text, opens = codes[keep] & ~_FLAGS, flags[keep], text[keep], opens[keep]
    same = np.zeros(len(keep), bool)
    same[1:] = text[1:] == text[:-1]
    number = flags == _DIGITS
    unit = (flags & _UNIT_WORD > 0) & same & np.roll(number, 1)
    capital = (flags & _CAPITAL > 0) & ~unit
    inside = capital & ~opens
    own = codes ^ (text.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)  # the word in its text
    opening = np.flatnonzero(capital & opens)
    also = np.zeros(len(keep), bool)
    also[opening] = np.isin(own[opening], own[inside])
    second = np.zeros(len(texts), bool)
    second[text[also]] = True

    def reading(name: np.ndarray, of: np.ndarray):
        typed = codes.copy()
        typed[number], typed[unit], typed[name] = _NUMBER, _UNIT, _NAME
        once = of & ~(name & same & np.roll(name, 1))
        return typed[once], text[once], keep[once], raw

    return [reading(inside, np.ones(len(keep), bool)), reading(inside | also, second[text])]


def _windows(some: pd.DataFrame, memo: _Tokens, bits: np.ndarray | None, lengths: list[int]) -> Iterator[pd.DataFrame]:
    """Windows of both readings: id, row, reading, single, pos, hash, slots, length.

    reading is 0 or 1, or 2 where the text has no other reading. Windows of WINDOW tokens and of
    each of ``lengths`` begin at every token that has enough behind it; a text too short for WINDOW
    gives itself. Windows of placeholders alone are left out.
    """
    texts = some["text"].tolist()
    both = canonical(texts, memo)
    twofold = np.zeros(len(texts), bool)
    twofold[both[1][1]] = True
    for no, (codes, text, at, raw) in enumerate(both):
        n = len(codes)
        if not n:
            continue
        size = np.bincount(text, minlength=len(texts))
        place = np.arange(n) - (np.cumsum(size) - size)[text]
        for length in sorted({WINDOW, *lengths}):
            own = np.minimum(length, size[text]) if length == WINDOW else np.full(n, length)
            ok = place + own <= size[text]
            if length != WINDOW:
                ok &= size[text] > length  # a text of that very length is given by WINDOW already
            hashes, words = own.astype(np.uint64), np.zeros(n, np.int64)
            for k in range(length):
                there = ok & (k < own)
                step = np.zeros(n, np.uint64)
                step[: max(0, n - k)] = codes[k:]
                mixed = (hashes ^ step) * np.uint64(0x9E3779B97F4A7C15)
                hashes = np.where(there, mixed ^ mixed >> np.uint64(29), hashes)
                words += there & (step > _NAME)
            if bits is not None:
                ok &= (bits[(hashes % FILTER_BITS >> np.uint64(3)).astype(np.int64)] >> (hashes & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
            hit = np.flatnonzero(ok & (words > 0))
            slots = []
            for k in hit.tolist():
                inside = [(_SLOT_NAMES[c], j) for j, c in enumerate(codes[k : k + own[k]].tolist(), k) if c in _SLOT_NAMES]
                slots.append("\x1f".join(f"{kind}={_slot(kind, raw, int(at[j]))}" for kind, j in inside))
            of = text[hit]
            yield pd.DataFrame(
                {
                    "id": some["id"].to_numpy(dtype=object)[of],
                    "row": some["row"].to_numpy()[of],
                    "reading": np.where(twofold[of], no, 2).astype(np.int32),
                    "size": size[of].astype(np.int32),
                    "length": own[hit].astype(np.int32),
                    "pos": place[hit].astype(np.int32),
                    "hash": hashes[hit].view(np.int64),
                    "slots": pd.Series(slots, dtype=object),
                }
            )


def _slot(kind: str, raw: list[str], k: int) -> str:
    """The text of a placeholder: for a name, the whole run of capitalised words."""
    if kind != "name":
        return raw[k].lower()
    end = k + 1
    while end < len(raw) and raw[end][0].isupper() and raw[end][1:] == raw[end][1:].lower():
        end += 1
    return " ".join(raw[k:end]).lower()


def _window_rows(df: DataFrame, id_col: str, text_col: str, keep: np.ndarray | None, lengths: list[int]) -> DataFrame:
    """id, row, reading, size, length, pos, hash, slots of the template windows, of those alone that the filter lets through.

    row is a hash of id and text: it stands for the row where an id is null or repeated. Ids pass
    through Python as text, so none changes.
    """
    held = df.sparkSession.sparkContext.broadcast(keep) if keep is not None else None

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = _Tokens()
        bits = held.value if held is not None else None
        for part in parts:
            sizes = part["text"].str.len().cumsum() // BATCH_CHARS
            for _, some in part.groupby(sizes.to_numpy(), sort=False):
                yield from _windows(some, memo, bits, lengths)

    named = df.select(F.col(id_col).cast("string").alias("id"), row_key(id_col, text_col).alias("row"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull())
    rows = named.mapInPandas(run, "id string, row long, reading int, size int, length int, pos int, hash long, slots string")
    return rows.withColumn("id", F.col("id").cast(df.schema[id_col].dataType))


def row_key(id_col: str, text_col: str) -> Column:
    """Names a row by its id and text."""
    return F.xxhash64(F.col(id_col).cast("string"), F.col(text_col))


def _filter_of(items: DataFrame) -> np.ndarray:
    """Bit filter over the benchmark's window hashes, built in the tasks: a fixed size for any benchmark."""

    def bits(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine = np.zeros(int(FILTER_BITS) // 8, np.uint8)
        for part in parts:
            h = part["hash"].to_numpy().astype(np.uint64)
            np.bitwise_or.at(mine, (h % FILTER_BITS >> np.uint64(3)).astype(np.int64), (1 << (h & np.uint64(7))).astype(np.uint8))
        at = np.flatnonzero(mine)
        yield pd.DataFrame({"at": at.astype(np.int32), "byte": mine[at].astype(np.int32)})

    merged = items.select("hash").mapInPandas(bits, "at int, byte int").groupBy("at").agg(F.bit_or("byte").alias("byte")).toPandas()
    out = np.zeros(int(FILTER_BITS) // 8, np.uint8)
    out[merged["at"].to_numpy()] = merged["byte"].to_numpy()
    return out


def _leaks(docs: DataFrame, benchmark: DataFrame, coverage: float, id_col: str, item_col: str, text_col: str) -> DataFrame:
    """find_leaks with the rows' keys."""
    read = materialise(_window_rows(benchmark, item_col, text_col, None, []), "leak-read")
    # an item shorter than WINDOW has one window of its own length; the very shortest match whole texts alone
    lengths = sorted(r["length"] for r in read.filter((F.col("length") < WINDOW) & (F.col("length") >= SHORTEST)).select("length").distinct().collect())
    items = read.select(F.col("id").alias("item_id"), F.when(F.col("reading") == 2, 0).otherwise(F.col("reading")).alias("reading"), "length", F.col("pos").alias("item_pos"), "hash", F.col("slots").alias("item_slots"))
    totals = items.groupBy("item_id", "reading").agg(F.count_distinct("hash").alias("total"))
    hits = _window_rows(docs, id_col, text_col, _filter_of(read), lengths)
    readings = F.when(F.col("reading") == 2, F.array(F.lit(0), F.lit(1))).otherwise(F.array("reading"))
    hits = hits.select(F.col("id").alias("doc_id"), "row", F.explode(readings).alias("reading"), "size", F.col("pos").alias("doc_pos"), "hash", F.col("slots").alias("doc_slots"))
    known = items.select("hash", "reading").distinct()
    hits = materialise(hits.join(known, ["hash", "reading"], "left_semi"), "leak-hits")
    # a text that holds enough of an item holds one of any (1 - coverage) of its windows, and one more: the rarest
    often = hits.groupBy("hash", "reading").agg(F.count(F.lit(1)).alias("often"))
    own = items.select("item_id", "reading", "hash").distinct().join(often, ["hash", "reading"], "left").join(totals, ["item_id", "reading"])
    place = F.row_number().over(Window.partitionBy("item_id", "reading").orderBy(F.coalesce("often", F.lit(0)), "hash"))
    spare = F.floor(F.col("total") * (1 - coverage) + 1e-9) + 1
    rarest = own.withColumn("place", place).filter((F.col("place") <= spare) & F.col("often").isNotNull()).select("item_id", "reading", "hash")
    candidates = hits.select("row", "reading", "hash").join(rarest, ["hash", "reading"]).select("row", "item_id", "reading").distinct()
    pairs = candidates.join(items, ["item_id", "reading"]).join(hits, ["row", "reading", "hash"])
    pairs = materialise(pairs.withColumn("shift", F.col("doc_pos") - F.col("item_pos")), "leak-pairs")
    key = ["row", "item_id", "reading"]
    found = (
        pairs.groupBy(*key, "doc_id", "hash")
        .agg(F.lit(1).alias("one"))
        .groupBy(*key, "doc_id")
        .agg(F.count("one").alias("found"))
        .join(totals, ["item_id", "reading"])
        .filter(F.col("found") >= F.col("total") * coverage - 1e-9)
    )
    aligned = pairs.groupBy(*key, "shift").agg(F.count(F.lit(1)).alias("n")).groupBy(*key).agg(F.max_by("shift", F.struct("n", -F.col("shift"))).alias("shift"))
    best = found.join(aligned, key)
    slots = (
        best.join(pairs.select(*key, "shift", "item_slots", "doc_slots"), [*key, "shift"], "left")
        .withColumn("_s", F.explode_outer(F.arrays_zip(F.split("item_slots", "\x1f").alias("a"), F.split("doc_slots", "\x1f").alias("b"))))
        .groupBy(*key, "doc_id", "found", "total", "shift", "_s.a")
        .agg(F.min("_s.b").alias("low"), F.max("_s.b").alias("high"))
    )
    # one item value, one document value
    consistent = F.bool_and(F.col("low").eqNullSafe(F.col("high")))
    changed = F.sum((F.coalesce("a", F.lit("")) != F.coalesce("low", F.lit(""))).cast("long"))
    out = slots.groupBy(*key, "doc_id", "found", "total", "shift").agg(consistent.alias("ok"), changed.alias("changed")).filter("ok")
    out = out.select("row", "doc_id", "item_id", "reading", (F.col("found") / F.col("total")).alias("coverage"), "changed", F.greatest("shift", F.lit(0)).alias("start_token"))
    chosen = F.min_by(F.struct("coverage", "changed", "start_token"), F.struct(-F.col("coverage"), "changed", "reading"))
    return out.groupBy("row", "doc_id", "item_id").agg(chosen.alias("best")).select("row", "doc_id", "item_id", "best.*")


def find_leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Documents that hold a benchmark item, verbatim or with other numbers, names and units.

    Returns doc_id, item_id, coverage (share of the item's distinct template windows found),
    changed (slot values that differ), start_token. A pair is reported when coverage reaches the
    given share and the slots are consistent: wherever the item repeats a value, the document
    repeats one value too, at the alignment that most windows agree on. Texts and items in which a
    word that opens a sentence also stands capitalised within one are read both ways, and a pair
    needs one reading only.

    A filter of fixed size over the benchmark's window hashes drops most windows of the documents in
    the task that reads them. The rest is hash-joined on each item's rarest windows first, so a stock
    phrase of many items and documents gives no pairs of its own.

    Null and empty texts and items hold no windows. An item of three or four template tokens is one
    window and is found wherever it stands; a shorter one matches only a text of the same template;
    one of placeholders alone matches nothing. Rows stand for themselves: a null id is reported as
    null, rows alike in id and text once, an id on two texts for each text that leaks. A repeated
    item_id is treated as one item with all its windows; ties go to the earliest alignment. Other
    columns are ignored; empty tables give no rows.
    """
    return _leaks(docs, benchmark, coverage, id_col, item_col, text_col).drop("row")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that hold a benchmark item.

    Only rows that may be among the leaked ones are shuffled, each packed in one column so that no
    name can clash; the others pass as they are.
    """
    leaked = materialise(_leaks(docs, benchmark, COVERAGE, id_col, "item_id", text_col).select(F.col("row").alias("leaked"), F.col("doc_id").alias("leaked_id")).distinct(), "leaked")
    packed = docs.select(F.struct(*docs.columns).alias("doc"), F.col(id_col).alias("id"), row_key(id_col, text_col).alias("row"))
    clear, rest = bitfilter.split(packed, F.col("row"), leaked.select("leaked"))
    rest = rest.join(leaked, (F.col("row") == F.col("leaked")) & F.col("id").eqNullSafe(F.col("leaked_id")), "left_anti")
    return clear.select("doc.*").unionByName(rest.select("doc.*"))
