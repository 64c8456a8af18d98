"""Near-duplicate classes by DartMinHash signatures, banded joining and exact checks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayline.llm import bitfilter
from quayline.storage import materialise

WORD = re.compile(r"\w+")
SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 25, 5  # a pair at 0.8 misses all bands with probability 5e-5
COORDINATES = BANDS * ROWS
DARTS = COORDINATES * (np.log(COORDINATES) + 4)  # expected darts of a text; an empty coordinate is rare
BATCH_CHARS = 400_000
WHOLE_BUCKET = 12  # buckets up to this size check every pair
NEXT_BANDS = (1, 7)  # larger ones are also divided by the bands so many further on
RARE = 32  # shingles of more crowded texts than this are common ones
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    x = x + _GOLD
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _uniform(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


#: inverse of the Poisson(1) distribution function: every dart cell has area one
_POISSON = np.cumsum([np.exp(-1.0) / f for f in np.cumprod([1.0, *range(1, 16)])])


class _Words(dict):
    """64-bit hash of each word seen by this worker; emptied when it has grown large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 150_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.lower())
        return value


def shingles(texts: list[str], memo: _Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct five-word shingles: text number, hash, occurrences; sorted by text, then hash.

    Words are lower-cased runs of word characters. A text of one to four words is one shingle.
    """
    found = [WORD.findall(t) for t in texts]
    size = np.array([len(f) for f in found], dtype=np.int64)
    h = np.fromiter(map(memo.__getitem__, chain.from_iterable(found)), dtype=np.uint64, count=int(size.sum()))
    text = np.repeat(np.arange(len(texts)), size)
    place = np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)
    length = np.minimum(SHINGLE, size)[text]
    ok = place + length <= size[text]
    out = length.astype(np.uint64)
    for k in range(SHINGLE):
        step = np.zeros_like(h)
        step[: max(0, len(h) - k)] = h[k:]
        out = np.where(ok & (k < length), _mix(out ^ step), out)
    text, out = text[ok], out[ok]
    order = np.lexsort((out, text))
    text, out = text[order], out[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    return text[first], out[first], np.diff(np.append(first, len(out)))


def dart_signatures(text: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """DartMinHash: (n, COORDINATES) ids of the earliest darts; text is sorted.

    Darts fall on weight x rank with one dart per unit of area on average. The plane is cut into
    cells of area one: weight cell 2^a..2^(a+1) (or 0..1), and as many equal rank steps as make the
    area one. The darts of a cell (count, place, rank, coordinate) follow from the hash of element
    and cell alone, so every text that holds the element sees the same darts. A dart hits where its
    weight lies below the element's; each coordinate keeps its earliest hit. Ranks are walked up to
    the bound that gives DARTS hits for the text's total weight; texts with an empty coordinate
    walk twice as far, until every one is filled.
    """
    best_rank = np.full(n * COORDINATES, np.inf)
    best_dart = np.zeros(n * COORDINATES, np.uint64)
    total = np.bincount(text, weights=weight, minlength=n)
    bound = np.where(total > 0, DARTS / np.maximum(total, 1e-9), 0.0)
    done = np.zeros(n)
    todo = total > 0
    while todo.any():
        live = todo[text]
        t, e, w = text[live], element[live], weight[live].astype(np.float64)
        top = np.floor(np.log2(np.maximum(w, 1))).astype(np.int64)
        for a in range(int(top.max()) + 1):
            some = top >= a
            tt, ee, ww = t[some], e[some], w[some]
            low, width = (0.0, 2.0) if a == 0 else (2.0**a, 2.0**a)
            begin, end = np.floor(done[tt] * width).astype(np.int64), np.ceil(bound[tt] * width).astype(np.int64)
            for lo in range(0, len(tt), 100_000):
                cut = slice(lo, lo + 100_000)
                cells = end[cut] - begin[cut]
                for sub in _slices(cells, 150_000):
                    c = cells[sub]
                    at = np.repeat(np.arange(len(c)), c)
                    rank_cell = np.arange(len(at)) - np.repeat(np.cumsum(c) - c, c) + np.repeat(begin[cut][sub], c)
                    seed = _mix(_mix(ee[cut][sub][at] ^ np.uint64(a << 56)) ^ rank_cell.astype(np.uint64))
                    darts = np.searchsorted(_POISSON, _uniform(seed), side="right")
                    hit = np.repeat(np.arange(len(at)), darts)
                    if not len(hit):
                        continue
                    no = np.arange(len(hit)) - np.repeat(np.cumsum(darts) - darts, darts)
                    dart = _mix(seed[hit] + _GOLD * (no + 1).astype(np.uint64))
                    x = low + width * _uniform(_mix(dart ^ np.uint64(1)))
                    good = x < ww[cut][sub][at[hit]]
                    hit, dart = hit[good], dart[good]
                    rank = (rank_cell[hit] + _uniform(_mix(dart ^ np.uint64(2)))) / width
                    slot = tt[cut][sub][at[hit]] * COORDINATES + (_mix(dart ^ np.uint64(3)) % np.uint64(COORDINATES)).astype(np.int64)
                    order = np.lexsort((dart, rank, slot))
                    slot, rank, dart = slot[order], rank[order], dart[order]
                    lead = np.ones(len(slot), bool)
                    lead[1:] = slot[1:] != slot[:-1]
                    slot, rank, dart = slot[lead], rank[lead], dart[lead]
                    near = (rank < best_rank[slot]) | ((rank == best_rank[slot]) & (dart < best_dart[slot]))
                    best_rank[slot[near]], best_dart[slot[near]] = rank[near], dart[near]
        filled = np.isfinite(best_rank.reshape(n, COORDINATES)).all(1)
        todo = todo & ~filled
        done = np.where(todo, bound, done)
        bound = np.where(todo, bound * 2, bound)
    return best_dart.reshape(n, COORDINATES)


def _slices(cells: np.ndarray, most: int) -> Iterator[slice]:
    """Runs of elements with at most so many cells together (one element may exceed it)."""
    reached = np.cumsum(cells)
    lo = 0
    while lo < len(cells):
        base = reached[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(reached, base + most, side="right")))
        yield slice(lo, hi)
        lo = hi


def _batches(part: pd.DataFrame) -> Iterator[pd.DataFrame]:
    sizes = part["text"].str.len().cumsum() // BATCH_CHARS
    for _, some in part.groupby(sizes.to_numpy(), sort=False):
        yield some


def _signed(weighted: bool):
    """Key (digest of the word sequence; null without words) and band hashes of each text."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = _Words()
        for part in parts:
            part["text"] = part["text"].fillna("")
            for some in _batches(part):
                texts = some["text"].tolist()
                text, element, count = shingles(texts, memo)
                weight = count if weighted else np.ones(len(count))
                darts = dart_signatures(text, element, weight, len(some))
                h = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(some), BANDS))
                for k in range(ROWS):
                    h = _mix(h ^ darts[:, k * BANDS : (k + 1) * BANDS])
                worded = np.bincount(text, minlength=len(some)) > 0
                keys = [xxhash.xxh3_128_digest("\x00".join(WORD.findall(t)).lower()) if w else None for t, w in zip(texts, worded, strict=True)]
                yield pd.DataFrame({"id": some["id"], "row": some["row"], "key": keys, "buckets": list(h.view(np.int64))})

    return run


def elements(texts: list[str], memo: _Words, weighted: bool) -> tuple[np.ndarray, np.ndarray]:
    """Elements of each text, laid end to end, and their number; with weights, one for each occurrence of a shingle.

    The k-th occurrence of a shingle is an element of its own, so the Jaccard similarity of these
    sets is the weighted one of the shingles' occurrences.
    """
    text, element, count = shingles(texts, memo)
    if weighted:
        text, element = np.repeat(text, count), np.repeat(element, count)
        no = (np.arange(len(element)) - np.repeat(np.cumsum(count) - count, count)).astype(np.uint64)
        element = np.where(no > 0, _mix(element ^ _mix(no)), element)
    return element.view(np.int64), np.bincount(text, minlength=len(texts))


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (a, b): node, root (the smallest node).

    Every node takes the smallest root among its neighbours, then its root's root; the rounds end
    when nothing changes, about log2 of the longest path. Each round is kept in the workspace.
    """
    both = materialise(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "near-links")
    roots = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "near-roots")
    while True:
        near = both.join(roots.select(F.col("node").alias("b"), F.col("root").alias("r")), "b").groupBy("a").agg(F.min("r").alias("r"))
        lower = roots.join(near.select(F.col("a").alias("node"), "r"), "node").select("node", "root", F.least("root", "r").alias("r"))
        # the root itself learns the lower root too, so whole trees hook on at once
        hooks = lower.filter(F.col("r") < F.col("root")).groupBy("root").agg(F.min("r").alias("h")).withColumnRenamed("root", "k")
        lower = materialise(lower.join(hooks, F.col("node") == F.col("k"), "left").select("node", F.col("root").alias("was"), F.least("r", F.coalesce("h", "r")).alias("root")), "near-hooked")
        up = lower.select(F.col("node").alias("k"), F.col("root").alias("rr"))
        jumped = materialise(lower.join(up, F.col("root") == F.col("k")).select("node", "was", F.least("root", "rr").alias("root")), "near-roots")
        if jumped.filter(F.col("root") != F.col("was")).isEmpty():
            return jumped.select("node", "root")
        roots = jumped.select("node", "root")


def _bucket_pairs(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs (a < b) of texts that share a bucket, a number in proportion to the members; and
    node, bucket of the large buckets, whose other pairs _crowded_pairs finds.

    Buckets of up to WHOLE_BUCKET members give every pair. In a larger one each member is paired with
    the bucket's most central member (the one whose buckets are largest together) and with the most
    central of those members that share one more band with it, for each of NEXT_BANDS bands. All of
    these are aggregates, so no task gathers a bucket.
    """
    bands = nodes.select("node", F.posexplode("buckets").alias("no", "bucket"))
    sizes = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = bands.join(sizes, "bucket")
    central = shared.groupBy("node").agg(F.sum("n").alias("pull"))
    shared = materialise(shared.join(central, "node"), "near-buckets")
    small = shared.filter(F.col("n") <= WHOLE_BUCKET).groupBy("bucket").agg(F.sort_array(F.collect_list("node")).alias("m"))
    small = small.select(F.explode("m").alias("a"), "m").select("a", F.explode("m").alias("b")).filter("a < b")
    large = shared.filter(F.col("n") > WHOLE_BUCKET).join(nodes.select("node", "buckets"), "node")
    parts = [F.xxhash64("bucket", F.element_at("buckets", (F.col("no") + k) % BANDS + 1)) for k in NEXT_BANDS]
    grouped = large.select("node", "pull", F.explode(F.array("bucket", *parts)).alias("group"))
    heads = grouped.groupBy("group").agg(F.max_by("node", F.struct("pull", "node")).alias("other"))
    stars = grouped.join(heads, "group").select("node", "other").filter("node != other").distinct()
    pairs = small.unionByName(stars.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"))).distinct()
    return pairs, shared.filter(F.col("n") > WHOLE_BUCKET).select("node", "bucket")


def _apart(large: DataFrame, roots: DataFrame) -> DataFrame:
    """The nodes of those large buckets whose members are not all in one component yet."""
    member = large.join(roots, "node", "left").select("node", "bucket", F.coalesce("root", "node").alias("comp"))
    mixed = member.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high")
    return member.join(mixed, "bucket", "left_semi").select("node").distinct()


def _sets(weighted: bool):
    """Elements of each node's text."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = _Words()
        for part in parts:
            for some in _batches(part):
                element, size = elements(some["text"].tolist(), memo, weighted)
                yield pd.DataFrame({"node": some["node"].to_numpy(), "size": size, "tokens": np.split(element, np.cumsum(size)[:-1])})

    return run


def _crowded_pairs(sets: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs (a < b) that link all those of these texts' components that SIMILARITY links: a prefix-filter join.

    Ordered by the number of texts that hold them, the first element that two linked texts share stands
    in both prefixes of size - 0.8 size + 1. If it is a rare one, a bounded posting gives the pair.
    Otherwise the two share common elements only, so their similarity follows from these and the sizes
    and falls with the sizes: of the texts with one set of common elements and one component, the
    smallest has all the links; all links within one set go to its smallest text too, and the sets
    are compared with each other by the common elements of the prefixes. Pairs within a component
    are left out, so a group of near copies is not expanded.
    """
    sets = materialise(sets.join(roots, "node", "left").select("node", "size", "tokens", F.coalesce("root", "node").alias("comp")), "near-crowd")
    rows = sets.select("node", F.explode("tokens").alias("s"))
    counts = rows.groupBy("s").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    ranked = rows.join(counts, "s").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "s"))).alias("t"))
    # a text's own shingles come first in its prefix and meet no other text
    length = F.floor(F.col("size") * (1 - SIMILARITY) + 1e-9) + 1 - (F.col("size") - F.size("t"))
    common = F.filter("t", lambda x: x["n"] > RARE)
    prefix = F.slice("t", F.lit(1), F.greatest(length, F.lit(0)).cast("int"))
    ranked = sets.drop("tokens").join(ranked, "node").select("node", "size", "comp", F.xxhash64(common["s"]).alias("set"), F.size(common).alias("held"), prefix.alias("prefix"))
    ranked = materialise(ranked.filter(F.size("prefix") > 0), "near-prefixes")

    def meeting(posted: DataFrame, also) -> DataFrame:
        """Pairs of different components within a posting that the sizes allow."""
        mixed = posted.groupBy("s").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high").select("s")
        posted = posted.join(mixed, "s")
        x, y = posted.alias("x"), posted.alias("y")
        near = F.least("x.size", "y.size") >= SIMILARITY * F.greatest("x.size", "y.size") - 1e-9
        return x.join(y, (F.col("x.s") == F.col("y.s")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.comp") != F.col("y.comp")) & near & also).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))

    def enough(held, size_a, size_b):
        return held >= SIMILARITY * (size_a + size_b - held) - 1e-9

    rare = ranked.select("node", "size", "comp", F.explode(F.filter("prefix", lambda x: x["n"] <= RARE)["s"]).alias("s"))
    crowd = ranked.filter(F.exists("prefix", lambda x: x["n"] > RARE))
    own = [c for c in crowd.columns if c not in ("set", "comp")]
    heads = crowd.groupBy("set", "comp").agg(F.min_by(F.struct(*own), F.struct("size", "node")).alias("h")).select("set", "comp", "h.*")
    heads = materialise(heads, "near-heads")
    least = heads.groupBy("set").agg(F.min(F.struct("size", "node")).alias("m"))
    within = heads.join(least, "set").filter((F.col("node") != F.col("m.node")) & enough(F.col("held"), F.col("size"), F.col("m.size")))
    within = within.select(F.least("node", "m.node").alias("a"), F.greatest("node", "m.node").alias("b"))
    posted = heads.select("node", "size", "comp", "set", "held", F.explode(F.filter("prefix", lambda x: x["n"] > RARE)["s"]).alias("s"))
    across = meeting(posted, (F.col("x.set") != F.col("y.set")) & enough(F.least("x.held", "y.held"), F.col("x.size"), F.col("y.size")))
    return meeting(rare, F.lit(True)).unionByName(within).unionByName(across).distinct()


def _checked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose whole texts reach SIMILARITY; sets travel for pairs of like sizes alone."""
    for side in "ab":
        pairs = pairs.join(sets.select(F.col("node").alias(side), F.col("size").alias(f"n{side}")), side)
    near = pairs.filter(F.least("na", "nb") >= SIMILARITY * F.greatest("na", "nb") - 1e-9)
    for side in "ab":
        near = near.join(sets.select(F.col("node").alias(side), F.col("tokens").alias(f"t{side}")), side)
    both = F.size(F.array_intersect("ta", "tb"))
    return near.filter(both >= SIMILARITY * (F.col("na") + F.col("nb") - both) - 1e-9).select("a", "b")


def _row_key(id_col: str, text_col: str):
    """Names a row by its id and text; read again, the same row has the same key."""
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col))


def _classed(docs: DataFrame, id_col: str, text_col: str, weighted: bool, counted: bool = False) -> DataFrame:
    """Every row as doc_id, row, worded, kept_id, kept_row (the row of its class that stays) and n_links, if they are counted."""
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), _row_key(id_col, text_col).alias("row"), F.col(text_col).alias("text"))
    # ids pass through Python as text, so neither nulls nor large ids change
    signed = named.select(F.col("doc_id").cast("string").alias("id"), "row", "text").mapInPandas(_signed(weighted), "id string, row long, key binary, buckets array<long>")
    rows = materialise(signed.select(F.col("id").cast("long").alias("doc_id"), "row", "key", "buckets"), "near-signed")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    nodes = rows.filter(F.col("key").isNotNull()).groupBy("key").agg(F.min(rank).alias("first"), F.first("buckets").alias("buckets"))
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()), "near-nodes")
    pairs, large = _bucket_pairs(nodes)
    pairs = materialise(pairs, "near-pairs")
    wanted = nodes.join(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct(), "node", "left_semi")
    wanted = materialise(wanted.select("node", F.col("first.doc_id").alias("first_id"), F.col("first.row").alias("first_row")), "near-wanted")
    # a bit filter of fixed size drops the texts of documents in no pair before anything is shuffled
    texts = named.filter(bitfilter.may_hold(wanted.select("first_row"))(F.col("row")))
    texts = texts.join(wanted, (F.col("row") == F.col("first_row")) & F.col("doc_id").eqNullSafe(F.col("first_id"))).dropDuplicates(["node"])
    sets = materialise(texts.select("node", "text").mapInPandas(_sets(weighted), "node long, size long, tokens array<long>"), "near-sets")
    links = materialise(_checked(pairs, sets), "near-links")
    roots = components(links)
    # the rest of the pairs of large buckets, where they may join two components
    more = materialise(_crowded_pairs(sets.join(_apart(large, roots), "node", "left_semi"), roots), "near-crowded")
    more = materialise(_checked(more, sets), "near-more")
    if not more.isEmpty():
        links = links.unionByName(more).distinct()
        roots = components(links)
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    at = roots.join(ends, "node", "left") if counted else roots.withColumn("n_links", F.lit(None).cast("long"))
    rooted = nodes.select("key", "node", "first").join(at, "node", "left")
    rooted = materialise(rooted.select("key", "first", F.coalesce("root", "node").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "near-rooted")
    kept = rooted.groupBy("root").agg(F.min("first").alias("kept"))
    classes = rooted.join(kept, "root").select("key", F.col("kept.doc_id").alias("kept_id"), F.col("kept.row").alias("kept_row"), "n_links")
    rows = rows.select("doc_id", "row", "key")
    worded = rows.filter(F.col("key").isNotNull()).join(classes, "key").select("doc_id", "row", F.lit(True).alias("worded"), "kept_id", "kept_row", "n_links")
    alone = rows.filter(F.col("key").isNull()).select("doc_id", "row", F.lit(False).alias("worded"), F.col("doc_id").alias("kept_id"), F.col("row").alias("kept_row"), F.lit(0).cast("long").alias("n_links"))
    return worded.unionByName(alone)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", weighted: bool = True) -> DataFrame:
    """Class of every document and its links: doc_id, class_id, n_links.

    Texts of the same words form one node. Nodes whose DartMinHash signatures share a band are
    candidates; those whose five-word shingles, weighted by their occurrences, have a Jaccard
    similarity of 0.8 or more are linked, and classes are the connected components. class_id is the
    smallest doc_id of the class; n_links counts the different texts to which a verified link leads.
    All links that classes rest on are among them; of the pairs of one large bucket only those with
    its heads and those that join components are verified, so there the count is of these. Without ``weighted`` signature and check go by distinct shingles.

    Copies are never expanded into pairs. A bucket of thousands of similar texts gives a number of
    pairs in proportion to its members, against the most central members of the bucket and of its
    parts (see _bucket_pairs). The texts of buckets that these leave in several components are then
    joined exactly (see _crowded_pairs).

    Rows, not ids, are joined: one id on several texts stands in each text's class. A document
    without words (null, empty) is a class of its own; one to four words are one shingle; repeated
    rows share their class, and each is returned; a row with a null id keeps it and is in the class
    of its text (a class of null ids alone has a null class_id); empty tables give no rows. Other
    columns are ignored.
    """
    return _classed(docs, id_col, text_col, weighted, counted=True).select("doc_id", F.col("kept_id").alias("class_id"), "n_links")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", weighted: bool = True) -> DataFrame:
    """One row of each class: that of the smallest id (nulls last), then of the smallest row key.

    Rows alike in id and text are one document, of which any one stays; documents without words are
    no copies of each other. Only rows that may be copies or repeated are shuffled, each packed in
    one column so that no name can clash; the others pass as they are.
    """
    kept = F.col("row").eqNullSafe(F.col("kept_row")) & F.col("doc_id").eqNullSafe(F.col("kept_id"))
    gone = materialise(_classed(docs, id_col, text_col, weighted).filter(F.col("worded") & ~kept).select(F.col("doc_id").alias("gone_id"), F.col("row").alias("gone_row")).distinct(), "near-gone")
    packed = docs.select(F.struct(*docs.columns).alias("doc"), F.col(id_col).cast("long").alias("id"), _row_key(id_col, text_col).alias("row"))
    repeated = packed.groupBy("id", "row").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    clear, rest = bitfilter.split(packed, F.col("row"), gone.select("gone_row").unionByName(repeated.select(F.col("row").alias("gone_row"))))
    rest = rest.join(gone, (F.col("row") == F.col("gone_row")) & F.col("id").eqNullSafe(F.col("gone_id")), "left_anti").dropDuplicates(["id", "row"])
    return clear.select("doc.*").unionByName(rest.select("doc.*"))
