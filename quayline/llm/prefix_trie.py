"""A trie of conversation prefixes: rolling fingerprints group turns, verification splits collisions, sums roll up."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayline.operators.scans import running_sums
from quayline.storage import materialise

BLOCK, HEADS = 100, 6  # a conversation begins with the first crc32(id) % 6 turns of its block's first one
PRIMES, BASES = np.array([2147483647, 2147483629]), np.array([1103515245, 1664525])
PACKED = 1 << 16  # ids in one packed row
KEY = ["depth", "print", "level"]


@F.pandas_udf(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))
def _terms(turn: pd.Series, depth: pd.Series) -> pd.DataFrame:
    """What a turn adds to a prefix's fingerprint: its hash times base ** depth, modulo each prime."""
    out = {}
    for name, p, b in zip("ab", PRIMES, BASES):
        x = (turn.to_numpy(np.int64).view(np.uint64) % np.uint64(p)).astype(np.int64)
        e, square = depth.to_numpy(np.int64).copy(), int(b)
        while e.any():
            x = np.where(e & 1, x * square % p, x)
            e, square = e >> 1, square * square % int(p)
        out[name] = x
    return pd.DataFrame(out)


def turn_identities(conversations: DataFrame, mask: int) -> DataFrame:
    """conv_id, turn, role, text with the turn's identity: turn_hash, and turn_no that sets different turns of one hash apart.

    Every hash's texts are compared: the least and the greatest of them are equal unless two differ.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    turns = conversations.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), blank("role"), blank("text"))
    turns = turns.withColumn("turn_hash", F.xxhash64("role", "text").bitwiseAND(F.lit(mask)))
    told = F.struct("role", "text")
    differ = turns.groupBy("turn_hash").agg(F.min(told).alias("least"), F.max(told).alias("most")).filter("least <> most").select("turn_hash")
    differ = materialise(differ, "trie-collisions")
    if differ.isEmpty():
        return turns.withColumn("turn_no", F.lit(0))
    texts = turns.join(differ, "turn_hash", "left_semi").select("turn_hash", "role", "text").distinct()
    numbered = texts.withColumn("turn_no", F.row_number().over(Window.partitionBy("turn_hash").orderBy("role", "text")))
    return turns.join(numbered, ["turn_hash", "role", "text"], "left").fillna(0, ["turn_no"])


def rebuilt_turns(turns: DataFrame, block: int, heads: int) -> tuple[DataFrame, DataFrame]:
    """All conversations (conv_id), and their rebuilt turns: conv_id, depth, turn_hash, turn_no, n_chars."""
    turns = turns.withColumn("one", F.lit(1).cast("long")).withColumn("n_chars", F.length("text").cast("long"))
    what = ["turn_hash", "turn_no", "n_chars"]
    own = running_sums(turns, "conv_id", [F.asc_nulls_first("turn"), "role", "text"], ["one"], ["conv_id", *what], "trie-turns").withColumnRenamed("run_one", "pos")
    taken = (F.crc32(F.col("conv_id").cast("string")) % heads).alias("taken")

    first = own.filter((F.col("conv_id") % block == 0) & (F.col("pos") < heads))
    first = first.groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("pos", *what))).alias("head"))  # fewer than ``heads`` each
    convs = own.select("conv_id").distinct().withColumn("base", F.col("conv_id") - F.col("conv_id") % block).join(first, "base", "left")
    convs = convs.select("conv_id", taken, F.slice(F.coalesce("head", F.array().cast(first.schema["head"].dataType)), 1, F.col("taken").cast("int")).alias("head"))
    convs = materialise(convs, "trie-convs")

    begun = convs.select("conv_id", F.explode("head").alias("t")).select("conv_id", F.col("t.pos").alias("depth"), *[F.col(f"t.{c}").alias(c) for c in what])
    short = convs.select("conv_id", "taken", (F.col("taken") - F.size("head")).alias("short"))
    went_on = own.join(short, "conv_id").filter("pos > taken").select("conv_id", (F.col("pos") - F.col("short")).alias("depth"), *what)
    return convs.select("conv_id"), begun.unionByName(went_on)


def _grouped(rows: DataFrame) -> DataFrame:
    """One row a candidate group: its representative (the least member), size, and whether all members' turns and parents are its own."""
    same = ["turn_hash", "turn_no", "parent_print", "parent_level"]
    sums = [F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), *[F.min(c).alias(c) for c in ("n_chars", *same)], *[F.max(c).alias(f"_{c}") for c in same]]
    alike = [F.col(c) == F.col(f"_{c}") for c in same]
    return rows.groupBy(*KEY).agg(*sums).withColumn("clean", alike[0] & alike[1] & alike[2] & alike[3]).drop(*[f"_{c}" for c in same])


def verified_nodes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidate groups, split until every member equals its representative turn by turn: rows and nodes.

    A member equals the representative if their turns and their parents do. Where one does not,
    its conversation leaves the group from that depth on, with the others of its round.
    """
    for level in count(1):
        nodes = materialise(_grouped(rows), "trie-nodes")
        mixed = nodes.filter("not clean")
        if mixed.isEmpty():
            return rows, nodes.drop("clean")
        same = ["turn_hash", "turn_no", "parent_print", "parent_level"]
        heads = mixed.select(*KEY, "conv_id").join(rows, [*KEY, "conv_id"]).select(*KEY, *[F.col(c).alias(f"_{c}") for c in same])
        differs = F.lit(False)
        for c in same:
            differs = differs | (F.col(c) != F.col(f"_{c}"))
        left = rows.join(heads, KEY).filter(differs).groupBy("conv_id").agg(F.min("depth").alias("_from"))
        moved = lambda c, at: F.when(F.col("depth") >= at, level).otherwise(F.col(c)).cast("long").alias(c)
        others = [c for c in rows.columns if c not in ("level", "parent_level")]
        rows = materialise(rows.join(left, "conv_id", "left").select(*others, moved("level", F.col("_from")), moved("parent_level", F.col("_from") + 1)), "trie-rows")


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Members in order as rows of joined ids."""
    for batch in batches:
        if not len(batch):
            continue
        keys, ids = batch[KEY].to_numpy(), batch["conv_id"].to_numpy()
        starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
        cuts = [k for a, b in zip(starts, [*starts[1:], len(ids)]) for k in range(a, b, PACKED)]
        out = batch.iloc[cuts].copy()
        out["ids"] = [",".join(map(str, ids[a:b])) for a, b in zip(cuts, [*cuts[1:], len(ids)])]
        yield out


def _digested(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The SHA-256 of each node's joined ids; a hash state goes on from row to row, so a large node needs no memory."""
    now, state = None, None
    for batch in batches:
        out = []
        for *key, ids in batch[[*KEY, "ids"]].itertuples(index=False):
            if key == now:
                state.update(b"," + ids.encode())
                continue
            if now is not None:
                out.append((*now, state.hexdigest()))
            now, state = key, hashlib.sha256(ids.encode())
        yield pd.DataFrame(out, columns=[*KEY, "ends_sha256"])
    if now is not None:
        yield pd.DataFrame([(*now, state.hexdigest())], columns=[*KEY, "ends_sha256"])


def end_digests(convs: DataFrame, rows: DataFrame) -> DataFrame:
    """The digest of the members that end at each node: depth, print, level, ends_sha256; nodes without are left out."""
    at = rows.select("conv_id", *KEY).unionByName(convs.select("conv_id", *[F.lit(0).cast("long").alias(c) for c in KEY]))
    ends = at.groupBy("conv_id").agg(F.max("depth").alias("depth"), F.max_by("print", "depth").alias("print"), F.max_by("level", "depth").alias("level"))
    n = int(convs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [*KEY, "conv_id"]
    key = "depth long, print long, level long"
    packed = ends.select(*order).repartitionByRange(n, *order).sortWithinPartitions(*order).mapInPandas(_packed, f"{key}, conv_id long, ids string")
    return packed.repartition(*KEY).sortWithinPartitions(*order).mapInPandas(_digested, f"{key}, ends_sha256 string")


def _chain_totals(chains: DataFrame, top: int) -> DataFrame:
    """Sums over each chain and all chains that hang from it, by doubling the distance to the ancestor that is added to."""
    state = materialise(chains.select("conv_id", F.col("up").alias("anc"), "leaves", "saved"), "trie-chains")
    while not state.filter("anc is not null").isEmpty():
        more = state.filter("anc is not null").groupBy(F.col("anc").alias("conv_id")).agg(F.sum("leaves").alias("_leaves"), F.sum("saved").alias("_saved"))
        summed = state.join(more, "conv_id", "left").select("conv_id", "anc", *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in ("leaves", "saved")])
        done = F.col("anc").isNull() | (F.col("anc") == top)  # the top chain, from which a third of all may hang, has no ancestor
        further = state.filter("anc is not null").select(F.col("conv_id").alias("anc"), F.col("anc").alias("_next"))
        stay = summed.filter(done).withColumn("anc", F.lit(None).cast("long"))
        go_on = summed.filter(~done).join(further, "anc", "left").select("conv_id", F.col("_next").alias("anc"), "leaves", "saved")
        state = materialise(stay.unionByName(go_on), "trie-chains")
    return state.drop("anc")


def prefix_trie(conversations: DataFrame, block: int = BLOCK, heads: int = HEADS, mask: int = -1) -> DataFrame:
    """The trie of all rebuilt conversations' prefixes, one row a node.

    Returns conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256. A conversation is rebuilt from the first crc32(id) % ``heads`` turns
    of its block's first conversation and its own turns after as many; a node is a distinct
    sequence of turns (role, text).

    A prefix's fingerprint is the running sum of turn hash times base ** depth in two prime fields,
    62 bits; equal fingerprints are only candidates, compared with the group's least member by turn
    and parent, and split where they differ. ``mask`` keeps some bits of hashes and fingerprints
    alone, for tests of that splitting. A node's least member stays the least below it, so nodes
    form chains of one conversation each; sums roll up from chain to chain by pointer doubling and
    along a chain by running sums. A hot turn, prefix or conversation is summed in the tasks first
    or lies over several range partitions.

    Turns are ordered by turn (null first), then role and text; null role or text is empty; rows
    without conv_id belong to none and are left out. A repeated row is a turn of its own. A
    conversation may come out turnless: it is a member of the root alone. No conversations, no
    rows. Other columns are ignored.
    """
    turns = turn_identities(conversations, mask)
    convs, rebuilt = rebuilt_turns(turns, block, heads)
    term = rebuilt.withColumn("_t", _terms("turn_hash", "depth")).select("*", "_t.a", "_t.b")
    summed = running_sums(term, "conv_id", ["depth"], ["a", "b"], ["conv_id", "depth", "turn_hash", "turn_no", "n_chars", "a", "b"], "trie-prints")

    def fingerprint(of) -> Column:
        a, b = (F.pmod(of(c), F.lit(int(p))) for c, p in zip("ab", PRIMES))
        return F.shiftleft(a, 31).bitwiseOR(b).bitwiseAND(F.lit(mask))

    zero = F.lit(0).cast("long")
    rows = summed.select(
        "conv_id", "depth", "turn_hash", "turn_no", "n_chars",
        fingerprint(lambda c: F.col(f"run_{c}")).alias("print"), zero.alias("level"),
        fingerprint(lambda c: F.col(f"run_{c}") - F.col(c)).alias("parent_print"), zero.alias("parent_level"),
    )
    rows, nodes = verified_nodes(materialise(rows, "trie-rows"))
    top, n_convs = convs.agg(F.min("conv_id"), F.count(F.lit(1))).first()
    if top is None:
        top, n_convs = 0, 0

    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("print").alias("parent_print"), F.col("level").alias("parent_level"), F.col("conv_id").alias("parent_conv_id"))
    deep = nodes.filter("depth > 1").join(parents, ["depth", "parent_print", "parent_level"])
    cols = ["conv_id", *KEY, "parent_conv_id", "n_convs", "n_chars"]
    top_id = F.lit(top).cast("long")
    root = convs.sparkSession.range(1 if n_convs else 0).select(top_id.alias("conv_id"), *[zero.alias(c) for c in KEY], top_id.alias("parent_conv_id"), F.lit(n_convs).cast("long").alias("n_convs"), zero.alias("n_chars"))
    nodes = deep.select(*cols).unionByName(nodes.filter("depth = 1").withColumn("parent_conv_id", top_id).select(*cols)).unionByName(root)
    nodes = materialise(nodes.join(end_digests(convs, rows), KEY, "left").drop("print", "level"), "trie-parents")

    children = nodes.filter("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, ["conv_id", "depth"], "left").fillna(0, ["n_children"])
    nodes = nodes.withColumn("leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved", (F.col("n_convs") - 1) * F.col("n_chars"))
    nodes = materialise(nodes, "trie-children")

    begins = F.col("parent_conv_id") != F.col("conv_id")
    up, up_depth = F.min(F.when(begins, F.col("parent_conv_id"))).alias("up"), F.min(F.when(begins, F.col("depth") - 1)).alias("up_depth")
    chains = materialise(nodes.groupBy("conv_id").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), up, up_depth), "trie-chains")
    totals = _chain_totals(chains, top)
    hung = chains.select("conv_id", "up", "up_depth").join(totals, "conv_id")
    below = hung.filter("up is not null").groupBy(F.col("up").alias("conv_id"), F.col("up_depth").alias("depth")).agg(F.sum("leaves").alias("_leaves"), F.sum("saved").alias("_saved"))
    nodes = nodes.join(below, ["conv_id", "depth"], "left").withColumns({c: F.col(c) + F.coalesce(f"_{c}", F.lit(0)) for c in ("leaves", "saved")})
    keep = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "ends_sha256", "leaves", "saved"]
    along = running_sums(nodes, "conv_id", ["depth"], ["leaves", "saved"], keep, "trie-rollup")
    total = totals.select("conv_id", F.col("leaves").alias("_all_leaves"), F.col("saved").alias("_all_saved"))
    rest = lambda c: F.col(f"_all_{c}") - F.col(f"run_{c}") + F.col(c)
    return along.join(total, "conv_id").select(
        "conv_id", "depth", F.when(F.col("depth") > 0, F.col("parent_conv_id")).alias("parent_conv_id"), "n_convs", "n_children", rest("leaves").alias("n_leaves"), rest("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


ORACLE_SQL = r"""
WITH crc_table AS (
  SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS crcs
  FROM (SELECT unnest(range(256)) AS b)),
own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)),
                                  lambda c, b: xor(crcs[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM own), crc_table),
parts AS (
  SELECT c.conv_id, 0 AS half, o.pos, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.conv_id - c.conv_id % 100 AND o.pos <= c.h
  UNION ALL
  SELECT c.conv_id, 1, o.pos, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.pos > c.h),
rebuilt AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY half, pos) AS depth, role, text FROM parts),
paths AS (
  SELECT conv_id, depth, text, list({'r': role, 't': text}) OVER (PARTITION BY conv_id ORDER BY depth ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS path
  FROM rebuilt
  UNION ALL
  SELECT conv_id, 0, '', [] FROM convs),
lengths AS (SELECT conv_id, max(depth) AS longest FROM paths GROUP BY conv_id),
nodes AS (
  SELECT min(conv_id) AS conv_id, depth, path, count(*) AS n_convs, any_value(length(text)) AS n_chars,
         string_agg(CASE WHEN depth = longest THEN conv_id::VARCHAR END, ',' ORDER BY conv_id) AS ends
  FROM paths JOIN lengths USING (conv_id) GROUP BY depth, path),
members AS (SELECT p.conv_id, p.depth, n.conv_id AS node FROM paths p JOIN nodes n ON p.depth = n.depth AND p.path = n.path),
tree AS (
  SELECT n.conv_id, n.depth, m.node AS parent_conv_id, n.n_convs, (n.n_convs - 1) * n.n_chars AS saved, n.ends
  FROM nodes n LEFT JOIN members m ON m.conv_id = n.conv_id AND m.depth = n.depth - 1),
children AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM tree WHERE depth > 0 GROUP BY ALL),
full_tree AS (SELECT t.*, coalesce(n_children, 0) AS n_children FROM tree t LEFT JOIN children c ON c.conv_id = t.conv_id AND c.depth = t.depth),
below AS (
  SELECT m.node AS conv_id, m.depth, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens
  FROM full_tree t JOIN members m ON m.conv_id = t.conv_id AND m.depth <= t.depth GROUP BY ALL)
SELECT t.conv_id, t.depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM full_tree t JOIN below b ON b.conv_id = t.conv_id AND b.depth = t.depth
"""
