"""Token counts of flat token files by a vectorised scan for the end-of-document id."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import SparkFiles, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quayline.storage import materialise

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: fixed value: the pre-tokenisation pattern that belongs to the vocabulary
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END_ID = 50_256
BLOCK_TOKENS = 1 << 16
GROUP = 4096  # blocks whose sums one task scans in order
STREAM = "file long, block long, tokens binary, first long, ids array<string>"
SUMMARY = "file long, block long, n long, n_sep long, head long, tail long, inner array<long>"


@lru_cache(maxsize=2)
def _encoding(path: str):
    """The tokenizer of this worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("quayline", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def write_streams(docs: DataFrame, tokenizer: str = f"{TOKENIZERS}/{VOCABULARY}", id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS, dtype: str = "<u2", end_id: int = END_ID) -> DataFrame:
    """Texts as flat token streams in fixed blocks: file, block, tokens; and the order of the ids.

    Each partition makes one stream: the tokens of its documents, END_ID after each, cut every
    ``block_tokens`` tokens wherever that falls. Rows with a null block carry the ids of consecutive
    documents from ``first`` on; nothing else says where a document begins. The vocabulary file is
    read on the driver's machine and shipped to the executors.
    """
    docs.sparkSession.sparkContext.addFile(tokenizer)
    vocabulary = os.path.basename(tokenizer)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoding(SparkFiles.get(vocabulary)).encode_ordinary
        file, block, first = TaskContext.get().partitionId(), 0, 0
        held: list[np.ndarray] = []
        size = 0
        for part in parts:
            rows = []
            for text in part["text"]:
                ids = encode(text) if text else []
                held.append(np.array([*ids, end_id], dtype))
                size += len(ids) + 1
                if size >= 16 * block_tokens:
                    flat = np.concatenate(held)
                    whole = len(flat) // block_tokens
                    rows += [(file, block + k, flat[k * block_tokens : (k + 1) * block_tokens].tobytes(), None, None) for k in range(whole)]
                    held, block = [flat[whole * block_tokens :]], block + whole
                    size = len(held[0])
            rows.append((file, None, None, first, part["id"].tolist()))
            first += len(part)
            yield pd.DataFrame(rows, columns=["file", "block", "tokens", "first", "ids"])
        flat = np.concatenate(held) if held else np.zeros(0, dtype)
        rows = [(file, block + k, flat[k * block_tokens : (k + 1) * block_tokens].tobytes(), None, None) for k in range(-(-len(flat) // block_tokens))]
        yield pd.DataFrame(rows, columns=["file", "block", "tokens", "first", "ids"])

    named = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return named.mapInPandas(run, STREAM)


def read_token_files(spark: SparkSession, uris: list[str], block_tokens: int = BLOCK_TOKENS, dtype: str = "<u2") -> DataFrame:
    """Flat binary token files as blocks: file (place in ``uris``), block, tokens.

    The driver asks for the files' sizes alone; each block is read by the task that scans it, from
    any store that pyarrow opens by URI.
    """
    from pyarrow import fs

    width = np.dtype(dtype).itemsize * block_tokens
    sizes = []
    for uri in uris:
        store, path = fs.FileSystem.from_uri(uri)
        sizes.append(store.get_file_info(path).size)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for file, block in part[["file", "block"]].itertuples(index=False):
                store, path = fs.FileSystem.from_uri(uris[file])
                with store.open_input_file(path) as f:
                    yield pd.DataFrame({"file": [file], "block": [block], "tokens": [f.read_at(min(width, sizes[file] - block * width), block * width)]})

    files = spark.createDataFrame([(k, -(-n // width)) for k, n in enumerate(sizes)], "file long, n long")
    places = files.filter("n > 0").select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("block"))
    return places.repartition("file", "block").mapInPandas(run, "file long, block long, tokens binary")


def count_tokens(blocks: DataFrame, end_id: int = END_ID, dtype: str = "<u2") -> DataFrame:
    """Tokens of each document of flat streams: file, ordinal, n_tokens, ended.

    Each block is searched once, vectorised, and becomes a row of sums: tokens before its first
    separator, between separators, after its last. A prefix scan in two levels gives each block the
    documents ended before it and the tokens of the document that is open where it begins: first
    over the sums of groups of GROUP blocks, then within each group. Only sums take part in the
    scan; the counts between separators stay where they are and are numbered by a join. Tokens
    after the last separator are a document that has not ended. Empty blocks and tables give no rows.
    """

    def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for file, block, data in part[["file", "block", "tokens"]].itertuples(index=False):
                ids = np.frombuffer(data, dtype)
                at = np.flatnonzero(ids == end_id)
                head, tail = (int(at[0]), len(ids) - int(at[-1]) - 1) if len(at) else (0, len(ids))
                rows.append((file, block, len(ids), len(at), head, tail, (np.diff(at) - 1).astype(np.int64)))
            yield pd.DataFrame(rows, columns=["file", "block", "n", "n_sep", "head", "tail", "inner"])

    scanned = materialise(blocks.select("file", "block", "tokens").mapInPandas(scan, SUMMARY).withColumn("group", F.floor(F.col("block") / GROUP)), "token-sums")
    sums = scanned.select("file", "group", "block", "n_sep", "head", "tail")
    # a run begins with a block that holds separators: its tail and the blocks without any after it are open
    last = F.max(F.when(F.col("n_sep") > 0, F.col("block")))
    ends = sums.groupBy("file", "group").agg(F.sum("n_sep").alias("n_sep"), last.alias("last"))
    tails = sums.join(ends.select("file", "group", "last"), ["file", "group"]).filter(F.col("last").isNull() | (F.col("block") >= F.col("last")))
    groups = ends.join(tails.groupBy("file", "group").agg(F.sum("tail").alias("tail")), ["file", "group"])
    groups = _carried(groups, ["file"], "group", F.lit(0), F.lit(0)).select("file", "group", F.col("before").alias("group_before"), F.col("carry").alias("group_carry"))
    sums = _carried(sums.join(groups, ["file", "group"]), ["file", "group"], "block", F.col("group_before"), F.col("group_carry"))
    places = sums.select("file", "block", "before", "carry")
    counts = F.concat(F.array(F.col("carry") + F.col("head")), "inner")
    held = scanned.filter("n_sep > 0").join(places, ["file", "block"])
    ended = held.select("file", F.posexplode(counts).alias("k", "n_tokens"), "before").select("file", (F.col("before") + F.col("k")).alias("ordinal"), "n_tokens", F.lit(True).alias("ended"))
    rest = sums.groupBy("file").agg(F.max_by(F.struct((F.col("before") + F.col("n_sep")).alias("ordinal"), F.when(F.col("n_sep") > 0, F.col("tail")).otherwise(F.col("carry") + F.col("tail")).alias("n_tokens")), "block").alias("r"))
    return ended.unionByName(rest.select("file", "r.*", F.lit(False).alias("ended")).filter("n_tokens > 0"))


def _carried(sums: DataFrame, keys: list[str], order: str, before: Column, carry: Column) -> DataFrame:
    """Rows of sums with ``before`` (separators before the row) and ``carry`` (tokens open where it begins)."""
    so_far = Window.partitionBy(*keys).orderBy(order)
    ahead = so_far.rowsBetween(Window.unboundedPreceding, -1)
    rows = sums.withColumn("run", F.sum((F.col("n_sep") > 0).cast("long")).over(so_far))
    rows = rows.withColumn("open", F.sum("tail").over(Window.partitionBy(*keys, "run").orderBy(order)) + F.when(F.col("run") == 0, carry).otherwise(0))
    return rows.withColumn("before", before + F.coalesce(F.sum("n_sep").over(ahead), F.lit(0))).withColumn("carry", F.coalesce(F.lag("open").over(so_far), carry))


def document_token_counts(docs: DataFrame, tokenizer: str = f"{TOKENIZERS}/{VOCABULARY}", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens of each whole text, through flat streams and the separator scan.

    Null and empty texts have no tokens; repeated rows are counted each; a null id stays null; an
    empty table gives no rows. Other columns are ignored.
    """
    streams = materialise(write_streams(docs, tokenizer, id_col, text_col), "token-streams")
    counted = count_tokens(streams.filter(F.col("block").isNotNull()))
    order = streams.filter(F.col("block").isNull()).select("file", "first", F.posexplode("ids").alias("k", "doc_id")).select("file", (F.col("first") + F.col("k")).alias("ordinal"), F.col("doc_id").cast("long").alias("doc_id"))
    return order.join(counted, ["file", "ordinal"]).select("doc_id", "n_tokens")
