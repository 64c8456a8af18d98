"""A set of 64-bit hashes as a bit array of fixed size, built in the tasks.

A value that is in the set always passes; others pass by chance, more often the fuller the array.
What passes has to be joined exactly afterwards, so the size bounds memory, never the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 26  # 8 MB
CHUNK = 1 << 16  # bytes


def build(df: DataFrame, hash_col: str, bits: int) -> np.ndarray:
    """The bits of df's hashes; what reaches the driver is the array itself."""

    def mark(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine = np.zeros(bits // 8, np.uint8)
        for part in parts:
            h = part[hash_col].to_numpy().view(np.uint64)
            at = h % np.uint64(bits)
            np.bitwise_or.at(mine, (at >> np.uint64(3)).astype(np.int64), (1 << (at & np.uint64(7))).astype(np.uint8))
        rows = [(k, mine[k * CHUNK : (k + 1) * CHUNK].tobytes()) for k in range(-(-len(mine) // CHUNK))]
        yield pd.DataFrame([r for r in rows if any(r[1])], columns=["chunk", "bits"])

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        out = np.frombuffer(part["bits"].iloc[0], np.uint8).copy()
        for more in part["bits"].iloc[1:]:
            out |= np.frombuffer(more, np.uint8)
        return pd.DataFrame({"chunk": part["chunk"].iloc[:1], "bits": [out.tobytes()]})

    kind = "chunk int, bits binary"
    merged = df.select(hash_col).mapInPandas(mark, kind).groupBy("chunk").applyInPandas(merge, kind).toPandas()
    out = np.zeros(bits // 8, np.uint8)
    for chunk, part in merged.itertuples(index=False):
        out[chunk * CHUNK : chunk * CHUNK + len(part)] = np.frombuffer(part, np.uint8)
    return out


def passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes may be in the set."""
    at = hashes % np.uint64(len(bits) * 8)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def may_hold(keys: DataFrame, bits: int = BITS):
    """A test of key columns against the one column of ``keys``: true for all of them and a few others."""
    name = keys.columns[0]
    held = keys.sparkSession.sparkContext.broadcast(build(keys.select(F.xxhash64(name).alias("h")), "h", bits))
    test = F.pandas_udf(lambda h: pd.Series(passes(held.value, h.to_numpy(dtype=np.int64).view(np.uint64))), "boolean")
    return lambda key: key.isNotNull() & test(F.xxhash64(key))


def split(df: DataFrame, key: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """df in two: the rows whose key cannot be in ``keys``, which need no join, and the rest."""
    test = may_hold(keys)
    return df.filter(~test(key)), df.filter(test(key))
