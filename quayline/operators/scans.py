"""Ranks and running sums in one order: range partitions and what they carry on, no window that holds a group in one task."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayline.storage import materialise

_WITHIN = 33  # bits of monotonically_increasing_id that count within a partition


def _placed(df: DataFrame, by: Sequence[Column | str]) -> DataFrame:
    """df in range partitions of the order ``by``, as many as the session shuffles into."""
    return df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by).sortWithinPartitions(*by)


def ranked(df: DataFrame, by: Sequence[Column | str], name: str, label: str) -> DataFrame:
    """df with its rank from 1 in the order ``by``; equal rows get ranks in any order.

    A key that a third of all rows share is spread over parts as long as later columns of ``by``
    tell its rows apart.
    """
    kept = materialise(_placed(df, by).withColumn("_id", F.monotonically_increasing_id()), label)
    kept = kept.withColumn("_part", F.shiftright("_id", _WITHIN)).withColumn("_at", F.col("_id").bitwiseAND((1 << _WITHIN) - 1))
    counts = sorted(kept.groupBy("_part").count().collect())  # one row a range partition
    starts = [0, *accumulate(n for _, n in counts)]
    before = df.sparkSession.createDataFrame([(int(p), int(s)) for (p, _), s in zip(counts, starts)], "_part long, _before long")
    return kept.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before", "_id")


def _sums(batches: Iterator[pd.DataFrame], group: str, values: Sequence[str]) -> Iterator[pd.DataFrame]:
    """Running sums of one part's rows, which come by group and in order."""
    last, carry, at = None, np.zeros(len(values), np.int64), 0
    for batch in batches:
        if not len(batch):
            continue
        g, v = batch[group].to_numpy(), batch[list(values)].to_numpy(np.int64)
        begins = np.r_[g[0] != last, g[1:] != g[:-1]]
        starts = np.flatnonzero(np.r_[True, begins[1:]])
        run = np.cumsum(v, axis=0)
        run -= np.repeat(run[starts] - v[starts], np.diff(np.r_[starts, len(g)]), axis=0)
        if not begins[0]:
            run[: starts[1] if len(starts) > 1 else len(g)] += carry
        yield batch.assign(_at=np.arange(at, at + len(g)), **{f"run_{c}": run[:, k] for k, c in enumerate(values)})
        last, carry, at = g[-1], run[-1], at + len(g)


def running_sums(df: DataFrame, group: str, order: Sequence[Column | str], values: Sequence[str], keep: Sequence[str], label: str) -> DataFrame:
    """The columns ``keep`` with run_<value>: the sum of each of ``values`` over the group's rows up to this one.

    Groups are not null, values whole numbers. The rows lie in range partitions of (group, order), so a group may
    reach over many of them; each is summed for itself, and one row a partition carries sums on.
    """
    cols = list(dict.fromkeys([group, *values, *keep]))
    placed = _placed(df, [group, *order]).select(*cols, F.spark_partition_id().alias("_part"))
    runs = [f"run_{c}" for c in values]
    schema = T.StructType([*placed.schema.fields, *(T.StructField(c, T.LongType()) for c in ("_at", *runs))])
    kept = materialise(placed.mapInPandas(partial(_sums, group=group, values=values), schema), label)

    ends = kept.groupBy("_part").agg(F.min_by(group, "_at"), F.max_by(group, "_at"), *[F.max_by(c, "_at") for c in runs])
    carried, last, sums = [], None, [0] * len(runs)
    for part, first, now, *own in sorted(ends.collect()):  # one row a range partition
        if first == last:
            carried.append((part, first, *sums))
        sums = [a + b for a, b in zip(sums, own)] if first == last == now else own
        last = now
    names = [f"_more{k}" for k in range(len(runs))]
    kinds = [("_part", T.IntegerType()), ("_of_group", df.schema[group].dataType), *((c, T.LongType()) for c in names)]
    more = df.sparkSession.createDataFrame(carried, T.StructType([T.StructField(*k) for k in kinds]))
    whole = kept.join(F.broadcast(more), (kept["_part"] == more["_part"]) & (kept[group] == more["_of_group"]), "left")
    return whole.select(*keep, *[(F.col(r) + F.coalesce(F.col(m), F.lit(0))).alias(r) for r, m in zip(runs, names)])
