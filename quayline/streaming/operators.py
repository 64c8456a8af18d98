"""Structured Streaming variants: live bars, de-duplication within a time to live, an append-only sink."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quayline.functions import suppression


def live_bars(ticks: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """OHLCV bars of a tick stream (symbol, ts, price, volume, seq) by event time.

    A bar is final when the watermark passes its end; later ticks are dropped. State is one bar for
    each open window and symbol.
    """
    order = F.struct("ts", "seq")
    return (
        ticks.withWatermark("ts", late)
        .groupBy("symbol", F.window("ts", width))
        .agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("volume").alias("volume"))
        .select("symbol", F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume")
    )


def dedupe_within(events: DataFrame, keys: list[str], ttl: str = "20 minutes") -> DataFrame:
    """The first of the events with equal keys within the time to live, which is not extended."""
    return events.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(keys)


def _in_time(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """A group's new rows of one trigger, by time."""
    return pd.concat(list(batches)).sort_values(["ts", "seq"], kind="stable")


def dedupe_capped(events: DataFrame, group: str, key: str, ttl_seconds: int = 1200, most: int = 5000) -> DataFrame:
    """group, key, ts, seq of the events (with those columns) whose key is not among the group's recent ones.

    A key is remembered for its time to live, which a repetition does not extend, and no more than
    ``most`` of them are: beyond, the oldest is forgotten. State is that list alone.
    """
    kinds = [f"{c} {events.schema[c].dataType.simpleString()}" for c in (group, key, "ts", "seq")]

    def run(_, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = _in_time(batches)
        seen = dict(json.loads(state.get[0])) if state.exists else {}  # in order of arrival
        fresh = []
        for k, at in zip(rows[key].astype(str), rows["ts"].map(pd.Timestamp.timestamp)):
            for old in list(seen):
                if seen[old] >= at - ttl_seconds and len(seen) <= most:
                    break
                del seen[old]
            fresh.append(k not in seen)
            seen.setdefault(k, at)
        state.update((json.dumps(list(seen.items())),))
        yield rows[fresh][[group, key, "ts", "seq"]]

    return events.select(group, key, "ts", "seq").groupBy(group).applyInPandasWithState(run, ", ".join(kinds), "seen string", "append", GroupStateTimeout.NoTimeout)


def drained_history(messages: DataFrame, most: int = 50) -> DataFrame:
    """group_id, ts, seq, body and history of every message that triggers: what its group said since the one before.

    ``messages`` has group_id, ts, seq, sender, body, triggers. A group keeps its last ``most``
    messages; a trigger takes them all.
    """
    out = "group_id string, ts timestamp, seq long, body string, history array<struct<sender:string,body:string>>"

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, made = json.loads(state.get[0]) if state.exists else [], []
        for r in _in_time(batches).itertuples(index=False):
            if r.triggers:
                made.append((key[0], r.ts, r.seq, r.body, [{"sender": s, "body": b} for s, b in held]))
                held = []
            else:
                held = [*held, (r.sender, r.body)][-most:]
        state.update((json.dumps(held),))
        yield pd.DataFrame(made, columns=["group_id", "ts", "seq", "body", "history"])

    picked = messages.select(F.col("group_id").cast("string"), "ts", F.col("seq").cast("long"), "sender", "body", "triggers")
    return picked.groupBy("group_id").applyInPandasWithState(run, out, "held string", "append", GroupStateTimeout.NoTimeout)


def suppressed(messages: DataFrame, window_seconds: int = suppression.WINDOW_SECONDS) -> DataFrame:
    """channel, ts, seq, cleaned, reason of every message (channel, ts, seq, text); reason ``none`` is sent.

    A message is suppressed by itself (empty, ok-token, no-action) or as a duplicate of the last one that the
    channel was sent within the window. State is that one message.
    """
    out = "channel string, ts timestamp, seq long, cleaned string, reason string"

    def run(_, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, at = state.get if state.exists else (None, 0.0)
        rows = _in_time(batches)
        reasons = []
        for cleaned, reason, ts in zip(rows["cleaned"], rows["reason"], rows["ts"]):
            now = ts.timestamp()
            if reason == "none" and cleaned == last and now - at < window_seconds:
                reason = "duplicate"
            elif reason == "none":
                last, at = cleaned, now
            reasons.append(reason)
        if last is not None:
            state.update((last, at))
        yield rows.assign(reason=reasons)[["channel", "ts", "seq", "cleaned", "reason"]]

    told = messages.withColumn("_j", suppression.judged(F.col("text"))).select(F.col("channel").cast("string"), "ts", F.col("seq").cast("long"), "_j.cleaned", "_j.reason")
    return told.groupBy("channel").applyInPandasWithState(run, out, "text string, at double", "append", GroupStateTimeout.NoTimeout)


def quiet_periods(changes: DataFrame, key: str, gap: str = "1500 milliseconds") -> DataFrame:
    """One row for each burst of changes that a quiet period ends: when to re-index."""
    return changes.withWatermark("ts", gap).groupBy(key, F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("changes")).select(key, F.col("session_window.end").alias("at"), "changes")


def append_snapshots(snapshots: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append each snapshot row as JSON under its month; runs through what is there, then stops."""
    rows = snapshots.withColumn("month", F.date_format("ts", "yyyy-MM"))
    return rows.writeStream.format("json").partitionBy("month").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
