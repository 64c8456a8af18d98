"""Streams give what the batch over the same rows gives."""

from pyspark.sql import functions as F

from quayline.operators import bars
from quayline.streaming import operators as live

SF = "/root/testdata/sf0.001"


def ticks(df):
    return df.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), F.lit(1.0).alias("volume"), F.col("event_id").alias("seq"))


def drained(spark, df, name, tmp_path, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_live_bars_equal_batch_bars(spark, tmp_path):
    batch = spark.read.parquet(f"{SF}/events.parquet")
    source = tmp_path / "in"
    batch.orderBy("ts").coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema(batch.schema).parquet(str(source))
    got = {(r["symbol"], r["ts"]): tuple(r)[2:] for r in drained(spark, live.live_bars(ticks(stream)), "live", tmp_path).collect()}
    want = bars.bars_from_ticks(ticks(batch).withColumn("hour", F.date_trunc("hour", "ts")), ["symbol", "hour"], F.struct("ts", "seq"))
    want = {(r["symbol"], r["hour"]): tuple(r)[2:] for r in want.collect()}
    assert got and all(want[k] == v for k, v in got.items())
    assert len(want) - len(got) <= 10  # the last windows stay open


def test_duplicates_within_the_time_to_live(spark, tmp_path):
    rows = spark.range(40).select((F.col("id") % 10).alias("id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 10).alias("ts"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    assert drained(spark, live.dedupe_within(stream, ["id"]), "once", tmp_path).count() == 10


def test_snapshots_are_appended_by_month(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1.0)], "asset string, oi double").withColumn("ts", F.to_timestamp(F.lit("2026-03-05 00:00:00")))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    live.append_snapshots(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert spark.read.json(str(tmp_path / "out")).select("month").first()[0] == "2026-03"


def run_in_two(spark, df_rows, schema, make, name, tmp_path):
    """The stream over two files, the second after a restart from the checkpoint."""
    out = []
    for k, rows in enumerate(df_rows):
        spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("at")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(f"{schema}, ts timestamp").parquet(str(tmp_path / "in"))
        q = make(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(120) and q.exception() is None
    return spark.read.parquet(str(tmp_path / "out"))


def test_capped_duplicates_are_forgotten_by_age_and_number(spark, tmp_path):
    first = [("g", "a", 0, 1), ("g", "a", 5, 2), ("g", "b", 6, 3), ("h", "a", 7, 4)]
    second = [("g", "a", 8, 5), ("g", "a", 2000, 6), ("g", "c", 2001, 7), ("g", "d", 2002, 8), ("g", "e", 2003, 9), ("g", "a", 2004, 10), ("g", "e", 2005, 11)]
    got = run_in_two(spark, [first, second], "grp string, key string, at long, seq long", lambda s: live.dedupe_capped(s, "grp", "key", 1200, 3), "capped", tmp_path)
    # 5 repeats after the restart; 6 is too old; by 10 a was pushed out by c, d, e; 11 repeats
    assert sorted(r["seq"] for r in got.collect()) == [1, 3, 4, 6, 7, 8, 9, 10]


def test_history_is_kept_short_and_drained(spark, tmp_path):
    talk = lambda ks, t=False: [("g", k, k, f"s{k}", f"b{k}", t) for k in ks]
    rows = [talk(range(5)), talk(range(5, 7)) + talk([7], True) + talk([8]) + talk([9], True) + [("h", 9, 10, "x", "y", True)]]
    got = run_in_two(spark, rows, "group_id string, at long, seq long, sender string, body string, triggers boolean", lambda s: live.drained_history(s, 4), "drain", tmp_path)
    assert {r["seq"]: [h["body"] for h in r["history"]] for r in got.collect()} == {7: ["b3", "b4", "b5", "b6"], 9: ["b8"], 10: []}


def test_messages_that_say_nothing_new(spark, tmp_path):
    day = 86_400
    first = [("c", 0, 1, " "), ("c", 1, 2, "**HEARTBEAT_OK**."), ("c", 2, 3, "HEARTBEAT_OK all calm"), ("c", 3, 4, "all calm"), ("d", 3, 5, "all calm"), ("c", 4, 6, "There is Nothing to report.")]
    second = [("c", 10, 7, "all calm HEARTBEAT_OK!"), ("c", 11, 8, "a new thing"), ("c", 12, 9, "all calm"), ("c", 12 + day, 10, "all calm"), ("c", 13 + day, 11, "all calm"), ("c", 14 + day, 12, None)]
    got = run_in_two(spark, [first, second], "channel string, at long, seq long, text string", live.suppressed, "hush", tmp_path)
    want = {1: "empty", 2: "ok-token", 3: "none", 4: "duplicate", 5: "none", 6: "no-action", 7: "duplicate", 8: "none", 9: "none", 10: "none", 11: "duplicate", 12: "empty"}
    assert {r["seq"]: r["reason"] for r in got.collect()} == want
    assert {r["seq"]: r["cleaned"] for r in got.collect() if r["seq"] in (2, 3, 7)} == {2: "", 3: "all calm", 7: "all calm"}


def test_quiet_periods_end_bursts(spark, tmp_path):
    rows = [("f", t, t) for t in (0, 1, 2, 60, 61, 200)]
    got = run_in_two(spark, [rows[:3], rows[3:]], "file string, at long, seq long", lambda s: live.quiet_periods(s, "file", "10 seconds"), "quiet", tmp_path)
    assert sorted((int(r["at"].timestamp()), r["changes"]) for r in got.collect()) == [(12, 3), (71, 2)]
