"""File-shaped sources with fixed schemas; malformed lines are dropped, nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayline.functions.numeric import finite
from quayline.functions.text import maturity, us_date

JOURNAL = (
    "id string, openedAt string, symbol string, direction string, horizon string, strategy string, entry double, stop double, target double, size double, thesis string, "
    "confidence double, status string, closedAt string, exit double, resultR double, resultPercent double, outcome string, lesson string"
)
SNAPSHOT = "at string, asset string, venue string, oiCoins double, oiUsd double, funding8h double"
FUNDING = "symbol string, time long, rate string"


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """Trade journal lines; a corrupt line is dropped."""
    return spark.read.schema(JOURNAL).option("mode", "DROPMALFORMED").json(path)


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Open-interest snapshots with their time and month."""
    return spark.read.schema(SNAPSHOT).option("mode", "DROPMALFORMED").json(path).withColumn("ts", F.to_timestamp("at"))


def read_funding(spark: SparkSession, path: str) -> DataFrame:
    """Funding prints with finite rates."""
    f = spark.read.schema(FUNDING).json(path).withColumn("rate", finite("rate"))
    return f.filter("rate IS NOT NULL").withColumn("ts", F.timestamp_millis("time"))


def read_curve(spark: SparkSession, path: str) -> DataFrame:
    """Yield curve CSV with quoted maturity headers as rows: day, maturity, value; empty cells are dropped."""
    wide = spark.read.csv(path, header=True, quote='"')
    names = [c for c in wide.columns if c.lower() != "date"]
    long = wide.select(us_date("Date").alias("day"), *names).unpivot(["day"], names, "label", "value")
    return long.select("day", maturity("label").alias("maturity"), finite("value").alias("value")).filter("value IS NOT NULL")


def read_quoted_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV whose quoted fields may hold line breaks and doubled quotes."""
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, quote='"', escape='"')
