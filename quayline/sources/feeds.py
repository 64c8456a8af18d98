"""News feeds: RSS responses and filing search results as rows of one shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ITEM = "title string, link string, pubDate string, description string"
RSS = f"channel struct<item: array<struct<{ITEM.replace(' string', ': string')}>>>"
HITS = "hits struct<hits: array<struct<_source: struct<form_type: string, entity_name: string, display_names: string, file_date: string, file_num: string>>>>"
#: fixed values: entities in the order in which they are resolved
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"))


def clean_html(text: Column) -> Column:
    """Without tags, the five entities resolved, trimmed."""
    x = F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]*>", "")
    for name, put in ENTITIES:
        x = F.replace(x, F.lit(name), F.lit(put))
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def _items(found: DataFrame, items: Column, most: int, source: Column, title: Column, date: Column, url: Column, summary: Column) -> DataFrame:
    placed = found.select("feed", F.posexplode(F.slice(items, 1, most)).alias("place", "item"))
    return placed.select("feed", "place", source.alias("source"), title.alias("title"), F.coalesce(date, F.lit("")).alias("date"), F.coalesce(url, F.lit("")).alias("url"), F.substring(summary, 1, 200).alias("summary"))


def rss_items(responses: DataFrame, source: str, most: int = 10) -> DataFrame:
    """feed, place, source, title, date, url, summary: the first ``most`` items of each RSS response (feed, body).

    A response that is no XML has no items.
    """
    parsed = responses.select("feed", F.from_xml("body", RSS, {"mode": "PERMISSIVE"}).alias("rss")).filter("rss.channel.item IS NOT NULL")
    of = lambda name: F.col(f"item.{name}")
    return _items(parsed, F.col("rss.channel.item"), most, F.lit(source), clean_html(of("title")), of("pubDate"), of("link"), clean_html(of("description")))


def filing_items(responses: DataFrame, source: str, most: int = 10) -> DataFrame:
    """The same of filing search results in JSON (feed, the ticker asked for, and body)."""
    parsed = responses.select("feed", F.from_json("body", HITS).alias("r")).filter("r.hits.hits IS NOT NULL")
    own = lambda name, otherwise=None: F.coalesce(F.col(f"item._source.{name}"), *([otherwise] if otherwise is not None else []))
    title = F.concat_ws(" — ", own("form_type", F.lit("Filing")), own("entity_name", F.coalesce(F.col("item._source.display_names"), F.col("feed"))))
    url = F.concat(F.lit("https://www.sec.gov/cgi-bin/browse-edgar?action=getcompany&CIK="), F.col("feed"), F.lit("&type=&dateb=&owner=include&count=10"))
    summary = F.concat(F.lit("Form "), own("form_type", F.lit("")), F.lit(" filed on "), own("file_date", F.lit("")), F.lit(". File #"), own("file_num", F.lit("N/A")))
    return _items(parsed, F.col("r.hits.hits"), most, F.lit(source), title, own("file_date", F.lit("")), url, summary)


def read_rss(spark: SparkSession, path: str) -> DataFrame:
    """Items of RSS files, one row each, whatever the number of files; malformed items are dropped."""
    rows = spark.read.format("xml").option("rowTag", "item").option("mode", "DROPMALFORMED").schema(ITEM).load(path)
    return rows.select(clean_html(F.col("title")).alias("title"), F.col("pubDate").alias("date"), F.col("link").alias("url"), F.substring(clean_html(F.col("description")), 1, 200).alias("summary"))


def newest_first(*feeds: DataFrame) -> DataFrame:
    """All feeds' items with their time, null where the date can't be read: latest first when ordered by it."""
    out = feeds[0]
    for more in feeds[1:]:
        out = out.unionByName(more)
    day = F.regexp_replace("date", r"^[A-Za-z]{3},\s*", "")  # the weekday says nothing more
    stamp = F.coalesce(F.try_to_timestamp(day, F.lit("d MMM yyyy HH:mm:ss z")), F.try_to_timestamp(day, F.lit("yyyy-MM-dd")))
    return out.withColumn("time", stamp)
