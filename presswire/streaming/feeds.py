"""Feeds as a stream (beyond the batch requests): files of feed XML as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import pub_date, url_key
from ..operators.match import keyword_match, linked
from ..sources.rss import items


def read_feeds(spark: SparkSession, path: str) -> DataFrame:
    """A stream of ``body``, one for each file that appears in ``path``."""
    return spark.readStream.format("text").option("wholetext", True).load(path).withColumnRenamed("value", "body")


def new_items(feeds: DataFrame, late: str = "7 days") -> DataFrame:
    """Items with a link and a date, each link once within the watermark."""
    i = linked(items(feeds)).withColumn("published", pub_date(F.col("pubDate"))).where("published is not null")
    return i.withColumn("url_key", url_key(F.col("link"))).withWatermark("published", late).dropDuplicatesWithinWatermark(["url_key"])


def alerts(feeds: DataFrame, keywords: list[str], late: str = "7 days") -> DataFrame:
    """New items that match keywords."""
    return keyword_match(new_items(feeds, late), keywords)


def counts(events: DataFrame, time: str = "ts", kind: str = "event_type", every: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events of each kind in each window of time."""
    return events.withWatermark(time, late).groupBy(F.window(time, every), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), kind, "n")
