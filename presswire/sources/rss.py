"""Feed XML to items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import trim
from ..schemas import FEED


def items(feeds: DataFrame, body: str = "body", keep: tuple[str, ...] = (), mode: str = "intended") -> DataFrame:
    """One row for each item of each feed: ``title, thumbnail, link, pubDate, description,
    category`` after the columns ``keep`` of the feed.

    Null, malformed and item-less bodies and other formats (Atom) have no items. The thumbnail
    is the last of the thumbnails, or else of the media contents. ``compat`` drops feeds with a
    single item.
    """
    parsed = feeds.select(*keep, F.from_xml(F.col(body), FEED, {"mode": "PERMISSIVE"}).alias("r")).select(*keep, F.col("r.channel.item").alias("items"))
    if mode == "compat":
        parsed = parsed.where(F.size("items") > 1)
    i = F.col("i")
    media = F.coalesce(F.filter(i["media:thumbnail"], lambda x: x.isNotNull()), F.filter(i["media:content"], lambda x: x.isNotNull()))
    return parsed.select(*keep, F.explode("items").alias("i")).select(
        *keep,
        F.coalesce(i["title"], F.lit("")).alias("title"),
        F.try_element_at(media, F.lit(-1))["_url"].alias("thumbnail"),
        F.try_element_at(F.filter(i["link"], lambda x: trim(x) != ""), F.lit(1)).alias("link"),
        i["pubDate"].alias("pubDate"),
        F.coalesce(i["description"], F.lit("")).alias("description"),
        i["category"].alias("category"),
    )


ATOM = "struct<entry:array<struct<title:string,link:array<struct<_href:string>>,published:string,summary:string>>>"


def atom_items(feeds: DataFrame, body: str = "body") -> DataFrame:
    """Items of Atom feeds, in the same columns (beyond the RSS feeds that are asked for)."""
    e = F.col("e")
    parsed = feeds.select(F.from_xml(F.col(body), ATOM, {"mode": "PERMISSIVE"}).alias("r"))
    return parsed.select(F.explode("r.entry").alias("e")).select(
        F.coalesce(e["title"], F.lit("")).alias("title"),
        F.lit(None).cast("string").alias("thumbnail"),
        F.try_element_at(e["link"], F.lit(1))["_href"].alias("link"),
        e["published"].alias("pubDate"),
        F.coalesce(e["summary"], F.lit("")).alias("description"),
        F.lit(None).cast("array<struct<_VALUE:string,_domain:string>>").alias("category"),
    )
