"""From a request to its articles."""

from __future__ import annotations

import logging
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.readability import articles
from ..functions.summary import summarize
from ..functions.text import BLANK_CHARACTERS, pub_date, url_key
from ..operators import match
from ..operators.request import MOST_ARTICLES, NewsRequest
from ..sources import catalogue, http, rss

log = logging.getLogger(__name__)

#: What makes two URLs the same page.
Key = Callable[[Column], Column]


def matched_items(items: DataFrame, request: NewsRequest) -> DataFrame:
    """The items whose pages are wanted. ``intended``: those that match and pass the other
    filters. ``compat``: all with a link if any item matches."""
    hits = match.keyword_match(items, request.keywords, request.mode)
    if request.mode == "compat":
        return match.gate(match.linked(items), hits)
    hits = match.without_topics(match.linked(hits), request.undesired_topics, ("title",), "category")
    return match.in_timeframe(hits, pub_date(F.col("pubDate")), request.start, request.end)


def wanted_pages(items: DataFrame, request: NewsRequest, link_key: Key = url_key) -> DataFrame:
    """``key, url, thumbnail`` of wanted items, one row for each URL key: of items with one key
    that with the smallest link, and among these one with a thumbnail, the smallest."""
    asked = match.crawl_requests(matched_items(items, request)).select("url", F.col("userData.thumbnail").alias("thumbnail"))
    order = F.struct("url", F.col("thumbnail").isNull(), "thumbnail")
    one = asked.groupBy(link_key(F.col("url")).alias("key")).agg(F.min_by(F.struct("url", "thumbnail"), order).alias("r"))
    return one.select("key", "r.url", "r.thumbnail")


def find_articles(items: DataFrame, pages: DataFrame, request: NewsRequest, link_key: Key = url_key, page_key: Key = url_key, open_references: bool = True) -> DataFrame:
    """Articles of wanted items, with the items' links and thumbnails. ``pages``: ``url, html``,
    stored pages, which items find by URL key; of pages with one key that with
    the smallest url, and among these the smallest text. ``link_key`` and ``page_key``: the keys of
    links and of stored pages, where fewer or other URLs are the same than by :func:`url_key`.
    ``open_references``: see :func:`articles`."""
    wanted = wanted_pages(items, request, link_key)
    p = pages.select(page_key(F.col("url")).alias("key"), F.col("url").alias("page"), "html").join(wanted, "key")
    found = p.groupBy("key").agg(F.min_by(F.struct("url", "thumbnail", "html"), F.struct("page", "html")).alias("r")).select("r.*")
    return _speaking(articles(found, open_references), request)


def fetch_articles(items: DataFrame, request: NewsRequest, transport: http.Transport = http.urlopen) -> DataFrame:
    """Articles of wanted items; their pages are fetched. Pages that fail are left out."""
    fetched = http.fetch(wanted_pages(items, request).select("url", "thumbnail"), transport, to="html")
    return _speaking(articles(http.split_failures(fetched)[0]), request)


def _speaking(found: DataFrame, request: NewsRequest) -> DataFrame:
    """``intended`` keeps the articles in the request's language and those without one."""
    if request.mode != "intended" or not request.language:
        return found
    return found.where((F.col("lang") == "") | match.speaks(F.col("lang"), request.language))


def get_news(
    spark: SparkSession,
    body: dict[str, Any] | None,
    feeds: DataFrame | None = None,
    pages: DataFrame | None = None,
    mode: str = "intended",
    summary: bool = False,
    transport: http.Transport = http.urlopen,
    most: int = MOST_ARTICLES,
) -> dict[str, Any] | list:
    """Answer a request. ``feeds`` (``url, body``) and ``pages`` (``url, html``) are tables of what
    is stored; without them the feeds of the request's categories, and then the pages of matching
    items, are fetched by ``transport``. Without a match the answer is ``[]``. ``totalResults``
    counts all articles; ``news`` has ``most`` of them at most. For the articles as a table see
    :func:`find_articles`."""
    request = NewsRequest.parse(body, mode)
    lang = request.language or "en" if mode == "intended" else "en"
    urls = catalogue.category_links(spark, request.category, lang=lang if lang in catalogue.FEEDS else "en")
    if not request.keywords[0].strip(BLANK_CHARACTERS):
        return []
    wanted = spark.createDataFrame([(u,) for u in dict.fromkeys(urls)], "url string")
    own = http.split_failures(http.fetch(wanted, transport, to="body"))[0] if feeds is None else feeds.join(F.broadcast(wanted), "url", "left_semi")
    items = rss.items(own, mode=mode).persist()
    try:
        if match.keyword_match(items, request.keywords, mode).isEmpty():
            log.info("no item of %d feeds matches", len(urls))
            return []
        found = fetch_articles(items, request, transport) if pages is None else find_articles(items, pages, request)
        found = found.persist()
        try:
            some = found.limit(most)
            rows = (summarize(some) if summary else some).collect()
            return {"totalResults": found.count(), "news": [r.asDict(recursive=True) for r in rows]}
        finally:
            found.unpersist()
    finally:
        items.unpersist()
