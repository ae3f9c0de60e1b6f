"""The feed catalogue and its lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import NoCategory, UnknownCategories
from ..schemas import CATALOGUE

#: Feeds by language and category, in order (fixed values).
FEEDS = {
    "en": {
        "world": [
            "https://rss.nytimes.com/services/xml/rss/nyt/HomePage.xml",
            "https://rss.nytimes.com/services/xml/rss/nyt/World.xml",
            "https://abcnews.go.com/abcnews/internationalheadlines",
            "https://www.youtube.com/feeds/videos.xml?playlist_id=PLQOa26lW-uI9Ja7WDOHBJecZXTC9fm__C",
        ],
        "press": [
            "https://www.404media.co/rss/",
            "https://abcnews.go.com/abcnews/internationalheadlines",
        ],
        "sport": [
            "https://www.wfmz.com/search/?f=rss&t=article&c=sports&l=50&s=start_time&sd=desc",
            "https://abcnews.go.com/abcnews/sportsheadlines",
        ],
    }
}


def catalogue(spark: SparkSession, feeds: dict[str, dict[str, list[str]]] | None = None) -> DataFrame:
    """``lang, category, pos, url``."""
    rows = [(lang, c, i, u) for lang, by in (FEEDS if feeds is None else feeds).items() for c, urls in by.items() for i, u in enumerate(urls)]
    return spark.createDataFrame(rows, CATALOGUE)


def requested(spark: SparkSession, categories: list[str]) -> DataFrame:
    """``req_pos, req``: the requested categories in order; they come with a request, so they are few."""
    return spark.createDataFrame(list(enumerate(categories)), "req_pos int, req string")


def links(req: DataFrame, feeds: DataFrame, lang: str = "en") -> DataFrame:
    """``req_pos, pos, category, url`` of the feeds of requested categories, case ignored; a
    category asked for twice gives its feeds twice. The request's side is broadcast."""
    f = feeds.where(F.col("lang") == lang)
    return f.join(F.broadcast(req), F.lower("req") == F.col("category")).select("req_pos", "pos", "category", "url")


def missing(req: DataFrame, feeds: DataFrame, lang: str = "en") -> DataFrame:
    """``req_pos, req`` of the requested categories that have no feed."""
    return req.join(feeds.where(F.col("lang") == lang), F.lower("req") == F.col("category"), "left_anti")


def category_links(spark: SparkSession, categories: list[str] | None, feeds: DataFrame | None = None, lang: str = "en") -> list[str]:
    """Feed URLs of the categories in the order asked for. It fails if there are no categories
    or none of them has a feed; unknown ones among others are passed over."""
    if not categories:
        raise NoCategory("No categories selected, please select a category.")
    feeds, req = catalogue(spark) if feeds is None else feeds, requested(spark, categories)
    urls = [r.url for r in links(req, feeds, lang).orderBy("req_pos", "pos").collect()]
    if not urls:
        names = missing(req, feeds, lang).agg(F.expr("listagg(req, ', ') within group (order by req_pos)")).first()[0]
        raise UnknownCategories(f"None of theses categories were found: {names}")
    return urls
