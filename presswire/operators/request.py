"""Requests and responses."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import BadRequest
from ..schemas import ARTICLE, REQUEST

ALLOWED = ("keywords", "category", "undesiredTopics", "language", "timeframe")
#: Languages that may be asked for if they are checked (fixed values).
LANGUAGES = ("en", "fr", "es", "ch", "ru")


@dataclass
class NewsRequest:
    keywords: list[str]
    category: list[str]
    undesired_topics: list[str] = field(default_factory=list)
    language: str | None = None
    start: str | None = None
    end: str | None = None
    mode: str = "intended"

    @classmethod
    def parse(cls, body: dict[str, Any] | None, mode: str = "intended", check_language: bool = False) -> NewsRequest:
        """Check a request body; ``intended`` also takes ``categories`` for ``category``."""
        if not isinstance(body, dict):
            raise BadRequest("The request has no body.")
        body = dict(body)
        if mode == "intended" and "categories" in body and "category" not in body:
            body["category"] = body.pop("categories")
        for name in body:
            if name not in ALLOWED:
                raise BadRequest(f"Filter {name} is not authorized.")

        def words(name: str, message: str | None) -> list[str]:
            got = body.get(name)
            if message and (name not in body or got == []):
                raise BadRequest(message)
            if got is None and not message:
                return []
            if not isinstance(got, list) or not all(isinstance(w, str) for w in got):
                raise BadRequest(f"{name} must be an array of strings.")
            return got

        keywords = words("keywords", "No keywords were inserted, please enter at least one.")
        category = words("category", "No categories selected, please select at least one category.")
        language, frame = body.get("language"), body.get("timeframe") or {}
        if language is not None and not isinstance(language, str):
            raise BadRequest("language must be a string.")
        if check_language and language not in (None, "") and language not in LANGUAGES:
            raise BadRequest(f"Language {language} is not authorized.")
        if not isinstance(frame, dict):
            raise BadRequest('timeframe must be an object with "start" and "end".')
        return cls(keywords, category, words("undesiredTopics", None), language, frame.get("start"), frame.get("end"), mode)


def parse_json(text: str | bytes | None) -> Any:
    """The value of a JSON body; one that is not JSON is a bad request, an empty one none."""
    try:
        return json.loads(text) if text and text.strip() else None
    except ValueError as e:
        raise BadRequest(f"The body is not JSON: {e}") from None


def parse_requests(df: DataFrame, body: str = "body") -> DataFrame:
    """``df`` with its JSON bodies as ``request`` (of the schema REQUEST); null where a body is not JSON."""
    parsed = F.from_json(F.col(body), REQUEST, {"mode": "PERMISSIVE"})
    return df.withColumn("request", F.when(F.try_parse_json(F.col(body)).isNotNull(), parsed))


#: Articles of one answer at most.
MOST_ARTICLES = 1_000


def response(articles: DataFrame, most: int = MOST_ARTICLES) -> DataFrame:
    """``totalResults, news`` in one row: the number of all articles, and ``most`` of them at most."""
    total = articles.agg(F.count(F.lit(1))).scalar()
    return articles.limit(most).agg(F.collect_list(F.struct(*ARTICLE.names)).alias("news")).select(total.alias("totalResults"), "news")


def to_json(df: DataFrame) -> DataFrame:
    """Each row as a JSON text."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("json"))
