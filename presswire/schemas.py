"""Schemas of the data model."""

from pyspark.sql import types as T

_text = T.StringType()


def _struct(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, _text) for n in names])


CATALOGUE = T.StructType([T.StructField("lang", _text), T.StructField("category", _text), T.StructField("pos", T.IntegerType()), T.StructField("url", _text)])

CATEGORY = T.ArrayType(_struct("_VALUE", "_domain"))

#: What is read of a feed. Attributes have the prefix "_", the text beside them is "_VALUE".
FEED = T.StructType(
    [
        T.StructField(
            "channel",
            T.StructType(
                [
                    T.StructField(
                        "item",
                        T.ArrayType(
                            T.StructType(
                                [
                                    T.StructField("title", _text),
                                    T.StructField("link", T.ArrayType(_text)),
                                    T.StructField("pubDate", _text),
                                    T.StructField("description", _text),
                                    T.StructField("category", CATEGORY),
                                    T.StructField("media:thumbnail", T.ArrayType(_struct("_url"))),
                                    T.StructField("media:content", T.ArrayType(_struct("_url"))),
                                ]
                            )
                        ),
                    )
                ]
            ),
        )
    ]
)

ITEM = T.StructType([*_struct("title", "thumbnail", "link", "pubDate", "description").fields, T.StructField("category", CATEGORY)])

CRAWL_REQUEST = T.StructType([T.StructField("url", _text), T.StructField("userData", _struct("thumbnail"))])

ARTICLE = _struct("url", "thumbnail", "source", "publishedAt", "title", "author", "lang", "description", "content")

RESPONSE = T.StructType([T.StructField("totalResults", T.LongType()), T.StructField("news", T.ArrayType(ARTICLE))])

REQUEST = T.StructType(
    [
        T.StructField("keywords", T.ArrayType(_text)),
        T.StructField("category", T.ArrayType(_text)),
        T.StructField("undesiredTopics", T.ArrayType(_text)),
        T.StructField("language", _text),
        T.StructField("timeframe", _struct("start", "end")),
    ]
)

CHAT = T.ArrayType(_struct("role", "content"))
