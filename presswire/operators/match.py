"""Matching items with keywords, topics, languages and times."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import NUMERIC_TITLE, SINGLE_CATEGORY, BadRequest
from ..functions.text import BLANK_CHARACTERS, contains_any

#: Keywords up to which a predicate of literals is used; beyond, a semi join with their table.
LITERALS = 32
#: Keywords of a request at most: their table is broadcast.
MOST_KEYWORDS = 100_000


def _blank(word: str) -> bool:
    return not word.strip(BLANK_CHARACTERS)


def _has(word: str):
    return lambda v: F.contains(v, F.lit(word))


def _values(category: Column, mode: str) -> Column:
    """The category texts that can match. ``compat``: those without attributes, and an item
    whose only category has attributes is an error."""
    if mode == "compat":
        plain = F.filter(category, lambda c: c["_domain"].isNull())
        single = (F.size(category) == 1) & (F.size(plain) == 0)
        plain = F.when(single, F.raise_error(F.lit(SINGLE_CATEGORY)).cast("array<struct<_VALUE:string,_domain:string>>")).otherwise(plain)
        return F.transform(plain, lambda c: F.lower(c["_VALUE"]))
    return F.transform(category, lambda c: F.lower(c["_VALUE"]))


def keyword_match(items: DataFrame, keywords: list[str], mode: str = "intended", description: bool = False, title: str = "title", category: str = "category", literals: int = LITERALS) -> DataFrame:
    """Items whose title or one of whose categories contains a keyword, case ignored.

    A blank first keyword matches nothing. ``intended`` leaves other blank keywords out and tests
    items without categories too; ``compat`` lets a blank keyword match everything, skips items
    without categories, sees only categories without attributes, and fails (see :class:`ItemError`)
    on an item with categories whose title is a number or whose only category has attributes.
    ``description`` tests the description as well.
    """
    if len(keywords) > MOST_KEYWORDS:
        raise BadRequest(f"{len(keywords)} keywords; {MOST_KEYWORDS} are allowed.")
    if not keywords or _blank(keywords[0]):
        return items.limit(0)
    words = [k.lower() for k in keywords if mode == "compat" or not _blank(k)]
    has = F.col(category).isNotNull() & (F.size(category) > 0)
    if mode == "compat":
        number = F.col(title).rlike(r"^\s*[-+]?\d+(\.\d+)?\s*$")
        items = items.where(has & F.when(number, F.raise_error(F.lit(NUMERIC_TITLE)).cast("boolean")).otherwise(F.lit(True)))
    texts = [F.lower(F.col(c)) for c in (title, *(["description"] if description else []))]
    values = _values(F.col(category), mode)
    if len(words) <= literals:
        found = F.lit(False)
        for w in words:
            for t in texts:
                found = found | F.coalesce(F.contains(t, F.lit(w)), F.lit(False))
            found = found | F.coalesce(F.exists(values, _has(w)), F.lit(False))
        return items.where(found)
    table = items.sparkSession.createDataFrame([(w,) for w in sorted(set(words))], "__word string")
    word, lowered = F.col("__word"), {f"__text{i}": t for i, t in enumerate(texts)}
    # what is compared is made once for each row, not for each pair
    made = items.withColumns({**lowered, "__values": values})
    on = F.coalesce(F.exists("__values", lambda v: F.contains(v, word)), F.lit(False))
    for t in lowered:
        on = on | F.coalesce(F.contains(F.col(t), word), F.lit(False))
    return made.join(F.broadcast(table), on, "left_semi").drop(*lowered, "__values")  # MOST_KEYWORDS rows at most


def multiplicity(title: Column, values: Column, keywords: list[str]) -> Column:
    """How often an item is listed if every hit of a category lists it, and a hit of the title
    does when nothing has yet. ``values``: category texts in lower case."""
    total = F.lit(0)
    for k in keywords:
        hits = F.size(F.filter(values, _has(k.lower())))
        total = total + hits
        total = F.when((total == 0) & F.contains(F.lower(title), F.lit(k.lower())), 1).otherwise(total)
    return total


def linked(items: DataFrame) -> DataFrame:
    """Items with a link."""
    return items.where(F.col("link").isNotNull() & (F.col("link") != ""))


def gate(items: DataFrame, matched: DataFrame) -> DataFrame:
    """All of ``items`` if anything matched, else none."""
    return items.where(matched.select(F.lit(1)).exists())


def crawl_requests(items: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``url, userData`` of items with a link, one row for each, after the columns ``keep`` of the item."""
    return linked(items).select(*keep, F.col("link").alias("url"), F.struct("thumbnail").alias("userData"))


def without_topics(df: DataFrame, topics: list[str], columns: tuple[str, ...] = ("title",), category: str | None = None) -> DataFrame:
    """Rows that mention none of the topics."""
    topics = [t for t in topics if not _blank(t)]
    for c in columns:
        df = df.where(~F.coalesce(contains_any(F.col(c), topics), F.lit(False)))
    if category:
        df = df.where(~F.coalesce(F.exists(category, lambda v: contains_any(v["_VALUE"], topics)), F.lit(False)))
    return df


def in_language(df: DataFrame, language: str = "en", column: str = "lang") -> DataFrame:
    """Rows in the language, case ignored; a regional tag counts as its language."""
    return df.where(speaks(F.col(column), language))


def speaks(column: Column, language: str) -> Column:
    """Is the tag that of the language, or of a region of it? All spellings of a short code are
    listed, so that the filter reaches the scan."""
    if len(language) > 3:
        return F.split_part(F.lower(column), F.lit("-"), F.lit(1)) == language.lower()
    forms = sorted({"".join(x) for x in itertools.product(*[(c.lower(), c.upper()) for c in language])})
    found = column.isin(*forms)
    for f in forms:
        found = found | column.startswith(f"{f}-")
    return found


def in_timeframe(df: DataFrame, column: Column, start=None, end=None) -> DataFrame:
    """Rows of the time from ``start`` to ``end``, both included; open where null."""
    if start is not None:
        df = df.where(column >= F.lit(start).cast("timestamp"))
    if end is not None:
        df = df.where(column <= F.lit(end).cast("timestamp"))
    return df
