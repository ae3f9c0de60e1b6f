"""Column functions: trimming, defaults, feed dates and URL keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space and line ends that trimming takes away (fixed values).
_BLANK = "[\\u0009-\\u000D\\u0020\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]"
BLANK_CHARACTERS = "\t\n\v\f\r                  　﻿"


def trim(c: Column) -> Column:
    """Without Unicode white space at both ends (the built-in trim takes spaces only)."""
    return F.regexp_replace(c, f"^{_BLANK}+|{_BLANK}+$", "")


def or_default(c: Column, default: Column) -> Column:
    """``default`` where ``c`` is null or empty."""
    return F.coalesce(F.nullif(c, F.lit("")), default)


def contains_any(c: Column, words: list[str]) -> Column:
    """Does the text contain one of ``words``, whatever the case? An empty word is in every text."""
    found = F.lit(False)
    for w in words:
        found = found | F.contains(F.lower(c), F.lit(w.lower()))
    return found


def pub_date(c: Column) -> Column:
    """The time that an RFC 822 date gives, with a numeric or a named zone; null if it is none."""
    day = F.regexp_replace(F.trim(c), r"^\w{3},\s*", "")
    return F.coalesce(F.try_to_timestamp(day, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(day, F.lit("d MMM yyyy HH:mm:ss z")), F.try_to_timestamp(c))


def url_key(c: Column) -> Column:
    """What makes two URLs the same request: no fragment, no utm_ parameters, sorted
    parameters, no slash at the end, lower-case scheme and host."""
    plain = F.split_part(trim(c), F.lit("#"), F.lit(1))
    path = F.regexp_replace(F.split_part(plain, F.lit("?"), F.lit(1)), "/+$", "")
    host = F.regexp_extract(path, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)", 1)
    path = F.concat(F.lower(host), F.substr(path, F.length(host) + 1))
    query = F.regexp_extract(plain, r"\?(.*)$", 1)
    parts = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.startswith(F.lower(p), F.lit("utm_"))))
    return F.when(F.size(parts) > 0, F.concat(path, F.lit("?"), F.array_join(parts, "&"))).otherwise(path)


def day(c: Column) -> Column:
    """A time as DD.MM.YYYY."""
    return F.date_format(c, "dd.MM.yyyy")
