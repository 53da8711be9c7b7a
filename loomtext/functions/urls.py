"""Query strings of URLs, in which a plus sign is a plus sign."""

from __future__ import annotations

import re
from urllib.parse import unquote_to_bytes

from pyspark.sql import Column
from pyspark.sql import functions as F

_ESCAPE = re.compile(r"%(?![0-9A-Fa-f]{2})")


def _decoded(part: str) -> str | None:
    return None if _ESCAPE.search(part) else unquote_to_bytes(part).decode("utf-8", "replace")


def parse_query(query: str) -> dict[str, list[str]]:
    """Values by key in order. Empty pairs, pairs with a semicolon and pairs with a broken escape are dropped."""
    out: dict[str, list[str]] = {}
    for pair in query.split("&"):
        if not pair or ";" in pair:
            continue
        key, _, value = pair.partition("=")
        key, value = _decoded(key), _decoded(value)
        if key is not None and value is not None:
            out.setdefault(key, []).append(value)
    return out


def query_of(url: Column) -> Column:
    """What stands between the first question mark and the fragment."""
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def query_pairs(query: Column) -> Column:
    """Array of (key, value) of a query string column, by the rules of ``parse_query``."""
    read = lambda s: F.try_url_decode(F.replace(s, F.lit("+"), F.lit("%2B")))
    good = lambda p: (p != "") & ~p.contains(";") & ~p.rlike("%(?![0-9A-Fa-f]{2})")
    pairs = F.filter(F.split(query, "&"), good)
    return F.transform(pairs, lambda p: F.struct(read(F.substring_index(p, "=", 1)).alias("key"), read(F.when(p.contains("="), F.substring(p, F.length(F.substring_index(p, "=", 1)) + 2, F.length(p))).otherwise("")).alias("value")))


def values(query: Column, key: str) -> Column:
    return F.transform(F.filter(query_pairs(query), lambda p: p["key"] == key), lambda p: p["value"])


def joined_keys(query: Column, key: str = "q") -> Column:
    """All values of ``key`` with a space between them."""
    return F.array_join(values(query, key), " ")
