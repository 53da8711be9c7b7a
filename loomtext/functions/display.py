"""How results, sources, ports and times are shown and read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOCAL, WEB = 0, 1
FILE, DIRECTORY, URL = 0, 1, 2
FIRST_PORT, LAST_PORT = 39000, 39499


def basename(path: Column) -> Column:
    return F.regexp_replace(path, r"^.*[\\/]", "")


def extension(path: Column) -> Column:
    """From the last dot of the last name on, with the dot; empty if there is none."""
    return F.regexp_extract(path, r"(\.[^./]*)$", 1)


def source_name(source: Column) -> Column:
    return F.when(source == LOCAL, "local").when(source == WEB, "web").otherwise("unknown")


def source_type_name(kind: Column) -> Column:
    return F.when(kind == FILE, "file").when(kind == DIRECTORY, "dir").when(kind == URL, "url").otherwise("unknown")


def source_type_number(name: Column) -> Column:
    """An unknown name is an error."""
    return F.when(name == "file", FILE).when(name == "dir", DIRECTORY).when(name == "url", URL).otherwise(F.raise_error(F.concat(F.lit("unknown source type: "), name)).cast("int"))


def valid_port(port: Column) -> Column:
    return port.between(FIRST_PORT, LAST_PORT)


def port_text(port: Column) -> Column:
    return port.cast("string")


def score_text(score: Column, places: int = 2) -> Column:
    return F.format_string(f"%.{places}f", score)


def result_line(n: Column, path: Column, score: Column, source: Column) -> Column:
    return F.format_string("%d. Path: %s Score: %.2f, Source: %s", n.cast("int"), path, score, source_name(source))


def read_time(text: Column) -> Column:
    """RFC 3339, with or without the quotation marks of JSON; microseconds are kept, smaller parts are cut off."""
    return F.to_timestamp(F.regexp_replace(F.trim(text, F.lit('"')), r"(\.\d{6})\d+", "$1"))


def time_text(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
