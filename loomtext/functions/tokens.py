"""Words of a text: runs of ASCII letters, ASCII digits and non-ASCII characters, case kept."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII that is neither letter nor digit splits; everything from U+0080 on belongs to words. (For Java and RE2; named by
#: what it has, for Java is ten times slower on the complement.)
WORD_LETTER = "[0-9A-Za-z\\x{80}-\\x{10FFFF}]"
WORD = WORD_LETTER + "+"
_WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")


def is_word(text: str) -> bool:
    return _WORD.fullmatch(text) is not None


def words(text: str) -> list[str]:
    return _WORD.findall(text)


def word_places(text: str) -> list[tuple[str, int, int]]:
    """Words with where they begin and end."""
    return [(m[0], *m.span()) for m in _WORD.finditer(text)]


def words_column(text: Column | str) -> Column:
    """Array of the words of a string column, in text order; null for null."""
    return F.regexp_extract_all(F.col(text) if isinstance(text, str) else text, F.lit(WORD), 0)


def is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.char_length(c)


def is_ascii_letters(c: Column) -> Column:
    return c.rlike("^[A-Za-z]+$")


def is_ascii_digits(c: Column) -> Column:
    return c.rlike("^[0-9]+$")


def is_ascii_alphanumeric(c: Column) -> Column:
    return c.rlike("^[A-Za-z0-9]+$")


def utf8_length(c: Column) -> Column:
    """Bytes that the characters take in UTF-8."""
    return F.octet_length(c)
