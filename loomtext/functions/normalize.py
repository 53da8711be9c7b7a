"""Normal forms of words: 0 lower case, 1 stem, anything else the word itself."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .stemming import stem, stem_column

LOWER, STEM = 0, 1


def lower(word: str) -> str:
    """Lower case letter by letter, without the final sigma and without a dot apart."""
    return word.replace("Σ", "σ").replace("İ", "i").lower()


def lower_column(word: Column) -> Column:
    return F.lower(F.translate(word, "Σİ", "σi"))


def normalize(word: str, normalizer: int = LOWER) -> str:
    return lower(word) if normalizer == LOWER else stem(word) if normalizer == STEM else word


def normalize_column(word: Column, normalizer: int = LOWER) -> Column:
    return lower_column(word) if normalizer == LOWER else stem_column(word) if normalizer == STEM else word
