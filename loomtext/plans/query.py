"""The search language: words, +required, -excluded and "phrases"."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.normalize import LOWER, normalize
from ..functions.tokens import words, words_column


@dataclass(frozen=True)
class ParsedQuery:
    modified: str
    plus: list[str] = field(default_factory=list)
    minus: list[str] = field(default_factory=list)
    quotes: list[str] = field(default_factory=list)

    def terms(self, normalizer: int = LOWER) -> list[str]:
        """Scored words by position, phrases last; words whose normal form is empty are left out."""
        found = words(" ".join([self.modified, *quoted_words(self.quotes)]))
        return [t for w in found if (t := normalize(w, normalizer))]


def quoted_words(quotes: list[str]) -> list[str]:
    return [w for q in quotes for w in words(q)]


def quoted_words_column(quotes: Column) -> Column:
    """All words of an array of phrases, in order."""
    return F.flatten(F.transform(quotes, words_column))


def parse(query: str, normalizer: int = LOWER) -> ParsedQuery:
    """One scan from left to right.

    ``+`` and ``-`` are recognised inside words too and run to the next space (one that is not the first thing
    in them); an unfinished one ends with the query, an unfinished phrase is dropped. The text of plus words
    stays in the scored text, minus words and phrases leave it.
    """
    kept: list[str] = []
    found: dict[str, list[str]] = {"+": [], "-": [], '"': []}
    mode, held = "", ""

    def close() -> None:
        found[mode].append(held if mode == '"' else normalize(held, normalizer))

    for c in query:
        if mode == '"':
            if c == '"':
                close()
                mode, held = "", ""
            else:
                held += c
        elif mode and c == " " and held:
            close()
            mode, held = "", ""
            kept.append(c)
        elif mode:
            held += c
            if mode == "+":
                kept.append(c)
        elif c in found:
            mode = c
        else:
            kept.append(c)
    if mode in ("+", "-") and held:
        close()
    return ParsedQuery("".join(kept), found["+"], found["-"], found['"'])


PARSED = "modified string, plus array<string>, minus array<string>, quotes array<string>"


def parse_column(query: Column, normalizer: int = LOWER) -> Column:
    """A struct of the parts of every query, for batches of queries; null for null."""
    kind = pa.struct([("modified", pa.string()), *((n, pa.list_(pa.string())) for n in ("plus", "minus", "quotes"))])

    def run(queries: pa.Array) -> pa.Array:
        return pa.array([None if q is None else asdict(parse(q, normalizer)) for q in queries.to_pylist()], kind)

    return F.arrow_udf(run, PARSED)(query)
