"""Pieces of a text that a byte-level tokenizer treats independently, with remembered results.

With the usual pre-token pattern (an optional space, then letters, digits or other signs; runs of white
space apart) a pre-token starts at every space whose neighbours are not both white space. So a text splits
at its spaces into parts whose ids simply follow each other. Texts in which some space has white space (or
the end) on its right and white space on its left are taken whole instead.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from weakref import WeakSet

#: Signs that form a pre-token of their own after a letter.
TAIL = ".,;:!?"
RUN = re.compile(r"\s (?:\s|\Z)")


class Remembered(dict):
    """A bounded memory of ``f``; emptied when full, so it never grows with the data."""

    alive: WeakSet[Remembered] = WeakSet()
    owner = ""

    def __init__(self, f: Callable[[str], bytes], most: int = 150_000, longest: int = 64):
        self.f, self.most, self.longest = f, most, longest
        self.alive.add(self)

    __hash__ = object.__hash__

    @classmethod
    def claim(cls, owner: str) -> None:
        """Called where a worker begins a task of ``owner``: memories that another operator filled are emptied."""
        if owner != cls.owner:
            for memory in cls.alive:
                memory.clear()
            cls.owner = owner

    def __missing__(self, key: str) -> bytes:
        value = self.f(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value


class RememberedWords(Remembered):
    """A memory in which words of ASCII letters, most of what is missed, go to ``word`` at once, with ``before`` put
    before them; ``lower``: only those in lower case."""

    def __init__(self, f: Callable[[str], bytes], word: Callable[[str], bytes], before: str = "", most: int = 150_000, lower: bool = False):
        super().__init__(f, most)
        self.word, self.before, self.kind = word, before, str.islower if lower else str.isalpha

    def __missing__(self, key: str) -> bytes:
        if key.isascii() and key.isalpha() and self.kind(key) and len(key) <= self.longest:
            value = self.word(self.before + key)
            if len(self) >= self.most:
                self.clear()
            self[key] = value
            return value
        return super().__missing__(key)


class SpacedEncoder:
    """Ids of whole texts for a byte-level pattern, part by part. ``encode`` takes any text; ``letters`` one
    pre-token of letters, perhaps with a space before them; ``word`` the same of ASCII letters, after ``space``."""

    def __init__(self, encode: Callable[[str], bytes], letters: Callable[[str], bytes], most: int = 300_000, word: Callable[[str], bytes] | None = None, space: str = " "):
        self.encode, self.letters = encode, letters
        self.first = RememberedWords(lambda part: self._part(part, "", self.first), word or letters)
        self.spaced = RememberedWords(lambda part: self._part(part, " ", self.spaced), word or letters, space, most)

    def _part(self, part: str, space: str, same: Remembered) -> bytes:
        if part.isalpha():
            return self.letters(space + part)
        body = part.rstrip(TAIL)
        if len(body) < len(part) and body and body[-1].isalpha():
            return same[body] + self.first[part[len(body) :]]
        if "\n" in part:
            a, b = part.split("\n", 1)
            if a and b and not a[-1].isspace() and not b[0].isspace():
                return same[a] + self.first["\n"] + self.first[b]
        return self.encode(space + part)

    def __call__(self, text: str) -> bytes:
        if RUN.search(text):
            return self.encode(text)
        first, *rest = text.split(" ")
        return self.first[first] + b"".join(map(self.spaced.__getitem__, rest))
