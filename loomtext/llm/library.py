"""Ids of whole texts by the tokenizers library, with the results for recurring parts remembered."""

from __future__ import annotations

import struct
from functools import lru_cache

from .chunks import TAIL, RememberedWords, SpacedEncoder

#: Parts remembered by a worker: about 200 bytes each.
MOST = 500_000
#: Latin letters below this neither compose nor change by context when lowered.
_PLAIN_END = "ƀ"


def _byte_letters() -> dict[int, str]:
    """The printable stand-ins of bytes in byte-level vocabularies: printable ones stand for themselves, the
    others follow from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in own]
    return {b: chr(256 + k) for k, b in enumerate(rest)}


_LETTERS = _byte_letters()
_PACKS = [struct.Struct(f"<{n}I").pack for n in range(12)]


def _mapped(word: str) -> str:
    return word if word.isascii() else word.encode("utf-8").decode("latin-1").translate(_LETTERS)


def _plain(letters: str) -> bool:
    return letters.isascii() or max(letters) < _PLAIN_END and "İ" not in letters


class _Library:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.tokenize = self.t.model.tokenize
        #: Special tokens are read in a text as what they are; a text that has one is left to the library as a whole.
        self.special = tuple(x.content for x in self.t.get_added_tokens_decoder().values())
        self.top = max(self.t.get_vocab(with_added_tokens=True).values(), default=0)

    def __call__(self, text: str) -> bytes:
        return self.encode(text) if any(x in text for x in self.special) else self.parts(text)

    def encode(self, text: str) -> bytes:
        ids = self.t.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def word(self, mapped: str) -> bytes:
        """Of one pre-token: the model alone, without the normalising and splitting that would not change it."""
        found = [x.id for x in self.tokenize(mapped)]
        return _PACKS[len(found)](*found) if len(found) < len(_PACKS) else struct.pack(f"<{len(found)}I", *found)


class WordEncoder(_Library):
    """For a tokenizer that lowers its text and drops white space: letters, digits and other signs are apart."""

    def __init__(self, path: str):
        super().__init__(path)
        self.words = RememberedWords(self._word, self.word, most=MOST, lower=True)

    def _word(self, word: str) -> bytes:
        if word.isalpha():
            if not _plain(word):
                return self.encode(word)
            low = word.lower()
            return self.word(_mapped(low)) if low == word else self.words[low]
        body = word.rstrip(TAIL)
        if len(body) < len(word) and body and body[-1].isalpha() and _plain(body[-1]):
            return self.words[body] + self.words[word[len(body) :]]
        return self.encode(word)

    def parts(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, text.replace("\n", " ").split(" ")))


class ByteEncoder(_Library):
    """For a byte-level tokenizer, whose words carry the space before them."""

    def __init__(self, path: str):
        super().__init__(path)
        self.whole = SpacedEncoder(self.encode, self._letters, MOST, self.word, "Ġ")

    def _letters(self, word: str) -> bytes:
        own = word.removeprefix(" ")
        if not _plain(own):
            return self.encode(word)
        return self.word(_mapped(own) if own is word else "Ġ" + _mapped(own))

    def parts(self, text: str) -> bytes:
        return self.whole(text)


@lru_cache(maxsize=4)
def library_encoder(path: str, spaced: bool) -> ByteEncoder | WordEncoder:
    """Ids of a text as packed unsigned 32-bit integers, as the library gives them without adding special tokens. ``spaced``: a byte-level tokenizer; else one that lowers its text and
    drops white space."""
    return ByteEncoder(path) if spaced else WordEncoder(path)
