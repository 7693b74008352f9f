"""Token ids of whole texts by the tokenizers library, with its work shared between equal words."""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

from .common import pieces

# Words of ASCII and Latin-1 letters, where case folds one to one and nothing composes across a cut.
_PLAIN = re.compile(r"[!-&(-~À-ÖØ-öø-ÿ]+")
_PUNCTUATION = re.compile(r"([!-&(-/:-@\[-`{-~]+)")


class _Units(dict):
    """Ids of strings that the tokenizer treats apart from their neighbours, by the library, in two generations."""

    def __init__(self, tokenizer, most: int):
        self.tokenizer, self.most, self.old = tokenizer, most, {}

    def __missing__(self, unit: str) -> bytes:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        if (ids := self.old.get(unit)) is None:
            # A run of ASCII letters is one pre-token that the byte alphabet leaves as it is: the model takes it.
            if unit.isascii() and unit.isalpha():
                ids = array("I", [t.id for t in self.tokenizer.model.tokenize(unit)]).tobytes()
            else:
                ids = array("I", self.tokenizer.encode(unit, add_special_tokens=False).ids).tobytes()
        self[unit] = ids
        return ids


class _Words(dict):
    """Ids of words between spaces and line feeds."""

    def __init__(self, units: _Units, most: int):
        self.units, self.most = units, most

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        if "<|" in word or not _PLAIN.fullmatch(word):
            ids = self.units[word] if word else b""
        else:
            ids = b"".join([self.units[u] for u in _PUNCTUATION.split(word.lower()) if u])
        self[word] = ids
        return ids


class WordEncoder:
    """Encodes texts with a tokenizer that lowers case and never joins symbols across a space or a line feed.

    The pre-tokenizer drops white space and splits letters from punctuation, so a text's ids are its
    words' ids one after the other. Each distinct unit goes through the library while it is not in the
    cache, which holds ``most`` entries. A word that holds a special token's opening, an apostrophe or a
    character beyond Latin-1 letters goes to the library uncut.
    """

    def __init__(self, path: str, most: int = 500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.words = _Words(_Units(Tokenizer.from_file(path), most), most)

    def encode(self, text: str) -> bytes:
        """The ids of ``text`` as little-endian unsigned 32-bit integers."""
        get = self.words.__getitem__
        return b"".join([b"".join(map(get, piece.replace("\n", " ").split(" "))) for piece in pieces(text)])

    def forget(self) -> None:
        """Empties the cache."""
        for known in (self.words, self.words.units, self.words.units.old):
            known.clear()


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """The encoder that the tasks of one Python worker share, so that its cache outlives a task."""
    return WordEncoder(path)
