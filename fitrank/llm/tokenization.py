"""Exact, cached encoding of whole texts with the tokenizers library.

A text is cut before each single space that stands between two non-space characters. The byte-level
pre-tokenizer always starts a new pre-token there (the space leads it) and its classes never reach
across, so every cut falls on a boundary of the tokenizer's own pre-tokens. A unit between cuts is parted
into its pre-tokens, and the library's model encodes each distinct one once per worker; then it is looked up.
Units with an added token, or with characters on whose class Unicode versions or Python and the library may
disagree, go to the library whole.
"""

from __future__ import annotations

import os
import re
import unicodedata
from array import array
from functools import cache

#: Longer units are encoded without being remembered.
LONG = 64
#: Units, and pre-tokens, in a generation of a worker's memory.
REMEMBERED = 200_000

#: White space but for spaces and line breaks.
_RARE_SPACES = [c for c in map(chr, range(1 << 16)) if c.isspace() and c not in " \n"]
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: The byte-level pre-tokenizer's pattern; its classes are Python's for all but odd characters.
_BYTE_LEVEL = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: Likewise of the word-level one: digits stand alone.
_WORD_LEVEL = re.compile(r"'(?:[stmd]|re|ve|ll)|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
#: Characters for which Python's lower(), split(), \\s or \\d may differ from the library's, or that normalise.
_UNUSUAL = re.compile("[\x1c-\x1f²³¹¼½¾İɐ-\U0010ffff]")


_CONTROLS = re.compile("[\x1c-\x1f]")


@cache
def _odd() -> re.Pattern:
    """Characters whose class is not the same in Python's patterns and in every Unicode version since 3.2, and all
    beyond the basic plane."""

    def odd(c: str) -> bool:
        kind = unicodedata.category(c)
        return kind != unicodedata.ucd_3_2_0.category(c) or kind in ("Nl", "No", "Cn", "Cs") or "\x1c" <= c <= "\x1f" or (kind[0] not in "LN" and c.isalnum())

    return re.compile("[" + "".join(f"\\u{i:04x}" for i in range(1 << 16) if odd(chr(i))) + "\U00010000-\U0010ffff]")


def pieces(text: str) -> list[str]:
    """Units of a text: the first as it stands, all others without the space that led them."""
    if "  " in text or " \n" in text or "\n " in text or any(c in text for c in _RARE_SPACES):
        return _CUT.split(text)
    return text.split(" ")


def pre_tokens(unit: str) -> list[str] | None:
    """The byte-level pre-tokens of a unit (with its space); None if only the library can tell."""
    if "<|" in unit or (_CONTROLS if unit.isascii() else _odd()).search(unit):
        return None
    return _BYTE_LEVEL.findall(unit)


def library(path: str):
    """The tokenizer of a file, one in each worker process."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    if path not in _libraries:
        _libraries[path] = Tokenizer.from_file(path)
    return _libraries[path]


_libraries: dict = {}


def _byte_characters() -> str:
    """The character that stands for each byte: itself where it prints, else the next from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (b for b in range(256) if b not in prints)
    return "".join(chr(b) if b in prints else chr(256 + n) for b, n in sorted([(b, 0) for b in prints] + [(b, n) for n, b in enumerate(others)]))


_BYTES = dict(enumerate(_byte_characters()))


class _Memory(dict):
    """What was encoded lately: when it is full, it becomes the older generation, whose entries come back when
    they are met again."""

    def __init__(self, make):
        self.make, self.older = make, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= LONG:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


class _Coder:
    def __init__(self, path: str):
        self.library = library(path)
        self.tokenize = self.library.model.tokenize

    def _raw(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _model(self, pre_token: str) -> bytes:
        """A pre-token's ids from the model alone."""
        return array("I", [t.id for t in self.tokenize(pre_token.encode().decode("latin-1").translate(_BYTES))]).tobytes()


class ByteLevelCoder(_Coder):
    """Encodes with a byte-level BPE file; ids come as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        super().__init__(path)
        self.led = _Memory(lambda unit: self._unit(" " + unit))
        self.bare = _Memory(self._unit)

    def _unit(self, unit: str) -> bytes:
        parts = pre_tokens(unit)
        if parts is None:
            return self._raw(unit)
        if len(parts) == 1:
            return self._model(unit)
        # parts of several are remembered as units of their own
        return b"".join([self.led[p[1:]] if p[0] == " " else self.bare[p] for p in parts])

    def encode(self, text: str) -> bytes:
        units = pieces(text)
        if len(units) == 1:
            return self.bare[text]
        return self.bare[units[0]] + b"".join(map(self.led.__getitem__, units[1:]))


class WordCoder(_Coder):
    """Encodes with a word BPE file that lower-cases, drops white space and ends words: words are
    independent of each other. Texts with characters that lower-case, split or normalise in an unusual
    way, or with added tokens, go to the library whole."""

    def __init__(self, path: str):
        super().__init__(path)
        self.words = _Memory(self._word)

    def _word(self, word: str) -> bytes:
        parts = _WORD_LEVEL.findall(word)
        return self._model(word) if len(parts) == 1 else b"".join(map(self.words.__getitem__, parts))

    def encode(self, text: str) -> bytes:
        if _UNUSUAL.search(text) or "<|" in text:
            return self._raw(text)
        return b"".join(map(self.words.__getitem__, text.lower().split()))


_coders: dict = {}


def coder(path: str, kind=ByteLevelCoder):
    """The coder of this worker process."""
    if (path, kind) not in _coders:
        _coders[path, kind] = kind(path)
    return _coders[path, kind]
