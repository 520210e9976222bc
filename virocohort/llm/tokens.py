"""Token ids from the tokenizers library at the cost of the distinct units of a text.

A text is cut where no token of the tokenizer can reach across, and each distinct unit is encoded by the library
once per worker while a bounded cache holds it; units of Latin letters alone go straight to the library's BPE model.  ``split`` names where that is so:

* ``words``: the tokenizer drops white space and no word reaches over it; units are what stands between ASCII blanks;
* ``spaced``: byte-level tokens take one space before a word; units are words with that space, and runs of blanks
  cut as the byte-level pattern cuts them.  A text with other white space or a special token goes to the library whole;
* None: every text goes to the library whole.

Ids are arrays of the machine's order, little-endian on every platform that Spark's workers run on (checked on
import).  They equal those of the whole text; the tests compare both on whole tables and on odd texts.
"""

from __future__ import annotations

import os
import re
import sys
from array import array


if sys.byteorder != "little" or array("I").itemsize != 4:
    raise RuntimeError("token ids are written as little-endian 32-bit integers")

BARE = b"\xff"  # in no UTF-8 text
WHOLE = BARE * 2  # a text that is encoded as it stands
SPACED = re.compile(rb" ?[^ \t-\r]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+")
ODD_SIGNS = (b"\x1c", b"\x1d", b"\x1e", b"\x1f", b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")  # quick to look for
LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+")  # unchanged by NFC, one word in both patterns
LINE_END = re.compile(rb"[^ \t-\r]+\n[^ \t-\r]+")
ODD_BLANKS = re.compile(rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


def byte_alphabet() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (b for b in range(256) if b not in own)
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


ALPHABET = byte_alphabet()


class Units(dict):
    """Ids of the units met so far; a mark after an ASCII letter and a lone line end are tokens of their own."""

    def __init__(self, encode, unit_bytes: int):
        super().__init__()
        self.encode, self.unit_bytes = encode, unit_bytes

    def __missing__(self, unit: bytes) -> bytes:
        if unit.isalpha():  # ASCII letters
            ids = self.encode(unit)
        elif unit[:2] == WHOLE:
            return self.encode(unit)
        elif len(unit) > 2 and unit[-1] in b".,;:!?" and unit[-2:-1].isalpha():
            ids = self[unit[:-1]] + self[BARE + unit[-1:]]
        elif b"\n" in unit and LINE_END.fullmatch(unit):
            left, _, right = unit.partition(b"\n")
            ids = self[left] + self[BARE + b"\n"] + self[BARE + right]
        else:
            ids = self.encode(unit)
        if len(unit) <= self.unit_bytes:
            self[unit] = ids
        return ids


class Encoder:
    """Encodes UTF-8 texts to ids as bytes (little-endian, unsigned, 32 bits each), without special tokens added."""

    def __init__(self, path: str, split: str | None, cache_units: int = 600_000, unit_bytes: int = 48):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.library.no_truncation()
        self.library.no_padding()
        self.specials = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.split, self.cache_units, self.cache = split, cache_units, Units(self._unit, unit_bytes)

    def whole(self, text: bytes) -> bytes:
        """The library's ids of the text as it stands."""
        ids = self.library.encode_batch_fast([text.decode("utf-8", "replace")], add_special_tokens=False)[0].ids
        return array("I", ids).tobytes()

    def _word(self, word: str) -> bytes:
        """A word of the byte-level alphabet, by the library's model alone."""
        return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()

    def _unit(self, unit: bytes) -> bytes:
        if unit.isalpha() and self.split:
            word = unit.decode()
            return self._word(word if self.split == "words" else ALPHABET[32] + word)
        if unit[:2] == WHOLE:
            return self.whole(unit[2:])
        spaced = self.split == "spaced" and unit[:1] != BARE
        raw = unit[1:] if unit[:1] == BARE else unit
        text = raw.decode("utf-8", "replace")
        if self.split and LETTERS.fullmatch(text):  # normalised and cut already
            text = text.lower() if self.split == "words" else " " + text if spaced else text
            return self._word(text.encode().decode("latin-1").translate(ALPHABET))
        return self.whole(b" " + raw if spaced else raw)

    def units(self, text: bytes) -> list[bytes]:
        """Keys of the cache: in ``spaced`` a key has a space before it unless it begins with BARE."""
        if self.split is None or any(s in text for s in self.specials) or self.split == "spaced" and any(s in text for s in ODD_SIGNS) and ODD_BLANKS.search(text):
            return [WHOLE + text]
        if self.split == "words":
            return text.lower().split()
        if b"  " in text or text[-1:] == b" ":
            return [BARE + u for u in SPACED.findall(text)]
        units = text.split(b" ")
        units[0] = BARE + units[0]
        return units

    def __call__(self, text: bytes | None) -> bytes:
        if not text:
            return b""
        if len(self.cache) > self.cache_units:
            self.cache.clear()
        return b"".join(map(self.cache.__getitem__, self.units(text)))


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, split: str | None) -> Encoder:
    """One encoder per worker process: its cache lasts over batches and tasks."""
    if (path, split) not in _encoders:
        _encoders[path, split] = Encoder(path, split)
    return _encoders[path, split]
