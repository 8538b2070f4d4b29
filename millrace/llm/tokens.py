"""Token ids by the tokenizers library, with a memory for stretches of text between spaces."""

from __future__ import annotations

import os
import re
import string
from array import array
from operator import attrgetter

import numpy as np
import public_tokenizers

BPE_JSON, BPE_RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
MOST_UNITS, LONGEST_UNIT = 1_000_000, 64
#: A space that is followed by no white space always begins a new pre-token of public_tokenizers.PATTERN: a run of
#: white space before it ends where the text would end, so both sides can be encoded apart.
_CUT = re.compile(r" (?=\S)")
_ODD = re.compile(r" (?:\s|$)")
_ODD_BREAK = re.compile(r"\s\n|\n\s|\A\n|\n\Z")


def default_path(name: str = BPE_JSON) -> str:
    return public_tokenizers.path(name)


def units(text: str) -> list[str]:
    """text cut before each space that is followed by no white space; these spaces are left out."""
    return text.split(" ") if _ODD.search(text) is None else _CUT.split(text)


def _byte_letters() -> dict[int, str]:
    """The letter by which byte-level BPE writes each byte: itself if it prints, else the next from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTERS = _byte_letters()
_ID = attrgetter("id")
_AS_LATIN = str.maketrans({chr(b): c for b, c in _LETTERS.items()})


class UnitEncoder:
    """encode(texts) gives the ids of each text as the library would, meeting repeated units in a bounded memory.

    A unit is what follows a space, or a line break between other characters; the break and what begins a text have no space before them."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.later: dict[str, bytes] = {}  # units after a space, and units that begin with a line break
        self.first: dict[str, bytes] = {}  # what begins a text or line
        self.line_break = self._library("\n")

    def _library(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _pretoken(self, text: str) -> bytes:
        """A text known to be one pre-token goes to the library's BPE model, written as byte-level letters."""
        letters = text.replace(" ", _LETTERS[32]) if text.isascii() else text.encode().decode("latin-1").translate(_AS_LATIN)
        return array("I", map(_ID, self.model.tokenize(letters))).tobytes()

    def _learn(self, unit: str, lead: str) -> bytes:
        """A unit of letters is one pre-token; letters, then punctuation, are two, as the pattern cuts between them."""
        if unit.isalpha():
            return self._pretoken(lead + unit)
        word = unit.rstrip(string.punctuation)
        if word.isalpha():
            return self._known(word, lead) + self._known(unit[len(word) :], "")
        before, newline, after = unit.partition("\n")
        if newline and before and after and not before[-1].isspace() and not after[0].isspace():
            return self._known(before, lead) + self.line_break + self._known(after, "")
        return self._library(lead + unit)

    def _known(self, unit: str, lead: str) -> bytes:
        memory = self.later if lead else self.first
        if (ids := memory.get(unit)) is None:
            ids = self._learn(unit, lead)
            if len(unit) <= LONGEST_UNIT and "\n" not in unit[1:]:  # what is made of others is not kept
                memory[unit] = ids
        return ids

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        for memory in (self.first, self.later):
            if len(memory) >= MOST_UNITS:
                memory.clear()
        out, later = [], self.later
        for text in texts:
            # a break between other characters stands apart from both: it begins a unit
            plain = _ODD.search(text) is None and ("\n" not in text or _ODD_BREAK.search(text) is None)
            cut = text.replace("\n", " \n").split(" ") if plain else units(text)
            found = list(map(later.get, cut))
            found[0] = self._known(cut[0], "")
            if None in found:
                for i, ids in enumerate(found):
                    if ids is None:
                        unit = cut[i]
                        if plain and unit[0] == "\n":
                            ids = later[unit] = self.line_break + self._known(unit[1:], "")
                        else:
                            ids = self._known(unit, " ")
                        found[i] = ids
            out.append(np.frombuffer(b"".join(found), "<u4"))
        return out


_encoders: dict[str, UnitEncoder] = {}


def encoder(path: str) -> UnitEncoder:
    """One for each Python worker, which is used for many tasks."""
    if path not in _encoders:
        _encoders[path] = UnitEncoder(path)
    return _encoders[path]
