"""Token ids of whole texts by a byte-level tokenizer, looked up piece by piece.

Such a tokenizer keeps a space with what follows it and never lets a token run on
from another character into white space.  So a text may be cut before any white
space that follows something else, and the pieces' ids joined are those of the
whole text.  Pieces are encoded once per worker and looked up afterwards.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

import numpy as np

from lectern.llm.common import WordTable
from lectern.llm.tokens import PLAIN, byte_letters

SPACES = re.compile(r"\s\s")
CUT = re.compile(r"(?<=\S) ")

# Texts on which piecewise and whole encoding must agree before pieces are used.
PROBES = (
    "Hello world, it's 12 o'clock\nÀ l'été: 3.5 % (x_y)\n", "a  b\n\n c\t d \n", " lead", "\nlead", "trail ", "don't 'll we'll '", "",
    "naïve Straße ### %%% ... x y あい 12² á \x1c b", "1 2  3   4\r\n5 \r6",
)


def pieces(text: str) -> tuple[list[str], bool]:
    """(pieces, plain).  Plain: each piece but the first follows one space, left out, or begins with its line end."""
    if SPACES.search(text):
        first, *rest = CUT.split(text)
        return [first, *(" " + p for p in rest)], False
    return text.replace("\n", " \n").split(" "), True


def spelled(piece: str) -> str:
    """A later piece of a plain text with the space that it follows."""
    return piece if piece.startswith("\n") else " " + piece


class ByteCoder:
    """Ids of a text as bytes.  ``literal``: strings of special tokens inside texts are ordinary text."""

    def __init__(self, path: str, literal: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = literal
        self.model = self.tokenizer.model
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.specials = () if literal else tuple(t.content for t in added)
        self.type = np.dtype("<i4")
        self.letters = byte_letters()
        self.runs, self.cores = WordTable(self._run), WordTable(lambda letters: self._run(" " + letters))
        self.exact, self.later = WordTable(self.whole), WordTable(self._later)
        self.short_cut = True
        words = ("Hello", "ÀÉé", "été.,", "xqzzj!?", "Straße(", "%%%", "a", "\nHello", "\nété.,", "\n%%%", "\n")
        self.short_cut = array("i").itemsize == 4 and all(self.whole(spelled(w)) == self._later(w) for w in words)
        self.by_piece = all(self.whole(s) == self._joined(s) for s in PROBES)

    def _run(self, run: str) -> bytes:
        """Ids of one run of letters or marks, with or without a leading space."""
        if run.isascii() and run[0] == " ":
            mapped = "Ġ" + run[1:]
        else:
            mapped = run.encode().decode("latin-1").translate(self.letters)
        return array("i", [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def _later(self, piece: str) -> bytes:
        line = piece[:1] == "\n"
        if self.short_cut and (m := PLAIN.fullmatch(piece, line)):
            letters, marks = m.groups()
            if letters:
                ids = self.runs["\n"] + self.runs[letters] if line else self.cores[letters]
                return ids + self.runs[marks] if marks else ids
            if marks:
                return self.runs["\n"] + self.runs[marks] if line else self.runs[" " + marks]
        return self.whole(spelled(piece))

    def piece(self, text: str) -> bytes:
        """Ids of a text that may be a later piece, without a table of its own."""
        if text[0] == " " and text[1:2] != "\n":
            return self._later(text[1:])
        return self._later(text) if text[0] == "\n" else self.whole(text)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.type).tobytes()

    def _joined(self, text: str) -> bytes:
        found, plain = pieces(text)
        if plain:
            return self.exact[found[0]] + b"".join(map(self.later.__getitem__, found[1:]))
        return b"".join(map(self.exact.__getitem__, found))

    def ids(self, text: str) -> bytes:
        if not self.by_piece or any(s in text for s in self.specials):
            return self.whole(text)
        return self._joined(text)


@lru_cache(maxsize=2)
def byte_coder(path: str, literal: bool = False) -> ByteCoder:
    """One per worker process: its tables serve all tasks of that worker."""
    return ByteCoder(path, literal)


def byte_pieces(tokenizer) -> dict[int, bytes]:
    """id -> bytes of every token of a byte-level vocabulary; special tokens stand for their own text."""
    back = {c: b for b, c in byte_letters().items()}
    special = {i: t.content for i, t in tokenizer.get_added_tokens_decoder().items()}
    out = {}
    for token, i in tokenizer.get_vocab(with_added_tokens=True).items():
        out[i] = special[i].encode() if i in special else bytes(back[c] for c in token)
    return out
