"""Token ids of whole texts with the tokenizers library, each distinct pre-token merged once a worker.

The library's pipeline costs some 20 microseconds a call, and invented or rare words defeat its cache. Texts are therefore
cut before spaces (a byte-level pre-token only begins there, or within) or at white space, a piece that isn't known yet is
split with the vocabulary's own pattern, and the library's BPE model merges each pre-token at its first sight; the ids are
kept, packed. A byte-level piece that is a word and marks, or lines that a single break parts, is taken apart without the
pattern, so that a word is kept once and not with each mark or line behind it. Texts with a special token, or in which the
library's normaliser may do more than lower-case, are given to the library whole. tests/llm holds both paths against
Tokenizer.encode.
"""

from __future__ import annotations

import json
import re
import string
import struct
import unicodedata

import regex
from tokenizers import Tokenizer

from docrecon.llm.common import of_stage

#: White space as the library's patterns see it (Python's own \\s has four control characters more).
SPACES = r"\t-\r\x20\x85\xA0  -     　"
BYTE_LEVEL = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACES}\p{{L}}\p{{N}}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
WORD_LEVEL = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACES}\p{{L}}\p{{N}}]+")
#: Python's split() takes these for white space, the library doesn't.
CONTROL = re.compile("[\x1c-\x1f]")
#: Characters that byte-level pre-tokens join into one and part from letters.
MARKS = string.punctuation
KEPT = 500_000
#: Of the byte-level pieces, words are kept up to here (what a table of 2^20 slots holds), pieces that end in marks while there
#: are few.
WORDS, WITH_MARKS = 690_000, 100_000


def vocabulary(name: str) -> str:
    """The text of a vocabulary file of public_tokenizers; a path works too."""
    if "/" not in name:
        import public_tokenizers

        name = public_tokenizers.path(name)
    with open(name, encoding="utf-8") as f:
        return f.read()


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: printable ones as they are, the others from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in printable)}


class _Run(Exception):
    """A piece of a space and more white space: the byte-level pattern looks at what comes before it."""


class _Merged(dict):
    """Pre-token -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, model):
        super().__init__()
        self.model, self.letters = model, byte_letters()

    def __missing__(self, token: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(token.encode().decode("latin-1").translate(self.letters))]
        out = struct.pack(f"<{len(ids)}I", *ids)
        if len(self) < KEPT:
            self[token] = out
        return out


class Packed(dict):
    """Piece -> its ids, packed; at byte level the piece of a text behind a space -> the ids of both."""

    def __init__(self, text: str):
        super().__init__()
        told = json.loads(text)
        self.tokenizer = Tokenizer.from_str(text)
        self.merged = _Merged(self.tokenizer.model)
        self.special = [t["content"] for t in told["added_tokens"]]
        self.lower = told["normalizer"] is not None
        self.pattern = WORD_LEVEL if self.lower else BYTE_LEVEL
        self.four = [] if self.lower else [struct.pack("<I", i) for i in range(1 + max(told["model"]["vocab"].values()))]

    def __missing__(self, piece: str) -> bytes:
        if self.lower:
            out, kept = self.merged[piece] if piece.isalpha() else self.split(piece), KEPT
        elif not piece[:1].strip():
            raise _Run
        elif piece.isalpha():
            # Letters of ASCII are written as they are, a space as Ġ.
            written = f"Ġ{piece}" if piece.isascii() else f" {piece}".encode().decode("latin-1").translate(self.merged.letters)
            out, kept = b"".join([self.four[t.id] for t in self.merged.model.tokenize(written)]), WORDS
        elif (word := piece.rstrip(MARKS)).isalpha():
            out, kept = self[word] + self.merged[piece[len(word) :]], WITH_MARKS
        elif "\n" in piece and all(x and not x[0].isspace() and not x[-1].isspace() for x in piece.split("\n")):
            first, *lines = piece.split("\n")
            out, kept = self.merged["\n"].join([self[first], *map(self.bare, lines)]), 0
        else:
            out, kept = self.split(f" {piece}"), KEPT
        if len(self) < kept:
            self[piece] = out
        return out

    def split(self, piece: str) -> bytes:
        return b"".join(map(self.merged.__getitem__, self.pattern.findall(piece)))

    def bare(self, piece: str) -> bytes:
        """The byte-level ids of a piece that has no space before it."""
        word = piece.rstrip(MARKS)
        if not word.isalpha():
            return self.split(piece)
        return self.merged[word] + self.merged[piece[len(word) :]] if len(word) < len(piece) else self.merged[word]

    def ids(self, text: str | None) -> bytes:
        """The ids of a text; null counts as empty."""
        if not text:
            return b""
        if any(s in text for s in self.special):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        if self.lower:
            # Two letters lower-case by their context or to several characters.
            plain = text.isascii() or unicodedata.is_normalized("NFC", text) and "Σ" not in text and "İ" not in text
            text = text.lower() if plain else self.tokenizer.normalizer.normalize_str(text)
            return b"".join(map(self.__getitem__, text.split(" ") if CONTROL.search(text) else text.split()))
        first, *pieces = text.split(" ")
        try:
            return self.bare(first) + b"".join(map(self.__getitem__, pieces))
        except _Run:
            return self.split(text)


def packed(text: str) -> Packed:
    """The one Packed of this worker for a vocabulary, which the stage's later tasks use again."""
    return of_stage(f"ids {hash(text)}", lambda: Packed(text))
