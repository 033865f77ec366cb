"""Token ids of whole texts by the tokenizers library, cached by word, over Arrow batches.

Texts are cut only where the tokenizer itself always cuts: before a single
space or around a single newline that stands between two other characters.
Each different chunk goes through the library once per worker and its ids are
kept in a bounded cache, so a worker pays per different word, not per token.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa

from .words import chunks

CACHE_WORDS = 400_000


def load(path: str):
    """The tokenizer of a file; strings of special tokens in a text are ordinary text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    return tok


class Irregular(Exception):
    """White space other than single spaces and newlines between words."""


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable Latin-1
    characters stand for themselves, the other bytes take the characters from 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return [chr(b) if b in own else chr(256 + rest.index(b)) for b in range(256)]


BYTE_CHAR = byte_characters()
#: letters that every Unicode version calls letters and that no normal form changes
PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")


class _Cache(dict):
    """word -> ids as little-endian unsigned 32-bit integers.

    A word of plain letters is one unit for the tokenizer and goes straight to
    its model; a full stop or comma after such a word is a unit of its own."""

    def __init__(self, ids, model, prefix: str = "", lower: bool = False):
        super().__init__()
        self.ids, self.model, self.prefix, self.lower = ids, model, prefix, lower
        self.stops = {c: ids("a" + c)[len(ids("a")):] for c in ".,"}

    def __missing__(self, word: str) -> bytes:
        if not word or any(c.isspace() for c in word):
            raise Irregular
        stem = word[:-1] if word[-1] in ".," else word
        if PLAIN.fullmatch(stem):
            if stem is not word:
                out = self[stem] + self.stops[word[-1]]
            else:
                unit = (self.prefix + (word.lower() if self.lower else word)).encode()
                out = array("I", [t.id for t in self.model.tokenize("".join([BYTE_CHAR[b] for b in unit]))]).tobytes()
        else:
            out = self.ids(self.prefix + word)
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = out
        return out


class ByteLevelIds:
    """ids of a byte-level tokenizer that keeps a space with the word after it."""

    CUT = re.compile(r"(?<=\S)(?= \S)|(?<=\S)(?=\n\S)|(?<=\S\n)(?=\S)")

    def __init__(self, ids, model):
        self.ids, self.newline = ids, ids("\n")
        self.bare, self.spaced = _Cache(ids, model), _Cache(ids, model, " ")

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        try:
            out, bare, spaced = [], self.bare, self.spaced
            for line in text.split("\n"):
                first, *rest = line.split(" ")
                out.append(bare[first])
                out += map(spaced.__getitem__, rest)
                out.append(self.newline)
            out.pop()
            return b"".join(out)
        except Irregular:
            return b"".join(map(self.ids, self.CUT.split(text)))


class WordIds:
    """ids of a tokenizer that lower-cases and drops white space, so that words are independent."""

    def __init__(self, ids, model):
        self.cache = _Cache(ids, model, lower=True)
        self.ids = ids

    def __call__(self, text: str) -> bytes:
        try:
            return b"".join(map(self.cache.__getitem__, filter(None, text.replace("\n", " ").split(" "))))
        except Irregular:
            return b"".join(map(self.ids, filter(None, re.split(r"[ \n]+", text))))


_ENCODERS: dict[tuple[str, str], object] = {}


def encoder(path: str, kind: str):
    """The worker's encoder for a tokenizer file; kind is "byte" or "word"."""
    if (path, kind) not in _ENCODERS:
        tok = load(path)
        _ENCODERS[path, kind] = {"byte": ByteLevelIds, "word": WordIds}[kind](
            lambda text: array("I", tok.encode(text, add_special_tokens=False).ids).tobytes(), tok.model)
    return _ENCODERS[path, kind]


def encoded(batches: Iterator[pa.RecordBatch], path: str, kind: str, column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Bounded slices of the batches with the ids of each text; null counts as empty."""
    encode = encoder(path, kind)
    for batch in batches:
        for part in chunks(batch, column):
            yield part, [encode(t or "") for t in part.column(column).to_pylist()]
