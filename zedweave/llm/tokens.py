"""Token ids by the tokenizers library, with a bounded cache of the ids of units of text.

Splitting a text where its tokenizer never joins across gives units whose ids concatenate to the text's
ids. Most units repeat, so their ids are looked up; a text for which the split isn't provably
exact goes to the tokenizer whole. No text is cut short.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np

#: Entries of the cache of a Python worker, and characters of the longest unit in it: at most about 150 MB.
CACHE, LONGEST = 800_000, 40

_MARKS = frozenset(".,;:!?")
#: White space other than the two plain ones, and characters on which Python's and Unicode's classes may differ.
_BLANKS = ("\t", "\r", "\v", "\f", "\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0")
_DOUBLE = ("  ", "\n\n", " \n", "\n ")
_ODD = ("\xaa", "\xb2", "\xb3", "\xb9", "\xba", "\xbc", "\xbd", "\xbe", "\xad")
_BYTE_UNITS = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?[0-9]+| ?(?:[^\w\s]|_)+|\n| ")
_WORD_UNITS = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[^\W\d_]+|[0-9]|(?:[^\w\s]|_)+")


def plain(text: str, byte: bool) -> bool:
    """Whether the split into units is exact: Latin-1 only, and for byte-level ids single white space inside."""
    if not text.isascii():
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        if any(c in text for c in _ODD):
            return False
    if not byte:
        return not any(c in text for c in _BLANKS[4:])
    return not (any(c in text for c in _BLANKS) or any(c in text for c in _DOUBLE) or text[:1].isspace() or text[-1:].isspace() or "\0" in text)


def byte_table() -> dict[int, int]:
    """From a byte to the printable character that stands for it in byte-level vocabularies."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in own]
    return {b: b for b in own} | {b: 256 + i for i, b in enumerate(rest)}


class Encoder:
    """ids(text): the ids as bytes, little-endian unsigned 16-bit integers (32-bit for large vocabularies)."""

    def __init__(self, path: str, kind: str | None = None, cache: int | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = [t.content for t in added]  # a text that holds one isn't split
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 65536 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.table = byte_table()
        self.model = self.tokenizer.model
        pre = str(self.tokenizer.pre_tokenizer)
        if kind is None:
            kind = "word" if "'t|" in pre and "</w>" in str(self.tokenizer.model.end_of_word_suffix) else "byte" if "ByteLevel" in pre else "other"
        self.kind = "other" if any(t.normalized for t in added) else kind
        self.cache = _Cache(self.unit, cache or CACHE)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def unit(self, unit: str) -> bytes:
        if self.kind == "word":
            if "'" in unit:
                return self.whole(unit)
            parts = _WORD_UNITS.findall(unit.lower())
        else:
            parts = _BYTE_UNITS.findall(unit)
        model, table, ids = self.model, self.table, []
        for p in parts:
            ids += [t.id for t in model.tokenize(p if p.isascii() and p.isalnum() else p.encode().decode("latin-1").translate(table))]
        return array(self.code, ids).tobytes()

    def ids(self, text: str) -> bytes:
        byte = self.kind == "byte"
        if self.kind == "other" or any(a in text for a in self.added) or not plain(text, byte):
            return self.whole(text)
        units = text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0") if byte else text.split()
        return b"".join(map(self.cache.__getitem__, units))


class _Cache(dict):
    """From a unit to its ids. Starts afresh when full."""

    def __init__(self, unit, most: int):
        super().__init__()
        self.unit, self.most = unit, most

    def __missing__(self, u: str) -> bytes:
        if len(u) > LONGEST:
            return self.unit(u)
        b = self[u[:-1]] + self[u[-1]] if u[-1:] in _MARKS and u[-2:-1].isalpha() else self.unit(u)  # " word." is " word" and "."
        if len(self) >= self.most:
            self.clear()
        self[u] = b
        return b


_encoders: dict[str, Encoder] = {}


def encoder(path: str, cache: int | None = None) -> Encoder:
    """This Python worker's encoder of a vocabulary file, whose path must be readable on every machine. cache: its entries at
    most, if not CACHE."""
    if path not in _encoders:
        _encoders[path] = Encoder(path, cache=cache)
    _encoders[path].cache.most = cache or CACHE
    return _encoders[path]


def texts(batches, id_col: int = 0, text_col: int = 1) -> Iterator[tuple[int | None, str]]:
    """(id, text) one by one from Arrow batches; a null text is empty."""
    for batch in batches:
        ids, column = batch.column(id_col).to_pylist(), batch.column(text_col)
        for i, x in enumerate(ids):
            yield x, column[i].as_py() or ""
