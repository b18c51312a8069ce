"""The words of whole texts as numbers: split and looked up by Arrow and numpy, a slice of texts at a time.

A worker numbers each distinct word once. What is computed for a word (its token ids, its evidence for a class) is held in arrays by that
number, so that a slice costs one dictionary encoding, one look-up for each of its distinct words, and array work for the rest.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct words, and their bytes, that a worker holds before it starts anew.
MOST_WORDS, MOST_BYTES = 700_000, 64_000_000


def byte_lengths(texts: pa.Array) -> np.ndarray:
    """UTF-8 bytes of each text; null is the empty text."""
    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def byte_slices(texts: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about limit bytes together; a longer text stands alone."""
    ends = np.cumsum(byte_lengths(texts))
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield start, stop
        start = stop


def split_words(texts: pa.Array, lower: bool = True, unicode: bool = False) -> tuple[pa.Array, np.ndarray]:
    """All words between ASCII (or Unicode) white space, one text after the other, and where each text's words begin (one place more
    than texts); A-Z (or all letters) in small letters if asked for."""
    column = pc.fill_null(texts, "")
    if unicode:
        parts = pc.utf8_split_whitespace(pc.utf8_lower(column) if lower else column)
    else:
        parts = pc.ascii_split_whitespace(pc.ascii_lower(column) if lower else column)
    words, begins = parts.flatten(), parts.offsets.to_numpy().astype(np.int64)
    begins = begins - begins[0]
    filled = pc.greater(pc.binary_length(words), 0)
    keep = filled.to_numpy(zero_copy_only=False)
    if not keep.all():
        words, begins = words.filter(filled), np.concatenate([[0], np.cumsum(keep)])[begins]
    return words, begins


class WordIndex:
    """rows(words): the number of each word; words met for the first time are handed to learn(Arrow array of words, first number) before."""

    def __init__(self, most_words: int = MOST_WORDS, most_bytes: int = MOST_BYTES):
        self.most_words, self.most_bytes = most_words, most_bytes
        self.index: dict[bytes, int] = {}
        self.held = 0

    def full(self) -> bool:
        return len(self.index) > self.most_words or self.held > self.most_bytes

    def clear(self) -> None:
        self.index.clear()
        self.held = 0

    def rows(self, words: pa.Array, learn) -> np.ndarray:
        encoded = words.dictionary_encode()
        if not len(encoded.dictionary):
            return np.zeros(0, np.int64)
        known = encoded.dictionary.cast(pa.binary()).to_pylist()
        at = np.array(list(map(self.index.get, known, repeat(-1))), np.int64)
        fresh = np.flatnonzero(at < 0)
        if len(fresh):
            first = len(self.index)
            new = [known[i] for i in fresh.tolist()]
            learn(encoded.dictionary.take(pa.array(fresh)), first)
            at[fresh] = np.arange(first, first + len(new))
            self.index.update(zip(new, range(first, first + len(new)), strict=True))
            self.held += sum(map(len, new))
        return at[encoded.indices.to_numpy()]


class Growing:
    """An array that grows at its end."""

    def __init__(self, dtype, width: int | None = None):
        self.values = np.zeros(1024 if width is None else (1024, width), dtype)
        self.size = 0

    def clear(self) -> None:
        self.size = 0

    def extend(self, more: np.ndarray) -> None:
        need = self.size + len(more)
        if need > len(self.values):
            grown = np.zeros((max(need, 2 * len(self.values)), *self.values.shape[1:]), self.values.dtype)
            grown[: self.size] = self.values[: self.size]
            self.values = grown
        self.values[self.size : need] = more
        self.size = need


class WordTable:
    """rows of `width` floats for each distinct word, from compute(list of words) -> array of shape (n, width)."""

    def __init__(self, compute, width: int, most_words: int = MOST_WORDS):
        self.compute = compute
        self.index = WordIndex(most_words)
        self.values = Growing(np.float32, width)

    def read(self, words: pa.Array) -> np.ndarray:
        """The row number of each word; values.values holds the rows until the next call."""
        if self.index.full():
            self.index.clear()
            self.values.clear()
        return self.index.rows(words, lambda new, _: self.values.extend(self.compute(new.cast(pa.binary()).to_pylist())))


def sums(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Sums of values between neighbours of begins, 0 where they are equal, in double precision."""
    out = np.zeros((len(begins) - 1, *values.shape[1:]), np.float64)
    some = begins[1:] > begins[:-1]
    if some.any():
        out[some] = np.add.reduceat(values.astype(np.float64), begins[:-1][some], 0)
    return out
