"""Exact tokenizers ids of many texts, with each distinct word encoded once per worker.

The vocabulary's pre-tokenizer never matches across ASCII white space, and neither its normaliser nor its special strings reach
across it, so the ids of a text are the ids of its white-space-separated chunks, one after the other. Chunks repeat; the library
encodes each distinct one once, and the ids of a slice of texts are gathered from the cache by array work. The cache has a fixed bound.
"""

from __future__ import annotations

import os

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import numpy as np  # noqa: E402
import pyarrow as pa  # noqa: E402
import pyarrow.compute as pc  # noqa: E402
from tokenizers import Tokenizer, pre_tokenizers  # noqa: E402

from .word_index import Growing, WordIndex, byte_slices, split_words  # noqa: E402

#: Bytes of texts that are encoded together, and words that go to the library as one text.
SLICE, TOGETHER = 4_000_000, 500
#: Letters of ASCII and Latin-1: they are one match of the pre-tokenizer, and the normaliser only makes them small.
PLAIN = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+$"
#: Marks after a letter or digit that are a match of their own; none of them begins a special string or an ending such as 's.
MARKS = ".,;:!?*%&$#)"
_SHARED: dict[str, WordEncoder] = {}


def gather(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The stretches of pool, one after the other."""
    ends = np.cumsum(lengths)
    return pool[np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)]


class WordEncoder:
    """encode(texts): for slices of texts their ids as one array, and where each text's ids begin."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        # Plain words need no normaliser, and many of them go through the model as one text; the end mark of a word parts their ids.
        self.plain = Tokenizer(self.library.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        mark = getattr(self.library.model, "end_of_word_suffix", None)
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.last = np.array([bool(mark) and (self.library.id_to_token(i) or "").endswith(mark) for i in range(size)])
        for t in (self.library, self.plain):
            resize = getattr(t.model, "_resize_cache", None)
            if resize:
                resize(0)  # this class keeps its own
        self.index = WordIndex()
        self.start, self.length, self.pool = Growing(np.int64), Growing(np.int64), Growing(np.uint32)

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        """One encoder per worker process and path."""
        if path not in _SHARED:
            _SHARED[path] = cls(path)
        return _SHARED[path]

    def _plain(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of plain words, one after the other, and how many each word has."""
        texts = pc.utf8_lower(words).to_pylist()
        groups = [texts[s : s + TOGETHER] for s in range(0, len(texts), TOGETHER)]
        found = self.plain.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)
        ids = np.array([i for e in found for i in e.ids], np.uint32)
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(texts) or (len(ends) and ends[-1] != len(ids)):  # a vocabulary without such a mark
            return self._each(words)
        return ids, np.diff(ends, prepend=0)

    def _each(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same by the whole library, word by word."""
        texts = [w.decode("utf-8", "replace") for w in words.cast(pa.binary()).to_pylist()]
        found = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([i for x in found for i in x], np.uint32), np.array(list(map(len, found)), np.int64)

    def learn(self, words: pa.Array, _first: int) -> None:
        """Add the ids of these chunks: each is a core, and marks after a letter or digit as a piece of their own."""
        core = pc.ascii_rtrim(words, MARKS)
        core = pc.if_else(pc.match_substring_regex(core, "[0-9A-Za-z]$"), core, words)
        cut = np.flatnonzero(pc.not_equal(pc.binary_length(core), pc.binary_length(words)).to_numpy(zero_copy_only=False))
        tails = [w[len(c) :] for w, c in zip(words.take(pa.array(cut)).to_pylist(), core.take(pa.array(cut)).to_pylist(), strict=True)]
        pieces = pa.concat_arrays([core, pa.array(tails, core.type)]).dictionary_encode()
        number, names = pieces.indices.to_numpy(), pieces.dictionary
        plain = pc.match_substring_regex(names, PLAIN)
        length = np.zeros(len(names), np.int64)
        begin = np.zeros(len(names), np.int64)
        pool, used = [], 0
        for which, encode in ((plain, self._plain), (pc.invert(plain), self._each)):
            at = np.flatnonzero(which.to_numpy(zero_copy_only=False))
            if len(at):
                ids, length[at] = encode(names.take(pa.array(at)))
                begin[at] = used + np.cumsum(length[at]) - length[at]
                pool.append(ids)
                used += len(ids)
        # The pieces of each word in order: its core, and its marks if it has some.
        n = len(words)
        owner = np.concatenate([np.arange(n), cut])
        order = np.argsort(owner, kind="stable")
        piece = number[order]
        size = np.bincount(owner, length[number], n).astype(np.int64)
        self.start.extend(self.pool.size + np.cumsum(size) - size)
        self.length.extend(size)
        self.pool.extend(gather(np.concatenate(pool), begin[piece], length[piece]))

    def rows(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The number of each chunk of the texts, and where each text's chunks begin."""
        if self.index.full():
            self.index.clear()
            for held in (self.start, self.length, self.pool):
                held.clear()
        # Plain ASCII in small letters has fewer distinct chunks; the vocabulary ignores case but in special strings.
        simple = pc.and_(pc.string_is_ascii(texts), pc.invert(pc.match_substring(texts, "<|")))
        words, begins = split_words(pc.if_else(simple, pc.ascii_lower(texts), texts), lower=False)
        return self.index.rows(words, self.learn), begins

    def counts(self, texts: pa.Array) -> np.ndarray:
        """The number of ids of each text."""
        rows, begins = self.rows(texts)
        total = np.concatenate([[0], np.cumsum(self.length.values[rows])])
        return total[begins[1:]] - total[begins[:-1]]

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text's begin."""
        rows, begins = self.rows(texts)
        lengths = self.length.values[rows]
        ids = gather(self.pool.values, self.start.values[rows], lengths)
        return ids, np.concatenate([[0], np.cumsum(lengths)])[begins]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """For each UTF-8 text its ids as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        column = pa.array([t.decode("utf-8", "replace") for t in texts], pa.large_string())
        for a, b in byte_slices(column, SLICE):
            ids, begins = self.ids(column.slice(a, b - a))
            out += [ids[x:y].tobytes() for x, y in zip(begins[:-1], begins[1:], strict=True)]
        return out
