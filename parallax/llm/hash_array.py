"""A sorted array of hashes whose first bits tell where to look."""

from __future__ import annotations

import numpy as np


class HashArray:
    """Distinct evenly spread 64-bit keys, in order. There is about one key to a bucket, so that a look-up takes a step or two where a
    binary search takes twenty."""

    def __init__(self, keys: np.ndarray):
        bits = max(1, len(keys).bit_length())
        self.keys, self.shift = keys, np.uint64(64 - bits)
        self.first = np.searchsorted(keys >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)

    def find(self, asked: np.ndarray) -> np.ndarray:
        """The place of each asked key, -1 where there is none."""
        out = np.full(len(asked), -1)
        bucket = (asked >> self.shift).astype(np.int64)
        at, end = self.first[bucket], self.first[bucket + 1]
        left = np.flatnonzero(at < end)
        at = at[left]
        while len(left):
            hit = self.keys[at] == asked[left]
            out[left[hit]] = at[hit]
            at = at + 1
            on = ~hit & (at < end[left])
            left, at = left[on], at[on]
        return out
