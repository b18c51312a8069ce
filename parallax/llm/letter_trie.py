"""Words in a trie of letter-group counts, and the exact test of one edit, in numpy.

The letters are dealt into GROUPS groups. A word's vector is how many of its letters each group has, counts over MOST taken as MOST. One
replacement takes a letter from one group and gives one to another, one insertion or deletion changes one group by one: words one edit apart differ
by a surplus of one at most and a deficit of one at most. The trie's level g branches by the count of group g; the search goes down
depth-first, and each child takes along those of the asked words that can still pay for its count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .shingles import BASE, INVERSE, powers

GROUPS, MOST, BITS = 12, 31, 5
#: A node with at most so many words, or words and asked words of at most so many pairs, is compared at once; in a larger leaf only words
#: that share a half are.
SMALL, PAIRS = 6, 3000
#: Pairs that are handed over together, at least.
CHUNK = 200_000
#: Longest word, in code points, that is verified in arrays; pairs with a longer one are verified one by one.
WIDE = 48
#: Letters that a word may have: a-z and U+00C0 to U+00FF.
LETTERS = 256


def deal(counts: dict[int, int]) -> np.ndarray:
    """The group of each letter (by its code point below 256): the frequent letters are dealt out to and fro, so that groups are alike."""
    group = np.zeros(LETTERS, np.int64)
    known = sorted(range(LETTERS), key=lambda c: (-counts.get(c, 0), c))
    for i, c in enumerate(known):
        turn, place = divmod(i, GROUPS)
        group[c] = place if turn % 2 == 0 else GROUPS - 1 - place
    return group


def letters(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All words' code points (Latin-1 bytes) one after the other, and where each word begins (one place more than words)."""
    begins = np.concatenate([[0], np.cumsum(list(map(len, words)), dtype=np.int64)])
    return np.frombuffer(b"".join(words), np.uint8), begins


def vectors(words: list[bytes], group: np.ndarray) -> np.ndarray:
    """(words, GROUPS) counts."""
    raw, begins = letters(words)
    owner = np.repeat(np.arange(len(words)), np.diff(begins))
    found = np.bincount(owner * GROUPS + group[raw], minlength=len(words) * GROUPS)
    return np.minimum(found, MOST).reshape(len(words), GROUPS).astype(np.int8)


def packed(vector: np.ndarray) -> np.ndarray:
    """A vector as one number, the first group in the highest place."""
    out = np.zeros(len(vector), np.int64)
    for g in range(GROUPS):
        out = out << BITS | vector[:, g]
    return out


def unpacked(code: np.ndarray, depth: int = GROUPS) -> np.ndarray:
    return np.stack([code >> (BITS * (depth - 1 - g)) & MOST for g in range(depth)], 1).astype(np.int8) if depth else np.zeros((len(code), 0), np.int8)


def reachable(prefix: np.ndarray) -> Iterator[np.ndarray]:
    """Prefixes of the vectors' length that one edit may lead to and that are greater in order, as arrays of the vectors' shape; a row
    that has no such prefix (a count below 0 or over MOST) holds -1 in its first place."""
    depth = prefix.shape[1]
    for g in range(depth):
        # The first group that differs must grow, for the other prefix to be the greater one.
        for h in [None, *range(g + 1, depth)]:
            other = prefix.copy()
            other[:, g] += 1
            if h is not None:
                other[:, h] -= 1
            bad = (other[:, g] > MOST) | (other[:, h] < 0 if h is not None else False)
            other[bad, 0] = -1
            yield other


class Halves:
    """Hashes of the halves of words. One edit leaves one half of the shorter word as it is: its first length // 2 letters, or the others,
    at the same end of the longer word. `even` has both for a word that is the shorter one or as long, `odd` for the longer one."""

    def __init__(self, words: list[bytes]):
        raw, begins = letters(words)
        self.length = np.diff(begins)
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers(BASE, max(1, len(raw)))[: len(raw)], out=total[1:])
        back = powers(INVERSE, len(raw) + 1)
        start, end = begins[:-1], begins[1:]
        of = lambda a, b: (total[b] - total[a]) * back[a]
        half, less = self.length // 2, (self.length - 1) // 2
        self.even = of(start, start + half), of(start + half, end)
        self.odd = of(start, start + less), of(end - (self.length - 1 - less), end)

    def alike(self, asked: np.ndarray, words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of words of one length the pairs (asked, word) that share a half, each once."""
        gap = self.length[asked] - self.length[words[0]]
        for k, mine, theirs in ((0, self.even, self.even), (1, self.odd, self.even), (-1, self.even, self.odd)):
            q = asked[gap == k]
            for end in (0, 1) if len(q) else ():
                key = theirs[end][words]
                by = np.argsort(key)
                low, high = np.searchsorted(key[by], mine[end][q], "left"), np.searchsorted(key[by], mine[end][q], "right")
                n = high - low
                x = np.repeat(q, n)
                y = words[by[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)]]
                if end:  # those that share the first half, too, have been given
                    new = mine[0][x] != theirs[0][y]
                    x, y = x[new], y[new]
                yield x, y


class LetterTrie:
    """`words` (numbers of words) by their vectors, sorted: a node of the trie is a range of them."""

    def __init__(self, vector: np.ndarray, words: np.ndarray, halves: Halves):
        order = np.lexsort(vector[words].T[::-1])
        self.all, self.words, self.halves = vector, words[order], halves
        self.vector = vector[self.words]

    def near(self, asked: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(asked word, word of the trie), as numbers: at least all pairs that are one edit apart, each once, many together."""
        held, found = 0, []
        for pair in self._search(asked):
            found.append(pair)
            held += len(pair[0])
            if held > CHUNK:
                yield np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])
                held, found = 0, []
        if held:
            yield np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])

    def _search(self, asked: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        vector, depth = self.vector, self.vector.shape[1]
        none = np.zeros(len(asked), bool)
        stack = [(0, len(vector), 0, asked, none, none)] if len(vector) and len(asked) else []
        while stack:
            a, b, g, who, more, less = stack.pop()
            pairs = (b - a) * len(who)
            if pairs > PAIRS and (g == depth or (vector[a] == vector[b - 1]).all() and b - a > SMALL):
                gap = vector[a, g:] - self.all[who, g:]
                who = who[(np.maximum(gap, 0).sum(1) + more <= 1) & (np.maximum(-gap, 0).sum(1) + less <= 1)]
                if vector[a].max() < MOST and len(who):
                    yield from self.halves.alike(who, self.words[a:b])
                    continue
                g, more, less = depth, none[: len(who)], none[: len(who)]  # counts are cut off: lengths differ
            if g == depth or b - a <= SMALL or pairs <= PAIRS:
                step = max(1, 1_000_000 // (b - a))
                for s in range(0, len(who), step):
                    part = slice(s, s + step)
                    gap = vector[None, a:b, g:] - self.all[who[part], None, g:]
                    q, w = np.nonzero((np.maximum(gap, 0).sum(2) + more[part, None] <= 1) & (np.maximum(-gap, 0).sum(2) + less[part, None] <= 1))
                    yield who[part][q], self.words[a + w]
                continue
            column = vector[a:b, g]
            cuts = np.concatenate([[0], np.flatnonzero(column[1:] != column[:-1]) + 1, [b - a]])
            count = self.all[who, g]
            for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                gap = column[x] - count
                ok = (gap == 0) | (gap == 1) & ~more | (gap == -1) & ~less
                if ok.any():
                    stack.append((a + x, a + y, g + 1, who[ok], more[ok] | (gap[ok] == 1), less[ok] | (gap[ok] == -1)))


def one_edit(a: bytes, b: bytes) -> bool:
    """Whether one inserted, deleted or replaced letter makes b of a."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


class Verifier:
    """holds(i, j): whether the words of each pair are one edit apart."""

    def __init__(self, words: list[bytes]):
        self.words = words
        raw, begins = letters(words)
        self.length = np.diff(begins)
        self.width = int(min(WIDE, self.length.max(initial=1)))
        short = np.flatnonzero(self.length <= WIDE)
        self.left = np.zeros((len(words), self.width), np.uint8)
        self.right = np.zeros((len(words), self.width), np.uint8)
        size = self.length[short]
        owner = np.repeat(short, size)
        within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        at = np.repeat(begins[short], size) + within
        self.left[owner, within] = raw[at]
        self.right[owner, within + self.width - self.length[owner]] = raw[at]
        # Which letters a word has: one edit changes two of these marks at most.
        self.mask = np.zeros(len(words), np.uint64)
        np.bitwise_or.at(self.mask, np.repeat(np.arange(len(words)), self.length), np.uint64(1) << (raw % 64).astype(np.uint64))

    def holds(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), bool)
        la, lb = self.length[i], self.length[j]
        maybe = (np.abs(la - lb) <= 1) & (i != j) & (np.bitwise_count(self.mask[i] ^ self.mask[j]) <= 2)
        far = maybe & (np.maximum(la, lb) > WIDE)
        for k in np.flatnonzero(far).tolist():
            out[k] = one_edit(self.words[i[k]], self.words[j[k]])
        some = np.flatnonzero(maybe & ~far)
        for s in range(0, len(some), 200_000):
            k = some[s : s + 200_000]
            a, b = i[k], j[k]
            shorter, longer = np.minimum(self.length[a], self.length[b]), np.maximum(self.length[a], self.length[b])
            head, tail = self.left[a] != self.left[b], self.right[a] != self.right[b]
            first = np.where(head.any(1), head.argmax(1), self.width)
            last = np.where(tail.any(1), tail[:, ::-1].argmax(1), self.width)
            same = np.minimum(first, shorter) + np.minimum(last, shorter)
            out[k] = same >= np.where(shorter == longer, shorter - 1, shorter)
        return out
