"""A character-level bidirectional LSTM with CRF transitions, in numpy."""

from __future__ import annotations

import numpy as np

#: Character classes: printable ASCII, white space, small letters, capital letters and all else beyond ASCII.
CLASSES = 99
EMBED, HIDDEN = 12, 24


def char_ids(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    out = np.where((code >= 32) & (code < 127), code - 32, 95)
    far = code >= 127
    if far.any():
        out[far] = [97 if c.isupper() else 96 if c.isalpha() else 98 for c in map(chr, code[far])]
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Tagger:
    def __init__(self, tags: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"embed": draw(CLASSES, EMBED), "out": draw(2 * HIDDEN, tags), "bias": np.zeros(tags, np.float32), "move": np.zeros((tags, tags), np.float32)}
        for d in "fb":
            self.p |= {f"w{d}": draw(EMBED, 4 * HIDDEN), f"u{d}": draw(HIDDEN, 4 * HIDDEN), f"c{d}": np.zeros(4 * HIDDEN, np.float32)}
            self.p[f"c{d}"][HIDDEN : 2 * HIDDEN] = 1  # remember at first

    def _run(self, x: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """x: (time, rows) of character classes, -1 where a text has ended. Hidden states (time, rows, HIDDEN)."""
        p = self.p
        table = p["embed"] @ p[f"w{d}"] + p[f"c{d}"]
        steps, n = x.shape
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        out = np.zeros((steps, n, HIDDEN), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            live = (x[t] >= 0)[:, None]
            z = table[x[t]] + h @ p[f"u{d}"]
            gates = sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            c1 = (f * c + i * g) * live
            tc = np.tanh(c1)
            h1 = o * tc * live
            if keep is not None:
                keep.append((t, live, i, f, o, g, c, tc, h))
            h, c = h1, c1
            out[t] = h
        return out

    def emissions(self, x: np.ndarray) -> np.ndarray:
        h = np.concatenate([self._run(x, "f"), self._run(x, "b")], 2)
        return h @ self.p["out"] + self.p["bias"]

    def train(self, windows: list[tuple[np.ndarray, np.ndarray]], steps: int = 220, batch: int = 40, rate: float = 0.012, seed: int = 5) -> None:
        """Adam on the CRF's negative log-likelihood of (characters, tags)."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, steps + 1):
            part = [windows[i] for i in rng.integers(0, len(windows), batch)]
            length = max(len(a) for a, _ in part)
            x, y = np.full((length, batch), -1), np.zeros((length, batch), np.int64)
            for k, (a, b) in enumerate(part):
                x[: len(a), k], y[: len(b), k] = a, b
            grads = self.gradients(x, y)
            norm = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
            lr = rate * (1.0 if step <= steps * 0.6 else 0.3)
            for k, g in grads.items():
                g = g * min(1.0, 5 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.99 * s[k] + 0.01 * g * g
                self.p[k] = (self.p[k] - lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        steps, n = x.shape
        live = x >= 0
        kept: dict[str, list] = {"f": [], "b": []}
        h = np.concatenate([self._run(x, d, kept[d]) for d in "fb"], 2)
        e = (h @ p["out"] + p["bias"]).astype(np.float64)
        de, dmove = crf_gradients(e, p["move"].astype(np.float64), y, live)
        de, dmove = (de / n).astype(np.float32), (dmove / n).astype(np.float32)
        g = {"move": dmove, "bias": de.sum((0, 1)), "out": h.reshape(steps * n, -1).T @ de.reshape(steps * n, -1)}
        dh_all = de @ p["out"].T
        dembed = np.zeros_like(p["embed"])
        for d, part in (("f", dh_all[:, :, :HIDDEN]), ("b", dh_all[:, :, HIDDEN:])):
            dtable, du = np.zeros((CLASSES, 4 * HIDDEN), np.float32), np.zeros_like(p[f"u{d}"])
            dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
            for t, alive, i, f, o, gg, c, tc, h0 in reversed(kept[d]):
                dh1 = (part[t] + dh) * alive
                dc1 = (dc + dh1 * o * (1 - tc * tc)) * alive
                dz = np.concatenate([dc1 * gg * i * (1 - i), dc1 * c * f * (1 - f), dh1 * tc * o * (1 - o), dc1 * i * (1 - gg * gg)], 1)
                np.add.at(dtable, x[t], dz * alive)
                du += h0.T @ dz
                dh = dz @ p[f"u{d}"].T
                dc = dc1 * f
            g[f"u{d}"], g[f"c{d}"], g[f"w{d}"] = du, dtable.sum(0), p["embed"].T @ dtable
            dembed += dtable @ p[f"w{d}"].T
        g["embed"] = dembed
        return g


def logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def crf_gradients(e: np.ndarray, move: np.ndarray, y: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the negative log-likelihood: marginals less the true tags, and so for the moves."""
    steps, n, k = e.shape
    a = np.zeros((steps, n, k))
    a[0] = e[0]
    for t in range(1, steps):
        a[t] = np.where(live[t][:, None], logsum(a[t - 1][:, :, None] + move, 1) + e[t], a[t - 1])
    z = logsum(a[-1], 1)
    b = np.zeros((n, k))
    de, dmove = np.zeros_like(e), np.zeros_like(move)
    rows = np.arange(n)
    for t in range(steps - 1, -1, -1):
        on = live[t][:, None]
        de[t] = np.exp(a[t] + b - z[:, None]) * on
        de[t, rows, y[t]] -= live[t]
        if t:
            after = e[t] + b
            pair = np.exp(a[t - 1][:, :, None] + move + after[:, None, :] - z[:, None, None]) * live[t][:, None, None]
            dmove += pair.sum(0)
            np.add.at(dmove, (y[t - 1], y[t]), -live[t].astype(float))
            b = np.where(on, logsum(move + after[:, None, :], 2), b)
    return de, dmove


def viterbi(regions: list[np.ndarray], move: np.ndarray, cells: int = 400_000) -> list[np.ndarray]:
    """The best tags of each region, from its emissions (length, tags). Regions of like length are decoded side by side, so many that they
    have about `cells` places together with what they are padded by."""
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(regions)
    order = sorted(range(len(regions)), key=lambda i: -len(regions[i]))
    s = 0
    while s < len(order):
        part = order[s : s + max(1, cells // max(1, len(regions[order[s]])))]
        s += len(part)
        lengths = np.array([len(regions[i]) for i in part])
        steps, n, k = int(lengths.max()), len(part), move.shape[0]
        e = np.zeros((steps, n, k), np.float32)
        for j, i in enumerate(part):
            e[: lengths[j], j] = regions[i]
        best, back = forward(e, move, None, lengths)
        for j, i in enumerate(part):
            out[i] = trace(back[: lengths[j], j], int(best[j].argmax()))
    return out


def forward(e: np.ndarray, move: np.ndarray, best: np.ndarray | None, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best scores after emissions (steps, rows, tags), from those before (None at the beginning), and where each came from."""
    back = np.zeros(e.shape, np.int8)
    for t in range(len(e)):
        if best is None:
            best = e[0].astype(float)
            continue
        way = best[:, :, None] + move
        back[t] = way.argmax(1)
        best = np.where((t < lengths)[:, None], way.max(1) + e[t], best)
    return best, back


def trace(back: np.ndarray, last: int) -> np.ndarray:
    """The path that ends with tag `last`."""
    path = np.zeros(len(back), np.int64)
    path[-1] = last
    for t in range(len(back) - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def viterbi_long(length: int, emissions, move: np.ndarray, piece: int) -> np.ndarray:
    """The best tags of one region of any length, emissions(a, b) giving those of its places a to b. Forward only the scores at the
    beginning of each piece are kept; backward each piece is run again for its own way."""
    begins = list(range(0, length, piece))
    scores: list[np.ndarray | None] = []
    best = None
    for a in begins:
        scores.append(best)
        e = emissions(a, min(length, a + piece))
        best, _ = forward(e[:, None], move, best, np.array([len(e)]))
    path = np.zeros(length, np.int64)
    last = int(best[0].argmax())
    for a, before in zip(reversed(begins), reversed(scores), strict=True):
        e = emissions(a, min(length, a + piece))
        _, back = forward(e[:, None], move, before, np.array([len(e)]))
        path[a : a + len(e)] = trace(back[:, 0], last)
        last = int(back[0, 0, path[a]])
    return path
