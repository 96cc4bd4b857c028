"""Local-minimum fingerprints of byte windows, computed over whole Arrow batches."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inv = pow(_BASE, -1, 1 << 64)
    p = np.full(n, _BASE, np.uint64)
    q = np.full(n, inv, np.uint64)
    p[0] = q[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(p), np.multiply.accumulate(q)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def sliding(a: np.ndarray, w: int, op: np.ufunc, fill: int) -> np.ndarray:
    """``op`` over every window of ``w``; two accumulations over blocks of ``w``."""
    n = len(a)
    m = -(-n // w) * w
    padded = np.full(m, fill, a.dtype)
    padded[:n] = a
    blocks = padded.reshape(-1, w)
    ahead = op.accumulate(blocks, axis=1).reshape(-1)
    back = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return op(back[: n - w + 1], ahead[w - 1 : n])


class Winnower:
    """Every run of at least ``run`` bytes that two texts share puts an equal fingerprint into both.

    A fingerprint is the hash of ``gram`` bytes; of each window of ``run - gram + 1`` successive
    grams inside a text the least is kept, with all ties.
    """

    def __init__(self, run: int, gram: int, piece: int = 1 << 20):
        self.run, self.gram, self.window, self.piece = run, gram, run - gram + 1, piece
        self._pow, self._inv = _powers(1)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``data``: bytes of all texts, text i at offsets[i]:offsets[i+1]. Gives text index, position, hash."""
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        n, first = len(offsets) - 1, 0
        while first < n:  # texts in groups of about `piece` bytes: arrays of eight times that stay in memory
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + self.piece, "right")) - 1)
            lo, hi = int(offsets[first]), int(offsets[last])
            if hi - lo >= self.run:
                out.append(self._some(data[lo:hi], offsets[first : last + 1] - lo, first))
            first = last
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return tuple(np.concatenate(x) for x in zip(*out))  # type: ignore[return-value]

    def _some(self, b: np.ndarray, off: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, k, w = len(b), self.gram, self.window
        if len(self._pow) < n + 1:
            self._pow, self._inv = _powers(n + 1)
        with np.errstate(over="ignore"):
            s = np.zeros(n + 1, np.uint64)
            np.cumsum((b.astype(np.uint64) + np.uint64(1)) * self._pow[:n], out=s[1:])
            h = mix((s[k:] - s[:-k]) * self._inv[: n - k + 1])
        h |= np.uint64(1)  # 0 is less than all of them
        least = sliding(h, w, np.minimum, _MASK)
        inside = np.zeros(len(least) + 1, np.int32)  # windows that lie within one text
        starts, ends = off[:-1], off[1:]
        fits = ends - starts >= self.run
        np.add.at(inside, starts[fits], 1)
        np.add.at(inside, ends[fits] - self.run + 1, -1)
        least[np.cumsum(inside[:-1]) == 0] = 0
        padded = np.zeros(len(h) + w - 1, np.uint64)
        padded[w - 1 : w - 1 + len(least)] = least
        pos = np.flatnonzero(sliding(padded, w, np.maximum, 0) == h)
        text = np.searchsorted(off, pos, "right") - 1
        return text + first, pos - off[text], h[pos]
