"""Small numpy pieces that the trained operators share."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Adam:
    """Updates named arrays in place."""

    def __init__(self, params: dict[str, np.ndarray], rate: float = 3e-3, decay: float = 1e-4) -> None:
        self.params, self.rate, self.decay, self.t = params, rate, decay, 0
        self.m, self.v = ({k: np.zeros_like(p) for k, p in params.items()} for _ in range(2))

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grads.items():
            m, v, p = self.m[k], self.v[k], self.params[k]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= self.rate * (m / (1 - 0.9**self.t) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8) + self.decay * p)


def shift(logits: np.ndarray, labels: np.ndarray, at: float, share: float | None = None) -> float:
    """What to add to logits so that the best cut, in the middle of its gap, becomes the probability at. Best: of balanced accuracy, or with share (of label 1 among all) of F1."""
    order = np.argsort(logits)
    z, y = logits[order], labels[order].astype(bool)
    if not len(z) or y.all() or not y.any():
        return 0.0
    under = np.r_[0, np.cumsum(~y)] / (~y).sum()  # zeros below each cut
    over = 1 - np.r_[0, np.cumsum(y)] / y.sum()
    good = under + over if share is None else 2 * share * over / (share * over + (1 - share) * (1 - under) + share)
    edges = np.r_[z[0] - 2, (z[1:] + z[:-1]) / 2, z[-1] + 2]
    best = np.flatnonzero(good >= good.max() - 1e-12)
    cut = edges[best[len(best) // 2]]
    return float(np.log(at / (1 - at)) - cut)


def word_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs without blanks, tabs to carriage returns) of texts raw[offsets[k]:offsets[k + 1]], and by text the number of words before it."""
    ink = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    edge = edge[:-1]
    prev = np.r_[False, ink[:-1]]
    starts = np.flatnonzero(ink & (~prev | edge))
    ends = np.flatnonzero(np.r_[prev[1:] & (~ink[1:] | edge[1:]), ink[-1:]]) + 1 if len(raw) else starts
    return starts, ends, np.searchsorted(starts, offsets)


_POWER = 0x9E3779B97F4A7C15
_INVERSE = pow(_POWER, -1, 1 << 64)


def hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each raw[starts[k]:ends[k]]."""
    power, inverse = (np.full(len(raw) + 1, np.uint64(p)) for p in (_POWER, _INVERSE))
    power[0] = inverse[0] = 1
    np.cumprod(power, out=power)
    np.cumprod(inverse, out=inverse)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[:-1], out=sums[1:])
    h = (sums[ends] - sums[starts]) * inverse[starts]
    h ^= (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x9FB21C651E98DF25)
    return h ^ h >> np.uint64(29)


_STEP = 0xC2B2AE3D27D4EB4F
_BACK = pow(_STEP, -1, 1 << 64)


def rolled(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive hashes."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    power, back = (np.full(len(h) + 1, np.uint64(p)) for p in (_STEP, _BACK))
    power[0] = back[0] = 1
    np.cumprod(power, out=power)
    np.cumprod(back, out=back)
    sums = np.r_[np.uint64(0), np.cumsum(h * power[:-1])]
    x = (sums[k:] - sums[:-k]) * back[: len(h) - k + 1]
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)
