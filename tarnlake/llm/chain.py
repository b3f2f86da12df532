"""Linear-chain conditional random field with two labels, over many sequences at once.

All sequences lie one behind the other in flat arrays; `first` marks where one begins. Forward and backward
passes are products of 2x2 matrices, so they are done in blocks: the product of each block (all blocks at once),
the state at each block's edge, then each block from its edge. The time doesn't depend on the longest sequence.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_BLOCK = 128
_CLIP = 30.0


def _blocks(x: np.ndarray, fill: float, block: int) -> np.ndarray:
    k = -(-len(x) // block)
    out = np.full(k * block, fill, x.dtype)
    out[: len(x)] = x
    return np.ascontiguousarray(out.reshape(k, block).T)


def _odds(w: np.ndarray, first: np.ndarray, t: np.ndarray, start: float) -> np.ndarray:
    """Odds r with r_t = w_t (t01 + t11 r') / (t00 + t10 r'), r' = r_(t-1); where a sequence begins, r_t = w_t start."""
    n = len(w)
    block = min(_BLOCK, max(1, int(n**0.5)))
    w, first = _blocks(w, 1.0, block), _blocks(first, True, block)
    (a, b), (c, d) = t
    k = w.shape[1]
    p00, p01, p10, p11 = np.ones(k), np.zeros(k), np.zeros(k), np.ones(k)
    for i in range(block):
        s, at = w[i], first[i]
        q00, q01 = np.where(at, p00 + p10, a * p00 + c * p10), np.where(at, p01 + p11, a * p01 + c * p11)
        q10, q11 = s * np.where(at, start * (p00 + p10), b * p00 + d * p10), s * np.where(at, start * (p01 + p11), b * p01 + d * p11)
        scale = 1.0 / (q00 + q01 + q10 + q11)
        p00, p01, p10, p11 = q00 * scale, q01 * scale, q10 * scale, q11 * scale
    edge, r = np.empty(k), 1.0
    for i, (x, y, z, v) in enumerate(zip(p00.tolist(), p01.tolist(), p10.tolist(), p11.tolist(), strict=True)):
        edge[i] = r
        r = (z + v * r) / max(x + y * r, 1e-300)
        r = min(max(r, 1e-250), 1e250)
    out = np.empty_like(w)
    r = edge
    for i in range(block):
        r = w[i] * np.where(first[i], start, (b + d * r) / (a + c * r))
        out[i] = r
    return out.T.reshape(-1)[:n]


@dataclass
class Chain:
    """`move[i, j]`: score of label j after label i; `begin`: score of label 1 against 0 at a sequence's start."""

    move: np.ndarray
    begin: float

    def marginals(self, scores: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(label 1) at each place, and P(label i here, j at the next place) as (n, 4) rows (0 where one ends)."""
        n = len(scores)
        if not n:
            return np.zeros(0), np.zeros((0, 4))
        t, w = np.exp(self.move), np.exp(np.clip(scores, -_CLIP, _CLIP))
        ahead = _odds(w, first, t, float(np.exp(self.begin)))
        last = np.append(first[1:], True)
        # what comes after, seen from a place: its label's odds from the next place on, that place's own score included
        after = _odds(w[::-1], last[::-1], t.T, 1.0)[::-1]
        back = np.ones(n)
        back[:-1] = np.where(last[:-1], 1.0, (t[1, 0] + t[1, 1] * after[1:]) / (t[0, 0] + t[0, 1] * after[1:]))
        odds = np.clip(ahead * back, 1e-300, 1e300)
        p = odds / (1 + odds)
        pairs = np.zeros((n, 4))
        on = ~last[:-1]
        if on.any():
            f, g = ahead[:-1][on], after[1:][on]
            both = np.stack([t[0, 0] + 0 * f, t[0, 1] * g, t[1, 0] * f, t[1, 1] * f * g], 1)
            pairs[:-1][on] = both / both.sum(1, keepdims=True)
        return p, pairs

    def fitted(self, scores_of, update, labels: np.ndarray, first: np.ndarray, rounds: int, rate: float = 0.5, l2: float = 1e-4) -> Chain:
        """Maximum likelihood by resilient steps over all places. `scores_of()` gives the label scores from the caller's
        weights; `update(d)` moves those weights, d being the gradient for each place's score."""
        last = np.append(first[1:], True)
        on = ~last[:-1]
        seen = np.bincount((2 * labels[:-1] + labels[1:])[on], minlength=4).astype(float)
        n = len(labels)
        begun = labels[first].sum()
        step, old = np.full(5, rate), np.zeros(5)
        for _ in range(rounds):
            p, pairs = self.marginals(scores_of(), first)
            update((labels - p) / n)
            grad = np.append((seen - pairs.sum(0)) / n - l2 * self.move.ravel(), (begun - p[first].sum()) / n - l2 * self.begin)
            step = np.clip(np.where(grad * old > 0, step * 1.2, np.where(grad * old < 0, step * 0.5, step)), 1e-6, 1.0)
            change = np.sign(grad) * step
            old = grad
            self.move = np.clip(self.move + change[:4].reshape(2, 2), -12, 12)
            self.begin = float(np.clip(self.begin + change[4], -12, 12))
        return self
