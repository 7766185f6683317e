"""Linear-chain conditional random fields over many sequences at once.

Sequences are laid out by time: all first items, all second items and so on,
longest sequence first, so one step handles every sequence that is still
running.  Each item is visited once forwards and once backwards, whatever the
lengths; nothing is padded or cut.
"""

from __future__ import annotations

import numpy as np


class Layout:
    """Where item t of sequence s stands.  ``place[i]`` is the place of flat item i."""

    def __init__(self, lengths: np.ndarray) -> None:
        lengths = np.asarray(lengths, dtype=np.int64)
        self.lengths, self.total = lengths, int(lengths.sum())
        order = np.argsort(-lengths, kind="stable")
        self.rank = np.empty(len(lengths), dtype=np.int64)
        self.rank[order] = np.arange(len(lengths))
        steps = int(lengths.max()) if len(lengths) else 0
        ended = np.bincount(lengths, minlength=steps + 1)
        self.running = (len(lengths) - np.cumsum(ended))[:steps]
        self.offset = np.concatenate([[0], np.cumsum(self.running)])
        start = np.cumsum(lengths) - lengths
        t = np.arange(self.total) - np.repeat(start, lengths)
        self.place = self.offset[t] + np.repeat(self.rank, lengths)

    def packed(self, flat: np.ndarray) -> np.ndarray:
        out = np.empty_like(flat)
        out[self.place] = flat
        return out


def forward_backward(layout: Layout, scores: np.ndarray, transition: np.ndarray, start: np.ndarray, count: bool = False):
    """(marginals by flat item, expected transitions, expected starts, log partition); the last three only if ``count``."""
    labels = scores.shape[1]
    if not layout.total:
        return scores.copy(), np.zeros((labels, labels)), np.zeros(labels), 0.0
    top = scores.max(axis=1, keepdims=True)
    lift = layout.packed(np.exp(scores - top))
    step = np.exp(transition).astype(scores.dtype)
    alpha = np.empty_like(lift)
    norms = np.empty(layout.total, dtype=scores.dtype)
    previous = None
    for t, k in enumerate(layout.running):
        a = layout.offset[t]
        now = lift[a : a + k] * (np.exp(start).astype(scores.dtype) if t == 0 else previous[:k] @ step)
        norm = now.sum(axis=1)
        previous = now / norm[:, None]
        alpha[a : a + k] = previous
        norms[a : a + k] = norm
    pairs = np.zeros((labels, labels))
    beta = np.ones((int(layout.running[-1]), labels), dtype=scores.dtype)
    out = np.empty_like(alpha)
    for t in range(len(layout.running) - 1, -1, -1):
        a, k = layout.offset[t], layout.running[t]
        if len(beta) < k:
            beta = np.concatenate([beta, np.ones((k - len(beta), labels), dtype=scores.dtype)])
        out[a : a + k] = alpha[a : a + k] * beta
        if t:
            back = lift[a : a + k] * beta / norms[a : a + k, None]
            b = layout.offset[t - 1]
            if count:
                pairs += (alpha[b : b + k].T @ back) * step
            beta = back @ step.T
    out /= out.sum(axis=1, keepdims=True)
    starts = out[: layout.running[0]].sum(axis=0)
    flat = out[layout.place]
    return flat, pairs, starts, float(np.log(norms).sum() + top.sum()) if count else 0.0


def viterbi(layout: Layout, scores: np.ndarray, transition: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The best label of each flat item; ties go to the smaller label."""
    if not layout.total:
        return np.zeros(0, dtype=np.int64)
    packed = layout.packed(scores)
    choice = np.zeros(packed.shape, dtype=np.int8)
    best, last = None, np.zeros(len(layout.lengths), dtype=np.int64)
    for t, k in enumerate(layout.running):
        a = layout.offset[t]
        if t == 0:
            best = packed[:k] + start
        else:
            if k < len(best):
                last[k : len(best)] = best[k:].argmax(axis=1)
            via = best[:k, :, None] + transition[None]
            choice[a : a + k] = via.argmax(axis=1)
            best = via.max(axis=1) + packed[a : a + k]
    last[: len(best)] = best.argmax(axis=1)
    out = np.zeros(layout.total, dtype=np.int64)
    now = np.empty(0, dtype=np.int64)
    for t in range(len(layout.running) - 1, -1, -1):
        a, k = layout.offset[t], layout.running[t]
        now = np.concatenate([now, last[len(now) : k]])
        out[a : a + k] = now
        if t:
            now = choice[a : a + k][np.arange(k), now].astype(np.int64)
    return out[layout.place]


class Adam:
    """Adam steps over named arrays, changed in place."""

    def __init__(self, params: dict[str, np.ndarray], rate: float) -> None:
        self.params, self.rate, self.n = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, gradient: dict[str, np.ndarray]) -> None:
        self.n += 1
        for k, g in gradient.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.params[k] -= self.rate * (self.m[k] / (1 - 0.9**self.n)) / (np.sqrt(self.v[k] / (1 - 0.999**self.n)) + 1e-8)
