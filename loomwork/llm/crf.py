"""Two-state linear-chain conditional random fields over many sequences at once.

A sequence is a run of rows; state 1 has the score (logit) that its features give, state 0 has 0; steps[i, j] scores
state j after state i. All sequences advance together, longest first, so one array operation serves each position.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def _messages(scores: np.ndarray, starts: np.ndarray, lengths: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normalised forward and backward messages for state 1 of each row."""
    unary, m = np.exp(np.clip(scores, -30, 30)), np.exp(steps)
    ahead, back = np.empty_like(unary), np.empty_like(unary)
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    alive = np.searchsorted(-lengths, -np.arange(int(lengths[0]) if len(lengths) else 0), "left")
    at = starts
    f = unary[at] / (1 + unary[at]) if len(at) else unary[:0]
    for t, k in enumerate(alive):
        at = starts[:k] + t
        if t:
            f = f[:k]
            one = unary[at] * (m[0, 1] + f * (m[1, 1] - m[0, 1]))
            f = one / (one + m[0, 0] + f * (m[1, 0] - m[0, 0]))
        else:
            f = f[:k]
        ahead[at] = f
    last = starts + lengths - 1
    b = np.full(len(starts), 0.5)
    for t, k in enumerate(alive):
        at = last[:k] - t
        if t:
            b = b[:k]
            one = unary[at + 1] * b
            zero = 1 - b
            to1, to0 = m[1, 0] * zero + m[1, 1] * one, m[0, 0] * zero + m[0, 1] * one
            b = to1 / (to1 + to0)
        else:
            b = b[:k]
        back[at] = b
    return ahead, back


def marginals(scores: np.ndarray, starts: np.ndarray, lengths: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Probability of state 1 of each row; sequences cover all rows and none is empty."""
    ahead, back = _messages(scores, starts, lengths, steps)
    one, zero = ahead * back, (1 - ahead) * (1 - back)
    return one / np.maximum(one + zero, 1e-300)


def fit(score: Callable[[np.ndarray], np.ndarray], gradient: Callable[[np.ndarray], np.ndarray], size: int, labels: np.ndarray, starts: np.ndarray, lengths: np.ndarray, *, rounds: int, rate: float, l2: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights and steps of the largest penalised likelihood that Adam finds in a fixed number of rounds.

    score(weights) gives each row's score, gradient(residuals) sums residuals by weight.
    """
    params = np.zeros(size + 4)
    first, second = np.zeros_like(params), np.zeros_like(params)
    n = max(1, len(labels))
    inner = np.ones(len(labels), bool)
    inner[starts + lengths - 1] = False
    left = np.flatnonzero(inner)
    seen = np.bincount(labels[left] * 2 + labels[left + 1], minlength=4).astype(float)
    for t in range(1, rounds + 1):
        steps = params[size:].reshape(2, 2)
        scores = score(params[:size])
        ahead, back = _messages(scores, starts, lengths, steps)
        p = ahead * back / np.maximum(ahead * back + (1 - ahead) * (1 - back), 1e-300)
        unary, m = np.exp(np.clip(scores, -30, 30)), np.exp(steps)
        a, b = ahead[left], back[left + 1]
        one, zero = unary[left + 1] * b, 1 - b
        pairs = [lambda a=x, m=m[i, j], b=y: a() * m * b for i, x in enumerate((lambda: 1 - a, lambda: a)) for j, y in enumerate((zero, one))]  # made one by one
        total = pairs[0]()
        for pair in pairs[1:]:
            total += pair()
        np.maximum(total, 1e-300, out=total)
        g = np.concatenate((gradient(labels - p), seen - np.array([(pair() / total).sum() for pair in pairs]))) / n - l2 * params
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        params = params + rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-9)
    return params[:size], params[size:].reshape(2, 2)
