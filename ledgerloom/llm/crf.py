"""Two-label linear-chain conditional random fields: batched forward-backward and fitting in numpy.

A chain has a score for label 1 against label 0 at each place and four transition scores. Batches
of chains are padded; places past a chain's end do not count. Fitting is full-batch Adam on the
mean log-likelihood of chains that callers cut to a bounded length."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

CLIP = 30.0


def forward_backward(unary: np.ndarray, lengths: np.ndarray, trans: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Probabilities of label 1, shape (chains, places), and on request the expected transitions."""
    b, n = unary.shape
    e = np.exp(np.clip(unary, -CLIP, CLIP)).T
    t = np.exp(trans)
    live = np.arange(n)[:, None] < lengths[None, :]
    a0, a1, scale = np.empty((n, b)), np.empty((n, b)), np.empty((n, b))
    x0, x1 = np.ones(b), e[0].copy()
    for k in range(n):
        if k:
            x0, x1 = x0 * t[0, 0] + x1 * t[1, 0], (x0 * t[0, 1] + x1 * t[1, 1]) * e[k]
        s = x0 + x1
        x0, x1 = x0 / s, x1 / s
        a0[k], a1[k], scale[k] = x0, x1, s
    y0, y1 = np.ones(b), np.ones(b)
    out = np.empty((n, b))
    expected = np.zeros((2, 2)) if pairs else None
    for k in range(n - 1, -1, -1):
        p0, p1 = a0[k] * y0, a1[k] * y1
        out[k] = p1 / (p0 + p1)
        if not k:
            break
        z0, z1 = y0 / scale[k], y1 * e[k] / scale[k]
        inside = live[k]
        if pairs:
            h0, h1 = a0[k - 1] * inside, a1[k - 1] * inside
            expected += [[(h0 * z0).sum() * t[0, 0], (h0 * z1).sum() * t[0, 1]], [(h1 * z0).sum() * t[1, 0], (h1 * z1).sum() * t[1, 1]]]
        y0, y1 = np.where(inside, t[0, 0] * z0 + t[0, 1] * z1, 1.0), np.where(inside, t[1, 0] * z0 + t[1, 1] * z1, 1.0)
    return out.T, expected


def marginals(chains: list[np.ndarray], trans: np.ndarray, cells: int = 400_000) -> list[np.ndarray]:
    """Probabilities of label 1 along each chain; chains of like length share a padded batch."""
    out: list[np.ndarray] = [np.zeros(0)] * len(chains)
    order = [i for i in sorted(range(len(chains)), key=lambda i: len(chains[i])) if len(chains[i])]
    at = 0
    while at < len(order):
        stop = at + 1
        while stop < len(order) and stop - at < 1024 and len(chains[order[stop]]) * (stop - at + 1) <= cells:
            stop += 1
        part = order[at:stop]
        lengths = np.array([len(chains[i]) for i in part])
        unary = np.zeros((len(part), lengths[-1]))
        for k, i in enumerate(part):
            unary[k, : lengths[k]] = chains[i]
        p, _ = forward_backward(unary, lengths, trans)
        for k, i in enumerate(part):
            out[i] = p[k, : lengths[k]]
        at = stop
    return out


def fit(labels: np.ndarray, lengths: np.ndarray, theta: np.ndarray, score: Callable, gradient: Callable, rounds: int = 60, rate: float = 0.15, ridge: float = 1e-3, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """theta and transitions of the likeliest field. labels: 0/1 of shape (chains, places);
    score(theta) gives the unary scores, gradient(d) the theta gradient of unary gradients d."""
    b, n = labels.shape
    live = np.arange(n)[None, :] < lengths[:, None]
    w = np.ones(b) if weight is None else weight
    both = live[:, 1:] & live[:, :-1]
    seen = np.array([[((labels[:, :-1] == i) & (labels[:, 1:] == j) & both).sum() for j in (0, 1)] for i in (0, 1)], float)
    trans = np.zeros((2, 2))
    total = max(1.0, float(live.sum()))
    state = [np.zeros_like(theta), np.zeros_like(theta), np.zeros((2, 2)), np.zeros((2, 2))]
    for k in range(1, rounds + 1):
        p, expected = forward_backward(score(theta), lengths, trans, True)
        grads = [gradient((labels - p) * live * w[:, None]) / total - ridge * theta, (seen - expected) / total - ridge * trans]
        for i, (value, g) in enumerate(zip((theta, trans), grads, strict=True)):
            m, v = state[2 * i], state[2 * i + 1]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            value += rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return theta, trans


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.05, rounds: int = 30) -> np.ndarray:
    """Weights (the last one constant) of a weighted logistic regression, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    beta = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[-1, -1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -CLIP, CLIP)))
        h = x.T @ (x * (weight * p * (1 - p) + 1e-9)[:, None]) + penalty
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - penalty @ beta)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def probability(x: np.ndarray, beta: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(np.column_stack([x, np.ones(len(x))]) @ beta, -CLIP, CLIP)))
