"""A linear-chain conditional random field with two states in numpy: training on windows, marginals of whole texts."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Chain:
    """Log potentials: trans[a, b] from state a to b; state 1 has the bias at every token, and word[f] for each of its features f."""

    trans: np.ndarray
    word: np.ndarray
    bias: float


def fit(y: np.ndarray, token: np.ndarray, feature: np.ndarray, size: int, start: Chain | None = None, steps: int = 80, rate: float = 0.2, prior: float = 0.5) -> tuple[Chain, np.ndarray]:
    """Maximum likelihood with an L2 prior by Adam; also the marginals of state 1 under the result.

    y: labels of windows x tokens. token, feature: which token (counted through all windows) has which feature, of size many.
    """
    n, length = y.shape
    trans, bias, word = (start.trans.copy(), np.array([start.bias]), start.word.copy()) if start else (np.zeros((2, 2)), np.zeros(1), np.zeros(size))
    params = [trans, bias, word]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    label = y.astype(float)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[:, :-1].ravel().astype(int), y[:, 1:].ravel().astype(int)), 1)
    alpha, beta, p = np.empty((length, n)), np.empty((length, n)), np.empty((length, n))
    for t in range(1, steps + 2):
        # alpha and beta hold the share of state 1: both states add up to one after each step
        e = np.exp(np.clip(bias[0] + np.bincount(token, weights=word[feature], minlength=n * length), -30, 30)).reshape(n, length).T
        a = np.exp(trans)
        alpha[0] = e[0] / (1 + e[0])
        for k in range(1, length):
            one = (alpha[k - 1] * a[1, 1] + (1 - alpha[k - 1]) * a[0, 1]) * e[k]
            alpha[k] = one / (one + alpha[k - 1] * a[1, 0] + (1 - alpha[k - 1]) * a[0, 0])
        beta[-1] = 0.5
        for k in range(length - 2, -1, -1):
            one, none = beta[k + 1] * e[k + 1], 1 - beta[k + 1]
            to_one, to_none = one * a[1, 1] + none * a[1, 0], one * a[0, 1] + none * a[0, 0]
            beta[k] = to_one / (to_one + to_none)
        np.multiply(alpha, beta, out=p)
        p /= p + (1 - alpha) * (1 - beta)
        if t > steps:
            break
        pair = np.zeros((2, 2))
        one, none = beta[1:] * e[1:], 1 - beta[1:]
        q = [[(1 - alpha[:-1]) * a[0, 0] * none, (1 - alpha[:-1]) * a[0, 1] * one], [alpha[:-1] * a[1, 0] * none, alpha[:-1] * a[1, 1] * one]]
        total = q[0][0] + q[0][1] + q[1][0] + q[1][1]
        for i in (0, 1):
            for j in (0, 1):
                pair[i, j] = (q[i][j] / total).sum()
        off = label - p.T
        grads = seen - pair - prior * trans, np.array([off.sum() - prior * bias[0]]), np.bincount(feature, weights=off.ravel()[token], minlength=size) - prior * word
        pace = rate * (1 - 0.9 * t / steps)
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            params[i] += pace * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.99**t)) + 1e-8)
    return Chain(trans, word, float(bias[0])), p.T


def neutral(model: Chain, n: np.ndarray) -> np.ndarray:
    """The product of n steps through words without known features, scaled; by eigenvalues, so a long run costs what a short one does."""
    step = np.exp(model.trans) * np.array([1.0, np.exp(model.bias)])
    values, left = np.linalg.eig(step)
    values, left = values.real, left.real
    order = np.argsort(-values)
    values, left = values[order], left[:, order]
    right = np.linalg.inv(left)
    ratio = np.clip(values[1] / values[0], -1, 1) ** n.astype(float)
    return np.clip(left[None, :, :1] @ right[None, :1, :] + ratio[:, None, None] * (left[None, :, 1:] @ right[None, 1:, :]), 0, None)


def marginals(model: Chain, score: np.ndarray, gap: np.ndarray, first: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """Probability of state 1 at each known word (one with known features) of some texts, by forward-backward over the whole texts.

    score, gap: sum of the weights of each known word's features, and how many other words stand before it (since the one before it);
    first: each text's first in them (one more at the end); tail: the unknown words after each text's last.
    """
    p = np.zeros(len(score))
    count = np.diff(first)
    if not len(score):
        return p
    emit = np.exp(np.stack([np.zeros(len(score)), np.clip(model.bias + score, -30, 30)], 1))
    a = np.exp(model.trans)
    before = neutral(model, gap)
    order = np.argsort(-count, kind="stable")
    n_live = np.searchsorted(-count[order], -np.arange(1, count.max() + 1), "right")
    alpha, beta = np.ones((len(score), 2)), np.ones((len(score), 2))
    start = np.exp(np.array([0.0, model.bias]))
    for k in range(int(count.max())):
        at = first[:-1][order[: n_live[k]]] + k
        g = gap[at]
        if k == 0:
            # the first word of a text has no step into it: a run of g unknown words has g - 1 steps
            came = np.where((g > 0)[:, None], np.einsum("j,ijk->ik", start, neutral(model, np.maximum(g - 1, 0))) @ a, 1.0)
        else:
            came = np.einsum("ij,ijk->ik", alpha[at - 1], before[at]) @ a
        alpha[at] = came * emit[at]
        alpha[at] /= alpha[at].sum(1, keepdims=True)
    for k in range(int(count.max()) - 1, -1, -1):
        own = order[: n_live[k]]
        at = first[:-1][own] + k
        is_last = count[own] == k + 1
        nxt = np.minimum(at + 1, len(score) - 1)
        via = (beta[nxt] * emit[nxt]) @ a.T
        via = np.einsum("ijk,ik->ij", before[nxt], np.where(is_last[:, None], 1.0, via))
        beta[at] = np.where(is_last[:, None], neutral(model, tail[own]).sum(2), via)
        beta[at] /= beta[at].sum(1, keepdims=True)
    p = alpha * beta
    return p[:, 1] / p.sum(1)
