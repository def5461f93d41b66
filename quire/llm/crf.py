"""A linear-chain conditional random field with the states O and T (toxic), over many chains at once.

Forward and backward messages of all chains run together: chains are cut into segments, the transfer matrices of
all segments are multiplied side by side, messages cross segment borders chain by chain, and a second
sweep fills the segments.  The result equals the plain recursions; no chain is shortened.

Cases: chains without tokens have no marginals; a chain of one token has no transitions; no chains give empty arrays.
"""

from __future__ import annotations

import numpy as np

SEGMENT = 96


def _layout(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segment starts, lengths, and the first segment of each chain (with the total at the end)."""
    lens = np.diff(starts)
    per = -(-lens // SEGMENT)
    first = np.concatenate([[0], np.cumsum(per)])
    chain = np.repeat(np.arange(len(lens)), per)
    k = np.arange(first[-1]) - first[:-1][chain]
    at = starts[:-1][chain] + k * SEGMENT
    return at, np.minimum(SEGMENT, starts[1:][chain] - at), first


def messages(unary: np.ndarray, starts: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Normalised forward and backward messages ``(n, 2)`` and the sum of log partition functions.

    ``unary``: log potential of T over O at each token; ``trans[i, j]``: log potential of state j after state i.
    A chain starts after a virtual O.
    """
    n = len(unary)
    alpha, beta = np.ones((n, 2)), np.ones((n, 2))
    if not n:
        return alpha, beta, 0.0
    a, e = np.exp(trans - trans.max()), np.exp(np.clip(unary, -30, 30))
    at, size, first = _layout(starts)
    order = np.argsort(-size, kind="stable")
    at_o, size_o = at[order], size[order]
    live = [int(np.searchsorted(-size_o, -t, side="left")) for t in range(SEGMENT)]  # segments longer than t
    m = np.zeros((len(at), 2, 2))
    m[:, 0, 0] = m[:, 1, 1] = 1
    for t in range(SEGMENT):
        k = live[t]
        if not k:
            break
        x, w = m[:k] @ a, e[at_o[:k] + t]
        x[:, :, 1] *= w[:, None]
        m[:k] = x / x.max(axis=(1, 2), keepdims=True)
    whole = np.empty_like(m)
    whole[order] = m
    per = np.diff(first)
    chains = np.argsort(-per, kind="stable")
    heads, per_o = first[:-1][chains], per[chains]
    into, behind = np.ones((len(at), 2)), np.ones((len(at), 2))
    v = np.tile([1.0, 0.0], (len(chains), 1))
    for k in range(int(per_o[0])):
        c = int(np.searchsorted(-per_o, -k, side="left"))
        s = heads[:c] + k
        into[s] = v[:c]
        v[:c] = np.einsum("ni,nij->nj", v[:c], whole[s])
        v[:c] /= v[:c].sum(axis=1, keepdims=True)
    v = np.ones((len(chains), 2))
    for k in range(int(per_o[0]) - 1, -1, -1):
        c = int(np.searchsorted(-per_o, -k, side="left"))
        s = heads[:c] + k
        behind[s] = v[:c]
        v[:c] = np.einsum("nij,nj->ni", whole[s], v[:c])
        v[:c] /= v[:c].sum(axis=1, keepdims=True)
    log_z, v = 0.0, into[order]
    for t in range(SEGMENT):
        k = live[t]
        if not k:
            break
        x, w = v[:k] @ a, e[at_o[:k] + t]
        x[:, 1] *= w
        z = x.sum(axis=1, keepdims=True)
        log_z += float(np.log(z).sum())
        v[:k] = x / z
        alpha[at_o[:k] + t] = v[:k]
    v = behind[order]
    for t in range(SEGMENT - 1, -1, -1):
        k = live[t]
        if not k:
            continue
        w = e[at_o[:k] + t]
        beta[at_o[:k] + t] = v[:k]
        x = v[:k].copy()
        x[:, 1] *= w
        x = x @ a.T
        v[:k] = x / x.sum(axis=1, keepdims=True)
    return alpha, beta, log_z + n * float(trans.max())


def marginals(unary: np.ndarray, starts: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Probability of T at each token."""
    alpha, beta, _ = messages(unary, starts, trans)
    x = alpha * beta
    return x[:, 1] / x.sum(axis=1)


#: Tokens whose pairs of states are worked out at once in a step of the fit.
PART = 1 << 16


def fit(features: np.ndarray, starts: np.ndarray, labels: np.ndarray, size: int, steps: int = 40, rate: float = 0.25, l2: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights ``(size,)`` of hashed features ``(n_features, n_tokens)`` and transitions, by Adam on the conditional likelihood.

    ``features`` are numbered anew in place, since a copy of them would be most of the memory.
    """
    n = features.shape[1]
    w, trans = np.zeros(size), np.array([[0.0, -2.0], [0.0, -2.0]])
    present = np.zeros(size, dtype=bool)
    for row in features:
        present[row] = True
    used = np.flatnonzero(present)
    number = (np.cumsum(present) - 1).astype(features.dtype)
    for row in features:
        row[:] = number[row]
    local = features
    moment = [np.zeros(len(used)), np.zeros(len(used)), np.zeros((2, 2)), np.zeros((2, 2))]
    theta = np.zeros(len(used))
    prev = np.concatenate([[0], labels[:-1]])
    prev[starts[:-1][np.diff(starts) > 0]] = 0
    seen = np.zeros((2, 2))
    np.add.at(seen, (prev, labels), 1)
    heads = starts[:-1][np.diff(starts) > 0]
    for step in range(1, steps + 1):
        unary = np.zeros(n)
        for row in local:
            unary += theta[row]
        alpha, beta, _ = messages(unary, starts, trans)
        x = alpha * beta
        p = x[:, 1] / x.sum(axis=1)
        pairs = np.zeros((2, 2))
        for lo in range(0, n, PART):
            hi = min(lo + PART, n)
            before = np.concatenate([[[1.0, 0.0]] if lo == 0 else alpha[lo - 1 : lo], alpha[lo : hi - 1]])
            before[heads[(heads >= lo) & (heads < hi)] - lo] = [1.0, 0.0]
            after = beta[lo:hi].copy()
            after[:, 1] *= np.exp(np.clip(unary[lo:hi], -30, 30))
            pair = before[:, :, None] * np.exp(trans - trans.max())[None] * after[:, None, :]
            pair /= pair.sum(axis=(1, 2), keepdims=True)
            pairs += pair.sum(axis=0)
        off = p - labels
        del alpha, beta, x, p, unary
        grad = np.zeros(len(used))
        for row in local:
            grad += np.bincount(row, weights=off, minlength=len(used))
        grad = grad / n * 100 + l2 * theta
        grad_t = (pairs - seen) / n * 100
        grad_t[:, 0] = 0  # O after either state is the reference
        for value, g, i in ((theta, grad, 0), (trans, grad_t, 2)):
            moment[i] = 0.9 * moment[i] + 0.1 * g
            moment[i + 1] = 0.99 * moment[i + 1] + 0.01 * g * g
            value -= rate * (moment[i] / (1 - 0.9**step)) / (np.sqrt(moment[i + 1] / (1 - 0.99**step)) + 1e-8)
    w[used] = theta
    return w, trans
