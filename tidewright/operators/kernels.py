"""Small NumPy kernels that run inside one sub-model's task."""

from __future__ import annotations

import numpy as np


def automatic_rank(s: np.ndarray, rows: int, columns: int) -> int:
    """Singular values above the optimal hard threshold of the median one; at least 1."""
    b = rows / columns
    if b > 1:
        b = 1 / b
    omega = 0.56 * b**3 - 0.95 * b**2 + 1.43 + 1.82 * b
    return max(int(np.sum(s > omega * np.median(s))), 1)


def truncated(x: np.ndarray, k: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """u, s, v (columns) of the first k singular triplets, and all singular values; signs are fixed.

    The entry of largest size in each left vector is positive.
    """
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    if k is None:
        k = automatic_rank(s, *x.shape)
    k = max(0, min(k, len(s)))
    sign = np.sign(u[np.abs(u).argmax(axis=0), np.arange(u.shape[1])])
    sign[sign == 0] = 1
    return u[:, :k] * sign[:k], s[:k], vt[:k].T * sign[:k], s


def autoregression(u: np.ndarray, s: np.ndarray, v: np.ndarray, last: np.ndarray, p: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Weights that give the last row from the denoised others, by a pseudo-inverse of rank k; and the factors of these rows.

    Weights are in the order of the rows: the oldest step first.
    """
    head = (u[:-1] * s) @ v.T / p
    uw, sw, vw, _ = truncated(head, len(s))
    keep = sw > 1e-12 * (sw[0] if len(sw) else 1)
    weights = uw[:, keep] @ ((vw[:, keep].T @ last) / sw[keep])
    return weights, uw, sw, vw


def r_squared(truth: np.ndarray, guess: np.ndarray) -> float:
    ok = ~(np.isnan(truth) | np.isnan(guess))
    total = np.sum((truth[ok] - truth[ok].mean()) ** 2) if ok.any() else 0.0
    return float(1 - np.sum((truth[ok] - guess[ok]) ** 2) / total) if total > 0 else float("nan")


def append_columns(u: np.ndarray, s: np.ndarray, v: np.ndarray, new: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rank-k factors of [u s v', new]: the new columns' residual is orthonormalised and a small matrix decomposed."""
    inside = u.T @ new
    q, r = np.linalg.qr(new - u @ inside)
    top = np.hstack([np.diag(s), inside])
    bottom = np.hstack([np.zeros((r.shape[0], len(s))), r])
    a, s2, b, _ = truncated(np.vstack([top, bottom]), k)
    old = len(s)
    return np.hstack([u, q]) @ a, s2, np.vstack([v @ b[:old], b[old:]])


def fold_in(u: np.ndarray, s: np.ndarray, v: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Factors with the new columns projected on the old left vectors, which stay."""
    return u, s, np.vstack([v, new.T @ u / s])


def recurse(lags: np.ndarray, weights: np.ndarray, bias: float, ahead: int, projection: np.ndarray | None = None, observed: int = 0) -> np.ndarray:
    """``ahead`` values: each is bias + weights . the last values (oldest first).

    With a projection (uw uw'), the lag vectors of the first ``observed`` steps are
    projected before they are used.
    """
    n = len(weights)
    out = np.concatenate([lags[-n:], np.zeros(ahead)]) if n else np.zeros(ahead)
    for i in range(ahead):
        window = out[i : i + n]
        if projection is not None and i < observed:
            window = projection @ window
        out[n + i] = bias + (weights @ window if n else 0.0)
    return out[n:]
