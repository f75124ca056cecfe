"""Small dense algebra on moment blocks. Arrays are batched: first axis = fits.

A moment block is (n, mean[p+1], cov[p+1, p+1]) with the target in the last place.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def solve_batch(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Batched solve; near-singular systems give NaN and ``ok`` False."""
    scale = np.sqrt(np.clip(np.einsum("nii->ni", a), 0, None))
    safe = np.where(scale > 0, scale, 1.0)
    corr = a / safe[:, :, None] / safe[:, None, :]
    ok = (scale > 0).all(axis=1) & np.isfinite(a).all(axis=(1, 2)) & np.isfinite(b).all(axis=1)
    eye = np.eye(a.shape[1])
    corr = np.where(ok[:, None, None], corr, eye)
    ok &= np.linalg.eigvalsh(corr)[:, 0] > 1e-12
    corr = np.where(ok[:, None, None], corr, eye)
    x = np.linalg.solve(corr, (b / safe)[:, :, None])[:, :, 0] / safe
    x[~ok] = np.nan
    return x, ok


def ols(
    n: np.ndarray,
    mean: np.ndarray,
    cov: np.ndarray,
    idx: Sequence[int],
    log_weights: np.ndarray | None = None,
    sum_weights: np.ndarray | None = None,
) -> dict:
    """Least squares with intercept from moments; one result per batch entry.

    Weighted fits pass ``cov`` scaled by sum(w) / n, sum(ln w) and sum(w).
    """
    idx = list(idx)
    k = len(idx) + 1
    s = cov[:, idx][:, :, idx]
    c = cov[:, idx, -1]
    beta, ok = solve_batch(s, c)
    ok = ok & (n > k)
    vy = cov[:, -1, -1]
    ssr = np.maximum(n * (vy - np.einsum("ni,ni->n", beta, c)), 0.0)
    with np.errstate(all="ignore"):
        intercept = mean[:, -1] - np.einsum("ni,ni->n", beta, mean[:, idx])
        loglik2 = n * (np.log(2 * np.pi) + np.log(ssr / n) + 1)
        if log_weights is not None:
            loglik2 = loglik2 - log_weights
        aic = loglik2 + 2 * k
        bic = loglik2 + k * np.log(n)
        r2 = 1 - ssr / (n * vy)
        adj = 1 - (1 - r2) * (n - 1) / (n - k)
        sigma2 = ssr / (n - k)
        safe = np.where(ok[:, None, None], s, np.eye(len(idx)))
        inv = np.linalg.inv(safe) / n[:, None, None]
        m = mean[:, idx]
        var0 = 1 / (n if sum_weights is None else sum_weights) + np.einsum("ni,nij,nj->n", m, inv, m)
        se = np.sqrt(np.concatenate([var0[:, None], np.einsum("nii->ni", inv)], axis=1) * sigma2[:, None])
    coef = np.concatenate([intercept[:, None], beta], axis=1)
    return {"coef": coef, "se": se, "aic": aic, "bic": bic, "r2": r2, "adj_r2": adj, "ssr": ssr, "ok": ok & np.isfinite(aic)}


def ridge(
    sw: np.ndarray, mean: np.ndarray, cov: np.ndarray, idx: Sequence[int], alpha: float, positive: bool = False
) -> np.ndarray:
    """Ridge with a free intercept; optional non-negative slopes by coordinate descent. Returns [intercept, slopes]."""
    idx = list(idx)
    s = cov[:, idx][:, :, idx] * sw[:, None, None] + alpha * np.eye(len(idx))
    c = cov[:, idx, -1] * sw[:, None]
    beta = np.linalg.solve(s, c[:, :, None])[:, :, 0]
    if positive and (beta < 0).any():
        beta = np.maximum(beta, 0.0)
        for _ in range(2000):
            before = beta.copy()
            for j in range(len(idx)):
                rest = c[:, j] - np.einsum("ni,ni->n", s[:, j, :], beta) + s[:, j, j] * beta[:, j]
                beta[:, j] = np.maximum(rest / s[:, j, j], 0.0)
            if np.max(np.abs(beta - before)) < 1e-13:
                break
        else:
            # fits that have not settled leave as missing, not as good ones
            beta[np.abs(beta - before).max(axis=1) >= 1e-9] = np.nan
    intercept = mean[:, -1] - np.einsum("ni,ni->n", beta, mean[:, idx])
    return np.concatenate([intercept[:, None], beta], axis=1)


def merge_blocks(blocks: Sequence[tuple[float, np.ndarray, np.ndarray]]) -> tuple[float, np.ndarray, np.ndarray]:
    """Moments of the union of disjoint row sets."""
    n = sum(b[0] for b in blocks)
    mean = sum(b[0] * b[1] for b in blocks) / n
    second = sum(b[0] * (b[2] + np.outer(b[1] - mean, b[1] - mean)) for b in blocks)
    return n, mean, second / n
