"""Similarities of one dataset x (taxa x sites) in numpy, for kernels that work on a dataset each."""

from __future__ import annotations

import numpy as np


def one_hot(x: np.ndarray) -> np.ndarray:
    """(state, taxon, site) for the states that occur."""
    return np.stack([(x == a) for a in np.unique(x)]).astype(np.float32)


def hamming(x: np.ndarray) -> np.ndarray:
    same = sum(h @ h.T for h in one_hot(x))
    return 1 - same.astype(np.float64) / x.shape[1]


def jc(x: np.ndarray, k: int | None = None) -> np.ndarray:
    k = k or max(2, len(np.unique(x)))
    base = 1 - hamming(x) * k / (k - 1)
    return np.sign(base) ** (k - 1) * np.abs(base) ** (k - 1)


def jc_gamma(x: np.ndarray, shape: float = 5.0) -> np.ndarray:
    base = np.maximum(1 - hamming(x) * 4 / 3, 1e-9)
    return np.exp(-0.75 * shape * (base ** (-1 / shape) - 1))


def joint(x: np.ndarray) -> np.ndarray:
    """(i, j, a, b): joint frequencies."""
    h = one_hot(x)
    return np.einsum("ain,bjn->ijab", h, h, optimize=True).astype(np.float64) / x.shape[1]


def paralinear(x: np.ndarray) -> np.ndarray:
    det = np.linalg.det(joint(x))
    own = np.sqrt(np.abs(np.diag(det)))
    scale = np.outer(own, own)
    return np.divide(det, scale, out=np.zeros_like(det), where=scale > 0)


def hky(x: np.ndarray) -> np.ndarray:
    """States A C G T are 0 to 3."""
    h = np.stack([(x == a) for a in range(4)]).astype(np.float32)
    n = x.shape[1]
    share = h.sum(axis=2).astype(np.float64) / n
    ga, gc, gg, gt = ((share[a][:, None] + share[a][None, :]) / 2 for a in range(4))
    cross = lambda a, b: (h[a] @ h[b].T + h[b] @ h[a].T).astype(np.float64) / n
    p1, p2 = cross(0, 2), cross(1, 3)
    q = hamming(x) - p1 - p2
    gr, gy = ga + gg, gc + gt
    with np.errstate(divide="ignore", invalid="ignore"):
        r, y, t = 1 - gr / (2 * ga * gg) * p1 - q / (2 * gr), 1 - gy / (2 * gt * gc) * p2 - q / (2 * gy), 1 - q / (2 * gr * gy)
        powers = ((r, 8 * ga * gg / gr), (y, 8 * gt * gc / gy), (t, 8 * (gr * gy - ga * gg * gy / gr - gt * gc * gr / gy)))
        s = np.prod([np.sign(b) * np.abs(b) ** e for b, e in powers], axis=0)
    return np.maximum(np.nan_to_num(s), 0)


def correlation(x: np.ndarray) -> np.ndarray:
    return np.corrcoef(x) ** 2


def information(x: np.ndarray) -> np.ndarray:
    """Binary: exp of minus the information distance."""
    p = joint(x)
    margins = p.sum(axis=3).prod(axis=2) * p.sum(axis=2).prod(axis=2)
    return np.abs(np.linalg.det(p)) / np.sqrt(margins + 1e-10) + 1e-10


def identity(x: np.ndarray) -> np.ndarray:
    """exp(-h): its distance is the share of differing sites."""
    return np.exp(-hamming(x))


#: Metrics by name; others can be added with reconstruct.register_metric.
METRICS = {"jc": jc, "jc_gamma": jc_gamma, "paralinear": paralinear, "hky": hky, "correlation": correlation, "information": information, "identity": identity}
