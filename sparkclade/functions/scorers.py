"""Scores of a block M = S[A, not A]: how far it is from rank one.  All are functions of its
singular values and its shape, so a scorer of one's own is a function of (sv, rows, columns)."""

from __future__ import annotations

import numpy as np


def _all_but_first(sv):
    return float((sv[1:] ** 2).sum())


def _second(sv):
    return float(sv[1]) if len(sv) > 1 else 0.0


def _gap(sv):
    return _second(sv) ** 2 - float(sv[0]) ** 2


def _squares(sv):
    return float((sv**2).sum())


def _minors(sv):
    """The sum of squared 2 x 2 minors."""
    return (_squares(sv) ** 2 - float((sv**4).sum())) / 2


#: Scorers of the singular values of M.
BY_VALUES = {
    "second": lambda s, r, c: _second(s),
    "first": lambda s, r, c: float(s[0]),
    "second_of_two": lambda s, r, c: _second(s) / (s[0] + _second(s)),
    "second_of_all": lambda s, r, c: _second(s) / s.sum(),
    "rest": lambda s, r, c: float(s[1:].sum()),
    "rest_of_all": lambda s, r, c: float(s[1:].sum() / s.sum()),
    "gap": lambda s, r, c: _gap(s),
    "gap_of_two": lambda s, r, c: _gap(s) / (s[0] ** 2 + _second(s) ** 2),
    "gap_of_all": lambda s, r, c: _gap(s) / _squares(s),
    "gap_root": lambda s, r, c: np.sqrt(max(_squares(s) ** 2 - _gap(s) ** 2, 0.0)) / (2 * s[0] * _second(s)) if _second(s) else np.inf,
    "gap_quarter": lambda s, r, c: (_squares(s) ** 2 - _gap(s) ** 2) / 4,
    "gap_quarter_of_two": lambda s, r, c: ((s[0] ** 2 + _second(s) ** 2) ** 2 - _gap(s) ** 2) / 4,
    "rest_by_root_size": lambda s, r, c: float(s[1:].sum()) / np.sqrt(r * c),
    "rest_by_size": lambda s, r, c: float(s[1:].sum()) / (r * c),
    "rest_by_side": lambda s, r, c: float(s[1:].sum()) / min(r, c),
    "rest_by_quartets": lambda s, r, c: float(s[1:].sum()) / max(r * (r - 1) * c * (c - 1), 1),
    "rest_by_root_quartets": lambda s, r, c: float(s[1:].sum()) / np.sqrt(max(r * (r - 1) * c * (c - 1), 1)),
    "first_times_rest": lambda s, r, c: s[0] ** 2 * _all_but_first(s),
    "rest_squares": lambda s, r, c: _all_but_first(s),
    "root_rest_squares": lambda s, r, c: np.sqrt(_all_but_first(s)),
    "first_times_rest_of_all": lambda s, r, c: s[0] ** 2 * _all_but_first(s) / _squares(s),
    "minors": lambda s, r, c: _minors(s),
    "minors_by_first": lambda s, r, c: _minors(s) / s[0] ** 2,
    "minors_by_size": lambda s, r, c: _minors(s) / (r * c),
    "minors_of_scaled": lambda s, r, c: _minors(s / s[0]),
    "nuclear": lambda s, r, c: float(s.sum()),
    "rest_over_first": lambda s, r, c: _all_but_first(s) / s[0] ** 2,
    "spread": lambda s, r, c: float(np.abs(s - s.mean()).sum()),
    "over": lambda s, r, c: _squares(s) ** 2 - s[0] ** 4,
    "stable_rank": lambda s, r, c: _squares(s) / s[0] ** 2,
    "squared_quartets": lambda s, r, c: 2 * _minors(s) / _squares(s) if _squares(s) else 0.0,
    "average_quartets": lambda s, r, c: (n * n - float((s**4).sum())) / n if (n := r * (r - 1) * c * (c - 1)) else 0.0,
}
#: Scorers of the singular values of the elementwise root of M.
BY_ROOT_VALUES = {"rest_of_root": "rest", "minors_of_root": "minors", "stable_rank_of_root": "stable_rank", "minors_of_scaled_root": "minors_of_scaled"}


def by_values(name: str):
    """block -> score."""
    if name in BY_ROOT_VALUES:
        inner = by_values(BY_ROOT_VALUES[name])
        return lambda block: inner(np.sqrt(np.maximum(block, 0)))
    if name == "max_quartet":
        return max_quartet
    f = BY_VALUES[name]

    def score(block: np.ndarray) -> float:
        sv = np.linalg.svd(block, compute_uv=False)
        return float(f(sv, *block.shape)) if sv[0] else 0.0

    return score


def max_quartet(block: np.ndarray) -> float:
    """The largest 2 x 2 minor, in absolute value."""
    best = 0.0
    for i in range(len(block) - 1):
        # Row i with each row below it: all minors are differences of outer products.
        for other in block[i + 1 :]:
            outer = np.outer(block[i], other)
            best = max(best, float(np.abs(outer - outer.T).max()))
    return best


#: Every scorer by name.
NAMES = [*BY_VALUES, *BY_ROOT_VALUES, "max_quartet"]


# Scores of a pair of clades (row indices a, b) in a similarity --------------------------------------


def _outside(s, a, b):
    return [x for x in range(len(s)) if x not in set(a) | set(b)]


def angle_of_second_vectors(s: np.ndarray, a: list[int], b: list[int]) -> float:
    """1 - cosine of the second right singular vectors of the clades' own blocks (of unit length; 1 where a clade has one row)."""
    rest = _outside(s, a, b)
    x, y = (np.linalg.svd(s[np.ix_(k, rest)])[2] for k in (a, b))
    return float(1 - x[1] @ y[1]) if min(len(x), len(y)) > 1 else 1.0


def alignment_of_rows(s: np.ndarray, a: list[int], b: list[int]) -> float:
    """-|X Y'| / sqrt(|a| |b|) of the clades' rows, scaled to unit length."""
    rest = _outside(s, a, b)
    x, y = (s[np.ix_(k, rest)] / np.linalg.norm(s[np.ix_(k, rest)], axis=1, keepdims=True) for k in (a, b))
    return float(-np.linalg.norm(x @ y.T) / np.sqrt(len(a) * len(b)))
