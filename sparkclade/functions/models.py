"""Substitution models: how states, or real values, change along an edge.

A model has root(n, rng), the states of n sites at the root, and step(x, length, rng, rate),
the states below an edge of some length.  A class of one's own with these two works too."""

from __future__ import annotations

import numpy as np


class Transition:
    def root(self, n: int, rng: np.random.Generator) -> np.ndarray:
        raise NotImplementedError

    def step(self, x: np.ndarray, length: float, rng: np.random.Generator, rate: float = 1.0) -> np.ndarray:
        raise NotImplementedError


class Gaussian(Transition):
    """Real values: N(weight x + shift, length rate), from 0 at the root."""

    def __init__(self, weight: float = 1.0, shift: float = 0.0):
        self.weight, self.shift = weight, shift

    def root(self, n, rng):
        return np.zeros(n)

    def step(self, x, length, rng, rate=1.0):
        return rng.normal(self.weight * x + self.shift, np.sqrt(length * rate))


class Discrete(Transition):
    """States 0..k-1; a subclass gives matrix(length, rate), whose rows are distributions."""

    def __init__(self, pi):
        self.pi = np.asarray(pi, dtype=float)
        if self.pi.ndim != 1 or (self.pi < 0).any() or not self.pi.sum():
            raise ValueError("base frequencies must be a vector of numbers that aren't negative")
        self.pi = self.pi / self.pi.sum()

    def matrix(self, length: float, rate: float = 1.0) -> np.ndarray:
        raise NotImplementedError

    def root(self, n, rng):
        return rng.choice(len(self.pi), size=n, p=self.pi)

    def step(self, x, length, rng, rate=1.0):
        up_to = np.cumsum(self.matrix(length, rate), axis=1)[x]
        return np.minimum((rng.random((len(x), 1)) > up_to).sum(axis=1), len(self.pi) - 1)


class Fixed(Discrete):
    """The same matrix on every edge."""

    def __init__(self, pi, p):
        super().__init__(pi)
        self.p = np.asarray(p, dtype=float)
        if self.p.shape != (len(self.pi),) * 2 or (self.p < 0).any() or not np.allclose(self.p.sum(axis=1), 1):
            raise ValueError("a transition matrix is square, not negative, and has rows that sum to 1")

    def matrix(self, length, rate=1.0):
        return self.p


class ContinuousTime(Discrete):
    """exp(Q t rate); Q is scaled to one expected change in unit time."""

    def __init__(self, pi, q):
        super().__init__(pi)
        q = np.asarray(q, dtype=float)
        if q.shape != (len(self.pi),) * 2 or not np.allclose(q.sum(axis=1), 0):
            raise ValueError("a rate matrix is square and has rows that sum to 0")
        self.q = q / -(np.diag(q) @ self.pi)
        self.values, self.vectors = np.linalg.eig(self.q)
        self.inverse = np.linalg.inv(self.vectors)

    def matrix(self, length, rate=1.0):
        p = np.real(self.vectors * np.exp(self.values * length * rate) @ self.inverse)
        return np.maximum(p, 0) / np.maximum(p, 0).sum(axis=1, keepdims=True)

    def distance(self, length, rate=1.0):
        """Log-det (paralinear) distance across an edge."""
        return -np.trace(self.q) * length * rate

    def length(self, distance, rate=1.0):
        return distance / (-np.trace(self.q) * rate)

    def similarity(self, length, rate=1.0):
        return np.exp(-self.distance(length, rate))


def gtr(pi, rates) -> ContinuousTime:
    """Reversible rates in the order (0,1) (0,2) (0,3) .. (1,2) ..."""
    pi = np.asarray(pi, dtype=float) / np.sum(pi)
    k = len(pi)
    q = np.zeros((k, k))
    q[np.triu_indices(k, 1)] = rates
    q = (q + q.T) * pi
    return ContinuousTime(pi, q - np.diag(q.sum(axis=1)))


def tn93(pi, kappa1: float, kappa2: float, first_and_last: bool = False) -> ContinuousTime:
    """Two transition rates, A-G and C-T; or, for comparison, on the first and the last pair (A-C and G-T)."""
    return gtr(pi, [kappa1, 1, 1, 1, 1, kappa2] if first_and_last else [1, kappa1, 1, 1, kappa2, 1])


def t92(theta: float, kappa1: float, kappa2: float | None = None) -> ContinuousTime:
    """theta: the share of G and C."""
    return tn93([(1 - theta) / 2, theta / 2, theta / 2, (1 - theta) / 2], kappa1, kappa1 if kappa2 is None else kappa2)


def hky(kappa: float, pi=(0.25,) * 4) -> ContinuousTime:
    return tn93(pi, kappa, kappa)


class JukesCantor(ContinuousTime):
    def __init__(self, k: int = 4):
        super().__init__(np.full(k, 1 / k), np.full((k, k), 1.0) - k * np.eye(k))
        self.k = k

    def stay(self, t, rate=1.0):
        """Probability of the same state after time t."""
        return 1 / self.k + (self.k - 1) / self.k * np.exp(-np.asarray(t) * rate * self.k / (self.k - 1))

    def time(self, p, rate=1.0):
        """Time after which the state is the same with probability p."""
        return -(self.k - 1) / self.k * np.log(np.asarray(p) * self.k / (self.k - 1) - 1 / (self.k - 1)) / rate


# Random models: one draw per edge or per tree -----------------------------------------------------


def random_matrix(k: int, bounds: tuple[float, float], rng: np.random.Generator) -> np.ndarray:
    """Rows with a diagonal within bounds, and the rest shared out at random."""
    p = rng.random((k, k))
    np.fill_diagonal(p, 0)
    stay = rng.uniform(*bounds, size=k)
    return p / p.sum(axis=1, keepdims=True) * (1 - stay)[:, None] + np.diag(stay)


def random_symmetric(k: int, bounds: tuple[float, float], rng: np.random.Generator) -> np.ndarray:
    """One random value on the diagonal, one off it."""
    stay = rng.uniform(*bounds)
    return np.where(np.eye(k, dtype=bool), stay, (1 - stay) / (k - 1))


class PerEdge(Discrete):
    """A matrix of its own, drawn by make(rng), for each step."""

    def __init__(self, k: int, make):
        super().__init__(np.full(k, 1 / k))
        self.make = make

    def step(self, x, length, rng, rate=1.0):
        return Fixed(self.pi, self.make(rng)).step(x, length, rng)


def random_affine(rng: np.random.Generator, std: float = 0.8) -> Gaussian:
    """Gaussian steps with random weight in 1.2..2 and shift in 0..0.5; edges of length std^2 give that deviation."""
    return Gaussian(rng.uniform(1.2, 2), rng.uniform(0, 0.5))


def preset(name: str) -> Transition:
    """Models by name: jc, jc2, hky2, tn93, t92, gtr, gaussian."""
    made = {
        "jc": lambda: JukesCantor(4), "jc2": lambda: JukesCantor(2), "jc20": lambda: JukesCantor(20), "hky15": lambda: hky(1.5), "hky2": lambda: hky(2.0), "tn93": lambda: tn93([0.3, 0.2, 0.2, 0.3], 2.0, 3.0),
        "t92": lambda: t92(0.4, 2.0), "gtr": lambda: gtr([0.1, 0.2, 0.3, 0.4], [1.0, 2.0, 1.5, 0.5, 3.0, 1.0]), "gaussian": Gaussian,
        "random": lambda: PerEdge(4, lambda rng: random_matrix(4, (0.85, 0.95), rng)), "symmetric": lambda: PerEdge(4, lambda rng: random_symmetric(4, (0.85, 0.95), rng)),
    }
    if name not in made:
        raise ValueError(f"unknown model {name}")
    return made[name]()


def evolve(edges, m: int, model: Transition, sites: int, rng: np.random.Generator, rate: float = 1.0, shape: float = 0.0, block: int = 10, hidden: bool = False) -> np.ndarray:
    """Leaf states (m x sites) along a rooted tree of (child, parent, length).

    shape > 0: blocks of sites with rates of their own, from a gamma distribution of mean `rate`.
    hidden: states of all nodes, in the order of their numbers."""
    children: dict[int, list[tuple[int, float]]] = {}
    for c, p, w in edges:
        children.setdefault(p, []).append((c, w))
    root = ({p for _, p, _ in edges} - {c for c, _, _ in edges}).pop()
    parts = [(slice(0, sites), rate)] if shape <= 0 else [(slice(a, min(a + block, sites)), rate * rng.gamma(shape, 1 / shape)) for a in range(0, sites, block)]
    state = {root: model.root(sites, rng)}
    stack = [root]
    while stack:
        x = stack.pop()
        for c, w in children.get(x, []):
            state[c] = np.concatenate([model.step(state[x][at], w, rng, r) for at, r in parts])
            stack.append(c)
    return np.stack([state[i] for i in (sorted(state) if hidden else range(m))])


def tree_correlations(edges, m: int, total: int) -> np.ndarray:
    """exp(-d) between all nodes: the correlations of a Gaussian tree."""
    from sparkclade.functions.kernels import patristic

    return np.exp(-patristic(edges, total)[:m, :m])


def gaussian_samples(edges, m: int, n: int, rng: np.random.Generator) -> np.ndarray:
    """Samples (m x n) of the leaves of a Gaussian tree, by Cholesky's factor of their correlations."""
    total = max(max(u, v) for u, v, _ in edges) + 1
    return np.linalg.cholesky(tree_correlations(edges, m, total)) @ rng.normal(size=(m, n))


def random_lengths(edges, rng: np.random.Generator):
    """Edges with lengths -ln(0.2 + 0.6 U)."""
    return [(u, v, float(-np.log(0.2 + 0.6 * rng.random()))) for u, v, _ in edges]
