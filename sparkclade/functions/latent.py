"""Latent trees: grouping that tolerates noise, spanning trees with hidden nodes, and forests with EM.

Observed nodes are 0..m-1, hidden ones follow.  Distances are of the kind -ln(correlation)."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from sparkclade.functions import kernels as K

Edges = list[tuple[int, int, float]]

#: Correlations are taken to lie below this, so no edge is shorter than its -ln.
CLOSEST = -np.log(0.95)
#: Edges shorter than this are weak.
WEAK = -np.log(0.9)


# Grouping -------------------------------------------------------------------------------------


def range_of_differences(d: np.ndarray, samples: float = 1e4) -> np.ndarray:
    """phi[i, j]: by how much d_ik - d_jk varies over the nodes k near to both; siblings have little."""
    m, near = len(d), -np.log(0.05) + 0.1 * np.log(samples)
    out = np.full((m, m), 10.0)
    np.fill_diagonal(out, 0)
    for i in range(m):
        for j in range(i + 1, m):
            if d[i, j] > -2 * np.log(0.1):
                continue
            others = np.setdiff1d(np.arange(m), (i, j))
            if not len(others):
                out[i, j] = out[j, i] = 0
                continue
            reach, far = near, np.maximum(d[i, others], d[j, others])
            while (far < reach).sum() < min(5, len(others)):
                reach += np.log(2)
            kept = others[far < reach]
            diff = d[i, kept] - d[j, kept]
            out[i, j] = out[j, i] = diff.max() - diff.min()
    return out


def _silhouette(d: np.ndarray, label: np.ndarray) -> float:
    total = []
    for i in range(len(d)):
        same = (label == label[i]) & (np.arange(len(d)) != i)
        if not same.any():
            total.append(0.0)
            continue
        a = d[i, same].mean()
        b = min(d[i, label == c].mean() for c in np.unique(label) if c != label[i])
        total.append((b - a) / max(a, b, 1e-12))
    return float(np.mean(total))


def clusters(d: np.ndarray, seed: int = 0) -> np.ndarray:
    """Labels by medoids (the member whose farthest other is nearest), with the number of clusters of the best mean silhouette."""
    m, rng = len(d), np.random.default_rng(seed)
    best, label = -np.log(0.5) / max(d.max(), 1e-12), np.zeros(m, dtype=int)
    for k in range(2, m - 1):
        for _ in range(4):
            centres = rng.choice(m, k, replace=False)
            for _ in range(5):
                mine = np.argmin(d[:, centres], axis=1)
                mine[centres] = np.arange(k)
                groups = [np.flatnonzero(mine == c) for c in range(k)]
                centres = np.array([g[np.argmin(d[np.ix_(g, g)].max(axis=1))] for g in groups])
            score = _silhouette(d, mine)
            if score > best + 1e-12:
                best, label = score, mine.copy()
    return label


def families(d: np.ndarray, samples: float = 1e4) -> list[tuple[list[int], int | None]]:
    """(members, the member that is the parent of the others, or None): siblings by clustering."""
    m, out = len(d), []
    if m == 3:
        groups = [[0, 1, 2]]
    else:
        label = clusters(range_of_differences(d, samples))
        groups = [np.flatnonzero(label == c).tolist() for c in np.unique(label)]
        if all(len(g) == 1 for g in groups):
            # Nothing stands out: the pair that neighbor joining would take.
            q = (m - 2) * d - d.sum(axis=0)[:, None] - d.sum(axis=0)[None, :]
            np.fill_diagonal(q, np.inf)
            i, j = np.unravel_index(np.argmin(q), q.shape)
            groups = [sorted((int(i), int(j)))] + [[x] for x in range(m) if x not in (i, j)]
    for g in groups:
        parent, least = (g[0] if len(g) == 1 else None), np.inf
        for p in g if len(g) > 1 else []:
            others = [c for c in g if c != p]
            # A parent is as much nearer to all others as it is far from its child.
            off = sum(abs(np.mean([d[p, k] - d[c, k] for k in range(m) if k not in (p, c)] or [0.0]) + d[p, c]) for c in others)
            if off < 2 * WEAK * len(others) and off < least:
                parent, least = p, off
        out.append((g, parent))
    return out


def child_edges(d: np.ndarray, members: list[int]) -> np.ndarray:
    """Lengths from the members of a family to their hidden parent."""
    c, own = len(members), d[np.ix_(members, members)]
    if c == 2:
        others = [k for k in range(len(d)) if k not in members]
        diff = np.mean(d[members[0], others] - d[members[1], others]) if others else 0.0
        e = 0.5 * np.array([own[0, 1] + diff, own[0, 1] - diff])
    else:
        e = (own.sum(axis=1) - own.sum() / (2 * (c - 1))) / (c - 2)
    return np.maximum(e, CLOSEST)


def relaxed_grouping(d: np.ndarray, samples: float = 1e4) -> Edges:
    """Recursive grouping of estimated distances: families by clustering, a hidden parent or a member above each."""
    m = len(d)
    names, now, edges, fresh = list(range(m)), d.astype(float).copy(), [], m
    while len(names) > 2:
        parts = []
        for members, parent in families(now, samples):
            if len(members) == 1:
                parts.append((names[members[0]], members, np.zeros(1)))
            elif parent is not None:
                e = np.array([0.0 if c == parent else max(now[parent, c], CLOSEST) for c in members])
                edges += [(names[c], names[parent], float(w)) for c, w in zip(members, e, strict=True) if c != parent]
                parts.append((names[parent], [parent], np.zeros(1)))
            else:
                e = child_edges(now, members)
                edges += [(names[c], fresh, float(w)) for c, w in zip(members, e, strict=True)]
                parts.append((fresh, members, e))
                fresh += 1
        new = np.zeros((len(parts), len(parts)))
        for a in range(len(parts)):
            for b in range(a + 1, len(parts)):
                (_, x, ex), (_, y, ey) = parts[a], parts[b]
                mean = (now[np.ix_(x, y)].sum() - ex.sum() * len(y) - ey.sum() * len(x)) / (len(x) * len(y))
                new[a, b] = new[b, a] = max(mean, CLOSEST)
        names, now = [p[0] for p in parts], new
    if len(names) == 2:
        edges.append((names[0], names[1], float(now[0, 1])))
    return edges


def observed_neighbor_joining(d: np.ndarray, least: float = WEAK) -> Edges:
    """Neighbor joining that puts no hidden node at the end of a weak edge: an observed node is then the parent."""
    m = len(d)
    names, now, edges, fresh = list(range(m)), d.astype(float).copy(), [], m
    while len(names) > 2:
        n, total = len(names), now.sum(axis=0)
        q = now - (total[:, None] + total[None, :]) / (n - 2)
        q[np.tril_indices(n)] = np.inf
        i, j = np.unravel_index(np.argmin(q), q.shape)
        e = 0.5 * (now[i, j] + (total[i] - total[j]) / (n - 2))
        f = now[i, j] - e
        rest = [k for k in range(n) if k not in (i, j)]
        to_rest = 0.5 * (now[i, rest] + now[j, rest] - now[i, j])
        if min(e, f) > least and (to_rest > least).all():
            edges += [(names[i], fresh, float(e)), (names[j], fresh, float(f))]
            keep = rest
            now = np.block([[now[np.ix_(rest, rest)], to_rest[:, None]], [to_rest[None, :], np.zeros((1, 1))]])
            names = [names[k] for k in keep] + [fresh]
            fresh += 1
        else:
            parent, child = (i, j) if e <= f else (j, i)
            edges.append((names[child], names[parent], float(max(now[i, j], 1e-9))))
            keep = [k for k in range(n) if k != child]
            now, names = now[np.ix_(keep, keep)], [names[k] for k in keep]
    if len(names) == 2:
        edges.append((names[0], names[1], float(now[0, 1])))
    return edges


def contract_weak(edges: Edges, m: int, least: float = WEAK) -> Edges:
    """Hidden nodes at weak edges are merged into the other end; observed nodes stay apart."""
    into: dict[int, int] = {}

    def find(x: int) -> int:
        while x in into:
            x = into[x]
        return x

    for u, v, w in sorted(edges, key=lambda e: (e[2], e[:2])):
        a, b = sorted((find(u), find(v)))
        if w < least and a != b and b >= m:
            into[b] = a
    out = [(find(u), find(v), w) for u, v, w in edges if find(u) != find(v)]
    hidden = {x: m + k for k, x in enumerate(sorted({x for e in out for x in e[:2] if x >= m}))}
    return [(hidden.get(u, u), hidden.get(v, v), w) for u, v, w in out]


# Spanning tree first --------------------------------------------------------------------------


def surrogate(edges: Edges, m: int, x: int, seen_from: int) -> tuple[int, float]:
    """The nearest observed node beyond x, as seen from another node, and how far it is."""
    near, stack = K.neighbours(edges), [(0.0, x, seen_from)]
    while stack:
        stack.sort(reverse=True)
        far, y, back = stack.pop()
        if y < m:
            return y, far
        stack += [(far + w, z, y) for z, w in near[y] if z != back]
    raise ValueError("a hidden node with nothing observed beyond it")


def neighbourhood(edges: Edges, m: int, d: np.ndarray, centre: int) -> tuple[list[int], np.ndarray]:
    """A node and its neighbours, and their distances; hidden ones are measured from their surrogates."""
    around = sorted(v if u == centre else u for u, v, _ in edges if centre in (u, v))
    group = [centre, *around]
    seen = [(x, 0.0) if x < m else surrogate(edges, m, x, centre) for x in group]
    out = np.zeros((len(group),) * 2)
    for a, (x, wx) in enumerate(seen):
        for b, (y, wy) in enumerate(seen[:a]):
            out[a, b] = out[b, a] = max(d[x, y] - wx - wy, CLOSEST)
    return group, out


def resolved(edges: Edges, m: int, d: np.ndarray, centre: int, inner) -> Edges:
    """The edges with one node's neighbourhood put together anew by inner(distances)."""
    group, local = neighbourhood(edges, m, d, centre)
    fresh = max([m - 1, *(x for e in edges for x in e[:2])]) + 1
    name = dict(enumerate(group))
    kept = [e for e in edges if centre not in e[:2]]
    for u, v, w in inner(local):
        for z in (u, v):
            if z not in name:
                name[z] = fresh
                fresh += 1
        kept.append((name[u], name[v], w))
    return kept


def spanning_then(d: np.ndarray, inner, least: float | None = WEAK) -> Edges:
    """Chow-Liu tree, whose inner nodes' neighbourhoods are put together anew, those with most neighbours first."""
    m, edges = len(d), K.spanning_tree(d)
    degree = np.bincount([x for e in edges for x in e[:2]], minlength=m)
    for centre in sorted((i for i in range(m) if degree[i] > 1), key=lambda i: (-degree[i], i)):
        edges = resolved(edges, m, d, centre, inner)
    return edges if least is None else contract_weak(edges, m, least)


def gaussian_log_likelihood(edges: Edges, m: int, correlation: np.ndarray) -> float:
    """Mean log-likelihood of observations with these correlations, in a Gaussian tree."""
    total = max(x for e in edges for x in e[:2]) + 1
    j = np.linalg.inv(np.exp(-K.patristic(edges, total)[:m, :m]) + 1e-9 * np.eye(m))
    return float(-0.5 * np.trace(j @ correlation) + 0.5 * np.linalg.slogdet(j)[1] - 0.5 * m * np.log(2 * np.pi))


def regularised(d: np.ndarray, samples: int, inner, log_likelihood, most_hidden: int | None = None) -> Edges:
    """Spanning tree, to which each round adds the hidden nodes of the one neighbourhood that raises BIC most.

    log_likelihood(edges): total; a round costs half a log of the samples for each edge that it adds."""
    m, edges = len(d), K.spanning_tree(d)
    now = log_likelihood(edges)
    most_hidden = m if most_hidden is None else most_hidden
    while True:
        hidden = len({x for e in edges for x in e[:2] if x >= m})
        degree = np.bincount([x for e in edges for x in e[:2]])
        options = []
        for centre in np.flatnonzero(degree > 1).tolist():
            if centre >= m:
                continue
            tried = contract_weak(resolved(edges, m, d, centre, inner), m)
            new = len({x for e in tried for x in e[:2] if x >= m}) - hidden
            if new > 0 and hidden + new <= most_hidden:
                ll = log_likelihood(tried)
                options.append((ll - now - 0.5 * (2 * new - 1) * np.log(samples), centre, ll, tried))
        best = max(options, key=lambda o: (o[0], -o[1]), default=None)
        if best is None or best[0] <= 0:
            return edges
        _, _, now, edges = best


# Forests ----------------------------------------------------------------------------------------


@dataclass
class Forest:
    """parent[i] (-1: a root), and for a root its distribution, else a table of rows p(state | parent's state)."""

    parent: list[int]
    table: list[np.ndarray]
    observed: int
    levels: list[int] = field(default_factory=list)

    def __post_init__(self):
        self.levels = [t.shape[-1] for t in self.table]

    def order(self) -> list[int]:
        """Nodes, parents first."""
        children: dict[int, list[int]] = {}
        for i, p in enumerate(self.parent):
            children.setdefault(p, []).append(i)
        out = list(children.get(-1, []))
        for x in out:
            out += children.get(x, [])
        return out

    def freedom(self) -> int:
        return sum((k - 1) * (1 if p < 0 else self.levels[p]) for k, p in zip(self.levels, self.parent, strict=True))


def evidence(patterns: np.ndarray, levels: list[int]) -> list[np.ndarray]:
    """One-hot rows of each observed node's states; -1 is missing and says nothing."""
    return [np.vstack([np.eye(k), np.ones(k)])[patterns[:, i]] for i, k in enumerate(levels)]


def upward(forest: Forest, shown: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """(what each node's subtree says of it, what it tells its parent, log-likelihood of each pattern)."""
    n = len(shown[0])
    below = [shown[i].copy() if i < forest.observed else np.ones((n, k)) for i, k in enumerate(forest.levels)]
    told: list[np.ndarray] = [np.zeros(0)] * len(below)
    logs = np.zeros(n)
    with np.errstate(divide="ignore"):
        for i in reversed(forest.order()):
            most = below[i].max(axis=1, keepdims=True)
            below[i] = below[i] / np.maximum(most, 1e-300)
            logs += np.log(most[:, 0])
            if forest.parent[i] < 0:
                logs += np.log(below[i] @ forest.table[i])
            else:
                told[i] = below[i] @ forest.table[i].T
                below[forest.parent[i]] = below[forest.parent[i]] * told[i]
    return below, told, logs


def log_likelihood(forest: Forest, patterns: np.ndarray, weight: np.ndarray) -> float:
    """Of patterns (n x observed) that occur so often; those the forest can't give are left out."""
    logs = upward(forest, evidence(patterns, forest.levels[: forest.observed]))[2]
    can = np.isfinite(logs)
    return float(weight[can] @ logs[can])


def posteriors(forest: Forest, shown: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """(p(node | pattern), p(parent, node | pattern) for the others than roots, logs), by sum-product."""
    below, told, logs = upward(forest, shown)
    node: list[np.ndarray] = [np.zeros(0)] * len(below)
    joint: list[np.ndarray] = [np.zeros(0)] * len(below)
    for i in forest.order():
        p = forest.parent[i]
        if p < 0:
            node[i] = below[i] * forest.table[i]
        else:
            outside = node[p] / np.maximum(told[i], 1e-300)
            joint[i] = outside[:, :, None] * forest.table[i][None] * below[i][:, None, :]
            joint[i] /= np.maximum(joint[i].sum(axis=(1, 2), keepdims=True), 1e-300)
            node[i] = joint[i].sum(axis=1)
        node[i] = node[i] / np.maximum(node[i].sum(axis=1, keepdims=True), 1e-300)
    return node, joint, logs


def em(forest: Forest, patterns: np.ndarray, weight: np.ndarray, steps: int = 20, least: float = 1.0) -> tuple[Forest, float]:
    """Expectation-maximisation of all tables; ends when the log-likelihood gains less than `least`."""
    shown, before, ll = evidence(patterns, forest.levels[: forest.observed]), -np.inf, -np.inf
    for _ in range(steps):
        node, joint, logs = posteriors(forest, shown)
        can = np.isfinite(logs)
        ll, w = float(weight[can] @ logs[can]), np.where(can, weight, 0.0)
        if ll - before < least:
            break
        before, tables = ll, []
        for i, p in enumerate(forest.parent):
            counts = w @ node[i] if p < 0 else np.einsum("n,nab->ab", w, joint[i])
            counts = counts + 1e-9
            tables.append(counts / counts.sum(axis=-1, keepdims=True))
        forest = Forest(forest.parent, tables, forest.observed)
    return forest, ll


def forest_of_edges(edges: Edges, m: int, levels: int, marginal: np.ndarray | None = None, rng: np.random.Generator | None = None) -> Forest:
    """A forest with a tree's shape, rooted at its last node; tables whose determinant fits the edges' lengths.

    For two states the joint table of ends with marginals a, b solves det = exp(-d + half the sum of the logs of the four
    marginals); where that is no distribution, the other sign, else a random one."""
    rng = rng or np.random.default_rng(0)
    total = max(x for e in edges for x in e[:2]) + 1
    share = np.full((total, levels), 1 / levels)
    if marginal is not None:
        share[:m] = marginal
    parent, table = [-1] * total, [share[i] for i in range(total)]
    root = total - 1
    for c, p, w in K.rooted(edges, root):
        parent[c] = p
        if levels == 2:
            table[c] = _joint(w, share[p, 1], share[c, 1], rng) / share[p][:, None]
            table[c] = np.maximum(table[c], 1e-6)
            table[c] = table[c] / table[c].sum(axis=1, keepdims=True)
        else:
            stay = np.exp(-w / max(levels - 1, 1))
            table[c] = stay * np.eye(levels) + (1 - stay) * share[c][None, :]
    for x in range(total):
        if parent[x] < 0 and x != root:
            table[x] = share[x]
    return Forest(parent, table, m)


def _joint(d: float, a: float, b: float, rng) -> np.ndarray:
    det = np.exp(-d + 0.5 * np.log(max(a * (1 - a) * b * (1 - b), 1e-300)))
    low, high = max(0.0, a + b - 1), min(a, b)
    for both in (a * b + det, a * b - det, rng.uniform(low, high)):
        if low <= both <= high:
            break
    return np.array([[1 + both - a - b, b - both], [a - both, both]])


def marginals(forest: Forest) -> list[np.ndarray]:
    out: list[np.ndarray] = [np.zeros(0)] * len(forest.parent)
    for i in forest.order():
        out[i] = forest.table[i] if forest.parent[i] < 0 else out[forest.parent[i]] @ forest.table[i]
    return out


def oriented(forest: Forest) -> Forest:
    """Hidden nodes of two states are turned so that the first is at least as likely."""
    share, tables = marginals(forest), [t.copy() for t in forest.table]
    for i in range(forest.observed, len(forest.parent)):
        if forest.levels[i] == 2 and share[i][1] > share[i][0]:
            tables[i] = tables[i][..., ::-1]
            for c, p in enumerate(forest.parent):
                if p == i:
                    tables[c] = tables[c][::-1]
    return Forest(forest.parent, tables, forest.observed)


def sampled(forest: Forest, n: int, rng: np.random.Generator) -> np.ndarray:
    """States (n x nodes)."""
    out = np.zeros((n, len(forest.parent)), dtype=np.int64)
    for i in forest.order():
        p = forest.table[i][None, :] if forest.parent[i] < 0 else forest.table[i][out[:, forest.parent[i]]]
        out[:, i] = np.minimum((rng.random((n, 1)) > np.cumsum(p, axis=1)).sum(axis=1), forest.levels[i] - 1)
    return out


def independent(patterns: np.ndarray, weight: np.ndarray, levels: list[int]) -> Forest:
    """No edges: each node has its frequencies."""
    tables = [np.bincount(patterns[:, i], weights=weight, minlength=k) / weight.sum() for i, k in enumerate(levels)]
    return Forest([-1] * len(levels), tables, len(levels))


def information(patterns: np.ndarray, weight: np.ndarray, levels: list[int]) -> np.ndarray:
    """Mutual information (bits) of all pairs."""
    return soft_information(evidence(patterns, levels), weight)


def soft_information(shown: list[np.ndarray], weight: np.ndarray) -> np.ndarray:
    d, w = len(shown), weight / weight.sum()
    out = np.zeros((d, d))
    for i in range(d):
        for j in range(i + 1, d):
            p = (shown[i] * w[:, None]).T @ shown[j]
            e = np.outer(p.sum(axis=1), p.sum(axis=0))
            at = p > 0
            out[i, j] = out[j, i] = float((p[at] * np.log2(p[at] / e[at])).sum())
    return out


def chow_liu(patterns: np.ndarray, weight: np.ndarray, levels: list[int]) -> Forest:
    """The spanning tree of largest mutual information, from node 0, with tables of conditional frequencies."""
    shown = evidence(patterns, levels)
    parent, tables = [-1] * len(levels), [weight @ x / weight.sum() for x in shown]
    if len(levels) > 1:
        for c, p, _ in K.rooted(K.spanning_tree(-soft_information(shown, weight)), 0):
            joint = (shown[p] * weight[:, None]).T @ shown[c]
            parent[c], tables[c] = p, joint / np.maximum(joint.sum(axis=1, keepdims=True), 1e-300)
    return Forest(parent, tables, len(levels))


# One latent variable -----------------------------------------------------------------------------


def latent_class(shown: list[np.ndarray], weight: np.ndarray, k: int, rng: np.random.Generator, steps: int = 100, tolerance: float = 1e-5) -> tuple[float, np.ndarray, list[np.ndarray], np.ndarray]:
    """EM of one latent variable with k classes: (log-likelihood, shares, tables, posterior of each row)."""
    pi = rng.uniform(0.4, 0.6, k)
    theta = [rng.uniform(0.4, 0.6, (k, x.shape[1])) for x in shown]
    pi, theta, before = pi / pi.sum(), [t / t.sum(axis=1, keepdims=True) for t in theta], -np.inf
    for _ in range(steps):
        beta = np.tile(pi, (len(weight), 1))
        for x, t in zip(shown, theta, strict=True):
            beta = beta * (x @ t.T)
        total = np.maximum(beta.sum(axis=1), 1e-300)
        ll, post = float(weight @ np.log(total)), beta / total[:, None]
        if ll - before < tolerance:
            break
        before = ll
        pi = weight @ post / weight.sum()
        for j, x in enumerate(shown):
            # Soft evidence shares out by what each class expects.
            mixed = post @ theta[j] if not np.allclose(x.sum(axis=1), 1) else x
            t = (post * weight[:, None]).T @ (x if mixed is x else x * mixed / np.maximum((x * mixed).sum(axis=1, keepdims=True), 1e-300)) + 1e-12
            theta[j] = t / t.sum(axis=1, keepdims=True)
    return ll, pi, theta, post


def latent_class_by_bic(shown: list[np.ndarray], weight: np.ndarray, seed: int = 1, restarts: int = 10, most: int = 64):
    """(classes, log-likelihood, shares, tables, posterior) with the best ll - df / 2 log2 n: the number of classes is doubled
    while that helps, and then halved in on."""
    known: dict[int, tuple] = {}

    def at(k: int) -> tuple:
        if k not in known:
            found = max((latent_class(shown, weight, k, np.random.default_rng(1000 * seed + r)) for r in range(restarts if k > 1 else 1)), key=lambda f: f[0])
            df = (k - 1) + k * sum(x.shape[1] - 1 for x in shown)
            known[k] = (found[0] - 0.5 * df * np.log2(weight.sum()), k, *found)
        return known[k]

    k = 1
    while 2 * k <= most and at(2 * k)[0] > at(k)[0]:
        k *= 2
    low, high = max(1, k // 2), min(2 * k, most)
    while high - low > 1:
        middle = (low + high) // 2
        if middle == k:
            # The best so far is in the middle: look on both sides.
            left, right = (low + k) // 2, (k + high + 1) // 2
            k = max({left, k, right}, key=lambda x: (at(x)[0], -x))
            low, high = (left, right) if k == middle else (low, middle) if k == left else (middle, high)
            if (low, high) == (left, right) and high - low <= 2:
                break
        elif at(middle)[0] > at(k)[0]:
            k = middle
        else:
            low, high = (middle, high) if middle < k else (low, middle)
    return at(k)[1:]


def one_latent(patterns: np.ndarray, weight: np.ndarray, levels: list[int], seed: int = 1) -> Forest:
    """One hidden root above all observed nodes."""
    _, _, pi, theta, _ = latent_class_by_bic(evidence(patterns, levels), weight, seed)
    return Forest([len(levels)] * len(levels) + [-1], [*theta, pi], len(levels))


def pairing(patterns: np.ndarray, weight: np.ndarray, levels: list[int], seed: int = 1, restarts: int = 10) -> Forest:
    """Greedy forest: the pair with most mutual information gets a latent parent with as many classes as BIC says, until that is one.

    A new node takes part as the posterior of its classes; in the end all tables are refined together."""
    d = len(levels)
    shown: dict[int, np.ndarray] = dict(enumerate(evidence(patterns, levels)))
    parent, table, live, fresh = [-1] * d, [weight @ x / weight.sum() for x in shown.values()], list(range(d)), d
    while len(live) > 1:
        mi = soft_information([shown[i] for i in live], weight)
        a, b = np.unravel_index(np.argmax(np.round(np.triu(mi, 1), 12)), mi.shape)
        if a == b:
            break
        i, j = live[a], live[b]
        k, _, pi, theta, post = latent_class_by_bic([shown[i], shown[j]], weight, seed, restarts)
        if k == 1:
            break
        parent[i] = parent[j] = fresh
        table[i], table[j] = theta
        parent.append(-1)
        table.append(pi)
        shown[fresh] = post
        live = [x for x in live if x not in (i, j)] + [fresh]
        fresh += 1
    for x in live:
        table[x] = weight @ shown[x] / weight.sum()
    return em(Forest(parent, table, d), patterns, weight, 100, 1e-2)[0]


def hierarchical(patterns: np.ndarray, weight: np.ndarray, levels: list[int], how: str, hidden: int = 2, seed: int = 1) -> Forest:
    """The shape is a linkage by mutual information; tables by EM from random ones."""
    d, rng = len(levels), np.random.default_rng(seed)
    edges = K.linkage(information(patterns, weight, levels), how)
    parent = [-1] * (2 * d - 1)
    for c, p, _ in edges:
        parent[c] = p
    sizes = [*levels, *[hidden] * (d - 1)]
    table = [rng.dirichlet(np.ones(sizes[i]) * 5) if parent[i] < 0 else rng.dirichlet(np.ones(sizes[i]), size=hidden) for i in range(2 * d - 1)]
    return em(Forest(parent, table, d), patterns, weight, 100, 1e-2)[0]


def refining(parent: list[int], levels: list[int], observed: int) -> Forest:
    """A forest whose states tell their parents': a node's states are shared out evenly among its parent's."""
    table = []
    for i, p in enumerate(parent):
        if p < 0:
            table.append(np.full(levels[i], 1 / levels[i]))
        else:
            mine = np.arange(levels[i]) * levels[p] // levels[i] == np.arange(levels[p])[:, None]
            table.append(mine / mine.sum(axis=1, keepdims=True))
    return Forest(parent, table, observed)


def coins(count: int) -> Forest:
    """One hidden node that holds `count` coins, and a node for each coin that shows all coins but that one."""
    states = np.arange(2**count)
    tables = []
    for k in reversed(range(count)):
        shown = (states >> (k + 1) << k) | (states & ((1 << k) - 1))
        tables.append(np.eye(2 ** (count - 1))[shown])
    return Forest([count] * count + [-1], [*tables, np.full(2**count, 1 / 2**count)], count)


#: Toy forests by name; nodes that are observed come first.
TOYS = {
    "binary_forest": lambda: refining([6, 5, 5, 7, 7, 6, -1, -1], [4, 8, 8, 4, 4, 4, 2, 2], 5),
    "three_level_binary": lambda: refining([4, 4, 5, 5, 6, 6, -1], [8, 8, 8, 8, 4, 4, 2], 4),
    "three_coins": lambda: coins(3),
    "six_coins": lambda: coins(6),
}


#: Forests by name, as functions of patterns, how often each occurs, and the observed nodes' numbers of states.
FORESTS = {
    "bin": pairing, "cl": chow_liu, "ind": independent, "lcm": one_latent,
    "hcs": lambda x, w, k: hierarchical(x, w, k, "single"), "hca": lambda x, w, k: hierarchical(x, w, k, "average"), "hcc": lambda x, w, k: hierarchical(x, w, k, "complete"),
}


def scores(forest: Forest, patterns: np.ndarray, weight: np.ndarray) -> dict[str, float]:
    """Log-likelihood (natural), freedom, AIC, BIC (by log2, as its definition here has it), saturated log-likelihood and deviance."""
    ll, df, n = log_likelihood(forest, patterns, weight), forest.freedom(), weight.sum()
    saturated = float((weight * np.log(weight / n)).sum())
    return {"ll": ll, "df": float(df), "aic": ll - df, "bic": ll - 0.5 * df * np.log2(n), "saturated": saturated, "deviance": 2 * (saturated - ll)}


def cross_validated(name: str, x: np.ndarray, levels: list[int], folds: int = 5) -> list[float]:
    """Held-out log-likelihood per sample of each fold; sample i is in fold i mod folds."""
    out, fold = [], np.arange(len(x)) % folds
    for f in range(folds):
        patterns, weight = np.unique(x[fold != f], axis=0, return_counts=True)
        forest = FORESTS[name](patterns, weight.astype(float), levels)
        out.append(log_likelihood(forest, x[fold == f], np.ones(int((fold == f).sum()))) / max(1, int((fold == f).sum())))
    return out


def regularised_discrete(x: np.ndarray, d: np.ndarray, inner, levels: int = 2) -> Edges:
    """regularised() with the likelihood by EM of states x (n x m)."""
    patterns, weight = np.unique(x, axis=0, return_counts=True)
    share = np.stack([np.bincount(x[:, i], minlength=levels) / len(x) for i in range(x.shape[1])])

    def ll(edges: Edges) -> float:
        return em(forest_of_edges(edges, x.shape[1], levels, np.clip(share, 1e-3, 1)), patterns, weight.astype(float), 20, 1.0)[1]

    return regularised(d, len(x), inner, ll)


def regularised_gaussian(correlation: np.ndarray, samples: int, inner) -> Edges:
    d = -np.log(np.clip(np.abs(correlation), 1e-6, 1.0))
    np.fill_diagonal(d, 0)
    return regularised(d, samples, inner, lambda e: samples * gaussian_log_likelihood(e, len(d), correlation))


def consistent(relation: np.ndarray) -> tuple[bool, list[list[int]]]:
    """Whether 'is a sibling of' is a partition, and the groups taken greedily; too many groups are none."""
    m, left, groups = len(relation), list(range(len(relation))), []
    related = [[j for j in range(m) if relation[i, j] or j == i] for i in range(m)]
    ok = all(relation[a, b] for mine in related for a in mine for b in mine if a != b)
    while left:
        groups.append([j for j in left if j in related[left[0]]])
        left = [j for j in left if j not in groups[-1]]
    return ok and len(groups) < m - 1, groups
