"""Tree kernels: numpy on one dataset or one part of it.  Trees are lists of edges (u, v, length).

Leaves are 0..m-1; inner nodes follow.  Trees are unrooted unless said otherwise.
Ties are broken by (score, i, j)."""

from __future__ import annotations

import numpy as np

Edges = list[tuple[int, int, float]]


def neighbours(edges: Edges) -> dict[int, list[tuple[int, float]]]:
    out: dict[int, list[tuple[int, float]]] = {}
    for u, v, w in edges:
        out.setdefault(u, []).append((v, w))
        out.setdefault(v, []).append((u, w))
    return out


def sides(edges: Edges, m: int) -> list[tuple[int, frozenset[int]]]:
    """For each edge the leaves beyond it, seen from leaf 0."""
    near = neighbours(edges)
    order, parent = [0], {0: -1}
    for x in order:
        for y, _ in near.get(x, []):
            if y not in parent:
                parent[y] = x
                order.append(y)
    below: dict[int, set[int]] = {}
    for x in reversed(order):
        below.setdefault(x, set())
        if x < m:
            below[x].add(x)
        if parent[x] >= 0:
            below.setdefault(parent[x], set()).update(below[x])
    at = {frozenset((u, v)): k for k, (u, v, _) in enumerate(edges)}
    return [(at[frozenset((x, parent[x]))], frozenset(below[x])) for x in order if parent[x] >= 0]


def splits(edges: Edges, m: int) -> set[frozenset[int]]:
    """Non-trivial splits, each by the side without leaf 0."""
    return {s for _, s in sides(edges, m) if 2 <= len(s) <= m - 2}


def patristic(edges: Edges, m: int) -> np.ndarray:
    near, out = neighbours(edges), np.zeros((m, m))
    for a in range(m):
        stack = [(a, -1, 0.0)]
        while stack:
            x, back, d = stack.pop()
            if x < m:
                out[a, x] = d
            stack += [(y, x, d + w) for y, w in near.get(x, []) if y != back]
    return out


def neighbor_joining(d: np.ndarray) -> Edges:
    m = len(d)
    live, edges, fresh = list(range(m)), [], m
    size = 2 * m
    full = np.zeros((size, size))
    full[:m, :m] = d
    while len(live) > 3:
        sub = full[np.ix_(live, live)]
        r, total = len(live), sub.sum(axis=1)
        q = (r - 2) * sub - total[:, None] - total[None, :]
        q[np.tril_indices(r)] = np.inf
        a, b = np.unravel_index(np.argmin(q), q.shape)
        i, j = live[a], live[b]
        wi = 0.5 * sub[a, b] + (total[a] - total[b]) / (2 * (r - 2))
        edges += [(i, fresh, wi), (j, fresh, sub[a, b] - wi)]
        rest = [k for k in live if k not in (i, j)]
        new = 0.5 * (full[i, rest] + full[j, rest] - full[i, j])
        full[fresh, rest] = full[rest, fresh] = new
        live = [*rest, fresh]
        fresh += 1
    if len(live) == 3:
        x, y, z = live
        dx = 0.5 * (full[x, y] + full[x, z] - full[y, z])
        edges += [(x, fresh, dx), (y, fresh, full[x, y] - dx), (z, fresh, full[x, z] - dx)]
    elif len(live) == 2:
        edges.append((live[0], live[1], full[live[0], live[1]]))
    return edges


def second_singular(block: np.ndarray) -> float:
    s = np.linalg.svd(block, compute_uv=False)
    return float(s[1]) if len(s) > 1 else 0.0


def squared_quartets(block: np.ndarray) -> float:
    fro = (block**2).sum()
    return float((fro**2 - ((block.T @ block) ** 2).sum()) / fro) if fro else 0.0


#: Sides of a block up to which singular values are taken as such; beyond, as roots of those of its Gram matrix.
DIRECT = 16


def second_singulars(blocks: np.ndarray) -> np.ndarray:
    """Second singular values of a stack of blocks of one shape."""
    least = min(blocks.shape[1:])
    if least < 2:
        return np.zeros(len(blocks))
    if least <= DIRECT:
        return np.linalg.svd(blocks, compute_uv=False)[:, 1]
    flat = blocks if blocks.shape[1] <= blocks.shape[2] else blocks.transpose(0, 2, 1)
    return np.sqrt(np.maximum(np.linalg.eigvalsh(flat @ flat.transpose(0, 2, 1))[:, -2], 0))


def with_each(s: np.ndarray, clade: list[int], others: np.ndarray) -> np.ndarray:
    """Second singular values of S[A, not A] for the unions A of a clade with each of some single taxa.

    All these blocks are one block B = S[clade, rest] with a column turned into a row, so one
    eigendecomposition serves them all: how many squared singular values lie above x follows from
    inertia, in time linear in the block's side, and the second is halved in on."""
    m = len(s)
    inside = np.zeros(m, dtype=bool)
    inside[clade] = True
    rest = np.flatnonzero(~inside)
    place = np.full(m, -1)
    place[rest] = np.arange(len(rest))
    at, b = place[others], s[np.ix_(clade, rest)]
    rows = s[np.ix_(others, rest)].copy()
    # A taxon's own column is gone from its row.
    rows[np.arange(len(others)), at] = 0
    wide = len(clade) <= len(rest)
    values, vectors = np.linalg.eigh(b @ b.T if wide else b.T @ b)
    if wide:
        lost, gained, own = b[:, at].T @ vectors, rows @ b.T @ vectors, (rows**2).sum(axis=1)
    else:
        unit, gained = vectors[at], rows @ vectors
    low, high = np.zeros(len(others)), np.full(len(others), values[-1] + (rows**2).sum(axis=1).max() + 1e-300)

    def above(x: np.ndarray) -> np.ndarray:
        """How many squared singular values lie above x, for each block."""
        gap = values[None, :] - x[:, None]
        gap[gap == 0] = 1e-300
        count = (gap > 0).sum(axis=1)
        if wide:
            # Bordered by the row, less the column: two further pivots beyond the known ones, of which one is the column's.
            p, q, r = 1 - (lost**2 / gap).sum(axis=1), own - x - (gained**2 / gap).sum(axis=1), -(lost * gained / gap).sum(axis=1)
            det = p * q - r * r
            return count + np.where(det < 0, 1, np.where(p + q > 0, 2, 0)) - 1
        # The row's square is added; then the taxon's row and column are taken out.
        f, g, h = (unit**2 / gap).sum(axis=1), (unit * gained / gap).sum(axis=1), 1 + (gained**2 / gap).sum(axis=1)
        return count + (h < 0) - (f - g * g / np.where(h == 0, 1e-300, h) > 0)

    for _ in range(60):
        middle = (low + high) / 2
        enough = above(middle) >= 2
        low, high = np.where(enough, middle, low), np.where(enough, high, middle)
    return np.sqrt((low + high) / 2)


def agglomerate(m: int, score=None, score_many=None, pairs=None) -> Edges:
    """Joins the clades whose union has the least score, until three are left.

    score(clade) is of a union; score_many(clade, others) of its unions with each of some others;
    pairs(a, b) of two clades.  Ties go to the first pair."""
    if score_many is None:
        score_many = (lambda a, others: [pairs(a, b) for b in others]) if pairs else (lambda a, others: [score(a | b) for b in others])
    clades = {i: frozenset([i]) for i in range(m)}
    live, edges, fresh = list(range(m)), [], m
    known = np.full((2 * m, 2 * m), np.inf)
    for x, i in enumerate(live[:-1] if m > 3 else []):
        known[i, live[x + 1 :]] = np.round(score_many(clades[i], [clades[j] for j in live[x + 1 :]]), 12)
    while len(live) > 3:
        at = np.array(live)
        now = known[np.ix_(at, at)]
        x, y = np.unravel_index(np.argmin(now), now.shape)
        i, j = live[x], live[y]
        clades[fresh] = clades[i] | clades[j]
        edges += [(i, fresh, 1.0), (j, fresh, 1.0)]
        live = [k for k in live if k not in (i, j)]
        if len(live) > 2:
            known[live, fresh] = np.round(score_many(clades[fresh], [clades[k] for k in live]), 12)
        live.append(fresh)
        fresh += 1
    if len(live) > 2:
        edges += [(k, fresh, 1.0) for k in live]
    elif len(live) == 2:
        edges.append((live[0], live[1], 1.0))
    return edges


def spectral_joining(s: np.ndarray, scorer=None, alpha: float = 1.0, pair_scorer=None) -> Edges:
    """scorer: block -> score, by default its second singular value; pair_scorer: (s, rows, rows) -> score."""
    s = np.sign(s) * np.abs(s) ** alpha
    m = len(s)
    if pair_scorer is not None:
        return agglomerate(m, pairs=lambda a, b: pair_scorer(s, sorted(a), sorted(b)))
    everyone = np.ones(m, dtype=bool)

    def block(a: frozenset[int]) -> np.ndarray:
        rest = everyone.copy()
        rest[list(a)] = False
        return s[np.ix_(sorted(a), np.flatnonzero(rest))]

    if scorer is not None:
        return agglomerate(m, lambda a: scorer(block(a)))

    def many(a: frozenset[int], others: list[frozenset[int]]) -> np.ndarray:
        out, sizes = np.zeros(len(others)), np.array([len(b) for b in others])
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size)
            if size == 1 and DIRECT < len(a) < m - 1 - DIRECT:
                out[rows] = with_each(s, sorted(a), np.array([next(iter(others[r])) for r in rows]))
                continue
            step = max(1, 4_000_000 // (m * (len(a) + int(size))))
            for k in range(0, len(rows), step):
                out[rows[k : k + step]] = second_singulars(np.stack([block(a | others[r]) for r in rows[k : k + step]]))
        return out

    return agglomerate(m, score_many=many)


def flattening_joining(patterns: list[tuple[tuple[int, ...], int]], m: int, k: int) -> Edges:
    """Agglomeration by the flattening of sparse site-pattern counts: what k singular values leave."""

    def score(a: frozenset[int]) -> float:
        rows: dict[tuple, int] = {}
        cols: dict[tuple, int] = {}
        cells = [(rows.setdefault(tuple(p[i] for i in sorted(a)), len(rows)), cols.setdefault(tuple(p[i] for i in range(m) if i not in a), len(cols)), n) for p, n in patterns]
        f = np.zeros((len(rows), len(cols)))
        for r, c, n in cells:
            f[r, c] += n
        sv = np.linalg.svd(f, compute_uv=False)
        return float((sv[k:] ** 2).sum())

    return agglomerate(m, score)


def fiedler(s: np.ndarray) -> np.ndarray:
    """Eigenvector of the second smallest eigenvalue of the Laplacian."""
    return np.linalg.eigh(np.diag(s.sum(axis=0)) - s)[1][:, 1]


def division_vector(s: np.ndarray, kind: str = "laplacian") -> np.ndarray:
    """The vector whose signs or gaps divide the taxa."""
    if kind == "laplacian":
        return fiedler(s)
    if kind == "rw":
        root = 1 / np.sqrt(s.sum(axis=1))
        return np.linalg.eigh(root[:, None] * s * root)[1][:, -2] * root
    if kind == "centred":
        h = np.eye(len(s)) - 1 / len(s)
        return np.linalg.eigh(-2 * h @ -np.log(np.maximum(s, 1e-20)) @ h)[1][:, -1]
    if kind == "similarity":
        return np.linalg.eigh(s)[1][:, -2]
    raise ValueError(f"unknown division {kind}")


def partition(s: np.ndarray, gaps: int = 1, least: int = 1, kind: str = "laplacian", signs: bool = True) -> np.ndarray:
    """Two sides (True / False): the sign split, and those at the widest gaps of the vector; the least second singular value wins."""
    v = division_vector(s, kind)
    order = np.sort(v)
    options = [v > 0] if signs else []
    span = np.diff(order)[least - 1 : len(v) - least]
    for at in np.argsort(-span, kind="stable")[:gaps]:
        k = at + least - 1
        options.append(v < (order[k] + order[k + 1]) / 2)
    fair = [o for o in options if least <= o.sum() <= len(v) - least]
    if not fair:
        raise ValueError("no split leaves enough on both sides")
    return min(fair, key=lambda o: round(second_singular(s[np.ix_(o, ~o)]), 12))


#: Ways to divide recursively: a vector, and whether its signs or its widest gap divide.
DIVISIONS = {f"{kind}_{how}": (kind, how) for kind in ("similarity", "laplacian", "rw") for how in ("zero", "gap")}


def recursive_partition(s: np.ndarray, threshold: int, how: str) -> list[tuple[str, list[int], list[int]]]:
    """(path, one side, other side) of every division, until parts have at most `threshold` taxa."""
    kind, by = DIVISIONS[how]
    out, stack = [], [("0", list(range(len(s))))]
    while stack:
        name, ids = stack.pop()
        if len(ids) <= max(threshold, 2):
            continue
        own = s[np.ix_(ids, ids)]
        side = division_vector(own, kind) < 0 if by == "zero" else partition(own, 1, 1, kind, signs=False)
        if side.all() or not side.any():
            continue
        one, two = ([i for i, x in zip(ids, side, strict=True) if x == want] for want in (True, False))
        out.append((name, one, two))
        stack += [(f"{name}.0", one), (f"{name}.1", two)]
    return sorted(out)


def edge_score(x: np.ndarray, o: np.ndarray, kind: str) -> float:
    x, o = x.ravel(), o.ravel()
    if kind == "least_square":
        return 0.0 if len(x) < 2 else float(1 - (o @ x) ** 2 / max((o @ o) * (x @ x), 1e-300))
    if kind == "angle":
        return float(1 - o @ x / max(np.sqrt((o @ o) * (x @ x)), 1e-300))
    if kind == "normalized_least_square":
        r = o / x
        return float(len(x) - r.sum() ** 2 / (r @ r))
    raise ValueError(f"unknown merge score {kind}")


#: Merge scores that need more than one block: random ones draw pairs with a fixed seed.
OTHER_SCORES = ("global_diff", "longest_branch", "closest_triplet", "spectrum", "partition")


def _side_scores(kind: str, own: np.ndarray, vec: np.ndarray, top: float, splits_of: list[tuple[list[int], list[int]]], whole: np.ndarray, ids: list[int], draws: int = 1000) -> list[float]:
    """A score for each edge (a, b) of one side; own: its similarity, vec and top: singular vector and value of the cross block."""
    m, rng = len(own), np.random.default_rng(0)
    if kind == "global_diff":
        # One factor for all edges: the median of the smallest ratios among random pairs.
        i, j = rng.integers(0, m, (2, 100 * m))
        factor = np.median(np.sort(own[i, j] / np.maximum(vec[i] * vec[j], 1e-300))[:m])
        return [float(np.linalg.norm(factor * np.outer(vec[a], vec[b]) - own[np.ix_(a, b)]) / max(np.linalg.norm(own[np.ix_(a, b)]), 1e-300)) for a, b in splits_of]
    if kind in ("longest_branch", "closest_triplet"):
        # The first by how much the implied squared root edge varies over random pairs across the edge, the second by its least value.
        out = []
        for a, b in splits_of:
            i, j = rng.choice(a, draws), rng.choice(b, draws)
            found = top**2 * vec[i] * vec[j] / np.maximum(own[i, j], 1e-300)
            out.append(float(found.var() if kind == "longest_branch" else -found.min()))
        return out
    if kind == "spectrum":
        side = np.linalg.eigh(np.diag(whole.sum(axis=0)) - whole)[1][:, 2][ids] < 0
    else:
        side = fiedler(own) > 0
    # Taxa that must change sides for the edge to be the spectral split.
    inside = [np.isin(np.arange(m), a) for a, _ in splits_of]
    return [float(m - max((x == side).sum(), (x != side).sum())) for x in inside]


def merge_trees(one: Edges, ids1: list[int], two: Edges, ids2: list[int], s: np.ndarray, kind: str) -> Edges:
    """Joins two trees (over 0.. of their ids) at the edges where the cross similarity says their roots are."""
    u, top, vt = np.linalg.svd(s[np.ix_(ids1, ids2)], full_matrices=False)
    m = len(ids1) + len(ids2)
    out: Edges = []
    roots, fresh = [], m
    for edges, ids, vec, first in ((one, ids1, np.abs(u[:, 0]), 0), (two, ids2, np.abs(vt[0]), len(ids1))):
        if len(ids) == 1:
            roots.append(first)
            continue
        own = s[np.ix_(ids, ids)]
        found = [(k, sorted(side), [x for x in range(len(ids)) if x not in side]) for k, side in sides(edges, len(ids))]
        if kind in OTHER_SCORES:
            scores = _side_scores(kind, own, vec, float(top[0]), [(a, b) for _, a, b in found], s, ids)
        else:
            scores = [edge_score(own[np.ix_(a, b)], np.outer(vec[a], vec[b]), kind) for _, a, b in found]
        best = min((round(score, 12), k) for score, (k, _, _) in zip(scores, found, strict=True))
        rename = {x: first + x for x in range(len(ids))}
        for x, y, w in edges:
            for z in (x, y):
                if z not in rename:
                    rename[z] = fresh
                    fresh += 1
        root = fresh
        fresh += 1
        for k, (x, y, w) in enumerate(edges):
            if k == best[1]:
                out += [(rename[x], root, w / 2), (rename[y], root, w / 2)]
            else:
                out.append((rename[x], rename[y], w))
        roots.append(root)
    out.append((roots[0], roots[1], 1.0))
    return out


INNER = {
    "nj": lambda s: neighbor_joining(-np.log(np.maximum(s, 1e-20))),
    "snj": spectral_joining,
}


def parts_of(s: np.ndarray, threshold: int, least: int = 1, gaps: int = 1) -> list[tuple[str, list[int]]]:
    """Leaves of the partitioning tree, named by their path."""
    out, stack = [], [("0", list(range(len(s))))]
    while stack:
        name, ids = stack.pop()
        if len(ids) <= max(threshold, 2 * least):
            out.append((name, ids))
            continue
        mask = partition(s[np.ix_(ids, ids)], gaps, least)
        stack += [(f"{name}.0", [i for i, x in zip(ids, mask, strict=True) if x]), (f"{name}.1", [i for i, x in zip(ids, mask, strict=True) if not x])]
    return sorted(out)


def merge_parts(solved: dict[str, tuple[list[int], Edges]], s: np.ndarray, kind: str = "least_square") -> Edges:
    """Merges solved parts upwards, deepest first; edges are over the ids of s in the end."""
    while len(solved) > 1:
        deep = max(solved, key=lambda n: (n.count("."), n))
        left, right = deep[:-1] + "0", deep[:-1] + "1"
        (ids1, one), (ids2, two) = solved.pop(left), solved.pop(right)
        solved[deep[:-2]] = ids1 + ids2, merge_trees(one, ids1, two, ids2, s, kind)
    ids, edges = next(iter(solved.values()))
    name = dict(enumerate(ids))
    return [(name.get(x, x), name.get(y, y), w) for x, y, w in edges]


def divided(s: np.ndarray, inner: str = "nj", threshold: int = 64, least: int = 1, gaps: int = 1, kind: str = "least_square") -> Edges:
    """Spectral division, solving and merging in one task."""
    solved = {name: (ids, INNER[inner](s[np.ix_(ids, ids)]) if len(ids) > 1 else []) for name, ids in parts_of(s, threshold, least, gaps)}
    return merge_parts(solved, s, kind)


def spanning_tree(d: np.ndarray) -> Edges:
    """Minimum spanning tree (Prim): the nearest node outside joins next; of equal ones the first pair."""
    m = len(d)
    near, via, left, edges = d[0].astype(float).copy(), np.zeros(m, dtype=int), np.ones(m, dtype=bool), []
    left[0] = False
    while left.any():
        out = np.flatnonzero(left)
        v = int(out[np.lexsort((out, via[out], near[out]))[0]])
        edges.append((int(via[v]), v, float(near[v])))
        left[v] = False
        closer = left & (d[v] < near)
        near[closer], via[closer] = d[v][closer], v
    return edges


def metric_repair(d: np.ndarray) -> np.ndarray:
    """The largest metric below some distances: no path is shorter than its ends' distance."""
    out = np.minimum(d, d.T).astype(float)
    np.fill_diagonal(out, 0)
    for k in range(len(out)):
        out = np.minimum(out, out[:, [k]] + out[[k], :])
    return out


def linkage(sim: np.ndarray, how: str) -> Edges:
    """Agglomeration of the most similar clusters; single takes the largest, complete the least similarity, average the mean."""
    m = len(sim)
    now = np.full((2 * m, 2 * m), -np.inf)
    now[:m, :m] = sim
    size, live, edges, fresh = {i: 1 for i in range(m)}, list(range(m)), [], m
    while len(live) > 1:
        at = np.array(live)
        part = np.round(now[np.ix_(at, at)], 12)
        part[np.tril_indices(len(at))] = -np.inf
        x, y = np.unravel_index(np.argmax(part), part.shape)
        a, b = live[x], live[y]
        edges += [(a, fresh, 1.0), (b, fresh, 1.0)]
        live = [k for k in live if k not in (a, b)]
        joined = {"single": np.maximum, "complete": np.minimum, "average": lambda p, q: (size[a] * p + size[b] * q) / (size[a] + size[b])}[how](now[a, live], now[b, live])
        now[fresh, live] = now[live, fresh] = joined
        size[fresh] = size[a] + size[b]
        live.append(fresh)
        fresh += 1
    return edges


def recursive_grouping(d: np.ndarray, tolerance: float = 1e-6) -> Edges:
    """Families by constant differences d_ik - d_jk; siblings get a hidden parent, or one of them is the parent."""
    m = len(d)
    live, fresh, edges = list(range(m)), m, []
    dist = {(i, j): float(d[i, j]) for i in range(m) for j in range(m)}
    while len(live) > 2:
        family = {i: {i} for i in live}
        for x, i in enumerate(live):
            for j in live[x + 1 :]:
                phi = [dist[i, k] - dist[j, k] for k in live if k not in (i, j)]
                if max(phi) - min(phi) <= tolerance:
                    union = family[i] | family[j]
                    for k in union:
                        family[k] = union
        groups = sorted({frozenset(f) for f in family.values()}, key=min)
        if all(len(g) == 1 for g in groups):
            raise ValueError("distances are not additive within the tolerance")
        if len(groups) == 1 and len(live) == 3:
            i, j, k = sorted(live)
            e = {a: 0.5 * (dist[a, b] + dist[a, c] - dist[b, c]) for a, b, c in ((i, j, k), (j, i, k), (k, i, j))}
            centre = next((a for a in e if abs(e[a]) <= tolerance), None)
            hub = centre if centre is not None else fresh
            return edges + [(a, hub, e[a]) for a in e if a != hub]
        now = []
        for g in groups:
            if len(g) == 1:
                now.append(next(iter(g)))
                continue
            outside = [k for k in live if k not in g] or None
            e = {}
            for i in g:
                j = next(x for x in g if x != i)
                k = outside[0] if outside else next(x for x in g if x not in (i, j))
                e[i] = 0.5 * (dist[i, j] + dist[i, k] - dist[j, k])
            parent = next((i for i in sorted(g) if abs(e[i]) <= tolerance), None)
            hub = fresh if parent is None else parent
            fresh += parent is None
            edges += [(i, hub, e[i]) for i in sorted(g) if i != hub]
            if parent is None:
                child = min(g)
                for k in live:
                    dist[hub, k] = dist[k, hub] = dist[child, k] - e[child]
                dist[hub, hub] = 0.0
                for other in now:
                    if (child, other) in dist and (hub, other) not in dist:
                        dist[hub, other] = dist[other, hub] = dist[child, other] - e[child]
            now.append(hub)
        for x in now:
            for y in now:
                if (x, y) not in dist:
                    cx = next(a for a in live if (x, a) in dist and (a, y) in dist)
                    dist[x, y] = dist[y, x] = dist[cx, y] - dist[x, cx] if x != y else 0.0
        live = now
    if len(live) == 2:
        edges.append((live[0], live[1], dist[live[0], live[1]]))
    return edges


# Simulation --------------------------------------------------------------------------------


def kingman(m: int, rng: np.random.Generator, mean: bool = False) -> list[tuple[int, int, float]]:
    """(child, parent, length): waiting times Exp(C(k, 2)), or their means, then a random pair joins."""
    live = {i: 0.0 for i in range(m)}
    edges, fresh, now = [], m, 0.0
    while len(live) > 1:
        k = len(live)
        now += 2 / (k * (k - 1)) if mean else rng.exponential(2 / (k * (k - 1)))
        a, b = rng.choice(sorted(live), 2, replace=False).tolist()
        edges += [(a, fresh, now - live.pop(a)), (b, fresh, now - live.pop(b))]
        live[fresh] = now
        fresh += 1
    return edges


def birth_death(m: int, rng: np.random.Generator, birth: float = 1.0, death: float = 0.5) -> list[tuple[int, int, float]]:
    """(child, parent, length) of a birth-death tree with m living leaves; extinct lineages are pruned."""
    while True:
        parent, born, ended, live, now, fresh = {}, {0: 0.0}, {}, [0], 0.0, 1
        while live and len(live) < m:
            now += rng.exponential(1 / (len(live) * (birth + death)))
            x = live.pop(int(rng.integers(len(live))))
            ended[x] = now
            if rng.random() < birth / (birth + death):
                for y in (fresh, fresh + 1):
                    parent[y], born[y] = x, now
                    live.append(y)
                fresh += 2
        if live:
            break
    now += rng.exponential(1 / (len(live) * (birth + death)))
    kept: dict[int, list[int]] = {}
    for x in live:
        ended[x] = now
        while x in parent:
            if x in kept.setdefault(parent[x], []):
                break
            kept[parent[x]].append(x)
            x = parent[x]
    name = {x: i for i, x in enumerate(sorted(live))}
    edges: list[tuple[int, int, float]] = []
    made = iter(range(m, 2 * m))

    def walk(x: int) -> tuple[int, float]:
        since = born[x]
        while len(kept.get(x, [])) == 1:
            x = kept[x][0]
        if x in name:
            return name[x], now - since
        node = next(made)
        for c in kept[x]:
            child, length = walk(c)
            edges.append((child, node, length))
        return node, ended[x] - since

    walk(0)
    order = {n: m + i for i, n in enumerate(sorted({p for _, p, _ in edges}))}
    return [(order.get(c, c), order[p], w) for c, p, w in edges]


def random_topology(m: int, rng: np.random.Generator, length: float = 1.0) -> Edges:
    """Random pairs join until three are left, which meet in one node."""
    live, edges, fresh = list(range(m)), [], m
    while len(live) > 3:
        a, b = rng.choice(len(live), 2, replace=False).tolist()
        edges += [(live[a], fresh, length), (live[b], fresh, length)]
        live = [x for k, x in enumerate(live) if k not in (a, b)] + [fresh]
        fresh += 1
    return edges + ([(x, fresh, length) for x in live] if len(live) > 2 else [(live[0], live[1], length)])


# Likelihoods -----------------------------------------------------------------------------


def upward(edges: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """Edges (child, parent, length) of a rooted tree, children's before their parents'."""
    children: dict[int, list[tuple[int, int, float]]] = {}
    for e in edges:
        children.setdefault(e[1], []).append(e)
    order, stack = [], [({p for _, p, _ in edges} - {c for c, _, _ in edges}).pop()]
    while stack:
        for e in children.get(stack.pop(), []):
            order.append(e)
            stack.append(e[0])
    return order[::-1]


def tree_log_likelihood(edges: list[tuple[int, int, float]], patterns: np.ndarray, weight: np.ndarray, model) -> float:
    """Pruning over a rooted tree of (child, parent, length), of patterns (n x leaves) that occur so often.

    Each node's values are scaled to a largest of 1, and the logs of the factors added up."""
    hot, m = np.eye(len(model.pi)), patterns.shape[1]
    part: dict[int, np.ndarray] = {}
    logs, order = np.zeros(len(patterns)), upward(edges)
    for c, p, w in order:
        below = hot[patterns[:, c]] if c < m else part.pop(c)
        part[p] = part.get(p, 1.0) * (below @ model.matrix(max(w, 1e-6)).T)
        most = part[p].max(axis=1, keepdims=True)
        part[p] = part[p] / most
        logs += np.log(most[:, 0])
    return float(weight @ (np.log(part[order[-1][1]] @ model.pi) + logs))


def nearest_interchanges(edges: Edges, m: int) -> list[Edges]:
    """All trees one nearest-neighbour interchange away."""
    near, out = neighbours(edges), []
    for u, v, w in edges:
        if u < m or v < m:
            continue
        a = next(x for x, _ in near[u] if x != v)
        for b in [x for x, _ in near[v] if x != u]:
            swapped = []
            for x, y, z in edges:
                if {x, y} == {a, u}:
                    swapped.append((a, v, z))
                elif {x, y} == {b, v}:
                    swapped.append((b, u, z))
                else:
                    swapped.append((x, y, z))
            out.append(swapped)
    return out


def rooted(edges: Edges, root: int) -> list[tuple[int, int, float]]:
    near, out, seen, stack = neighbours(edges), [], {root}, [root]
    while stack:
        x = stack.pop()
        for y, w in near[x]:
            if y not in seen:
                seen.add(y)
                out.append((y, x, w))
                stack.append(y)
    return out


def likelihood_search(patterns: np.ndarray, weight: np.ndarray, model, start: Edges, rounds: int | None = None) -> tuple[Edges, float]:
    """Hill climbing by interchanges from a start tree, with branch lengths fitted in turn, until nothing improves
    (or for some rounds); not an emulation of any other program."""
    m = patterns.shape[1]
    score = lambda e: tree_log_likelihood(rooted(e, max(max(u, v) for u, v, _ in e)), patterns, weight, model)
    now, best = fitted_lengths(start, score)
    while rounds is None or rounds > 0:
        options = nearest_interchanges(now, m)
        found = max(((score(e), k) for k, e in enumerate(options)), default=(-np.inf, 0))
        if found[0] <= best + 1e-6:
            break
        now, best = fitted_lengths(options[found[1]], score)
        rounds = None if rounds is None else rounds - 1
    return now, best


def fitted_lengths(edges: Edges, score, steps: tuple[float, ...] = (2.0, 1.3, 1.08)) -> tuple[Edges, float]:
    """Each edge's length in turn is moved by factors while that helps."""
    edges, best = list(edges), score(edges)
    for factor in steps:
        for k, (u, v, w) in enumerate(edges):
            for f in (factor, 1 / factor):
                tried = edges[:k] + [(u, v, max(edges[k][2], 1e-4) * f)] + edges[k + 1 :]
                if (found := score(tried)) > best:
                    edges, best = tried, found
                    break
    return edges, best
