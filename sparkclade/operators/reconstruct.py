"""Reconstruction: one dataset, or one part of it, per task.

Input is a similarity (tree_id, i, j, s) with i < j over taxa 0..m-1; output its splits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkclade.functions import kernels as K
from sparkclade.functions import latent as L
from sparkclade.functions import metrics, scorers

SPLITS = "tree_id string, split string, size bigint"


def dense(pdf: pd.DataFrame, value: str = "s", own: float = 1.0) -> np.ndarray:
    m = int(max(pdf["i"].max(), pdf["j"].max())) + 1
    out = np.full((m, m), 0.0)
    np.fill_diagonal(out, own)
    i, j = pdf["i"].to_numpy(), pdf["j"].to_numpy()
    out[i, j] = out[j, i] = pdf[value].to_numpy()
    return out


def to_distance(s: np.ndarray) -> np.ndarray:
    return -np.log(np.maximum(s, 1e-20))


#: Methods by name: similarity to edges.
METHODS = {
    "nj": lambda s: K.neighbor_joining(to_distance(s)),
    "nj_observed": lambda s: L.observed_neighbor_joining(to_distance(s)),
    "snj": K.spectral_joining,
    "snj_half": lambda s: K.spectral_joining(s, alpha=0.5),
    "snj_angle_of_second_vectors": lambda s: K.spectral_joining(s, pair_scorer=scorers.angle_of_second_vectors),
    "snj_alignment_of_rows": lambda s: K.spectral_joining(s, pair_scorer=scorers.alignment_of_rows),
    "rg": lambda s: K.recursive_grouping(to_distance(s)),
    "rg_relaxed": lambda s: L.relaxed_grouping(to_distance(s)),
    "clrg": lambda s: L.spanning_then(to_distance(s), L.relaxed_grouping),
    "clnj": lambda s: L.spanning_then(to_distance(s), K.neighbor_joining, None),
    "clnj_observed": lambda s: L.spanning_then(to_distance(s), L.observed_neighbor_joining),
    "hc_single": lambda s: K.linkage(s, "single"),
    "hc_complete": lambda s: K.linkage(s, "complete"),
    "hc_average": lambda s: K.linkage(s, "average"),
}


def register_method(name: str, f) -> None:
    """f: similarity matrix -> edges (u, v, length), leaves first."""
    METHODS[name] = f


def register_scorer(name: str, f) -> None:
    """A spectral joining by a scorer of one's own, block -> score; the method is called snj_<name>."""
    METHODS[f"snj_{name}"] = lambda s: K.spectral_joining(s, f)


def register_metric(name: str, f) -> None:
    """f: states (taxa x sites) -> similarity matrix."""
    metrics.METRICS[name] = f


for _name in scorers.NAMES:
    register_scorer(_name, scorers.by_values(_name))
register_scorer("sum_squared_quartets", K.squared_quartets)
for _inner in K.INNER:
    for _t in (16, 32, 64, 128):
        register_method(f"stdr_{_inner}_{_t}", lambda s, inner=_inner, t=_t: K.divided(s, inner, t))


def similarity_of(x: np.ndarray, metric: str, least: float = 1e-6) -> np.ndarray:
    if metric not in metrics.METRICS:
        raise ValueError(f"unknown metric {metric}")
    return np.maximum(metrics.METRICS[metric](x), least)


def rows_of(tree_id: str, edges: K.Edges, m: int) -> pd.DataFrame:
    found = sorted(",".join(map(str, sorted(s))) for s in K.splits(edges, m))
    return pd.DataFrame({"tree_id": [tree_id] * len(found), "split": found, "size": [f.count(",") + 1 for f in found]})


def from_sites(sites: DataFrame, method: str, metric: str = "jc") -> DataFrame:
    """Splits from characters (tree_id, taxon, site, state): metric, then method, one dataset per task."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method}")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.pivot(index="taxon", columns="site", values="state").to_numpy()
        return rows_of(pdf["tree_id"].iloc[0], METHODS[method](similarity_of(x, metric)), len(x))

    return sites.groupBy("tree_id").applyInPandas(run, SPLITS)


def recursive_divisions(sim: DataFrame, threshold: int, how: str) -> DataFrame:
    """(tree_id, group, part, taxon) of every division of a recursive partition: part 1 and part 2."""
    if how not in K.DIVISIONS:
        raise ValueError(f"unknown division {how}")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(pdf["tree_id"].iloc[0], name, part, x) for name, one, two in K.recursive_partition(dense(pdf), threshold, how) for part, ids in ((1, one), (2, two)) for x in ids]
        return pd.DataFrame(rows, columns=["tree_id", "group", "part", "taxon"])

    return sim.groupBy("tree_id").applyInPandas(run, "tree_id string, group string, part int, taxon bigint")


def eigengap(sim: DataFrame) -> DataFrame:
    """(tree_id, split, gap): the taxa beyond the widest gap of the second eigenvector of the similarity, and the gap."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = K.division_vector(dense(pdf), "similarity")
        order = np.sort(v)
        at = int(np.argmax(np.diff(order)))
        side = np.flatnonzero((v <= order[at]) != (v[0] <= order[at]))
        return pd.DataFrame({"tree_id": [pdf["tree_id"].iloc[0]], "split": [",".join(map(str, side))], "gap": [float(order[at + 1] - order[at])]})

    return sim.groupBy("tree_id").applyInPandas(run, "tree_id string, split string, gap double")


def forest_scores(sites: DataFrame, method: str) -> DataFrame:
    """(tree_id, name, value): scores of a forest learnt from sites (tree_id, taxon, site, state): each site is a sample."""
    if method not in L.FORESTS:
        raise ValueError(f"unknown forest {method}")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.pivot(index="site", columns="taxon", values="state").to_numpy().astype(int)
        patterns, weight = np.unique(x, axis=0, return_counts=True)
        found = L.scores(L.FORESTS[method](patterns, weight.astype(float), [int(x.max()) + 1] * x.shape[1]), patterns, weight.astype(float))
        return pd.DataFrame({"tree_id": pdf["tree_id"].iloc[0], "name": list(found), "value": [float(v) for v in found.values()]})

    return sites.groupBy("tree_id").applyInPandas(run, "tree_id string, name string, value double")


def by_method(sim: DataFrame, method: str) -> DataFrame:
    if method not in METHODS:
        raise ValueError(f"unknown method {method}")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        s = dense(pdf)
        return rows_of(pdf["tree_id"].iloc[0], METHODS[method](s), len(s))

    return sim.groupBy("tree_id").applyInPandas(run, SPLITS)


def divide_and_merge(sim: DataFrame, inner: str = "nj", threshold: int = 4, least: int = 1, gaps: int = 1, score: str = "least_square") -> DataFrame:
    """Spectral division into parts, which are solved in parallel tasks, and merging at the roots that the cross similarity shows."""
    if inner not in K.INNER:
        raise ValueError(f"unknown inner method {inner}")

    def divide(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(pdf["tree_id"].iloc[0], name, i) for name, ids in K.parts_of(dense(pdf), threshold, least, gaps) for i in ids]
        return pd.DataFrame(rows, columns=["tree_id", "part", "taxon"])

    parts = sim.groupBy("tree_id").applyInPandas(divide, "tree_id string, part string, taxon bigint")
    x, y = parts.select("tree_id", "part", F.col("taxon").alias("i")), parts.select("tree_id", "part", F.col("taxon").alias("j"))
    within = x.join(y, ["tree_id", "part"]).where("i <= j").join(sim.select("tree_id", "i", "j", "s"), ["tree_id", "i", "j"], "left").fillna(1.0, ["s"])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = sorted(set(pdf["i"]))
        at = {t: k for k, t in enumerate(ids)}
        local = dense(pdf.assign(i=pdf["i"].map(at), j=pdf["j"].map(at)))
        edges = K.INNER[inner](local) if len(ids) > 1 else []
        return pd.DataFrame({"tree_id": [pdf["tree_id"].iloc[0]], "part": [pdf["part"].iloc[0]], "ids": [ids], "u": [[e[0] for e in edges]], "v": [[e[1] for e in edges]], "w": [[float(e[2]) for e in edges]]})

    solved = within.groupBy("tree_id", "part").applyInPandas(solve, "tree_id string, part string, ids array<bigint>, u array<bigint>, v array<bigint>, w array<double>")

    def merge(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        s = dense(left)
        have = {r.part: ([int(i) for i in r.ids], [(int(a), int(b), float(w)) for a, b, w in zip(r.u, r.v, r.w, strict=True)]) for r in right.itertuples()}
        return rows_of(key[0], K.merge_parts(have, s, score), len(s))

    return sim.groupBy("tree_id").cogroup(solved.groupBy("tree_id")).applyInPandas(merge, SPLITS)


def spanning_edges(dist: DataFrame) -> DataFrame:
    """(tree_id, u, v): minimum spanning tree of distances (tree_id, i, j, s)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        edges = K.spanning_tree(dense(pdf, own=0.0))
        return pd.DataFrame([(pdf["tree_id"].iloc[0], min(u, v), max(u, v)) for u, v, _ in edges], columns=["tree_id", "u", "v"])

    return dist.groupBy("tree_id").applyInPandas(run, "tree_id string, u bigint, v bigint")


def spectral_split(sim: DataFrame, kind: str = "laplacian", gaps: int = 1, least: int = 1, signs: bool = True) -> DataFrame:
    """(tree_id, split): the first spectral split, by its side without taxon 0."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        mask = K.partition(dense(pdf), gaps, least, kind, signs)
        side = np.flatnonzero(mask != mask[0])
        return pd.DataFrame({"tree_id": [pdf["tree_id"].iloc[0]], "split": [",".join(map(str, side))]})

    return sim.groupBy("tree_id").applyInPandas(run, "tree_id string, split string")


def singular_values(blocks: DataFrame) -> DataFrame:
    """(block, sv): singular values of each block (block, i, j, s); scorers are expressions over them."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot_table(index="i", columns="j", values="s", fill_value=0.0).to_numpy()
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "rows": [m.shape[0]], "cols": [m.shape[1]], "sv": [np.linalg.svd(m, compute_uv=False).tolist()]})

    return blocks.groupBy("block").applyInPandas(run, "block string, rows int, cols int, sv array<double>")


def spectrum_scores(values: DataFrame) -> DataFrame:
    """Scores of a block that follow from its singular values, as expressions."""
    s = values.withColumn("s1", F.expr("sv[0]")).withColumn("s2", F.expr("coalesce(get(sv, 1), 0D)")).withColumn("total", F.expr("aggregate(sv, 0D, (a, x) -> a + x)")).withColumn("fro2", F.expr("aggregate(sv, 0D, (a, x) -> a + x * x)")).withColumn("p4", F.expr("aggregate(sv, 0D, (a, x) -> a + x * x * x * x)"))
    rc = "cast(rows * cols as double)"
    return s.selectExpr(
        "block", "s1 as first", "s2 as second", "s2 / (s1 + s2) as second_of_two", "s2 / total as second_of_all", "total - s1 as rest", "(total - s1) / total as rest_of_all", "s2 * s2 - s1 * s1 as gap", "(s2 * s2 - s1 * s1) / (s1 * s1 + s2 * s2) as gap_of_two", "(s2 * s2 - s1 * s1) / fro2 as gap_of_all",
        f"(total - s1) / sqrt({rc}) as rest_by_root_size", f"(total - s1) / {rc} as rest_by_size", "(total - s1) / least(rows, cols) as rest_by_side", "s1 * s1 * (fro2 - s1 * s1) as first_times_rest", "fro2 - s1 * s1 as rest_squares", "s1 * s1 * (fro2 - s1 * s1) / fro2 as first_times_rest_of_all", "(fro2 * fro2 - p4) / 2 as minors", "total as nuclear",
        "(fro2 - s1 * s1) / (s1 * s1) as rest_over_first", "fro2 / (s1 * s1) as stable_rank", "fro2 * fro2 - pow(s1, 4) as over", "(fro2 * fro2 - p4) / (2 * s1 * s1) as minors_by_first", "aggregate(transform(sv, x -> abs(x - total / size(sv))), 0D, (a, x) -> a + x) as spread", "sqrt(greatest(fro2 - s1 * s1, 0D)) as root_rest_squares",
    )
