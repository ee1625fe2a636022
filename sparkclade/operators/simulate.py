"""Simulation and experiment grids: one trial per task, seeded by its number."""

from __future__ import annotations

import time

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkclade.functions import kernels as K
from sparkclade.functions import models


def tree_edges(kind: str, m: int, length: float, rng: np.random.Generator) -> list[tuple[int, int, float]]:
    """(child, parent, length) of a rooted tree."""
    if kind in ("kingman", "mean_kingman"):
        return [(c, p, w * length) for c, p, w in K.kingman(m, rng, kind == "mean_kingman")]
    if kind == "birth_death":
        return [(c, p, w * length) for c, p, w in K.birth_death(m, rng)]
    if kind == "random":
        return K.rooted(K.random_topology(m, rng, length), 2 * m - 3)
    if kind == "caterpillar":
        return [(k, m + min(k, m - 2), length) for k in range(m)] + [(m + k, m + k - 1, length) for k in range(1, m - 1)]
    if kind == "balanced":
        if m & (m - 1):
            raise ValueError("the number of leaves of a balanced tree is a power of two")
        heap = {n: (n - m if n >= m else m + n - 1) for n in range(1, 2 * m)}
        return [(heap[n], heap[n // 2], length) for n in range(2, 2 * m)]
    raise ValueError(f"unknown tree {kind}")


def _simulated(r) -> tuple[list[tuple[int, int, float]], np.ndarray]:
    """Tree and leaf states of a trial: all that is random follows from its number."""
    rng = np.random.default_rng(int(r["trial"]))
    edges = tree_edges(r["kind"], int(r["m"]), float(r["length"]), rng)
    return edges, models.evolve(edges, int(r["m"]), models.preset(r["model"]), int(r["n"]), rng, shape=float(r["shape"]))


def sequences(trials: DataFrame) -> DataFrame:
    """(trial, taxon, site, state) for trials (trial, kind, m, n, length, model, shape); shape > 0: gamma rates by blocks of ten sites."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        _, x = _simulated(r)
        m, n = x.shape
        return pd.DataFrame({"trial": r["trial"], "taxon": np.repeat(np.arange(m), n), "site": np.tile(np.arange(n), m), "state": x.ravel()})

    return trials.groupBy("trial").applyInPandas(run, "trial bigint, taxon bigint, site bigint, state double")


def trees(trials: DataFrame) -> DataFrame:
    """The trees of trials, as rows of trees."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        edges, _ = _simulated(r)
        root = ({p for _, p, _ in edges} - {c for c, _, _ in edges}).pop()
        rows = [(str(r["trial"]), c, p, w, c if c < r["m"] else None) for c, p, w in edges] + [(str(r["trial"]), root, None, None, None)]
        return pd.DataFrame(rows, columns=["tree_id", "node", "parent", "length", "taxon"]).astype({"parent": "Int64", "taxon": "Int64"})

    return trials.groupBy("trial").applyInPandas(run, "tree_id string, node bigint, parent bigint, length double, taxon bigint")


def reconstructed(trials: DataFrame) -> DataFrame:
    """(tree_id, split, size) of the trees that trials' methods find; trials also have `method` and `metric`."""
    from sparkclade.operators.reconstruct import METHODS, SPLITS, rows_of, similarity_of

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        _, x = _simulated(r)
        return rows_of(str(r["trial"]), METHODS[r["method"]](similarity_of(x, r["metric"])), len(x))

    return trials.groupBy("trial", "method", "metric").applyInPandas(run, SPLITS)


RESULT = "kind string, model string, rate double, rep int, n int, method string, rf int, f1 double, correct boolean, run_time double"


def experiment(spark: SparkSession, kinds: list[str], lengths: list[float], sites: list[int], methods: list[str], m: int, repeats: int, model: str = "jc", metric: str = "jc") -> DataFrame:
    """Results: each trial is simulated once, at the most sites, and prefixes are reused."""
    grid = spark.createDataFrame([(k, w, r) for k in kinds for w in lengths for r in range(repeats)], "kind string, length double, rep int")
    return results_of(grid.select("*", F.lit(m).alias("m"), F.lit(max(sites)).alias("n"), F.lit(model).alias("model"), F.lit(0.0).alias("shape"), F.expr("abs(xxhash64(kind, length, rep)) % 1000000007").alias("trial")), sites, methods, metric)


def results_of(trials: DataFrame, sites: list[int], methods: list[str], metric: str = "jc") -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        from sparkclade.operators.reconstruct import METHODS, similarity_of

        r = pdf.iloc[0]
        edges, x = _simulated(r)
        m = len(x)
        truth = K.splits(edges, m)
        rows = []
        for n in sites:
            s = similarity_of(x[:, :n], metric)
            for method in methods:
                began = time.time()
                got = K.splits(METHODS[method](s), m)
                tp = len(got & truth)
                rows.append((r["kind"], r["model"], float(r["length"]), int(r["rep"]), n, method, len(got) + len(truth) - 2 * tp, 2 * tp / max(1, len(got) + len(truth)), got == truth, time.time() - began))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")])

    return trials.groupBy("trial").applyInPandas(run, RESULT)


def reproduce(spark: SparkSession, kind: str, length: float, rep: int, n: int, method: str, m: int, most_sites: int, model: str = "jc", metric: str = "jc") -> DataFrame:
    """One result of an experiment, once more: its trial's number is that of the grid, and its seed."""
    one = spark.createDataFrame([(kind, length, rep)], "kind string, length double, rep int")
    trial = one.select("*", F.lit(m).alias("m"), F.lit(most_sites).alias("n"), F.lit(model).alias("model"), F.lit(0.0).alias("shape"), F.expr("abs(xxhash64(kind, length, rep)) % 1000000007").alias("trial"))
    return results_of(trial, [n], [method], metric)
