"""Similarities and distances as expressions over joint state counts."""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkclade.operators import counts as C


def to_distance(s: Column, least: float = 1e-20) -> Column:
    return -F.ln(F.greatest(s, F.lit(least)))


def jukes_cantor(ham: DataFrame, k: int) -> DataFrame:
    return ham.select("i", "j", F.pow(1 - F.col("h") * k / (k - 1), F.lit(k - 1.0)).alias("s"))


def jukes_cantor_of(k: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """jukes_cantor() as a score for pair_scores()."""
    return lambda n, diff: (1 - diff / n * k / (k - 1)) ** (k - 1.0)


def jukes_cantor_gamma(ham: DataFrame, shape: float) -> DataFrame:
    """exp(-d) with d = 3/4 a ((1 - 4/3 p)^(-1/a) - 1); saturated pairs have similarity 0."""
    base = 1 - F.col("h") * 4 / 3
    d = F.lit(0.75 * shape) * (F.pow(base, F.lit(-1.0 / shape)) - 1)
    return ham.select("i", "j", F.when(base > 0, F.exp(-d)).otherwise(0.0).alias("s"))


def expected_det(ham: DataFrame, k: int) -> DataFrame:
    h = F.least(F.col("h"), F.lit((k - 1) / k))
    return ham.select("i", "j", (F.lit((1 / k) ** k) * F.pow(1 - h * k / (k - 1), F.lit(k - 1.0))).alias("s"))


def _det(k: int) -> Column:
    """Leibniz' sum over the permutations of k states."""
    total = F.lit(0.0)
    for p in permutations(range(k)):
        sign = (-1) ** sum(p[x] > p[y] for x in range(k) for y in range(x + 1, k))
        term = F.lit(float(sign))
        for a, b in enumerate(p):
            term = term * F.col(f"f{a}{b}")
        total = total + term
    return total


def _packed_dets(conf: DataFrame, k: int) -> DataFrame:
    @F.pandas_udf("double")
    def det(tables: pd.Series) -> pd.Series:
        return pd.Series(np.linalg.det(np.stack(tables.to_numpy()).reshape(-1, k, k)))

    inside = conf.where((F.col("a") < k) & (F.col("b") < k))
    cells = inside.groupBy("i", "j").agg(F.sum("cnt").alias("n"), F.map_from_entries(F.collect_list(F.struct((F.col("a") * k + F.col("b")).alias("c"), "cnt"))).alias("m"))
    table = F.expr(f"transform(sequence(0, {k * k - 1}), c -> coalesce(m[c], 0L) / cast(n as double))")
    return cells.select("i", "j", det(table).alias("det"))


def joint_tables(conf: DataFrame, k: int) -> DataFrame:
    """(i, j, n, f00..): joint frequencies side by side."""
    n = F.sum("cnt")
    cells = [(F.sum(F.when((F.col("a") == a) & (F.col("b") == b), F.col("cnt")).otherwise(0)) / n).alias(f"f{a}{b}") for a in range(k) for b in range(k)]
    return conf.where((F.col("a") < k) & (F.col("b") < k)).groupBy("i", "j").agg(n.alias("n"), *cells)


def log_det(conf_with_diagonal: DataFrame, k: int, normalised: bool = True) -> DataFrame:
    """det of the joint table over the geometric mean of the two diagonal ones; 0 where a taxon lacks a state.

    Up to four states the determinant is an expression; beyond, numpy takes those of a batch together."""
    dets = joint_tables(conf_with_diagonal, k).select("i", "j", _det(k).alias("det")) if k <= 4 else _packed_dets(conf_with_diagonal, k)
    if not normalised:
        return dets.where("i < j").select("i", "j", F.col("det").alias("s"))
    own = dets.where("i = j")
    x, y = own.select("i", F.col("det").alias("di")), own.select(F.col("i").alias("j"), F.col("det").alias("dj"))
    s = F.coalesce(F.try_divide("det", F.sqrt(F.col("di") * F.col("dj"))), F.lit(0.0))
    return dets.where("i < j").join(x, "i").join(y, "j").select("i", "j", s.alias("s"))


def hky(sites: DataFrame) -> DataFrame:
    """Similarity under a model with two transition classes; states A C G T are 0 to 3, others missing."""
    t = C.transition_fractions(C.conf(sites)).join(C.pair_frequencies(sites), ["i", "j"])
    t = t.withColumn("q", F.expr("h - p1 - p2")).withColumn("gr", F.expr("g0 + g2")).withColumn("gy", F.expr("g1 + g3"))
    t = t.withColumn("r", F.expr("1 - try_divide(gr, 2 * g0 * g2) * p1 - try_divide(q, 2 * gr)")).withColumn("y", F.expr("1 - try_divide(gy, 2 * g3 * g1) * p2 - try_divide(q, 2 * gy)")).withColumn("t", F.expr("1 - try_divide(q, 2 * gr * gy)"))
    power = "sign({0}) * pow(abs({0}), {1})"
    s = " * ".join(power.format(*x) for x in (("r", "try_divide(8 * g0 * g2, gr)"), ("y", "try_divide(8 * g3 * g1, gy)"), ("t", "8 * (gr * gy - try_divide(g0 * g2 * gy, gr) - try_divide(g3 * g1 * gr, gy))")))
    return t.select("i", "j", F.expr(f"greatest(coalesce({s}, 0D), 0D)").alias("s"))


def mutual_information(conf: DataFrame) -> DataFrame:
    """(i, j, mi, hij, d): mutual information, joint entropy and their difference, base 2."""
    from pyspark.sql import Window

    pair = Window.partitionBy("i", "j")
    p = conf.withColumn("n", F.sum("cnt").over(pair)).withColumn("pa", F.sum("cnt").over(pair.partitionBy("i", "j", "a")) / F.col("n")).withColumn("pb", F.sum("cnt").over(pair.partitionBy("i", "j", "b")) / F.col("n"))
    p = p.withColumn("p", F.col("cnt") / F.col("n"))
    out = p.groupBy("i", "j").agg(F.sum(F.expr("p * ln(p / (pa * pb))") / F.ln(F.lit(2.0))).alias("mi"), F.sum(F.expr("-p * ln(p)") / F.ln(F.lit(2.0))).alias("hij"))
    return out.select("i", "j", "mi", "hij", (F.col("hij") - F.col("mi")).alias("d"))


def correlations(values: DataFrame) -> DataFrame:
    """(i, j, c): Pearson correlation of real observations (taxon, site, x)."""
    x = values.select(F.col("taxon").alias("i"), "site", "x")
    y = values.select(F.col("taxon").alias("j"), "site", F.col("x").alias("y"))
    return x.join(y, "site").where("i < j").groupBy("i", "j").agg(F.corr("x", "y").alias("c"))


def information_distance(conf: DataFrame) -> DataFrame:
    """Binary: -ln(abs(det J) / sqrt(p_i q_i p_j q_j + 1e-10) + 1e-10)."""
    t = joint_tables(conf, 2)
    margins = "sqrt((f00 + f01) * (f10 + f11) * (f00 + f10) * (f01 + f11) + 1e-10D)"
    return t.select("i", "j", F.expr(f"-ln(abs(f00 * f11 - f01 * f10) / {margins} + 1e-10D)").alias("d"))


def signed_mi(conf: DataFrame) -> DataFrame:
    """Mutual information, negative where the binary states are negatively correlated."""
    sign = joint_tables(conf, 2).select("i", "j", F.expr("if(f00 * f11 < f01 * f10, -1, 1)").alias("sg"))
    return mutual_information(conf).join(sign, ["i", "j"]).select("i", "j", (F.col("mi") * F.col("sg")).alias("mi"))


def binary_mi(conf_with_diagonal: DataFrame) -> DataFrame:
    """(i, j, mi) for i <= j: H_i + H_j - H_ij by natural logs with 1e-20 added, 0 for i = j."""
    p = joint_tables(conf_with_diagonal, 2)
    entropy = lambda *cells: "-(" + " + ".join(f"({c}) * ln({c} + 1e-20D)" for c in cells) + ")"
    both = f"{entropy('f00 + f01', 'f10 + f11')} + {entropy('f00 + f10', 'f01 + f11')} - {entropy('f00', 'f01', 'f10', 'f11')}"
    return p.select("i", "j", F.when(F.col("i") == F.col("j"), 0.0).otherwise(F.expr(both)).alias("mi"))


def threshold(sim: DataFrame, t: float) -> DataFrame:
    """Only similarities above t: the rest are no rows."""
    return sim.where(F.col("s") > t)


def power(sim: DataFrame, alpha: float, least: float = 1e-20) -> DataFrame:
    return sim.select("i", "j", F.pow(F.greatest("s", F.lit(least)), F.lit(alpha)).alias("s"))


def argmin_pair(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the pair (i, j) of the least score; of equal ones the first."""
    return scores.groupBy(*keys).agg(F.min(F.struct("score", "i", "j")).alias("x")).select(*keys, "x.i", "x.j", "x.score")


def median_of_smallest(values: DataFrame, keys: list[str], m: int) -> DataFrame:
    """Per key the median of the m smallest values (v)."""
    from pyspark.sql import Window

    ranked = values.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("v")))
    return ranked.where(F.col("r") <= m).groupBy(*keys).agg(F.median("v").alias("mid"))


def gaps(values: DataFrame, keys: list[str]) -> DataFrame:
    """Per key, of values (i, v) in order: (i, gap to the next, place, rank by falling gap)."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy("v", "i")
    g = values.withColumn("gap", F.lead("v").over(w) - F.col("v")).withColumn("k", F.row_number().over(w)).where("gap is not null")
    return g.select(*keys, "i", "gap", "k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("gap"), "i")).alias("best"))


# Matrices ----------------------------------------------------------------------------------


def full(sim: DataFrame, diagonal: float | None = 1.0) -> DataFrame:
    """Both triangles of a similarity that holds i < j, and the diagonal."""
    out = sim.select("i", "j", "s").union(sim.select(F.col("j"), F.col("i"), "s"))
    if diagonal is None:
        return out
    ids = sim.select("i").union(sim.select("j")).distinct()
    return out.union(ids.select("i", F.col("i").alias("j"), F.lit(diagonal).alias("s")))


def degree(matrix: DataFrame) -> DataFrame:
    return matrix.groupBy("i").agg(F.sum("s").alias("deg"))


def laplacian(matrix: DataFrame) -> DataFrame:
    d = degree(matrix)
    own = matrix.where("i = j").join(d, "i").select("i", "j", (F.col("deg") - F.col("s")).alias("v"))
    return matrix.where("i <> j").select("i", "j", (-F.col("s")).alias("v")).union(own)


def double_centred(dist: DataFrame) -> DataFrame:
    """-1/2 (d - row mean - column mean + mean) of a full matrix (i, j, s)."""
    rows = dist.groupBy("i").agg(F.avg("s").alias("mi"))
    total = dist.agg(F.avg("s").alias("mm"))
    joined = dist.join(rows, "i").join(rows.select(F.col("i").alias("j"), F.col("mi").alias("mj")), "j").join(F.broadcast(total))
    return joined.select("i", "j", (-0.5 * (F.col("s") - F.col("mi") - F.col("mj") + F.col("mm"))).alias("v"))


def block(matrix: DataFrame, inside: DataFrame) -> DataFrame:
    """S[A, not A]: rows by semi-join, columns by anti-join with the members (i) of A."""
    members = inside.select(F.col("i").alias("m"))
    return matrix.join(members, F.col("i") == F.col("m"), "left_semi").join(members, F.col("j") == F.col("m"), "left_anti")


def quartet_scores(m: DataFrame) -> DataFrame:
    """Scores of one block: Frobenius norms, and those that need no singular values.

    quartet_sum is the sum of squared 2x2 minors, (|M|^4 - |M'M|^2) / 2."""
    x = m.select("i", "j", "s")
    y = m.select("i", F.col("j").alias("k"), F.col("s").alias("t"))
    gram = x.join(y, "i").groupBy("j", "k").agg(F.sum(F.col("s") * F.col("t")).alias("g")).agg(F.sum(F.col("g") * F.col("g")).alias("gram2"))
    frob = m.agg(F.sum(F.col("s") * F.col("s")).alias("fro2"), F.count_distinct("i").alias("r"), F.count_distinct("j").alias("c"))
    n = "cast(r * (r - 1) * c * (c - 1) as double)"
    return frob.join(F.broadcast(gram)).selectExpr("sqrt(fro2) as fro", "sqrt(gram2) as gram", "(fro2 * fro2 - gram2) / fro2 as sum_squared_quartets", f"({n} * {n} - gram2) / {n} as average_quartets", "(fro2 * fro2 - gram2) / 2 as quartet_sum")


def merge_scores(matrix: DataFrame, clades: DataFrame, u: DataFrame) -> DataFrame:
    """Scores of candidate edges (clade, i) against a vector (i, u): all are sums over S[A, B].

    o = u_a u_b is compared with x = S_ab."""
    cells = clades.join(matrix, "i")
    outside = cells.join(clades.select(F.col("clade").alias("c2"), F.col("i").alias("i2")), (F.col("clade") == F.col("c2")) & (F.col("j") == F.col("i2")), "left_anti")
    withu = outside.join(u.select("i", F.col("u").alias("ua")), "i").join(u.select(F.col("i").alias("j"), F.col("u").alias("ub")), "j").withColumn("o", F.col("ua") * F.col("ub"))
    sums = withu.groupBy("clade").agg(F.sum("s").alias("sx"), F.sum(F.expr("s * s")).alias("xx"), F.sum(F.expr("o * o")).alias("oo"), F.sum(F.expr("s * o")).alias("xo"), F.sum(F.expr("try_divide(o, s)")).alias("r"), F.sum(F.expr("try_divide(o, s) * try_divide(o, s)")).alias("rr"), F.count(F.expr("try_divide(o, s)")).alias("cells"))
    return sums.selectExpr("clade", "1 - xo * xo / (oo * xx) as least_square", "1 - xo / sqrt(oo * xx) as angle", "cells - r * r / rr as normalized_least_square")
