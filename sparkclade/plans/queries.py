"""Registered queries and, for each that SQL can express, the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkclade.operators import counts as C
from sparkclade.operators import metadata as M_
from sparkclade.operators import reconstruct as R
from sparkclade.operators import similarity as S
from sparkclade.operators import simulate as M
from sparkclade.operators import trees as T
from sparkclade.sources import newick, observe

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def rd(c: Column | str, places: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, places) + F.lit(0.0)


def rds(x: str) -> str:
    return f"round(CAST({x} AS DOUBLE), 6) + CAST(0 AS DOUBLE)"


def ids(df: DataFrame) -> DataFrame:
    """Integer columns as BIGINT, doubles rounded."""
    return df.select(*(rd(c).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t in ("int", "smallint", "tinyint") else F.col(c) for c, t in df.dtypes))


def rounded(score: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """What rd() makes of a score, for pair_scores(): it rounds each distinct value, where rd() would each pair."""

    def f(n, diff):
        return np.array([float(Decimal(repr(x)).quantize(Decimal("0.000001"), ROUND_HALF_UP)) for x in score(n, diff).tolist()]) + 0.0

    return f


# Observations: mean vectors of labels (four or two states), all vectors, and users' days with gaps.
CUTS4, CUTS2 = [-0.01, 0.0, 0.01], [0.0]


def lab(spark, d) -> DataFrame:
    return observe.label_means(observe.table(spark, d, "embeddings"))


def lab4(spark, d) -> DataFrame:
    return observe.of_labels(observe.table(spark, d, "embeddings"), CUTS4)


def lab2(spark, d) -> DataFrame:
    return observe.of_labels(observe.table(spark, d, "embeddings"), CUTS2)


def evt(spark, d) -> DataFrame:
    return observe.of_events(observe.table(spark, d, "events"))


_LAB = "lab AS (SELECT taxon, site, avg(x) AS x FROM (SELECT CAST(label AS BIGINT) AS taxon, CAST(unnest(embedding) AS DOUBLE) AS x, unnest(range(len(embedding))) AS site FROM embeddings WHERE label IS NOT NULL) GROUP BY 1, 2)"
LAB4 = f"WITH {_LAB}, sites AS (SELECT taxon, site, CASE WHEN x >= 0.01 THEN 3 WHEN x >= 0 THEN 2 WHEN x >= -0.01 THEN 1 ELSE 0 END AS state FROM lab)"
LAB2 = f"WITH {_LAB}, sites AS (SELECT taxon, site, CASE WHEN x >= 0 THEN 1 ELSE 0 END AS state FROM lab)"
EMB4 = "WITH raw AS (SELECT vec_id AS taxon, CAST(unnest(embedding) AS DOUBLE) AS x, unnest(range(len(embedding))) AS site FROM embeddings), sites AS (SELECT taxon, site, CASE WHEN x >= CAST(0.1 AS DOUBLE) THEN 3 WHEN x >= 0 THEN 2 WHEN x >= CAST(-0.1 AS DOUBLE) THEN 1 ELSE 0 END AS state FROM raw)"
EVT = """WITH coded AS (SELECT user_id AS taxon, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS site, ts, event_id, CASE event_type WHEN 'click' THEN 0 WHEN 'purchase' THEN 1 WHEN 'view' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS state FROM events),
 sites AS (SELECT taxon, site, state FROM (SELECT *, row_number() OVER (PARTITION BY taxon, site ORDER BY ts DESC, event_id DESC) AS r FROM coded) WHERE r = 1)"""
CONF = ", conf AS (SELECT x.taxon AS i, y.taxon AS j, x.state AS a, y.state AS b, count(*) AS cnt FROM sites x JOIN sites y ON x.site = y.site AND x.taxon < y.taxon GROUP BY 1, 2, 3, 4)"
CONFD = CONF.replace("x.taxon < y.taxon", "x.taxon <= y.taxon")
HAM = CONF + ", ham AS (SELECT i, j, sum(CASE WHEN a <> b THEN cnt ELSE 0 END) / CAST(sum(cnt) AS DOUBLE) AS h FROM conf GROUP BY 1, 2)"
JC = HAM + ", sim AS (SELECT i, j, pow(1 - h * 4 / 3.0::DOUBLE, 3) AS s FROM ham)"
FULL = JC + ", mat AS (SELECT i, j, s FROM sim UNION ALL SELECT j, i, s FROM sim UNION ALL SELECT DISTINCT taxon, taxon, CAST(1 AS DOUBLE) FROM sites)"


@query(EMB4 + CONF + " SELECT i, j, a, b, cnt FROM conf")
def conf_counts(spark, d):
    return ids(C.conf_blocked(observe.of_vectors(observe.table(spark, d, "embeddings")), 4))


@query(LAB4 + CONF + " SELECT i, j, a, b, cnt FROM conf")
def conf_counts_blocked(spark, d):
    return ids(C.conf_blocked(lab4(spark, d), 4, block=4, chunk=16))


@query(EVT + CONF + " SELECT i, j, CAST(sum(cnt) AS BIGINT) AS n FROM conf GROUP BY 1, 2")
def valid_pairs(spark, d):
    return C.shared_sites(evt(spark, d))


@query(EMB4 + HAM + f" SELECT i, j, {rds('h')} AS h FROM ham")
def hamming(spark, d):
    return C.pair_scores(observe.of_vectors(observe.table(spark, d, "embeddings")), rounded(C.share)).withColumnRenamed("s", "h")


@query(EVT + HAM.replace("FROM conf GROUP", "FROM conf WHERE a <> 4 AND b <> 4 GROUP") + f" SELECT i, j, {rds('h')} AS h FROM ham")
def hamming_missing(spark, d):
    return C.pair_scores(evt(spark, d).where("state <> 4"), rounded(C.share)).withColumnRenamed("s", "h")


@query(LAB4 + ", f AS (SELECT taxon, count(*) AS n, sum(CAST(state = 0 AS INT)) AS c0, sum(CAST(state = 1 AS INT)) AS c1, sum(CAST(state = 2 AS INT)) AS c2, sum(CAST(state = 3 AS INT)) AS c3 FROM sites GROUP BY 1) SELECT x.taxon AS i, y.taxon AS j, " + ", ".join(rds(f"(x.c{k} + y.c{k}) / CAST(x.n + y.n AS DOUBLE)") + f" AS g{k}" for k in range(4)) + " FROM f x JOIN f y ON x.taxon < y.taxon")
def base_freq_pairs(spark, d):
    return ids(C.pair_frequencies(lab4(spark, d)))


_TRANS = ", tr AS (SELECT i, j, sum(CASE WHEN (a = 0 AND b = 2) OR (a = 2 AND b = 0) THEN cnt ELSE 0 END) / CAST(sum(cnt) AS DOUBLE) AS p1, sum(CASE WHEN (a = 1 AND b = 3) OR (a = 3 AND b = 1) THEN cnt ELSE 0 END) / CAST(sum(cnt) AS DOUBLE) AS p2, sum(CASE WHEN a <> b THEN cnt ELSE 0 END) / CAST(sum(cnt) AS DOUBLE) AS h FROM conf GROUP BY 1, 2)"


@query(LAB4 + CONF + _TRANS + f" SELECT i, j, {rds('p1')} AS p1, {rds('p2')} AS p2, {rds('h')} AS h FROM tr")
def transition_fracs(spark, d):
    return ids(C.transition_fractions(C.conf(lab4(spark, d))))


@query(LAB2 + ", cols AS (SELECT site, string_agg(CAST(state AS VARCHAR), ',' ORDER BY taxon) AS pattern FROM sites GROUP BY 1) SELECT pattern, count(*) AS cnt FROM cols GROUP BY 1")
def site_patterns(spark, d):
    return C.site_patterns(lab2(spark, d))


@query(EMB4 + JC + f" SELECT i, j, {rds('s')} AS s FROM sim")
def jc_similarity(spark, d):
    return C.pair_scores(observe.of_vectors(observe.table(spark, d, "embeddings")), rounded(S.jukes_cantor_of(4)))


def _jc(spark, d) -> DataFrame:
    return S.jukes_cantor(C.hamming(C.conf(lab4(spark, d))), 4)


@query(LAB4 + JC + f" SELECT i, j, {rds('-ln(greatest(s, 1e-20))')} AS d FROM sim")
def jc_distance(spark, d):
    return ids(_jc(spark, d).select("i", "j", S.to_distance(F.col("s")).alias("d")))


@query(LAB4 + HAM + f" SELECT i, j, {rds('CASE WHEN 1 - h * 4 / 3 > 0 THEN exp(-(1.5 * (pow(1 - h * 4 / 3, CAST(-0.5 AS DOUBLE)) - 1))) ELSE 0 END')} AS s FROM ham")
def jc_gamma_similarity(spark, d):
    return ids(S.jukes_cantor_gamma(C.hamming(C.conf(lab4(spark, d))), 2.0))


@query(LAB4 + HAM + f" SELECT i, j, {rds('pow(0.25, 4) * pow(1 - least(h, 0.75) * 4 / 3, 3)')} AS s FROM ham")
def legacy_jc_expected_det(spark, d):
    return ids(S.expected_det(C.hamming(C.conf(lab4(spark, d))), 4))


@query(LAB4 + HAM + f" SELECT i, j, {rds('-0.75 * ln(greatest(1 - h * 4 / 3, 1e-16))')} AS d FROM ham")
def legacy_jc_distance(spark, d):
    return ids(C.hamming(C.conf(lab4(spark, d))).select("i", "j", (-0.75 * F.ln(F.greatest(1 - F.col("h") * 4 / 3, F.lit(1e-16)))).alias("d")))


def _tables(k: int) -> str:
    cells = ", ".join(f"sum(CASE WHEN a = {a} AND b = {b} THEN cnt ELSE 0 END) / CAST(sum(cnt) AS DOUBLE) AS f{a}{b}" for a in range(k) for b in range(k))
    return f", tab AS (SELECT i, j, {cells} FROM conf GROUP BY 1, 2)"


def _minor(rows: list[int], cols: list[int]) -> str:
    """Cofactor expansion along the first row."""
    if len(rows) == 1:
        return f"f{rows[0]}{cols[0]}"
    return "(" + " ".join(f"{'-' if k % 2 else '+'} f{rows[0]}{c} * {_minor(rows[1:], cols[:k] + cols[k + 1:])}" for k, c in enumerate(cols)) + ")"


def _logdet(k: int) -> str:
    det = _minor(list(range(k)), list(range(k)))
    return CONFD + _tables(k) + f", det AS (SELECT i, j, {det} AS v FROM tab) SELECT x.i, x.j, {{}} FROM det x JOIN det p ON p.i = x.i AND p.j = x.i JOIN det q ON q.i = x.j AND q.j = x.j WHERE x.i < x.j"


_RATIO = "CASE WHEN p.v * q.v > 0 THEN x.v / sqrt(p.v * q.v) ELSE 0 END"


@query(LAB2 + _logdet(2).format(rds(_RATIO) + " AS s"))
def paralinear_k2(spark, d):
    return ids(S.log_det(C.conf(lab2(spark, d), True), 2))


@query(LAB4 + _logdet(4).format(rds(_RATIO) + " AS s"))
def paralinear_k4(spark, d):
    return ids(S.log_det(C.conf(lab4(spark, d), True), 4))


@query(LAB2 + _logdet(2).format(rds(f"-ln(greatest({_RATIO}, 1e-20))") + " AS d"))
def paralinear_distance(spark, d):
    return ids(S.log_det(C.conf(lab2(spark, d), True), 2).select("i", "j", S.to_distance(F.col("s")).alias("d")))


@query(LAB2 + _logdet(2).format(rds("x.v") + " AS s"))
def legacy_det_similarity(spark, d):
    return ids(S.log_det(C.conf(lab2(spark, d), True), 2, normalised=False))


_HKY = """, f AS (SELECT taxon, count(*) AS n, sum(CAST(state = 0 AS INT)) AS c0, sum(CAST(state = 1 AS INT)) AS c1, sum(CAST(state = 2 AS INT)) AS c2, sum(CAST(state = 3 AS INT)) AS c3 FROM sites GROUP BY 1),
 g AS (SELECT x.taxon AS i, y.taxon AS j, (x.c0 + y.c0) / CAST(x.n + y.n AS DOUBLE) AS ga, (x.c1 + y.c1) / CAST(x.n + y.n AS DOUBLE) AS gc, (x.c2 + y.c2) / CAST(x.n + y.n AS DOUBLE) AS gg, (x.c3 + y.c3) / CAST(x.n + y.n AS DOUBLE) AS gt FROM f x JOIN f y ON x.taxon < y.taxon),
 w AS (SELECT i, j, ga, gc, gg, gt, ga + gg AS gr, gc + gt AS gy, p1, p2, h - p1 - p2 AS q FROM tr JOIN g USING (i, j)),
 e AS (SELECT *, 1 - gr / (2 * ga * gg) * p1 - q / (2 * gr) AS rr, 1 - gy / (2 * gt * gc) * p2 - q / (2 * gy) AS yy, 1 - q / (2 * gr * gy) AS tt FROM w)"""
_HKYS = "greatest(sign(rr) * pow(abs(rr), 8 * ga * gg / gr) * sign(yy) * pow(abs(yy), 8 * gt * gc / gy) * sign(tt) * pow(abs(tt), 8 * (gr * gy - ga * gg * gy / gr - gt * gc * gr / gy)), 0)"


@query(LAB4 + CONF + _TRANS + _HKY + f" SELECT i, j, {rds(_HKYS)} AS s FROM e")
def hky_similarity(spark, d):
    return ids(S.hky(lab4(spark, d)))


_CORR = f"WITH {_LAB}, co AS (SELECT x.taxon AS i, y.taxon AS j, corr(x.x, y.x) AS c FROM lab x JOIN lab y ON x.site = y.site AND x.taxon < y.taxon GROUP BY 1, 2)"


@query(_CORR + f" SELECT i, j, {rds('-ln(greatest(abs(c), 1e-16))')} AS d FROM co")
def corr_distance(spark, d):
    return ids(S.correlations(lab(spark, d)).select("i", "j", S.to_distance(F.abs("c"), 1e-16).alias("d")))


@query(_CORR + f" SELECT i, j, {rds('c * c')} AS s FROM co")
def corr_sq_similarity(spark, d):
    return ids(S.correlations(lab(spark, d)).select("i", "j", (F.col("c") * F.col("c")).alias("s")))


_MI = """, n AS (SELECT i, j, sum(cnt) AS n FROM conf GROUP BY 1, 2), ma AS (SELECT i, j, a, sum(cnt) AS ca FROM conf GROUP BY 1, 2, 3), mb AS (SELECT i, j, b, sum(cnt) AS cb FROM conf GROUP BY 1, 2, 3),
 mi AS (SELECT i, j, sum(cnt / CAST(n AS DOUBLE) * log2(cnt * CAST(n AS DOUBLE) / (ca * cb))) AS mi, sum(-cnt / CAST(n AS DOUBLE) * log2(cnt / CAST(n AS DOUBLE))) AS hij FROM conf JOIN n USING (i, j) JOIN ma USING (i, j, a) JOIN mb USING (i, j, b) GROUP BY 1, 2)"""


@query(LAB4 + CONF + _MI + f" SELECT i, j, {rds('mi')} AS mi, {rds('hij')} AS hij, {rds('hij - mi')} AS d FROM mi")
def mutual_information(spark, d):
    return ids(S.mutual_information(C.conf(lab4(spark, d))))


@query(LAB2 + CONF + _MI + _tables(2) + f" SELECT i, j, {rds('CASE WHEN f00 * f11 < f01 * f10 THEN -mi ELSE mi END')} AS mi FROM mi JOIN tab USING (i, j)")
def signed_mi(spark, d):
    return ids(S.signed_mi(C.conf(lab2(spark, d))))


@query(LAB2 + CONF + _tables(2) + f" SELECT i, j, {rds('-ln(abs(f00 * f11 - f01 * f10) / sqrt((f00 + f01) * (f10 + f11) * (f00 + f10) * (f01 + f11) + 1e-10) + 1e-10)')} AS d FROM tab")
def info_distance_binary(spark, d):
    return ids(S.information_distance(C.conf(lab2(spark, d))))


@query(LAB4 + JC + f" SELECT i, j, {rds('s')} AS s FROM sim WHERE s > 0.00001")
def sim_threshold(spark, d):
    return ids(S.threshold(_jc(spark, d), 0.00001))


@query(LAB4 + JC + f" SELECT i, j, {rds('pow(greatest(s, 1e-20), 1.5)')} AS s FROM sim")
def sim_power(spark, d):
    return ids(S.power(_jc(spark, d), 1.5))


def _mat(spark, d) -> DataFrame:
    return S.full(_jc(spark, d))


@query(LAB4 + FULL + f" SELECT i, j, {rds('s')} AS s FROM mat WHERE i < 5 AND j >= 5")
def sim_submatrix(spark, d):
    m = _mat(spark, d)
    return ids(S.block(m, m.where("i < 5").select("i").distinct()))


@query(LAB4 + FULL + f" SELECT i, {rds('sum(s)')} AS deg FROM mat GROUP BY 1")
def degree(spark, d):
    return ids(S.degree(_mat(spark, d)))


@query(LAB4 + FULL + f", g AS (SELECT i, sum(s) AS deg FROM mat GROUP BY 1) SELECT i, j, {rds('CASE WHEN i = j THEN deg - s ELSE -s END')} AS v FROM mat JOIN g USING (i)")
def laplacian(spark, d):
    return ids(S.laplacian(_mat(spark, d)))


@query(LAB4 + FULL + f" SELECT i, j, {rds('-0.5 * (s - avg(s) OVER (PARTITION BY i) - avg(s) OVER (PARTITION BY j) + avg(s) OVER ())')} AS v FROM mat")
def double_centering(spark, d):
    return ids(S.double_centred(_mat(spark, d)))


_BLOCK = FULL + ", m AS (SELECT i, j, s FROM mat WHERE i < 5 AND j >= 5), g AS (SELECT sum(v * v) AS g2 FROM (SELECT x.j, y.j AS k, sum(x.s * y.s) AS v FROM m x JOIN m y ON x.i = y.i GROUP BY 1, 2)), fr AS (SELECT sum(s * s) AS f2, count(DISTINCT i) AS r, count(DISTINCT j) AS c FROM m)"


@query(LAB4 + _BLOCK + f" SELECT {rds('sqrt(f2)')} AS fro, {rds('sqrt(g2)')} AS gram, {rds('(f2 * f2 - g2) / f2')} AS sum_squared_quartets, {rds('(CAST(r * (r - 1) * c * (c - 1) AS DOUBLE) * (r * (r - 1) * c * (c - 1)) - g2) / (r * (r - 1) * c * (c - 1))')} AS average_quartets, {rds('(f2 * f2 - g2) / 2')} AS quartet_sum FROM fr, g")
def quartet_scores(spark, d):
    m = _mat(spark, d)
    return ids(S.quartet_scores(S.block(m, m.where("i < 5").select("i").distinct())))


@query(LAB4 + _BLOCK + f" SELECT {rds('max(abs(p.s * q.s - u.s * v.s))')} AS max_quartet FROM m p JOIN m q ON p.i < q.i AND p.j < q.j JOIN m u ON u.i = p.i AND u.j = q.j JOIN m v ON v.i = q.i AND v.j = p.j")
def max_quartet(spark, d):
    m = _mat(spark, d)
    b = S.block(m, m.where("i < 5").select("i").distinct())
    row = b.alias("p").join(b.alias("u"), (F.col("p.i") == F.col("u.i")) & (F.col("p.j") < F.col("u.j"))).select(F.col("p.i").alias("i"), F.col("p.j").alias("j"), F.col("u.j").alias("k"), F.col("p.s").alias("x"), F.col("u.s").alias("y"))
    both = row.alias("a").join(row.alias("b"), ["j", "k"]).where("a.i < b.i")
    return ids(both.agg(F.max(F.abs(F.expr("a.x * b.y - a.y * b.x"))).alias("max_quartet")))


_EDGE = FULL + ", cl AS (SELECT DISTINCT 'c' || CAST(k AS VARCHAR) AS clade, taxon AS i FROM sites, (VALUES (2), (3), (5)) v(k) WHERE taxon < k), u AS (SELECT i, 1 / (2 + CAST(i AS DOUBLE)) AS u FROM (SELECT DISTINCT i FROM mat)), z AS (SELECT cl.clade, m.s, a.u * b.u AS o FROM cl JOIN mat m ON m.i = cl.i JOIN u a ON a.i = m.i JOIN u b ON b.i = m.j WHERE NOT EXISTS (SELECT 1 FROM cl k WHERE k.clade = cl.clade AND k.i = m.j))"


@query(LAB4 + _EDGE + f" SELECT clade, {rds('1 - sum(s * o) * sum(s * o) / (sum(o * o) * sum(s * s))')} AS least_square, {rds('1 - sum(s * o) / sqrt(sum(o * o) * sum(s * s))')} AS angle, {rds('count(o / nullif(s, 0)) - sum(o / nullif(s, 0)) * sum(o / nullif(s, 0)) / sum((o / nullif(s, 0)) * (o / nullif(s, 0)))')} AS normalized_least_square FROM z GROUP BY 1")
def merge_scores(spark, d):
    m = _mat(spark, d)
    taxa = m.select("i").distinct()
    sizes = F.explode(F.array(*(F.lit(k) for k in (2, 3, 5)))).alias("k")
    clades = taxa.select("i", sizes).where("i < k").select(F.concat(F.lit("c"), F.col("k")).alias("clade"), "i")
    return ids(S.merge_scores(m, clades, taxa.select("i", (1 / (2 + F.col("i").cast("double"))).alias("u"))))


@query(LAB4 + FULL + f", g AS (SELECT i, sum(s) AS v FROM mat GROUP BY 1), p AS (SELECT i, v, lead(v) OVER (ORDER BY v, i) - v AS gap, row_number() OVER (ORDER BY v, i) AS k FROM g) SELECT i, {rds('gap')} AS gap, k, row_number() OVER (ORDER BY gap DESC, i) AS best FROM p WHERE gap IS NOT NULL")
def gap_candidates(spark, d):
    return ids(S.gaps(S.degree(_mat(spark, d)).select(F.lit("all").alias("tree_id"), "i", F.col("deg").alias("v")), ["tree_id"]).drop("tree_id"))


@query("SELECT l_returnflag AS method, CAST(l_linenumber AS BIGINT) AS n, round(CAST(avg(l_quantity) AS DOUBLE), 2) AS mean, round(CAST(stddev_samp(CAST(l_quantity AS DOUBLE)) AS DOUBLE), 2) AS sd, count(*) AS runs, count(DISTINCT l_suppkey) AS kinds FROM lineitem GROUP BY 1, 2")
def results_summary(spark, d):
    li = observe.table(spark, d, "lineitem")
    return li.groupBy(F.col("l_returnflag").alias("method"), F.col("l_linenumber").cast("long").alias("n")).agg(F.round(F.avg("l_quantity").cast("double"), 2).alias("mean"), F.round(F.stddev_samp(F.col("l_quantity").cast("double")), 2).alias("sd"), F.count("*").alias("runs"), F.count_distinct("l_suppkey").alias("kinds"))


@query("WITH g AS (SELECT l_returnflag AS method, CAST(sum(l_quantity) AS DOUBLE) AS qty, CAST(sum(l_extendedprice) AS DOUBLE) AS price FROM lineitem GROUP BY 1) SELECT method, 'qty' AS performance, round(qty, 2) AS value FROM g UNION ALL SELECT method, 'price', round(price, 2) FROM g")
def results_unpivot(spark, d):
    g = observe.table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("method")).agg(F.round(F.sum("l_quantity").cast("double"), 2).alias("qty"), F.round(F.sum("l_extendedprice").cast("double"), 2).alias("price"))
    return g.unpivot("method", ["qty", "price"], "performance", "value")


@query("SELECT l_returnflag AS method, CAST(l_linenumber AS BIGINT) AS n, count(*) AS runs, round(CAST(avg(CAST(l_quantity > 25 AS INT)) AS DOUBLE), 6) AS accuracy FROM lineitem GROUP BY ROLLUP (l_returnflag, CAST(l_linenumber AS BIGINT))")
def results_rollup(spark, d):
    li = observe.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("method"), F.col("l_linenumber").cast("long").alias("n"), (F.col("l_quantity") > 25).cast("int").alias("hit"))
    return li.rollup("method", "n").agg(F.count("*").alias("runs"), F.round(F.avg("hit"), 6).alias("accuracy"))


@query("SELECT CAST(regexp_extract(c_name, '([0-9]+)$', 1) AS BIGINT) AS m, count(*) AS n FROM customer GROUP BY 1")
def results_regex(spark, d):
    return observe.table(spark, d, "customer").groupBy(F.regexp_extract("c_name", "([0-9]+)$", 1).cast("long").alias("m")).agg(F.count("*").alias("n"))


@query("SELECT CAST(l_suppkey AS BIGINT) AS i, CAST(l_linenumber AS BIGINT) AS j, round(CAST(avg(CAST(l_discount AS DOUBLE)) AS DOUBLE), 6) AS mean, round(CAST(median(CAST(l_discount AS DOUBLE)) AS DOUBLE), 6) AS mid FROM lineitem GROUP BY 1, 2")
def mean_median_matrix(spark, d):
    li = observe.table(spark, d, "lineitem")
    x = F.col("l_discount").cast("double")
    return li.groupBy(F.col("l_suppkey").cast("long").alias("i"), F.col("l_linenumber").cast("long").alias("j")).agg(F.round(F.avg(x), 6).alias("mean"), F.round(F.median(x), 6).alias("mid"))


# Trees ---------------------------------------------------------------------------------------


def _heap(m: int, w) -> list[tuple]:
    return [(n, None if n == 1 else n // 2, None if n == 1 else w(n), n - m if n >= m else None) for n in range(1, 2 * m)]


REF = (
    [("balanced8", *r) for r in _heap(8, lambda n: 0.2)]
    + [("uneven8", *r) for r in _heap(8, lambda n: round(0.1 + 0.03 * ((7 * n) % 5), 2))]
    + [("cat8", k, 8 + min(k, 6), 0.3, k) for k in range(8)] + [("cat8", 8, None, None, None)] + [("cat8", 8 + k, 7 + k, 0.25, None) for k in range(1, 7)]
    + [("six", n, p, w, x) for n, p, w, x in ((0, 6, 0.1, 0), (1, 6, 0.3, 1), (2, 7, 0.2, 2), (3, 8, 0.15, 3), (4, 8, 0.4, 4), (5, 9, 0.25, 5), (6, 7, 0.12, None), (7, 9, 0.22, None), (8, 9, 0.18, None), (9, None, None, None))]
)
_SWAP = {0: 2, 2: 0}
OTHER = [(t, n, p, w, _SWAP.get(x, x)) for t, n, p, w, x in REF]


def _values(rows) -> str:
    lit = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    return "(SELECT tree_id, CAST(node AS BIGINT) AS node, CAST(parent AS BIGINT) AS parent, CAST(length AS DOUBLE) AS length, CAST(taxon AS BIGINT) AS taxon FROM (VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + ") v(tree_id, node, parent, length, taxon))"


def _up(name: str, rows) -> str:
    t = f"{name}t"
    return f"{t} AS {_values(rows)}, {name}(tree_id, node, taxon) AS (SELECT tree_id, node, taxon FROM {t} WHERE taxon IS NOT NULL UNION ALL SELECT u.tree_id, t.parent, u.taxon FROM {name} u JOIN {t} t ON t.tree_id = u.tree_id AND t.node = u.node WHERE t.parent IS NOT NULL)"


def _split(name: str, where: str = "true") -> str:
    return f"{name}l AS (SELECT DISTINCT tree_id, taxon FROM {name} WHERE {where}), {name}n AS (SELECT tree_id, count(*) AS m, min(taxon) AS lo FROM {name}l GROUP BY 1), {name}h AS (SELECT n.tree_id, n.node, l.taxon, EXISTS (SELECT 1 FROM {name} u WHERE u.tree_id = n.tree_id AND u.node = n.node AND u.taxon = l.taxon) AS has FROM (SELECT DISTINCT tree_id, node FROM {name} WHERE {where}) n JOIN {name}l l ON l.tree_id = n.tree_id), {name}z AS (SELECT h.tree_id, h.node, b.has AS flip FROM {name}h h JOIN {name}n n ON n.tree_id = h.tree_id AND n.lo = h.taxon JOIN {name}h b ON b.tree_id = h.tree_id AND b.node = h.node AND b.taxon = n.lo), {name}s AS (SELECT DISTINCT tree_id, split, size FROM (SELECT h.tree_id, h.node, string_agg(CAST(h.taxon AS VARCHAR), ',' ORDER BY h.taxon) AS split, count(*) AS size, any_value(n.m) AS m FROM {name}h h JOIN {name}z z ON z.tree_id = h.tree_id AND z.node = h.node JOIN {name}n n ON n.tree_id = h.tree_id WHERE h.has <> z.flip GROUP BY 1, 2) WHERE size >= 2 AND size <= m - 2)"


REFUP = "WITH RECURSIVE " + _up("r", REF)
REFS = REFUP + ", " + _split("r")
BOTHS = REFS + ", " + _up("w", OTHER) + ", " + _split("w")
ANC = f"WITH RECURSIVE t AS {_values(REF)}, anc(tree_id, taxon, node, d, hops) AS (SELECT tree_id, taxon, node, CAST(0 AS DOUBLE), 0 FROM t WHERE taxon IS NOT NULL UNION ALL SELECT a.tree_id, a.taxon, t.parent, a.d + t.length, a.hops + 1 FROM anc a JOIN t ON t.tree_id = a.tree_id AND t.node = a.node WHERE t.parent IS NOT NULL), pat AS (SELECT x.tree_id, x.taxon AS i, y.taxon AS j, min(x.d + y.d) AS d, min(x.hops + y.hops) AS hops FROM anc x JOIN anc y ON x.tree_id = y.tree_id AND x.node = y.node WHERE x.taxon < y.taxon GROUP BY 1, 2, 3)"


def ref(spark) -> DataFrame:
    return T.of_edges(spark, REF)


def ref_splits(spark) -> DataFrame:
    return T.splits(T.clades(ref(spark)))


def exact(spark) -> DataFrame:
    """Similarity exp(-d) of the reference trees."""
    return T.patristic(ref(spark)).select("tree_id", "i", "j", F.exp(-F.col("d")).alias("s"))


@query(REFUP + " SELECT tree_id, node, taxon FROM r")
def clades(spark, d):
    return T.clades(ref(spark))


@query(REFS + " SELECT tree_id, split, size FROM rs")
def splits(spark, d):
    return ref_splits(spark)


@query(ANC + f" SELECT tree_id, i, j, {rds('d')} AS d, CAST(hops AS BIGINT) AS hops FROM pat")
def patristic(spark, d):
    return ids(T.patristic(ref(spark)))


@query(ANC + f" SELECT tree_id, CAST(max(hops) AS BIGINT) AS hops, {rds('max(d)')} AS d FROM pat GROUP BY 1")
def diameter(spark, d):
    return ids(T.patristic(ref(spark)).groupBy("tree_id").agg(F.max("hops").alias("hops"), F.max("d").alias("d")))


@query(ANC + f" SELECT tree_id, i, j, {rds('pow(pow(1 - (1 - 0.95) * 4 / 3, 3), d)')} AS s FROM pat")
def exact_similarity(spark, d):
    return ids(T.patristic(ref(spark)).select("tree_id", "i", "j", F.pow(F.lit((1 - (1 - 0.95) * 4 / 3) ** 3), F.col("d")).alias("s")))


@query(f"WITH t AS {_values(REF)}, k AS (SELECT tree_id, parent FROM t WHERE parent IS NOT NULL GROUP BY 1, 2 HAVING count(*) = 2 AND count(taxon) = 2) SELECT tree_id, (SELECT count(*) FROM k WHERE k.tree_id = a.tree_id) AS cherries FROM (SELECT DISTINCT tree_id FROM t) a")
def cherries(spark, d):
    return T.cherries(ref(spark))


_CMP = BOTHS + ", c AS (SELECT coalesce(o.tree_id, r.tree_id) AS tree_id, count(o.split) AS ni, count(r.split) AS nr, count(CASE WHEN o.split IS NOT NULL AND r.split IS NOT NULL THEN 1 END) AS tp FROM ws o FULL JOIN rs r ON o.tree_id = r.tree_id AND o.split = r.split GROUP BY 1)"


@query(_CMP + f" SELECT tree_id, ni - tp AS fp, nr - tp AS fn, ni + nr - 2 * tp AS rf, {rds('tp / ni')} AS precision, {rds('tp / nr')} AS recall, {rds('2 * tp / (ni + nr)')} AS f1 FROM c")
def rf_precision_recall_f1(spark, d):
    return ids(T.compare(T.splits(T.clades(T.of_edges(spark, OTHER))), ref_splits(spark), ["tree_id"]))


@query(_CMP + ", m AS (SELECT tree_id, count(DISTINCT taxon) AS m FROM r GROUP BY 1) " + f"SELECT tree_id, {rds('(ni + nr - 2 * tp) / (2 * m - 6)')} AS nrf, ni = tp AND nr = tp AS same FROM c JOIN m USING (tree_id)")
def normalized_rf_topo_equal(spark, d):
    m = ref(spark).groupBy("tree_id").agg(F.count("taxon").alias("m"))
    c = T.compare(T.splits(T.clades(T.of_edges(spark, OTHER))), ref_splits(spark), ["tree_id"])
    return ids(c.join(m, "tree_id").select("tree_id", (F.col("rf") / (2 * F.col("m") - 6)).alias("nrf"), (F.col("rf") == 0).alias("same")))


@query(BOTHS + " SELECT o.tree_id, o.split, EXISTS (SELECT 1 FROM rs r WHERE r.tree_id = o.tree_id AND r.split = o.split) AS found FROM ws o")
def is_split(spark, d):
    return T.contains(T.splits(T.clades(T.of_edges(spark, OTHER))), ref_splits(spark))


@query(REFUP.replace("WHERE taxon IS NOT NULL UNION", "WHERE taxon IS NOT NULL AND taxon <> 3 UNION") + ", " + _split("r") + " SELECT tree_id, split, size FROM rs")
def restricted_splits(spark, d):
    taxa = ref(spark).where("taxon is not null and taxon <> 3").select("taxon").distinct()
    return T.splits(T.restrict(T.clades(ref(spark)), taxa))


@query("SELECT * FROM (VALUES ('six', 0, 6, 0.1, 0), ('six', 1, 6, 0.3, 1), ('six', 2, 7, 0.2, 2), ('six', 3, 8, 0.15, 3), ('six', 4, 8, 0.4, 4), ('six', 5, 9, 0.25, 5), ('six', 6, NULL, NULL, NULL), ('six', 7, 6, 0.12, NULL), ('six', 9, 7, 0.22, NULL), ('six', 8, 9, 0.18, NULL)) v(tree_id, node, parent, length, taxon)".replace("SELECT *", "SELECT tree_id, CAST(node AS BIGINT) AS node, CAST(parent AS BIGINT) AS parent, CAST(length AS DOUBLE) AS length, CAST(taxon AS BIGINT) AS taxon"))
def reroot(spark, d):
    """At node 6: the edges 6-7 and 7-9 turn round, the others stay."""
    return T.reroot(ref(spark).where("tree_id = 'six'"), 6, 6)


@query("SELECT * FROM (SELECT tree_id, CAST(node AS BIGINT) AS node, CAST(parent AS BIGINT) AS parent FROM (VALUES ('four', 0, 6), ('four', 1, 5), ('four', 2, 4), ('four', 3, 4), ('four', 4, 5), ('four', 5, 6), ('four', 6, NULL)) v(tree_id, node, parent))")
def adjacency_tree(spark, d):
    """Undirected edges 0-6 1-5 2-4 3-4 4-5 5-6, from node 6 on."""
    e = spark.sql("SELECT 'four' AS tree_id, CAST(col1 AS BIGINT) AS u, CAST(col2 AS BIGINT) AS v, 1D AS length FROM VALUES (0, 6), (1, 5), (2, 4), (3, 4), (4, 5), (5, 6)")
    return T.adjacency_to_tree(e, 6, 4).select("tree_id", "node", "parent")


@query("WITH n AS (SELECT unnest(range(1, 64)) AS node) SELECT 'balanced32' AS tree_id, node, CASE WHEN node > 1 THEN node // 2 END AS parent, CASE WHEN node > 1 THEN CAST(0.5 AS DOUBLE) END AS length, CASE WHEN node >= 32 THEN node - 32 END AS taxon FROM n")
def balanced_tree(spark, d):
    return T.balanced(spark, 32, 0.5)


@query("WITH n AS (SELECT unnest(range(63)) AS node) SELECT 'caterpillar32' AS tree_id, node, CASE WHEN node < 31 THEN 32 + node WHEN node = 31 THEN 62 WHEN node > 32 THEN node - 1 END AS parent, CASE WHEN node <> 32 THEN CAST(0.5 AS DOUBLE) END AS length, CASE WHEN node < 32 THEN node END AS taxon FROM n")
def caterpillar_tree(spark, d):
    return T.caterpillar(spark, 32, 0.5)


def _method(name: str, trees: str = "true"):
    def run(spark, d):
        return R.by_method(exact(spark).where(trees), name)

    run.__name__ = f"{name}_additive"
    return query(REFS + f" SELECT tree_id, split, size FROM rs WHERE {trees}")(run)


for _name in ("nj", "nj_observed", "snj", "snj_sum_squared_quartets", "snj_max_quartet", "snj_root_rest_squares", "rg", "clnj", "clnj_observed"):
    _method(_name)
for _name in ("hc_single", "hc_complete", "hc_average"):
    _method(_name, "tree_id = 'balanced8'")


@query(REFS + " SELECT tree_id, split, size FROM rs")
def stdr_nj_additive(spark, d):
    return R.divide_and_merge(exact(spark), "nj", 4)


@query(REFS + " SELECT tree_id, split, size FROM rs")
def str_snj_additive(spark, d):
    return R.divide_and_merge(exact(spark), "snj", 4, score="angle")


_HALVES = "SELECT tree_id, string_agg(CAST(t AS VARCHAR), ',' ORDER BY t) AS split FROM (SELECT tree_id, unnest(range(m // 2, m)) AS t FROM (VALUES ('balanced8', 8), ('balanced16', 16), ('balanced32', 32), ('double_star12', 12)) v(tree_id, m)) GROUP BY 1"


def halved(spark) -> DataFrame:
    """Similarities of trees whose first division is known: the lower and the upper half."""
    many = T.balanced(spark, 8, 0.3).unionByName(T.balanced(spark, 16, 0.25)).unionByName(T.balanced(spark, 32, 0.2)).unionByName(T.double_star(spark, 12, 0.4))
    return T.patristic(many).select("tree_id", "i", "j", F.exp(-F.col("d")).alias("s"))


@query(_HALVES)
def fiedler_split(spark, d):
    return R.spectral_split(halved(spark))


@query(_HALVES)
def griffing_split(spark, d):
    return R.spectral_split(halved(spark), "centred")


@query(_HALVES)
def random_walk_split(spark, d):
    return R.spectral_split(halved(spark), "rw")


@query(_HALVES)
def gap_split(spark, d):
    """Only gaps, three of them, with at least three taxa on either side."""
    return R.spectral_split(halved(spark), "laplacian", gaps=3, least=3, signs=False)


@query(f"WITH t AS {_values(REF)} SELECT DISTINCT tree_id, least(node, parent) AS u, greatest(node, parent) AS v FROM t WHERE parent IS NOT NULL AND tree_id = 'cat8'")
def chow_liu_tree(spark, d):
    """All nodes observed: the spanning tree of path lengths is the tree itself."""
    t = ref(spark).where("tree_id = 'cat8'")
    return R.spanning_edges(T.patristic(t.withColumn("taxon", F.col("node"))).select("tree_id", "i", "j", F.col("d").alias("s")))


_NEWICK = "((dog:0.1,cat:0.3)x:0.12[&k={1}],(snake:0.2,'big fish':0.15):0.2,tree:0.4);"


@query("SELECT 'n' AS tree_id, CAST(node AS BIGINT) AS node, CAST(parent AS BIGINT) AS parent, CAST(length AS DOUBLE) AS length, label FROM (VALUES (0, NULL, NULL, NULL), (1, 0, 0.12, 'x'), (2, 1, 0.1, 'dog'), (3, 1, 0.3, 'cat'), (4, 0, 0.2, NULL), (5, 4, 0.2, 'snake'), (6, 4, 0.15, 'big fish'), (7, 0, 0.4, 'tree')) v(node, parent, length, label)")
def newick_parse(spark, d):
    return newick.read(spark.sql("SELECT 'n' AS tree_id, :t AS newick", args={"t": _NEWICK})).drop("attrs")


@query("SELECT 'n' AS tree_id, '((dog:0.1,cat:0.3)x:0.12,(snake:0.2,''big fish'':0.15):0.2,tree:0.4);' AS newick")
def newick_write(spark, d):
    """Written, read and written again."""
    return newick.write(newick.read(newick.write(newick_parse(spark, d))))


_NS = "WITH ns(ns_ix, label) AS (VALUES (0, 'dog'), (1, 'cat'), (2, 'snake'), (3, 'fish'), (4, 'tree')), taxa(row_ix, label) AS (VALUES (0, 'fish'), (1, 'snake'), (2, 'cat'), (3, 'dog'))"


def labels(spark, *names: str) -> DataFrame:
    return spark.sql("SELECT explode(:v) AS label", args={"v": F.array(*map(F.lit, names))})


def _ns(spark) -> tuple[DataFrame, DataFrame]:
    ns = spark.sql("SELECT CAST(col1 AS BIGINT) AS ns_ix, col2 AS label FROM VALUES (0, 'dog'), (1, 'cat'), (2, 'snake'), (3, 'fish'), (4, 'tree')")
    taxa = spark.sql("SELECT CAST(col1 AS BIGINT) AS row_ix, col2 AS label FROM VALUES (0, 'fish'), (1, 'snake'), (2, 'cat'), (3, 'dog')")
    return ns, taxa


@query(_NS + " SELECT CAST(row_ix AS BIGINT) AS row_ix, label, label IN ('snake', 'dog') AS inside FROM taxa")
def taxa_mask(spark, d):
    return M_.mask_of(_ns(spark)[1], labels(spark, "snake", "dog"))


@query("SELECT '11100' AS bipartition")
def mask_bipartition(spark, d):
    """Highest namespace index first, on the side where index 0 is 0."""
    ns, taxa = _ns(spark)
    return M_.bipartition_of(ns, M_.mask_of(taxa, labels(spark, "dog", "cat")))


@query(_NS + " SELECT CAST(row_ix AS BIGINT) AS row_ix, label FROM taxa WHERE label NOT IN ('snake', 'dog')")
def invert_mask(spark, d):
    taxa = _ns(spark)[1]
    every = M_.mask_of(taxa, taxa.select("label"))
    return M_.taxa_of(M_.invert_mask(M_.mask_of(taxa, labels(spark, "snake", "dog")), every))


@query(_NS + " SELECT CAST(t.row_ix AS BIGINT) AS row_ix, CAST(n.ns_ix AS BIGINT) AS ns_ix, label FROM taxa t JOIN ns n USING (label)")
def label_index(spark, d):
    ns, taxa = _ns(spark)
    return taxa.join(ns, "label").select("row_ix", "ns_ix", "label")


@query("SELECT label, CAST(site AS BIGINT) AS site, CAST(state AS BIGINT) AS state FROM (SELECT label, unnest(codes) AS state, unnest(range(5)) AS site FROM (VALUES ('fish', [3, 1, 1, 0, 0]), ('snake', [3, 2, 1, 0, 0]), ('cat', [3, 2, 4, 0, 0]), ('dog', [2, 2, 0, 0, 0])) v(label, codes)) WHERE state <> 4")
def encode_seqs(spark, d):
    seqs = spark.sql("SELECT col1 AS label, col2 AS seq FROM VALUES ('fish', 'TCCAA'), ('snake', 'TGCAA'), ('cat', 'TG-AA'), ('dog', 'GGAAA')")
    return ids(observe.to_sites(observe.encode(seqs)))


@query("SELECT * FROM (VALUES ('fish', 'TCCAA'), ('snake', 'TGCAA'), ('cat', 'TG-AA'), ('dog', 'GGAAA')) v(label, seq)")
def decode_seqs(spark, d):
    return observe.decode(observe.encode(spark.sql("SELECT col1 AS label, col2 AS seq FROM VALUES ('fish', 'TCCAA'), ('snake', 'TGCAA'), ('cat', 'TG-AA'), ('dog', 'GGAAA')")))


@query(f"SELECT CAST(k AS BIGINT) AS k, {rds('1 / k + (k - 1) / k * exp(-t * k / (k - 1))')} AS p, {rds('t')} AS t FROM (SELECT CAST(unnest([2, 4, 20]) AS DOUBLE) AS k), (SELECT CAST(unnest([0.1, 0.5, 1.0]) AS DOUBLE) AS t)")
def jc_t2p_p2t(spark, d):
    g = spark.sql("SELECT k, u FROM (SELECT explode(array(2D, 4D, 20D)) AS k), (SELECT explode(array(0.1D, 0.5D, 1D)) AS u)").withColumn("p", F.expr("1 / k + (k - 1) / k * exp(-u * k / (k - 1))"))
    return ids(g.select(F.col("k").cast("long").alias("k"), "p", F.expr("-(k - 1) / k * ln(p * k / (k - 1) - 1 / (k - 1))").alias("t")))


_FREQ = LAB2 + ", cols AS (SELECT site, string_agg(CAST(state AS VARCHAR), ',' ORDER BY taxon) AS pattern FROM sites GROUP BY 1), pc AS (SELECT pattern, count(*) AS c FROM cols GROUP BY 1), ml AS (SELECT taxon, state, count(*) AS c, sum(count(*)) OVER (PARTITION BY taxon) AS n FROM sites GROUP BY 1, 2), x AS (SELECT sum(c * ln(c / CAST(n AS DOUBLE))) AS ll, count(DISTINCT taxon) AS df, max(n) AS n FROM ml), y AS (SELECT sum(c * ln(c / CAST(t AS DOUBLE))) AS sat FROM pc, (SELECT sum(c) AS t FROM pc))"


@query(_FREQ + f" SELECT {rds('ll')} AS ll, {rds('ll - df')} AS aic, {rds('ll - 0.5 * df * ln(n)')} AS bic, {rds('sat')} AS saturated, {rds('2 * (sat - ll)')} AS deviance FROM x, y")
def independent_aic_bic(spark, d):
    s = lab2(spark, d)
    margins = s.groupBy("taxon", "state").agg(F.count("*").alias("c"))
    n = s.groupBy("taxon").agg(F.count("*").alias("n"))
    ll = margins.join(n, "taxon").agg(F.sum(F.expr("c * ln(c / n)")).alias("ll"), F.count_distinct("taxon").alias("df"), F.max("n").alias("n"))
    pc = C.site_patterns(s)
    sat = pc.join(F.broadcast(pc.agg(F.sum("cnt").alias("t")))).agg(F.sum(F.expr("cnt * ln(cnt / t)")).alias("sat"))
    return ids(ll.join(F.broadcast(sat)).selectExpr("ll", "ll - df as aic", "ll - 0.5D * df * ln(n) as bic", "sat as saturated", "2 * (sat - ll) as deviance"))


@query(ANC.replace("min(x.d + y.d) AS d", "min(x.d + y.d) AS d") + ", dm AS (SELECT tree_id, i, j, d FROM pat UNION ALL SELECT tree_id, j, i, d FROM pat) " + f"SELECT a.tree_id, a.i, a.j, {rds('max(b.d - c.d) - min(b.d - c.d)')} AS phi FROM dm a JOIN dm b ON b.tree_id = a.tree_id AND b.i = a.i JOIN dm c ON c.tree_id = a.tree_id AND c.i = a.j AND c.j = b.j WHERE a.i < a.j GROUP BY 1, 2, 3")
def family_phi(spark, d):
    p = T.patristic(ref(spark)).select("tree_id", "i", "j", "d")
    m = p.union(p.select("tree_id", F.col("j"), F.col("i"), "d"))
    x, y = m.select("tree_id", "i", F.col("j").alias("k"), F.col("d").alias("x")), m.select("tree_id", F.col("i").alias("j"), F.col("j").alias("k"), F.col("d").alias("y"))
    return ids(x.join(y, ["tree_id", "k"]).where("i < j").groupBy("tree_id", "i", "j").agg((F.max(F.col("x") - F.col("y")) - F.min(F.col("x") - F.col("y"))).alias("phi")))


# Random or iterative: rows only -----------------------------------------------------------------


def _trials(spark, kind: str, shape: float = 0.0) -> DataFrame:
    return spark.sql(f"SELECT CAST(id AS BIGINT) AS trial, '{kind}' AS kind, 8 AS m, 200 AS n, 0.1D AS length, 'jc' AS model, CAST({shape} AS DOUBLE) AS shape FROM range(4)")


@query()
def simulate_jc(spark, d):
    return M.sequences(_trials(spark, "balanced"))


@query()
def simulate_gamma(spark, d):
    return M.sequences(_trials(spark, "caterpillar", 5.0))


@query()
def simulate_kingman(spark, d):
    return M.sequences(_trials(spark, "kingman"))


@query()
def simulate_birth_death(spark, d):
    return M.sequences(_trials(spark, "birth_death"))


@query()
def experiment_grid(spark, d):
    return M.experiment(spark, ["balanced", "caterpillar"], [0.1], [200, 800], ["nj", "snj"], 8, 2)


@query()
def spectrum_scores(spark, d):
    m = _mat(spark, d)
    blocks = S.block(m, m.where("i < 5").select("i").distinct()).select(F.lit("low").alias("block"), "i", "j", "s")
    return R.spectrum_scores(R.singular_values(blocks))


@query()
def latent_class_bic(spark, d):
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        from sparkclade.functions import latent

        x = np.array([[int(v) for v in p.split(",")] for p in pdf["pattern"]])
        k, ll, *_ = latent.latent_class_by_bic(latent.evidence(x, [2] * x.shape[1]), pdf["cnt"].to_numpy(float))
        return pd.DataFrame({"classes": [k], "ll": [ll]})

    return C.site_patterns(lab2(spark, d)).groupBy(F.lit(1).alias("one")).applyInPandas(run, "classes int, ll double")


@query("SELECT CAST(id AS VARCHAR) AS tree_id, string_agg(CAST(t AS VARCHAR), ',' ORDER BY t) AS split FROM (SELECT id, k, unnest(range(k, CASE WHEN k = 4 THEN 8 ELSE k + 2 END)) AS t FROM (SELECT unnest([1, 2, 3]) AS id), (SELECT unnest([2, 4, 6]) AS k)) GROUP BY id, k UNION ALL SELECT CAST(id AS VARCHAR), '4,5' FROM (SELECT unnest([1, 2, 3]) AS id) UNION ALL SELECT CAST(id AS VARCHAR), '2,3,4,5,6,7' FROM (SELECT unnest([1, 2, 3]) AS id)")
def ml_interchange_search(spark, d):
    """Maximum likelihood by interchanges finds the generating balanced trees."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        from sparkclade.functions import kernels as K
        from sparkclade.functions import models

        x = pdf.pivot(index="taxon", columns="site", values="state").to_numpy().astype(int)
        patterns, weight = np.unique(x.T, axis=0, return_counts=True)
        start = [(u, v, max(w, 1e-4)) for u, v, w in K.neighbor_joining(-np.log(R.similarity_of(x, "jc")))]
        edges, _ = K.likelihood_search(patterns, weight.astype(float), models.JukesCantor(4), start)
        return R.rows_of(str(pdf["trial"].iloc[0]), edges, len(x))[["tree_id", "split"]]

    return M.sequences(_trials(spark, "balanced").where("trial > 0").withColumn("n", F.lit(1500))).groupBy("trial").applyInPandas(run, "tree_id string, split string")


@query("SELECT split FROM (VALUES ('2,3'), ('4,5'), ('6,7'), ('4,5,6,7'), ('2,3,4,5,6,7')) v(split)")
def treesvd(spark, d):
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        from sparkclade.functions import kernels as K

        patterns = [(tuple(int(v) for v in p.split(",")), int(n)) for p, n in zip(pdf["pattern"], pdf["cnt"], strict=True)]
        edges = K.flattening_joining(patterns, len(patterns[0][0]), 4)
        found = sorted(",".join(map(str, sorted(s))) for s in K.splits(edges, len(patterns[0][0])))
        return pd.DataFrame({"split": found})

    one = M.sequences(_trials(spark, "balanced").where("trial = 1").withColumn("n", F.lit(1000))).withColumn("state", F.col("state").cast("int"))
    return C.site_patterns(one).groupBy(F.lit(1).alias("one")).applyInPandas(run, "split string")
