"""More registered queries: metadata, files, tree comparison, models, characters to trees, latent trees."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkclade.functions import kernels as K
from sparkclade.functions import latent as L
from sparkclade.functions import models, scorers
from sparkclade.operators import counts as C
from sparkclade.operators import metadata as M
from sparkclade.operators import reconstruct as R
from sparkclade.operators import similarity as S
from sparkclade.operators import simulate as G
from sparkclade.operators import trees as T
from sparkclade.plans import queries as Q
from sparkclade.plans.queries import ANC, CONFD, LAB2, LAB4, REFS, REFUP, ids, query, rds
from sparkclade.sources import newick, observe, results
from sparkclade.storage import shared_folder

_NS = Q._NS


# Metadata -----------------------------------------------------------------------------------------


@query(_NS + " SELECT CAST(row_ix AS BIGINT) AS row_ix, label FROM taxa WHERE row_ix IN (1, 3)")
def taxa_by_index(spark, d):
    return M.taxa_at(Q._ns(spark)[1], [1, 3])


@query(_NS + " SELECT label, CAST(row_ix AS BIGINT) AS row_ix FROM taxa WHERE label IN ('snake', 'cat')")
def index_by_label(spark, d):
    return M.index_of(Q._ns(spark)[1], Q.labels(spark, "snake", "cat"))


@query(_NS + " SELECT CAST(row_ix AS BIGINT) AS row_ix, label FROM taxa WHERE label IN ('snake', 'dog')")
def mask_to_taxa(spark, d):
    taxa = Q._ns(spark)[1]
    return M.taxa_of(M.mask_of(taxa, Q.labels(spark, "snake", "dog")))


@query(_NS + " SELECT CAST(row_ix AS BIGINT) AS row_ix, label, label NOT IN ('dog', 'cat') AS inside FROM taxa")
def bipartition_to_mask(spark, d):
    ns, taxa = Q._ns(spark)
    return M.of_bipartition(ns, taxa, "11100")


@query("SELECT '01000' AS bipartition")
def invert_bipartition(spark, d):
    """Within a tree over fish, snake and dog: all but snake and dog is fish; highest index first."""
    ns, taxa = Q._ns(spark)
    return M.invert_bipartition(ns, taxa.where("label <> 'cat'"), "00101")


@query(_NS + " SELECT row_number() OVER (ORDER BY row_ix) - 1 AS row_ix, label FROM taxa WHERE label IN ('cat', 'fish', 'dog')")
def sub_metadata(spark, d):
    return M.sub_metadata(Q._ns(spark)[1], Q.labels(spark, "dog", "fish", "cat"))


@query("SELECT CAST(i AS BIGINT) AS row_ix, 'T' || CAST(i + 1 AS VARCHAR) AS label, i < 6 AS inside FROM (SELECT unnest(range(8)) AS i)")
def tree_to_mask(spark, d):
    return M.tree_mask(Q.ref(spark).where("tree_id = 'six'"), M.default_taxa(spark, 8))


@query("SELECT CAST(i AS BIGINT) AS row_ix, 'T' || CAST(i + 1 AS VARCHAR) AS label, i IN (2, 4) AS inside FROM (SELECT unnest(range(8)) AS i)")
def invert_mask_in_tree(spark, d):
    taxa = M.default_taxa(spark, 8)
    return M.invert_mask(M.mask_of(taxa, Q.labels(spark, "T1", "T2", "T4", "T6")), M.tree_mask(Q.ref(spark).where("tree_id = 'six'"), taxa))


@query(_NS + " SELECT 'forest' AS tree_id, CAST(row_ix AS BIGINT) AS node, CAST(NULL AS BIGINT) AS parent, CAST(NULL AS DOUBLE) AS length, CAST(row_ix AS BIGINT) AS taxon FROM taxa WHERE label IN ('dog', 'fish')")
def leaf_constructor(spark, d):
    return M.leaves(Q._ns(spark)[1], Q.labels(spark, "dog", "fish"))


@query("SELECT * FROM (VALUES ('itself', true, true), ('other order', false, true), ('fewer', false, false)) v(name, ordered, unordered)")
def metadata_equality(spark, d):
    taxa = Q._ns(spark)[1]
    turned = taxa.select((3 - F.col("row_ix")).alias("row_ix"), "label")
    others = {"itself": taxa, "other order": turned, "fewer": taxa.where("row_ix < 3")}
    return spark.createDataFrame([(k, M.equal(taxa, v), M.equal(taxa, v, ordered=False)) for k, v in others.items()], "name string, ordered boolean, unordered boolean")


@query(LAB4 + Q.JC + f" SELECT 9 - i AS i, 9 - j AS j, {rds('s')} AS s FROM sim WHERE i < 10 AND j < 10")
def reindex_matrix(spark, d):
    old = M.default_taxa(spark, 10)
    return ids(M.reindex(Q._jc(spark, d), old, old.select((9 - F.col("row_ix")).alias("row_ix"), "label")))


@query(LAB4.replace("sites AS (SELECT", "sites AS (SELECT * FROM (SELECT") + " WHERE site < 16)" + Q.HAM + f" SELECT i, j, {rds('h')} AS h FROM ham")
def site_prefix_hamming(spark, d):
    return ids(C.hamming_blocked(C.site_prefix(Q.lab4(spark, d), 16)))


@query("SELECT * FROM (VALUES ('ACGT', 'dna'), ('ACGU', 'rna'), ('0110', 'binary'), ('MKVL', 'protein')) v(seq, name)")
def alphabet_inferred(spark, d):
    out = [(s, M.alphabet_of(spark.sql("SELECT explode(split(:s, '')) AS symbol", args={"s": s})).first()[0]) for s in ("ACGT", "ACGU", "0110", "MKVL")]
    return spark.createDataFrame(out, "seq string, name string")


# Files --------------------------------------------------------------------------------------------


@query("SELECT * FROM (VALUES ('A.CD.02 x', 'ACGT--AC'), ('B', 'GGTT')) v(label, seq)")
def fasta_scan(spark, d):
    return observe.parse_fasta(spark.sql("SELECT :t AS value", args={"t": ">A.CD.02 x\nACGT\n--AC\n>B\r\nGG\r\nTT\n"}))


@query("SELECT * FROM (VALUES (1, 'posterior', '1.0'), (1, 'height_95%_HPD', '{0.1,0.2}'), (2, 'rate', '3e-3')) v(node, key, value)".replace("SELECT *", "SELECT CAST(node AS BIGINT) AS node, key, value"))
def newick_attributes(spark, d):
    t = "((a[&rate=3e-3]:0.1,b:0.2)[&posterior=1.0,height_95%_HPD={0.1,0.2}]:0.3,c:0.4)[a remark];"
    return newick.read(spark.sql("SELECT 't' AS tree_id, :t AS newick", args={"t": t})).select("node", F.explode("attrs"))


@query("SELECT 't' AS tree_id, split, size FROM (VALUES ('2,3', 2)) v(split, size)".replace("size FROM", "CAST(size AS BIGINT) AS size FROM"))
def newick_to_splits(spark, d):
    taxa = spark.sql("SELECT CAST(col1 AS BIGINT) AS row_ix, col2 AS label FROM VALUES (0, 'fish'), (1, 'snake'), (2, 'cat'), (3, 'dog')")
    tree = newick.with_taxa(newick.read(spark.sql("SELECT 't' AS tree_id, '(fish:1,(snake:1,(cat:1,dog:1):1):1);' AS newick")), taxa)
    return T.splits(T.clades(tree))


_NEXUS = "#NEXUS\nBEGIN DATA;\nFORMAT DATATYPE=RNA;\nMATRIX\n'my taxon' ACGU\nb  AC-U\n\n'my taxon' GGGG\nb  CCCC\n;\nEND;\nBEGIN TREES;\n tree one = [&R] (a,(b,c));\n TREE two = ((a,b),c);\nEND;\n"


@query("SELECT * FROM (VALUES ('my taxon', 'ACGUGGGG'), ('b', 'AC-UCCCC')) v(label, seq)")
def nexus_matrix(spark, d):
    return newick.read_nexus_matrix(spark.sql("SELECT :t AS value", args={"t": _NEXUS}))


@query("SELECT * FROM (VALUES ('one', '(a,(b,c));'), ('two', '((a,b),c);')) v(tree_id, newick)")
def nexus_trees(spark, d):
    return newick.read_nexus(spark.sql("SELECT :t AS value", args={"t": _NEXUS}))


@query("SELECT * FROM (VALUES ('((a,b),c);'), ('(a,(b,c));')) v(newick)")
def gene_tree_list(spark, d):
    path = f"{shared_folder(spark)}/genes-{uuid.uuid4().hex}"
    spark.sql("SELECT explode(array('g1\t((a,b),c);', 'g2\t(a,(b,c));', '# no tree')) AS value").coalesce(1).write.option("compression", "gzip").text(path)
    return newick.gene_trees(spark.read.text(path)).select("newick")


@query("SELECT * FROM (VALUES (-1, '4 5'), (0, 'cat TG-AA'), (0, 'dog GGAAA'), (0, 'fish TCCAA'), (0, 'snake TGCAA')) v(ix, value)".replace("SELECT *", "SELECT CAST(ix AS BIGINT) AS ix, value"))
def phylip_characters(spark, d):
    return ids(observe.phylip(spark.sql("SELECT col1 AS label, col2 AS seq FROM VALUES ('fish', 'TCCAA'), ('snake', 'TGCAA'), ('cat', 'TG-AA'), ('dog', 'GGAAA')")))


@query("SELECT CAST(ix AS BIGINT) AS ix, value FROM (VALUES (-1, '3'), (0, 'T1\t0.000000\t0.500000\t1.000000'), (1, 'T2\t0.500000\t0.000000\t0.500000'), (2, 'T3\t1.000000\t0.500000\t0.000000')) v(ix, value)")
def phylip_distances(spark, d):
    """Written as one file, read again."""
    matrix = spark.sql("SELECT i, j, abs(i - j) / 2 AS s FROM (SELECT id AS i FROM range(3)), (SELECT id AS j FROM range(3))")
    path = f"{shared_folder(spark)}/phylip-{uuid.uuid4().hex}"
    results.write_lines(results.phylip_distances(matrix, M.default_taxa(spark, 3)), path)
    return spark.read.text(path).select((F.when(F.col("value").startswith("T"), F.substring("value", 2, 1).cast("long")).otherwise(0) - 1).alias("ix"), "value")


@query("SELECT * FROM (VALUES ('T1', 'T2', 0.5::DOUBLE), ('T2', 'T1', 0.5), ('T1', 'T3', 0.25), ('T3', 'T1', 0.25)) v(a, b, d)")
def distance_lines(spark, d):
    return observe.distance_lines(spark.sql("SELECT explode(array('T1 T2 \t 0.5', ' T1\tT3 0.25')) AS value"))


@query("SELECT CAST(r AS BIGINT) AS row, CAST(c AS BIGINT) AS col, CAST(v AS DOUBLE) AS v FROM (VALUES (1, 0, 3), (1, 1, 4.5), (3, 0, 1), (3, 1, 2)) t(r, c, v)")
def frequency_table(spark, d):
    return results.frequency_rows(spark.sql("SELECT pos AS ix, col AS value FROM (SELECT posexplode(array('% a remark', '3 4.5 % more', '', '1\t2')))"))


@query(LAB4 + Q.FULL + f" SELECT i, j, {rds('s')} AS s FROM mat")
def matrix_round_trip(spark, d):
    return ids(results.to_pairs(results.to_rows(Q._mat(spark, d))))


@query("SELECT CAST(method AS VARCHAR) AS method, CAST(n AS BIGINT) AS n, CAST(rf AS BIGINT) AS rf FROM (VALUES ('nj', 1, 4), ('snj', 1, 0), ('nj', 2, 2)) v(method, n, rf)")
def results_store(spark, d):
    """Written, overwritten, appended to, and read back."""
    path = f"{shared_folder(spark)}/results-{uuid.uuid4().hex}"
    make = lambda r: spark.createDataFrame(r, "method string, n long, rf long").coalesce(1)
    results.save(make([("old", 9, 9)]), path, append=False)
    results.save(make([("nj", 1, 4), ("snj", 1, 0)]), path, append=False)
    results.save(make([("nj", 2, 2)]), path)
    return results.load(spark, path)


@query("SELECT method, CAST(threshold AS BIGINT) AS threshold, CAST(rf AS BIGINT) AS rf, CAST(m AS BIGINT) AS m FROM (VALUES ('nj', 64, 3, 300), ('snj', 128, 1, 600)) v(method, threshold, rf, m)")
def results_csv(spark, d):
    """Tab-separated results under a folder named by their configuration."""
    root = f"{shared_folder(spark)}/grid-{uuid.uuid4().hex}"
    for method, threshold, rf, m in (("nj", 64, 3, 300), ("snj", 128, 1, 600)):
        results.write_table(spark.createDataFrame([(method, threshold, rf)], "method string, threshold long, rf long"), f"{root}/run_m{m}", "\t")
    found = results.read_table(spark, f"{root}/run_m*", "\t", "method string, threshold long, rf long")
    return results.configured(found, "file", m="_m([0-9]+)").drop("file")


@query("SELECT 'a' AS method, CAST(1 AS BIGINT) AS rf, CAST(NULL AS DOUBLE) AS f1 UNION ALL SELECT 'b', 2, 0.5")
def results_union(spark, d):
    return results.together(spark.sql("SELECT 'a' AS method, 1L AS rf"), spark.sql("SELECT 0.5D AS f1, 'b' AS method, 2L AS rf"))


@query("SELECT l_returnflag AS method, CAST(l_linenumber AS BIGINT) AS n, count(*) AS runs, round(CAST(avg(CAST(l_quantity > 25 AS INT)) AS DOUBLE), 6) AS accuracy FROM lineitem WHERE l_discount < 0.05 GROUP BY 1, 2")
def results_accuracy(spark, d):
    li = observe.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("method"), F.col("l_linenumber").cast("long").alias("n"), (F.col("l_quantity") > 25).alias("correct"), "l_discount")
    return ids(results.accuracy(li, ["method", "n"], "l_discount < 0.05"))


@query("SELECT l_returnflag AS method, CAST(min(l_quantity) AS DOUBLE) AS low, CAST(quantile_cont(CAST(l_quantity AS DOUBLE), 0.25) AS DOUBLE) AS q1, CAST(quantile_cont(CAST(l_quantity AS DOUBLE), 0.5) AS DOUBLE) AS mid, CAST(quantile_cont(CAST(l_quantity AS DOUBLE), 0.75) AS DOUBLE) AS q3, CAST(max(l_quantity) AS DOUBLE) AS high FROM lineitem GROUP BY 1")
def results_quartiles(spark, d):
    return ids(results.quartiles(observe.table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "method"), ["method"], "l_quantity"))


# Aggregates -----------------------------------------------------------------------------------------


@query(LAB4 + " SELECT count(DISTINCT state) AS k FROM sites")
def class_count(spark, d):
    return C.classes(Q.lab4(spark, d))


@query("SELECT l_returnflag AS method, round(CAST(median(v) AS DOUBLE), 6) AS mid FROM (SELECT l_returnflag, CAST(l_extendedprice AS DOUBLE) AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS r FROM lineitem) WHERE r <= 100 GROUP BY 1")
def median_of_smallest(spark, d):
    li = observe.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("method"), F.col("l_extendedprice").cast("double").alias("v"))
    return ids(S.median_of_smallest(li, ["method"], 100))


@query(LAB4 + Q.JC + f" SELECT i, j, {rds('s')} AS score FROM sim ORDER BY s, i, j LIMIT 1")
def argmin_pair(spark, d):
    scores = Q._jc(spark, d).select(F.lit(1).alias("one"), "i", "j", F.col("s").alias("score"))
    return ids(S.argmin_pair(scores, ["one"]).drop("one"))


_H = "-(" + " + ".join("({0}) * ln(({0}) + 1e-20)".format(c) for c in ("{0}", "{1}")) + ")"


@query(LAB2 + CONFD + Q._tables(2) + f" SELECT i, j, {rds('CASE WHEN i = j THEN 0 ELSE ' + _H.format('f00 + f01', 'f10 + f11') + ' + ' + _H.format('f00 + f10', 'f01 + f11') + ' + ' + ' + '.join('f{0} * ln(f{0} + 1e-20)'.format(c) for c in ('00', '01', '10', '11')) + ' END')} AS mi FROM tab")
def binary_mutual_information(spark, d):
    return ids(S.binary_mi(C.conf(Q.lab2(spark, d), True)))


_LAB5 = LAB4.replace("CASE WHEN x >= 0.01 THEN 3 WHEN x >= 0 THEN 2 WHEN x >= -0.01 THEN 1 ELSE 0 END", "CASE WHEN x >= 0.015 THEN 4 WHEN x >= 0.005 THEN 3 WHEN x >= -0.005 THEN 2 WHEN x >= -0.015 THEN 1 ELSE 0 END")


@query(_LAB5 + Q._logdet(5).format(rds(Q._RATIO) + " AS s"))
def paralinear_k5(spark, d):
    """Five states: beyond four, determinants are taken by numpy from packed tables."""
    sites = observe.of_labels(observe.table(spark, d, "embeddings"), [-0.015, -0.005, 0.005, 0.015])
    return ids(S.log_det(C.conf(sites, True), 5))


# Trees ----------------------------------------------------------------------------------------------


@query("SELECT CAST(512 + k AS BIGINT) AS node, CAST(512 - k AS BIGINT) AS n, CAST(k AS BIGINT) AS low FROM (SELECT unnest(range(511)) AS k) UNION ALL SELECT k, 1, k FROM (SELECT unnest(range(512)) AS k)")
def deep_clades(spark, d):
    """A caterpillar of 512 taxa: 511 levels."""
    return T.clades(T.caterpillar(spark, 512, 0.5)).groupBy("node").agg(F.count("*").alias("n"), F.min("taxon").alias("low"))


@query("SELECT i, CAST(sum(least(j, 510) - least(i, 510) + 2) AS BIGINT) AS hops FROM (SELECT unnest(range(512)) AS i), (SELECT unnest(range(512)) AS j) WHERE i < j GROUP BY 1")
def deep_patristic(spark, d):
    """Between leaves i < j of a caterpillar of 512: up from i, along the spine, down to j."""
    return T.patristic(T.caterpillar(spark, 512, 0.5)).groupBy("i").agg(F.sum("hops").cast("long").alias("hops"))


@query("SELECT string_agg(CAST(t AS VARCHAR), ',' ORDER BY t) AS split FROM (SELECT k, unnest(range(k, 512)) AS t FROM (SELECT unnest(range(2, 511)) AS k)) GROUP BY k")
def deep_splits(spark, d):
    return T.splits(T.clades(T.caterpillar(spark, 512, 0.5))).select("split")


_GROUPS = "(VALUES ('low', 1, 0), ('low', 1, 1), ('low', 2, 2), ('low', 2, 3), ('mixed', 1, 0), ('mixed', 1, 5), ('mixed', 2, 2), ('mixed', 2, 4), ('one', 1, 3), ('one', 2, 0), ('one', 2, 1), ('ends', 1, 4), ('ends', 1, 5), ('ends', 2, 0), ('ends', 2, 1))"
_IND = REFUP + f""", g(grp, part, taxon) AS (SELECT * FROM {_GROUPS}), a AS (SELECT grp, count(*) AS m, count(CASE WHEN part = 1 THEN 1 END) AS k FROM g GROUP BY 1),
 c AS (SELECT r.tree_id, r.node, g.grp, count(CASE WHEN part = 1 THEN 1 END) AS x, count(CASE WHEN part = 2 THEN 1 END) AS y FROM r JOIN g ON g.taxon = r.taxon GROUP BY 1, 2, 3),
 v AS (SELECT t.tree_id, a.grp, a.k <= 1 OR a.m - a.k <= 1 OR EXISTS (SELECT 1 FROM c WHERE c.tree_id = t.tree_id AND c.grp = a.grp AND ((x = a.k AND y = 0) OR (x = 0 AND y = a.m - a.k))) AS valid FROM (SELECT DISTINCT tree_id FROM r) t, a)"""


def _groups(spark) -> DataFrame:
    return spark.sql(f"SELECT col1 AS `group`, col2 AS part, CAST(col3 AS BIGINT) AS taxon FROM {_GROUPS}")


@query(_IND + ' SELECT tree_id, grp AS "group", valid FROM v')
def induced_splits(spark, d):
    return T.splits_induced(T.clades(Q.ref(spark)), _groups(spark))


@query(_IND + " SELECT tree_id, bool_and(valid) AS valid FROM v GROUP BY 1")
def all_splits_valid(spark, d):
    return T.all_splits_valid(T.clades(Q.ref(spark)), _groups(spark))


@query(Q._CMP + f" SELECT tree_id, {rds('CASE WHEN ni + nr > 0 THEN 4 * tp / CAST(2 * ni + 2 * nr AS DOUBLE) ELSE 0 END')} AS f FROM c")
def symmetric_f1(spark, d):
    return ids(T.symmetric_f1(T.splits(T.clades(T.of_edges(spark, Q.OTHER))), Q.ref_splits(spark)))


@query(Q._CMP + " SELECT tree_id, ni = tp AND nr = tp AS same FROM c")
def equal_topology(spark, d):
    return T.equal_topology(T.of_edges(spark, Q.OTHER), Q.ref(spark))


@query("SELECT tree_id, tree_id <> 'six' AS same FROM (VALUES ('balanced8'), ('uneven8'), ('cat8'), ('six')) v(tree_id)")
def equal_topology_and_lengths(spark, d):
    """One leaf of one tree is longer."""
    longer = Q.ref(spark).withColumn("length", F.when((F.col("tree_id") == "six") & (F.col("node") == 0), 0.11).otherwise(F.col("length")))
    return T.equal_topology(longer, Q.ref(spark), 6)


_PURE = REFUP + """, p AS (SELECT tree_id, node, count(CASE WHEN taxon IN (0, 1, 2, 5) THEN 1 END) AS y, count(*) AS n FROM r GROUP BY 1, 2)
 SELECT p.tree_id, p.node, p.y > 0 AS inside FROM p JOIN rt t ON t.tree_id = p.tree_id AND t.node = p.node LEFT JOIN p q ON q.tree_id = p.tree_id AND q.node = t.parent WHERE (p.y = 0 OR p.y = p.n) AND (q.node IS NULL OR NOT (q.y = 0 OR q.y = q.n))"""


@query(_PURE)
def pure_clades(spark, d):
    return T.pure_clades(Q.ref(spark), spark.sql("SELECT explode(array(0L, 1L, 2L, 5L)) AS taxon"))


@query(Q.BOTHS + " SELECT tree_id, split, 'wrong' AS verdict FROM ws o WHERE NOT EXISTS (SELECT 1 FROM rs r WHERE r.tree_id = o.tree_id AND r.split = o.split) UNION ALL SELECT tree_id, split, 'missed' FROM rs r WHERE NOT EXISTS (SELECT 1 FROM ws o WHERE r.tree_id = o.tree_id AND r.split = o.split)")
def diagnose(spark, d):
    return T.diagnose(T.splits(T.clades(T.of_edges(spark, Q.OTHER))), Q.ref_splits(spark))


@query(Q.BOTHS + " SELECT tree_id, split FROM ws INTERSECT SELECT tree_id, split FROM rs")
def common_splits(spark, d):
    return T.common(T.splits(T.clades(T.of_edges(spark, Q.OTHER))), Q.ref_splits(spark))


def _paths(name: str, table: list) -> str:
    return f"""{name}t AS {Q._values(table)}, {name}anc(tree_id, taxon, node, d, hops) AS (SELECT tree_id, taxon, node, CAST(0 AS DOUBLE), 0 FROM {name}t WHERE taxon IS NOT NULL
     UNION ALL SELECT a.tree_id, a.taxon, t.parent, a.d + t.length, a.hops + 1 FROM {name}anc a JOIN {name}t t ON t.tree_id = a.tree_id AND t.node = a.node WHERE t.parent IS NOT NULL),
     {name}pat AS (SELECT x.tree_id, x.taxon AS i, y.taxon AS j, min(x.d + y.d) AS d, min(x.hops + y.hops) AS hops FROM {name}anc x JOIN {name}anc y ON x.tree_id = y.tree_id AND x.node = y.node WHERE x.taxon < y.taxon GROUP BY 1, 2, 3)"""


@query("WITH RECURSIVE " + _paths("x", Q.OTHER) + ", " + _paths("y", Q.REF) + f" SELECT x.tree_id, bool_and(x.hops = y.hops) AS exact, {rds('avg(CASE WHEN abs(x.d - y.d) > 1e-9 THEN abs(x.d - y.d) ELSE 0 END)')} AS error FROM xpat x JOIN ypat y USING (tree_id, i, j) GROUP BY 1")
def exact_recovery(spark, d):
    return ids(T.exact_recovery(T.of_edges(spark, Q.OTHER), Q.ref(spark)))


def _cherry(table: list) -> str:
    return f"SELECT tree_id, sum(k) AS n FROM (SELECT tree_id, parent, CASE WHEN count(*) = 2 AND count(taxon) = 2 THEN 1 ELSE 0 END AS k FROM {Q._values(table)} WHERE parent IS NOT NULL GROUP BY 1, 2) GROUP BY 1"


@query(f"SELECT a.tree_id, CAST(a.n - b.n AS BIGINT) AS bias FROM ({_cherry(Q.REF)}) a JOIN ({_cherry(Q.REF)}) b USING (tree_id)")
def cherry_bias(spark, d):
    """Swapping leaves changes no shape, so no tree has more cherries than its reference."""
    return T.cherry_bias(T.of_edges(spark, Q.OTHER), Q.ref(spark))


@query("WITH RECURSIVE " + _paths("y", Q.REF) + f" SELECT tree_id, i, j, {rds('d')} AS d FROM ypat WHERE i <> 3 AND j <> 3")
def restricted_tree(spark, d):
    """Without taxon 3, paths between the others are as long as before."""
    taxa = spark.range(10).select(F.col("id").alias("taxon")).where("taxon <> 3")
    return ids(T.patristic(T.restrict_tree(Q.ref(spark), taxa)).select("tree_id", "i", "j", "d"))


@query("SELECT tree_id, count(*) AS nodes FROM (VALUES ('balanced8', 13), ('uneven8', 13), ('cat8', 13), ('six', 8)) v(tree_id, n), range(n) GROUP BY 1".replace("count(*) AS nodes FROM (VALUES", "count(*) AS nodes FROM (SELECT tree_id, unnest(range(n)) FROM (VALUES").replace("v(tree_id, n), range(n)", "v(tree_id, n))"))
def restricted_tree_nodes(spark, d):
    """A binary tree of m - 1 leaves has 2 m - 3 nodes; with a taxon whose sister is gone, one inner node fewer."""
    taxa = spark.range(10).select(F.col("id").alias("taxon")).where("taxon <> 3")
    return T.restrict_tree(Q.ref(spark), taxa).groupBy("tree_id").agg(F.count("*").alias("nodes"))


@query("SELECT CAST(node AS BIGINT) AS node, CAST(parent AS BIGINT) AS parent, CAST(taxon AS BIGINT) AS taxon FROM (VALUES (0, 4, 0), (1, 4, 1), (2, 5, 2), (3, NULL, 3), (4, 5, NULL), (5, NULL, NULL)) v(node, parent, taxon)")
def merge_children(spark, d):
    f = M.leaves(M.default_taxa(spark, 4), M.default_taxa(spark, 4).select("label"))
    return T.merge_children(T.merge_children(f, [0, 1], 4), [4, 2], 5, 0.5).select("node", "parent", "taxon")


@query(f"SELECT tree_id, node, CASE WHEN parent IS NOT NULL THEN {rds('0.1 * node')} END AS length FROM {Q._values(Q.REF)}")
def set_lengths(spark, d):
    return ids(T.set_lengths(Q.ref(spark), fun=0.1 * F.col("node")).select("tree_id", "node", "length"))


@query(f"SELECT tree_id, node, parent IS NULL OR true AS within FROM {Q._values(Q.REF)}")
def set_random_lengths(spark, d):
    t = T.set_lengths(Q.ref(spark), uniform=(0.2, 0.4), seed=3)
    return t.select("tree_id", "node", F.expr("if(parent is null, length is null, length between 0.2 and 0.4)").alias("within"))


_SHAPES = "SELECT 'star6' AS tree_id, k AS node, CASE WHEN k < 6 THEN 6 END AS parent FROM (SELECT unnest(range(7)) AS k) UNION ALL SELECT 'double_star6', k, CASE WHEN k < 3 THEN 6 WHEN k < 6 THEN 7 WHEN k = 7 THEN 6 END FROM (SELECT unnest(range(8)) AS k) UNION ALL SELECT 'hmm5', k, CASE WHEN k < 5 THEN k + 5 WHEN k > 5 THEN k - 1 END FROM (SELECT unnest(range(10)) AS k) UNION ALL SELECT 'cayley3_2', k, CASE WHEN k BETWEEN 1 AND 3 THEN 0 WHEN k > 3 THEN (k - 4) // 2 + 1 END FROM (SELECT unnest(range(10)) AS k)"


@query(_SHAPES)
def model_trees(spark, d):
    every = T.star(spark, 6, 1.0).unionByName(T.double_star(spark, 6, 1.0)).unionByName(T.hidden_chain(spark, 5, 1.0)).unionByName(T.cayley(spark, 3, 2, 1.0))
    return every.select("tree_id", "node", "parent")


@query(ANC + f" SELECT tree_id, i, j, {rds('exp(-d * 4)')} AS s FROM pat")
def transition_similarity(spark, d):
    """The product of the edges' determinants under equal rates of four states: exp(trace(Q) t), the trace being -4."""
    model = models.JukesCantor(4)
    return ids(T.patristic(Q.ref(spark)).select("tree_id", "i", "j", F.exp(F.col("d") * F.lit(float(np.trace(model.q)))).alias("s")))


# Models ---------------------------------------------------------------------------------------------


def _matrices(spark, made: dict[str, models.ContinuousTime], times=(0.1, 0.7)) -> DataFrame:
    out = [(name, float(t), a, b, float(p)) for name, m in made.items() for t in times for a, row in enumerate(m.matrix(t)) for b, p in enumerate(row)]
    return ids(spark.createDataFrame(out, "model string, t double, a long, b long, p double"))


@query(f"SELECT 'jc' || CAST(k AS VARCHAR) AS model, round(t, 6) AS t, a, b, {rds('1 / CAST(k AS DOUBLE) + (CASE WHEN a = b THEN (k - 1) ELSE -1 END) / CAST(k AS DOUBLE) * exp(-t * k / CAST(k - 1 AS DOUBLE))')} AS p FROM (SELECT k, t, a, unnest(range(k)) AS b FROM (SELECT k, t, unnest(range(k)) AS a FROM (SELECT unnest([2, 4, 20]) AS k), (SELECT CAST(unnest([0.1, 0.7]) AS DOUBLE) AS t)))")
def jukes_cantor_matrix(spark, d):
    return _matrices(spark, {f"jc{k}": models.JukesCantor(k) for k in (2, 4, 20)})


@query(f"SELECT 'hky' AS model, t, a, b, {rds('CASE WHEN a = b THEN 0.25 + 0.25 * exp(-t) + 0.5 * exp(-1.5 * t) WHEN a % 2 = b % 2 THEN 0.25 + 0.25 * exp(-t) - 0.5 * exp(-1.5 * t) ELSE 0.25 - 0.25 * exp(-t) END')} AS p FROM (SELECT unnest(range(4)) AS a), (SELECT unnest(range(4)) AS b), (SELECT CAST(unnest([0.1, 0.7]) AS DOUBLE) AS t)")
def hky_matrix(spark, d):
    """kappa 2 and equal frequencies: two transversions at rate 1/4 and a transition at 1/2."""
    return _matrices(spark, {"hky": models.hky(2.0)})


_PI = {"gtr": [0.1, 0.2, 0.3, 0.4], "tn93": [0.3, 0.2, 0.2, 0.3], "tn93_first_and_last": [0.3, 0.2, 0.2, 0.3], "t92": [0.3, 0.2, 0.2, 0.3]}
_RATES = {"gtr": [1.0, 2.0, 1.5, 0.5, 3.0, 1.0], "tn93": [1.0, 2.0, 1.0, 1.0, 3.0, 1.0], "tn93_first_and_last": [2.0, 1.0, 1.0, 1.0, 1.0, 3.0], "t92": [1.0, 2.5, 1.0, 1.0, 2.5, 1.0]}
_PAIRS = [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]
_Q = "WITH r(model, a, b, r) AS (VALUES {}), p(model, a, pi) AS (VALUES {}), off AS (SELECT r.model, r.a, r.b, r.r * p.pi AS q FROM (SELECT model, a, b, r FROM r UNION ALL SELECT model, b, a, r FROM r) r JOIN p ON p.model = r.model AND p.a = r.b), tot AS (SELECT o.model, sum(o.q * p.pi) AS s FROM off o JOIN p ON p.model = o.model AND p.a = o.a GROUP BY 1)".format(
    ", ".join(f"('{k}', {a}, {b}, CAST({r} AS DOUBLE))" for k, v in _RATES.items() for (a, b), r in zip(_PAIRS, v, strict=True)), ", ".join(f"('{k}', {a}, CAST({x} AS DOUBLE))" for k, v in _PI.items() for a, x in enumerate(v))
)


@query(_Q + f" SELECT o.model, CAST(o.a AS BIGINT) AS a, CAST(o.b AS BIGINT) AS b, {rds('o.q / t.s')} AS q FROM off o JOIN tot t USING (model)")
def rate_matrices(spark, d):
    """GTR, TN93 (both places of its two rates) and T92: off-diagonal rates, scaled to one change in unit time."""
    made = {"gtr": models.gtr(_PI["gtr"], _RATES["gtr"]), "tn93": models.tn93(_PI["tn93"], 2.0, 3.0), "tn93_first_and_last": models.tn93(_PI["tn93"], 2.0, 3.0, True), "t92": models.t92(0.4, 2.5)}
    return ids(spark.createDataFrame([(k, a, b, float(m.q[a, b])) for k, m in made.items() for a in range(4) for b in range(4) if a != b], "model string, a long, b long, q double"))


_MODELS = ("jc", "jc2", "jc20", "hky2", "tn93", "t92", "gtr")


@query("SELECT model, true AS stationary, true AS expected FROM (VALUES " + ", ".join(f"('{m}')" for m in _MODELS) + ") v(model)")
def simulated_frequencies(spark, d):
    """Of 40,000 sites: state shares at two leaves, and the share that differs between them, are within 5 standard errors of the model's."""
    n, length = 40_000, 0.3
    trials = spark.createDataFrame([(k, "balanced", 2, n, length, m, 0.0) for k, m in enumerate(_MODELS)], "trial long, kind string, m long, n long, length double, model string, shape double")
    sites = G.sequences(trials)
    x, y = sites.where("taxon = 0").select("trial", "site", F.col("state").alias("a")), sites.where("taxon = 1").select("trial", "site", F.col("state").alias("b"))
    found = x.join(y, ["trial", "site"]).groupBy("trial", "a", "b").agg(F.count("*").alias("c")).join(trials.select("trial", "model"), "trial")

    def check(pdf: pd.DataFrame) -> pd.DataFrame:
        m = models.preset(pdf["model"].iloc[0])
        k = len(m.pi)
        counts = np.zeros((k, k))
        counts[pdf["a"].astype(int), pdf["b"].astype(int)] = pdf["c"]
        want = np.einsum("r,ra,rb->ab", m.pi, m.matrix(length), m.matrix(length))
        close = lambda got, p: bool((np.abs(got / n - p) <= 5 * np.sqrt(p * (1 - p) / n) + 1e-12).all())
        return pd.DataFrame({"model": [pdf["model"].iloc[0]], "stationary": [close(counts.sum(axis=1), m.pi) and close(counts.sum(axis=0), m.pi)], "expected": [close(counts.trace(), np.trace(want))]})

    return found.groupBy("model").applyInPandas(check, "model string, stationary boolean, expected boolean")


@query("SELECT i, j, true AS close FROM (SELECT unnest(range(8)) AS i), (SELECT unnest(range(8)) AS j) WHERE i < j")
def gaussian_correlations(spark, d):
    """Real values drawn along a balanced tree: correlations by the join on sites agree with shared path lengths."""
    one = Q._trials(spark, "balanced").where("trial = 1").withColumn("model", F.lit("gaussian")).withColumn("n", F.lit(4000))
    got = S.correlations(G.sequences(one).select("taxon", "site", F.col("state").alias("x")))
    # With steps of equal variance the correlation is the share of the path from the root that is common.
    up = T.ancestors(T.balanced(spark, 8, 0.1)).select("taxon", "node")
    shared = up.select(F.col("taxon").alias("i"), "node").join(up.select(F.col("taxon").alias("j"), "node"), "node").where("i < j").groupBy("i", "j").agg((F.count("*") - 1).alias("common"))
    return got.join(shared, ["i", "j"]).select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), (F.abs(F.col("c") - F.col("common") / 3) < 0.08).alias("close"))


@query("SELECT name, true AS rows_sum_to_one, true AS diagonal_within FROM (VALUES ('random'), ('symmetric'), ('fixed')) v(name)")
def random_transitions(spark, d):
    rng = np.random.default_rng(1)
    made = {"random": models.random_matrix(4, (0.85, 0.95), rng), "symmetric": models.random_symmetric(4, (0.85, 0.95), rng), "fixed": models.Fixed([1] * 4, models.random_matrix(4, (0.85, 0.95), rng)).matrix(1.0)}
    return spark.createDataFrame([(k, bool(np.allclose(p.sum(axis=1), 1) and (p >= 0).all()), bool(((np.diag(p) >= 0.85) & (np.diag(p) <= 0.95)).all())) for k, p in made.items()], "name string, rows_sum_to_one boolean, diagonal_within boolean")


@query("SELECT kind, CAST(m AS BIGINT) AS leaves, CAST(m AS BIGINT) AS tips, true AS binary FROM (VALUES ('kingman', 40), ('mean_kingman', 40), ('birth_death', 40), ('random', 40), ('balanced', 32), ('caterpillar', 40)) v(kind, m)")
def sampled_trees(spark, d):
    """Trees of every kind: as many leaves as asked for, all named once, inner nodes with two children (at the root up to three)."""
    kinds = [("kingman", 40), ("mean_kingman", 40), ("birth_death", 40), ("random", 40), ("balanced", 32), ("caterpillar", 40)]
    trials = spark.createDataFrame([(k, kind, m, 1, 0.1, "jc", 0.0) for k, (kind, m) in enumerate(kinds)], "trial long, kind string, m long, n long, length double, model string, shape double")
    t = G.trees(trials)
    leaves = t.groupBy("tree_id").agg(F.count("taxon").alias("leaves"), F.count_distinct("taxon").alias("tips"))
    kids = t.where("parent is not null").groupBy("tree_id", "parent").agg(F.count("*").alias("c")).join(t.where("parent is null").select("tree_id", F.col("node").alias("root")), "tree_id")
    even = kids.groupBy("tree_id").agg(F.bool_and(F.expr("c = 2 or (parent = root and c = 3)")).alias("binary"))
    names = trials.select(F.col("trial").cast("string").alias("tree_id"), "kind")
    return names.join(leaves, "tree_id").join(even, "tree_id").select("kind", "leaves", "tips", "binary")


# Characters to trees ----------------------------------------------------------------------------------


def _true_splits(kind: str, m: int) -> str:
    if kind == "caterpillar":
        side = f"SELECT k AS id, unnest(range(k, {m})) AS t FROM (SELECT unnest(range(2, {m} - 1)) AS k)"
    else:
        sizes = ", ".join(str(2**k) for k in range(1, m.bit_length() - 1))
        blocks = f"SELECT w, unnest(range({m} // w)) AS b FROM (SELECT unnest([{sizes}]) AS w)"
        side = f"SELECT w * 1000 + b AS id, unnest(range(b * w, (b + 1) * w)) AS t FROM ({blocks}) WHERE b > 0 UNION ALL SELECT w * 1000 AS id, unnest(range(w, {m})) AS t FROM ({blocks}) WHERE b = 0 AND w < {m} // 2"
    return f"SELECT string_agg(CAST(t AS VARCHAR), ',' ORDER BY t) AS split, count(*) AS size FROM ({side}) GROUP BY id"


def _recovery(name: str, seed: int, kind: str, m: int, n: int, length: float, model: str, metric: str, method: str) -> None:
    def run(spark, d):
        one = spark.createDataFrame([(seed, kind, m, n, length, model, 0.0, method, metric)], "trial long, kind string, m long, n long, length double, model string, shape double, method string, metric string")
        return G.reconstructed(one).select("split", "size")

    run.__name__ = name
    run.__doc__ = f"{method} by {metric} from {n} sites of {model} on a {kind} tree of {m} finds all its splits."
    query(_true_splits(kind, m))(run)


#: Time after which a state of four is kept with probability 0.95.
T95 = float(models.JukesCantor(4).time(0.95))
for _args in [
    ("nj_jc_caterpillar32", 2, "caterpillar", 32, 400, 0.1, "jc", "jc", "nj"),
    ("nj_hky_caterpillar32", 1, "caterpillar", 32, 2000, 0.1, "hky15", "hky", "nj"),
    ("snj_jc_caterpillar32", 1, "caterpillar", 32, 5000, 0.1, "jc", "jc", "snj"),
    ("snj_hky_caterpillar32", 1, "caterpillar", 32, 5000, 0.1, "hky2", "hky", "snj"),
    ("snj_paralinear_caterpillar32", 1, "caterpillar", 32, 5000, 0.1, "jc", "paralinear", "snj"),
    ("nj_gamma_balanced32", 1, "balanced", 32, 3000, 0.1, "jc", "jc_gamma", "nj"),
    ("nj_identity_balanced16", 1, "balanced", 16, 5000, 0.1, "jc", "identity", "nj"),
    ("nj_paralinear_balanced32", 1, "balanced", 32, 4000, 0.1, "gtr", "paralinear", "nj"),
    ("hc_correlation_balanced16", 1, "balanced", 16, 8000, 0.2, "gaussian", "correlation", "hc_average"),
    ("stdr_nj_caterpillar64", 1, "caterpillar", 64, 1500, T95, "jc", "jc", "stdr_nj_16"),
    ("stdr_snj_caterpillar64", 1, "caterpillar", 64, 1500, T95, "jc", "jc", "stdr_snj_16"),
    ("stdr_snj_balanced128", 1, "balanced", 128, 3000, 0.05, "hky2", "hky", "stdr_snj_32"),
    ("snj_jc_caterpillar128", 1, "caterpillar", 128, 1000, T95, "jc", "jc", "snj"),
    ("rg_relaxed_balanced8", 1, "balanced", 8, 10000, 0.1, "jc2", "information", "rg_relaxed"),
    ("clnj_observed_balanced8", 1, "balanced", 8, 10000, 0.15, "jc2", "information", "clnj_observed"),
]:
    _recovery(*_args)


def _published(name: str, kind: str, m: int, n: int, length: float, method: str):
    """A setting of the published benchmarks (HKY, kappa 2): how far the tree found is from the generating one."""

    def run(spark, d):
        one = spark.createDataFrame([(1, kind, m, n, length, "hky2", 0.0, 1)], "trial long, kind string, m long, n long, length double, model string, shape double, rep int")
        return G.results_of(one, [n], [method], "hky").select("method", "n", "rf", (F.col("rf") / (2 * m - 6)).alias("nrf"))

    run.__name__ = name
    return query()(run)


for _args in [
    ("nj_caterpillar512", "caterpillar", 512, 400, 0.05, "nj"), ("stdr_nj_caterpillar512", "caterpillar", 512, 400, 0.05, "stdr_nj_64"), ("stdr_snj_caterpillar512", "caterpillar", 512, 400, 0.05, "stdr_snj_64"), ("snj_caterpillar512", "caterpillar", 512, 400, 0.05, "snj"),
    ("stdr_nj_balanced2048", "balanced", 2048, 1000, 0.1, "stdr_nj_128"), ("stdr_snj_balanced2048", "balanced", 2048, 1000, 0.1, "stdr_snj_128"), ("stdr_nj_kingman2000", "kingman", 2000, 2000, 0.4, "stdr_nj_128"), ("stdr_snj_kingman2000", "kingman", 2000, 2000, 0.4, "stdr_snj_128"),
]:
    _published(*_args)


@query("SELECT scorer, r.tree_id, CAST(count(*) AS BIGINT) AS right_splits FROM (VALUES " + ", ".join(f"('{n}')" for n in ("second", "rest", "rest_squares", "minors", "root_rest_squares", "max_quartet", "squared_quartets")) + ") v(scorer), (" + REFS + " SELECT tree_id, split FROM rs WHERE tree_id IN ('balanced8', 'six')) r GROUP BY 1, 2")
def snj_by_scorers(spark, d):
    """Scorers that are 0 for clades, and only for them, find all splits of exact similarities."""
    sim = Q.exact(spark).where("tree_id in ('balanced8', 'six')")
    found = None
    for name in ("second", "rest", "rest_squares", "minors", "root_rest_squares", "max_quartet", "squared_quartets"):
        one = R.by_method(sim, f"snj_{name}").select(F.lit(name).alias("scorer"), "tree_id", "split")
        found = one if found is None else found.unionByName(one)
    return found.join(Q.ref_splits(spark), ["tree_id", "split"]).groupBy("scorer", "tree_id").agg(F.count("*").alias("right_splits"))


@query()
def snj_by_other_scorers(spark, d):
    """Splits found by each of all scorers, by name; some are no measure of rank one."""
    sim = Q.exact(spark).where("tree_id = 'balanced8'")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        s = R.dense(pdf)
        methods = [*(f"snj_{n}" for n in scorers.NAMES), "snj_half", "snj_angle_of_second_vectors", "snj_alignment_of_rows"]
        return pd.DataFrame([(m, sp) for m in methods for sp in R.rows_of("", R.METHODS[m](s), len(s))["split"]], columns=["method", "split"])

    return sim.groupBy("tree_id").applyInPandas(run, "method string, split string")


def _merge(name: str):
    def run(spark, d):
        return R.divide_and_merge(Q.exact(spark), "nj", 4, score=name)

    run.__name__ = f"stdr_{name}_additive"
    return query(REFS + " SELECT tree_id, split, size FROM rs")(run)


for _name in ("angle", "normalized_least_square", "global_diff", "longest_branch"):
    _merge(_name)


@query()
def stdr_by_signs(spark, d):
    """Merging where the signs of a Laplacian eigenvector say, and at the closest triplet: what splits they find."""
    out = None
    for name in ("spectrum", "partition", "closest_triplet"):
        one = R.divide_and_merge(Q.exact(spark), "nj", 4, score=name).withColumn("score", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT how, tree_id, true AS valid FROM (VALUES " + ", ".join(f"('{h}')" for h in K.DIVISIONS) + ") v(how), (VALUES ('balanced8'), ('balanced16'), ('balanced32')) t(tree_id)")
def recursive_divisions(spark, d):
    """Each of six ways to divide recursively divides exact similarities at edges of the tree."""
    trees = T.balanced(spark, 8, 0.3).unionByName(T.balanced(spark, 16, 0.25)).unionByName(T.balanced(spark, 32, 0.2))
    sim = T.patristic(trees).select("tree_id", "i", "j", F.exp(-F.col("d")).alias("s"))
    clades, out = T.clades(trees), None
    for how in K.DIVISIONS:
        groups = R.recursive_divisions(sim, 4, how)
        # Divisions of a tree are checked in that tree alone.
        valid = T.splits_induced(clades, groups.select(F.concat_ws("/", "tree_id", "group").alias("group"), "part", "taxon")).where(F.col("tree_id") == F.split("group", "/")[0])
        one = valid.groupBy("tree_id").agg(F.bool_and("valid").alias("valid")).withColumn("how", F.lit(how))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT tree_id, split FROM (" + Q._HALVES + ") WHERE tree_id <> 'double_star12'")
def eigengap_split(spark, d):
    return R.eigengap(Q.halved(spark).where("tree_id <> 'double_star12'")).select("tree_id", "split")


# Latent trees -----------------------------------------------------------------------------------------


@query(REFS + " SELECT tree_id, split, size FROM rs WHERE tree_id = 'balanced8'")
def rg_relaxed_additive(spark, d):
    sim = T.patristic(T.balanced(spark, 8, 0.5)).select("tree_id", "i", "j", F.exp(-F.col("d")).alias("s"))
    return R.by_method(sim, "rg_relaxed")


@query(REFS + " SELECT tree_id, split, size FROM rs WHERE tree_id = 'balanced8'")
def clrg_additive(spark, d):
    sim = T.patristic(T.balanced(spark, 8, 0.5)).select("tree_id", "i", "j", F.exp(-F.col("d")).alias("s"))
    return R.by_method(sim, "clrg")


@query("SELECT CAST(u AS BIGINT) AS u, CAST(v AS BIGINT) AS v FROM (VALUES (0, 4), (1, 4), (2, 4), (3, 4)) t(u, v)")
def contract_weak_edges(spark, d):
    """Two hidden nodes at a weak edge become one."""
    edges = L.contract_weak([(0, 4, 0.5), (1, 4, 0.5), (4, 5, 0.05), (2, 5, 0.4), (3, 5, 0.6)], 4)
    return spark.createDataFrame([(u, v) for u, v, _ in edges], "u long, v long")


@query(LAB2 + ", c AS (SELECT x.taxon AS i, y.taxon AS j, x.state AS a, y.state AS b, count(*) AS cnt FROM sites x JOIN sites y USING (site) WHERE x.taxon <> y.taxon GROUP BY 1, 2, 3, 4) SELECT i AS parent, j AS node, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, " + rds("cnt / CAST(sum(cnt) OVER (PARTITION BY i, j, a) AS DOUBLE)") + " AS p FROM c")
def conditional_tables(spark, d):
    """Tables p(state of node | state of parent) for every pair that a spanning tree may join."""
    c = C.conf(Q.lab2(spark, d))
    both = c.select("i", "j", "a", "b", "cnt").union(c.select("j", "i", "b", "a", "cnt"))
    n = both.groupBy("i", "j", "a").agg(F.sum("cnt").alias("n"))
    return ids(both.join(n, ["i", "j", "a"]).select(F.col("i").alias("parent"), F.col("j").alias("node"), "a", "b", (F.col("cnt") / F.col("n")).alias("p")))


def _binary_sample(spark, m: int = 8, n: int = 4000, length: float = 0.1, seed: int = 5) -> DataFrame:
    one = spark.createDataFrame([(seed, "balanced", m, n, length, "jc2", 0.0)], "trial long, kind string, m long, n long, length double, model string, shape double")
    return G.sequences(one).select(F.lit("sample").alias("tree_id"), "taxon", "site", "state")


def _on_sample(spark, schema: str, run, **kw) -> DataFrame:
    """run(x) of the sample's states (samples x nodes), one task."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        return run(pdf.pivot(index="site", columns="taxon", values="state").to_numpy().astype(int))

    return _binary_sample(spark, **kw).groupBy("tree_id").applyInPandas(kernel, schema)


@query("SELECT name, true AS agrees FROM (VALUES ('ind'), ('cl'), ('lcm'), ('hca')) v(name)")
def forest_log_likelihood(spark, d):
    """Upward messages give what summing over all states of the hidden nodes gives."""

    def run(x: np.ndarray) -> pd.DataFrame:
        from itertools import product

        x = x[:, :4]
        patterns, weight = np.unique(x, axis=0, return_counts=True)
        out = []
        for name in ("ind", "cl", "lcm", "hca"):
            f = L.FORESTS[name](patterns, weight.astype(float), [2] * 4)
            hidden, total = range(4, len(f.parent)), np.zeros(len(patterns))
            for states in product(*(range(f.levels[h]) for h in hidden)):
                full = np.column_stack([patterns, *[np.full(len(patterns), s) for s in states]]) if states else patterns
                p = np.ones(len(patterns))
                for i, q in enumerate(f.parent):
                    p = p * (f.table[i][full[:, i]] if q < 0 else f.table[i][full[:, q], full[:, i]])
                total += p
            out.append((name, bool(np.isclose(weight @ np.log(total), L.log_likelihood(f, patterns, weight.astype(float))))))
        return pd.DataFrame(out, columns=["name", "agrees"])

    return _on_sample(spark, "name string, agrees boolean", run)


@query("SELECT true AS never_falls, true AS marginals_agree, true AS oriented_alike")
def em_binary_tree(spark, d):
    """Steps of EM never lower the likelihood; sum-product marginals are those of the tables; turning hidden states changes nothing."""

    def run(x: np.ndarray) -> pd.DataFrame:
        patterns, weight = np.unique(x, axis=0, return_counts=True)
        weight = weight.astype(float)
        d = -np.log(np.clip(np.abs(np.corrcoef(x.T)), 1e-6, 1))
        f = L.forest_of_edges(K.neighbor_joining(d), x.shape[1], 2, np.stack([1 - x.mean(axis=0), x.mean(axis=0)], axis=1))
        lls = []
        for _ in range(6):
            lls.append(L.log_likelihood(f, patterns, weight))
            f, _ = L.em(f, patterns, weight, 2, 0.0)
        node, _, _ = L.posteriors(f, L.evidence(np.full((1, x.shape[1]), -1), [2] * x.shape[1]))
        agree = all(np.allclose(a[0], b) for a, b in zip(node, L.marginals(f), strict=True))
        turned = L.oriented(f)
        alike = np.isclose(L.log_likelihood(turned, patterns, weight), L.log_likelihood(f, patterns, weight)) and all(L.marginals(turned)[h][0] >= 0.5 - 1e-9 for h in range(x.shape[1], len(f.parent)) if turned.parent[h] < 0)
        return pd.DataFrame({"never_falls": [bool((np.diff(lls) >= -1e-6).all())], "marginals_agree": [agree], "oriented_alike": [bool(alike)]})

    return _on_sample(spark, "never_falls boolean, marginals_agree boolean, oriented_alike boolean", run)


@query("SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b FROM (VALUES (0, 1), (2, 3), (4, 5), (6, 7)) v(a, b)")
def pairing_forest(spark, d):
    """Greedy pairing joins the cherries of the generating tree first."""

    def run(x: np.ndarray) -> pd.DataFrame:
        patterns, weight = np.unique(x, axis=0, return_counts=True)
        f = L.pairing(patterns, weight.astype(float), [2] * x.shape[1], restarts=3)
        kids: dict[int, list[int]] = {}
        for c, p in enumerate(f.parent[: x.shape[1]]):
            if p >= 0:
                kids.setdefault(p, []).append(c)
        return pd.DataFrame([k for k in kids.values() if len(k) == 2], columns=["a", "b"])

    return _on_sample(spark, "a bigint, b bigint", run)


@query("SELECT method, true AS better_than_none FROM (VALUES ('cl'), ('hca'), ('hcs'), ('hcc'), ('lcm'), ('bin')) v(method)")
def forest_methods(spark, d):
    """Each kind of forest explains dependent data better, by AIC, than no edges do."""
    sites = _binary_sample(spark)
    found = None
    for name in ("ind", "cl", "hca", "hcs", "hcc", "lcm", "bin"):
        one = R.forest_scores(sites, name).where("name = 'aic'").select(F.lit(name).alias("method"), "value")
        found = one if found is None else found.unionByName(one)
    base = found.where("method = 'ind'").select(F.col("value").alias("base"))
    return found.where("method <> 'ind'").join(F.broadcast(base)).select("method", (F.col("value") > F.col("base")).alias("better_than_none"))


@query("SELECT 'hca' AS best, CAST(5 AS BIGINT) AS folds")
def cross_validation(spark, d):
    """Held-out log-likelihood prefers the tree over a spanning tree and over no edges."""

    def run(x: np.ndarray) -> pd.DataFrame:
        found = {name: L.cross_validated(name, x, [2] * x.shape[1]) for name in ("ind", "cl", "hca")}
        return pd.DataFrame({"best": [max(found, key=lambda k: float(np.mean(found[k])))], "folds": [len(found["ind"])]})

    return _on_sample(spark, "best string, folds bigint", run)


@query("SELECT kind, true AS has_hidden, true AS better FROM (VALUES ('clrg'), ('clnj'), ('gaussian_clrg'), ('gaussian_clnj')) v(kind)")
def regularised_grouping(spark, d):
    """Hidden nodes that BIC allows, and the likelihood they add to the spanning tree's."""

    def run(x: np.ndarray) -> pd.DataFrame:
        m, rng = x.shape[1], np.random.default_rng(2)
        patterns, weight = np.unique(x, axis=0, return_counts=True)
        share = np.stack([1 - x.mean(axis=0), x.mean(axis=0)], axis=1)
        d = -np.log(np.clip(np.abs(np.corrcoef(x.T)), 1e-6, 1))
        np.fill_diagonal(d, 0)
        sample = np.corrcoef(models.gaussian_samples(G.tree_edges("balanced", m, 0.4, rng), m, 4000, rng))
        ll = lambda e: L.em(L.forest_of_edges(e, m, 2, share), patterns, weight.astype(float), 20, 1.0)[1]
        gaussian = lambda e: L.gaussian_log_likelihood(e, m, sample)
        d2 = -np.log(np.clip(np.abs(sample), 1e-6, 1))
        np.fill_diagonal(d2, 0)
        found = {
            "clrg": (L.regularised_discrete(x, d, L.relaxed_grouping), ll, d), "clnj": (L.regularised_discrete(x, d, L.observed_neighbor_joining), ll, d),
            "gaussian_clrg": (L.regularised_gaussian(sample, 4000, L.relaxed_grouping), gaussian, d2), "gaussian_clnj": (L.regularised_gaussian(sample, 4000, L.observed_neighbor_joining), gaussian, d2),
        }
        return pd.DataFrame([(k, max(max(u, v) for u, v, _ in e) >= m, bool(f(e) > f(K.spanning_tree(own)))) for k, (e, f, own) in found.items()], columns=["kind", "has_hidden", "better"])

    return _on_sample(spark, "kind string, has_hidden boolean, better boolean", run, length=0.15)


@query("SELECT name, CAST(observed AS BIGINT) AS observed, true AS as_tables FROM (VALUES ('binary_forest', 5), ('three_level_binary', 4), ('three_coins', 3), ('six_coins', 6)) v(name, observed)")
def toy_forests(spark, d):
    """Toy data sets: states of 20,000 samples are as frequent as the tables say."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        name = pdf["name"].iloc[0]
        f = L.TOYS[name]()
        x = L.sampled(f, 20_000, np.random.default_rng(0))
        close = all(np.abs(np.bincount(x[:, i], minlength=len(p)) / len(x) - p).max() < 0.02 for i, p in enumerate(L.marginals(f)))
        return pd.DataFrame({"name": [name], "observed": [f.observed], "as_tables": [bool(close)]})

    return spark.createDataFrame([(k,) for k in L.TOYS], "name string").groupBy("name").applyInPandas(run, "name string, observed bigint, as_tables boolean")


@query("SELECT CAST(taxon AS BIGINT) AS taxon, CAST(state AS BIGINT) AS state, CAST(n AS BIGINT) AS n FROM (VALUES (0, 0, 3), (0, 1, 2), (1, 0, 1), (1, 1, 4)) v(taxon, state, n)")
def frequency_samples(spark, d):
    """Rows of states with a frequency, as samples."""
    lines = spark.sql("SELECT pos AS ix, col AS value FROM (SELECT posexplode(array('% states, how often', '0 1 3', '1 0 1', '1 1 1', '0 0 0')))")
    return results.expanded(results.frequency_rows(lines), 2).groupBy("taxon", F.col("state").cast("long").alias("state")).agg(F.count("*").alias("n"))


@query("SELECT CAST(i AS BIGINT) AS i, round(CAST(e AS DOUBLE), 6) AS e FROM (VALUES (0, 0.3), (1, 0.5), (2, 0.9)) v(i, e)")
def hidden_child_distances(spark, d):
    """A family of three, and two taxa beyond their hidden parent: lengths of its edges."""
    dist = K.patristic([(0, 5, 0.3), (1, 5, 0.5), (2, 5, 0.9), (5, 6, 0.4), (3, 6, 0.6), (4, 6, 0.7)], 5)
    three = L.child_edges(dist, [0, 1, 2])
    return ids(spark.createDataFrame([(i, float(e)) for i, e in enumerate(three)], "i long, e double"))


@query("SELECT name, ok, CAST(n AS BIGINT) AS n FROM (VALUES ('pairs', true, 2), ('chain', false, 2), ('all', true, 1)) v(name, ok, n)")
def consistency_check(spark, d):
    """Whether a relation between siblings is a partition."""
    eye = np.eye(4, dtype=bool)
    rel = {"pairs": [(0, 1), (2, 3)], "chain": [(0, 1), (1, 2), (2, 3)], "all": [(a, b) for a in range(4) for b in range(a)]}
    out = []
    for name, pairs in rel.items():
        m = eye.copy()
        for a, b in pairs:
            m[a, b] = m[b, a] = True
        ok, groups = L.consistent(m)
        out.append((name, bool(ok), len(groups)))
    return spark.createDataFrame(out, "name string, ok boolean, n long")


@query(LAB2 + Q.CONF + " SELECT i, j, a, b, cnt FROM conf")
def conf_by_columns(spark, d):
    """Joint counts from whole site columns, as a stream of them gives."""
    from sparkclade.streaming.incremental import conf_stream

    columns = Q.lab2(spark, d).groupBy("site").agg(F.map_from_entries(F.collect_list(F.struct("taxon", "state"))).alias("states"))
    return ids(conf_stream(columns))


@query(LAB4 + Q.HAM + f", d AS (SELECT i, j, h FROM ham UNION ALL SELECT j, i, h FROM ham UNION ALL SELECT DISTINCT taxon, taxon, CAST(0 AS DOUBLE) FROM sites) SELECT i, j, {rds('min(s)')} AS d FROM (SELECT x.i, y.j, x.h * x.h + y.h * y.h AS s FROM d x JOIN d y ON x.j = y.i WHERE x.i < y.j) GROUP BY 1, 2")
def metric_repair(spark, d):
    """Squared Hamming distances break the triangle inequality; the largest metric below them is that of shortest paths (of two steps here)."""
    h = C.hamming(C.conf(Q.lab4(spark, d))).select(F.lit("all").alias("tree_id"), "i", "j", (F.col("h") * F.col("h")).alias("s"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        full = R.dense(pdf, own=0.0)
        two = np.minimum(full, (full[:, :, None] + full[None, :, :]).min(axis=1))
        best = K.metric_repair(full)
        if not np.allclose(np.minimum(two, best), best):
            raise ValueError("a shortest path longer than one of two steps")
        i, j = np.triu_indices(len(full), 1)
        return pd.DataFrame({"i": i, "j": j, "d": two[i, j]})

    return ids(h.groupBy("tree_id").applyInPandas(run, "i bigint, j bigint, d double"))


@query("SELECT true AS better, true AS same_tree")
def ml_from_start_tree(spark, d):
    """A climb from a poor start tree ends at the generating tree, with a higher likelihood."""

    def run(x: np.ndarray) -> pd.DataFrame:
        x = x[:, :6]
        patterns, weight = np.unique(x, axis=0, return_counts=True)
        start = K.rooted(K.random_topology(6, np.random.default_rng(5), 0.1), 8)
        model = models.JukesCantor(2)
        before = K.tree_log_likelihood(K.rooted(start, 8), patterns, weight.astype(float), model)
        edges, after = K.likelihood_search(patterns, weight.astype(float), model, start)
        truth = {frozenset((2, 3)), frozenset((4, 5)), frozenset((2, 3, 4, 5))}
        return pd.DataFrame({"better": [bool(after > before)], "same_tree": [K.splits(edges, 6) == truth]})

    return _on_sample(spark, "better boolean, same_tree boolean", run)


@query("SELECT true AS same")
def reproduce_result(spark, d):
    """A result of a grid, computed again by itself, is the same but for its run time."""
    columns = ["kind", "rate", "rep", "n", "method", "rf", "f1", "correct"]
    grid = G.experiment(spark, ["balanced", "kingman"], [0.05], [100, 300], ["nj", "snj"], 16, 2)
    one = G.reproduce(spark, "kingman", 0.05, 1, 100, "snj", 16, 300)
    return one.select(*columns).join(grid.select(*columns), columns, "left_semi").agg((F.count("*") == 1).alias("same"))


@query("SELECT true AS more_sites_help, true AS shares")
def experiment_shape(spark, d):
    """Over 12 trials a method, accuracy doesn't fall with ten times the sites, and F1 is a share."""
    r = G.experiment(spark, ["balanced", "birth_death", "kingman"], [0.1], [100, 1000], ["nj", "snj"], 16, 4)
    s = r.groupBy("method").agg(F.avg(F.when(F.col("n") == 100, F.col("f1"))).alias("few"), F.avg(F.when(F.col("n") == 1000, F.col("f1"))).alias("many"), F.bool_and(F.expr("f1 between 0 and 1 and rf >= 0 and correct = (rf = 0)")).alias("ok"))
    return s.agg(F.bool_and(F.col("many") >= F.col("few")).alias("more_sites_help"), F.bool_and("ok").alias("shares"))
