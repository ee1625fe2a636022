"""Trees as edge lists (tree_id, node, parent, length, taxon): set algebra over any number of trees of any depth.

A split is named by the taxa, in order, of its side without the lowest taxon.
Ancestors are found by pointer doubling: each round doubles how far up a leaf
sees, so a tree of depth d takes log2 d joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkclade.storage import stored


def of_edges(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    values = ", ".join("('{}', {}, {}, {}, {})".format(t, n, "null" if p is None else p, "null" if w is None else f"{w}D", "null" if x is None else x) for t, n, p, w, x in rows)
    return spark.sql(f"SELECT col1 AS tree_id, CAST(col2 AS BIGINT) AS node, CAST(col3 AS BIGINT) AS parent, CAST(col4 AS DOUBLE) AS length, CAST(col5 AS BIGINT) AS taxon FROM VALUES {values}")


def ancestors(tree: DataFrame, start: Column | None = None) -> DataFrame:
    """(tree_id, taxon, node, d, hops): every leaf with itself and all nodes above it.

    `start` may say which nodes to begin at instead of the leaves; their `taxon` is then the node."""
    up = tree.where("parent is not null").select("tree_id", F.col("node").alias("low"), F.col("parent").alias("high"), F.coalesce("length", F.lit(0.0)).alias("w"), F.lit(1).alias("steps"))
    begin = tree.where("taxon is not null") if start is None else tree.where(start).withColumn("taxon", F.col("node"))
    seen = begin.select("tree_id", "taxon", "node", F.lit(0.0).alias("d"), F.lit(0).alias("hops"))
    while True:
        up = stored(up)
        if up.isEmpty():
            return seen
        jump = up.select(F.col("tree_id").alias("t"), "low", "high", "w", "steps")
        both = "array(struct(node, d, hops), if(high is null, null, struct(high as node, d + w as d, hops + steps as hops)))"
        seen = seen.join(jump, (F.col("tree_id") == F.col("t")) & (F.col("node") == F.col("low")), "left")
        seen = seen.select("tree_id", "taxon", F.explode(F.expr(f"filter({both}, x -> x is not null)")).alias("x")).select("tree_id", "taxon", "x.node", "x.d", "x.hops")
        further = jump.select("t", F.col("low").alias("low2"), F.col("high").alias("high2"), F.col("w").alias("w2"), F.col("steps").alias("steps2"))
        up = up.join(further, (F.col("tree_id") == F.col("t")) & (F.col("high") == F.col("low2")))
        up = up.select("tree_id", "low", F.col("high2").alias("high"), (F.col("w") + F.col("w2")).alias("w"), (F.col("steps") + F.col("steps2")).alias("steps"))


def clades(tree: DataFrame) -> DataFrame:
    """(tree_id, node, taxon): which taxa are below which node."""
    return ancestors(tree).select("tree_id", "node", "taxon")


def splits(members: DataFrame) -> DataFrame:
    """(tree_id, split, size): distinct non-trivial splits of clades (tree_id, node, taxon)."""
    taxa = members.groupBy("tree_id").agg(F.sort_array(F.collect_set("taxon")).alias("every"))
    sets = members.groupBy("tree_id", "node").agg(F.sort_array(F.collect_set("taxon")).alias("c")).join(taxa, "tree_id")
    side = F.when(F.array_contains("c", F.col("every")[0]), F.array_except("every", "c")).otherwise(F.col("c"))
    found = sets.select("tree_id", side.alias("s"), F.size("every").alias("m")).where("size(s) >= 2 and size(s) <= m - 2")
    return found.select("tree_id", F.array_join("s", ",").alias("split"), F.size("s").cast("long").alias("size")).distinct()


def restrict(members: DataFrame, taxa: DataFrame) -> DataFrame:
    """Clades of the induced subtree: only the given taxa (taxon), nodes left empty are gone."""
    return members.join(taxa, "taxon", "left_semi").select("tree_id", "node", "taxon")


def patristic(tree: DataFrame) -> DataFrame:
    """(tree_id, i, j, d, hops): path lengths between taxa.

    Each pair is met once, where its paths to the root join: below two children of one node,
    or, where inner nodes are taxa too, at one of the pair itself."""
    seen = stored(ancestors(tree))
    edges = tree.where("parent is not null").select("tree_id", "parent", "node", F.coalesce("length", F.lit(0.0)).alias("w"))
    x, y = edges.select("tree_id", "parent", F.col("node").alias("c1"), F.col("w").alias("w1")), edges.select("tree_id", "parent", F.col("node").alias("c2"), F.col("w").alias("w2"))
    joints = x.join(y, ["tree_id", "parent"]).where("c1 < c2").drop("parent")
    left = seen.select("tree_id", F.col("node").alias("c1"), F.col("taxon").alias("a"), F.col("d").alias("d1"), F.col("hops").alias("h1"))
    right = seen.select("tree_id", F.col("node").alias("c2"), F.col("taxon").alias("b"), F.col("d").alias("d2"), F.col("hops").alias("h2"))
    apart = joints.join(left, ["tree_id", "c1"]).join(right, ["tree_id", "c2"])
    apart = apart.select("tree_id", F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"), F.expr("d1 + w1 + w2 + d2").alias("d"), F.expr("h1 + h2 + 2").alias("hops"))
    own = tree.where("taxon is not null").select("tree_id", "node", F.col("taxon").alias("b"))
    above = seen.where("hops > 0").join(own, ["tree_id", "node"]).select("tree_id", F.least("taxon", "b").alias("i"), F.greatest("taxon", "b").alias("j"), "d", "hops")
    return apart.unionByName(above)


def cherries(tree: DataFrame) -> DataFrame:
    """(tree_id, cherries): parents with exactly two leaves as children."""
    pairs = tree.groupBy("tree_id", "parent").agg(F.count("taxon").alias("leaves"), F.count("*").alias("children")).where("parent is not null and leaves = 2 and children = 2")
    return tree.select("tree_id").distinct().join(pairs.groupBy("tree_id").agg(F.count("*").alias("n")), "tree_id", "left").select("tree_id", F.coalesce("n", F.lit(0)).alias("cherries"))


def balanced(spark: SparkSession, m: int, length: float) -> DataFrame:
    """A balanced binary tree of m = 2^k leaves: node n (heap order from 1) has parent n div 2."""
    if m < 2 or m & (m - 1):
        raise ValueError("the number of leaves of a balanced tree is a power of two")
    n = F.col("id")
    return spark.range(1, 2 * m).select(F.lit(f"balanced{m}").alias("tree_id"), n.alias("node"), F.when(n > 1, F.floor(n / 2)).alias("parent"), F.when(n > 1, F.lit(length)).alias("length"), F.when(n >= m, n - m).alias("taxon"))


def caterpillar(spark: SparkSession, m: int, length: float) -> DataFrame:
    """Leaves 0..m-1 along a spine: inner node m + k has leaf k and the rest below."""
    n = F.col("id")
    parent = F.when(n < m - 1, F.lit(m) + n).when(n == m - 1, F.lit(2 * m - 2)).when(n > m, n - 1)
    return spark.range(2 * m - 1).select(F.lit(f"caterpillar{m}").alias("tree_id"), n.alias("node"), parent.alias("parent"), F.when(parent.isNotNull(), F.lit(length)).alias("length"), F.when(n < m, n).alias("taxon"))


def compare(inferred: DataFrame, reference: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: FP, FN, RF, precision, recall, F1 of split tables (keys.., split), by a full outer join."""
    a, b = inferred.select(*keys, "split", F.lit(1).alias("got")), reference.select(*keys, "split", F.lit(1).alias("ref"))
    j = a.join(b, [*keys, "split"], "full_outer")
    c = j.groupBy(*keys).agg(F.count("got").alias("n_inf"), F.count("ref").alias("n_ref"), F.sum(F.expr("cast(got is not null and ref is not null as bigint)")).alias("tp"))
    return c.selectExpr(*keys, "n_inf - tp as fp", "n_ref - tp as fn", "n_inf + n_ref - 2 * tp as rf", "coalesce(try_divide(cast(tp as double), n_inf), 0D) as precision", "coalesce(try_divide(cast(tp as double), n_ref), 0D) as recall", "coalesce(try_divide(cast(2 * tp as double), n_inf + n_ref), 0D) as f1")


def adjacency_to_tree(edges: DataFrame, root: int, leaves: int) -> DataFrame:
    """Orients undirected edges (tree_id, u, v, length) away from a root node, one tree per task."""
    both = edges.select("tree_id", "u", "v", "length").union(edges.select("tree_id", F.col("v"), F.col("u"), "length"))

    def walk(pdf):
        import pandas as pd

        near: dict[int, list[tuple[int, float]]] = {}
        for u, v, w in zip(pdf["u"].tolist(), pdf["v"].tolist(), pdf["length"].tolist(), strict=True):
            near.setdefault(u, []).append((v, w))
        rows, stack, seen = [(root, None, None)], [root], {root}
        while stack:
            x = stack.pop()
            for y, w in near.get(x, []):
                if y not in seen:
                    seen.add(y)
                    rows.append((y, x, w))
                    stack.append(y)
        out = pd.DataFrame(rows, columns=["node", "parent", "length"]).astype({"parent": "Int64", "length": "Float64"})
        out.insert(0, "tree_id", pdf["tree_id"].iloc[0])
        out["taxon"] = out["node"].where(out["node"] < leaves).astype("Int64")
        return out

    return both.groupBy("tree_id").applyInPandas(walk, "tree_id string, node bigint, parent bigint, length double, taxon bigint")


def reroot(tree: DataFrame, root: int, leaves: int) -> DataFrame:
    """The tree with another root: only edges on the path from the old root to the new one turn round."""
    path = ancestors(tree, F.col("node") == root).select("tree_id", "node", "hops")
    turned = tree.join(path, ["tree_id", "node"])
    # A node of the path gets as parent the path's node below it, with the length of the edge between them.
    below = turned.select("tree_id", F.col("parent").alias("node"), F.col("node").alias("parent"), "length").where("node is not null")
    above = tree.join(path.select("tree_id", "node"), ["tree_id", "node"], "left_anti").select("tree_id", "node", "parent", "length")
    top = turned.where(F.col("node") == root).select("tree_id", "node", F.lit(None).cast("long").alias("parent"), F.lit(None).cast("double").alias("length"))
    taxa = tree.select("tree_id", "node", "taxon")
    return above.unionByName(below).unionByName(top).join(taxa, ["tree_id", "node"]).select("tree_id", "node", "parent", "length", "taxon")


# Comparisons ---------------------------------------------------------------------------------


def contains(found: DataFrame, splits_of: DataFrame) -> DataFrame:
    """found (tree_id, split) with `found`: whether the other table has that split of that tree."""
    inside = splits_of.select("tree_id", "split").distinct().withColumn("found", F.lit(True))
    return found.select("tree_id", "split").join(inside, ["tree_id", "split"], "left").select("tree_id", "split", F.coalesce("found", F.lit(False)).alias("found"))


def split_of(taxa: Column, every: Column) -> Column:
    """The name of the split of sorted arrays: a side, and all taxa."""
    return F.array_join(F.when(F.array_contains(taxa, every[0]), F.array_except(every, taxa)).otherwise(taxa), ",")


def splits_induced(members: DataFrame, groups: DataFrame) -> DataFrame:
    """For groups (group, part, taxon), whose two parts split them: (tree_id, group, valid), whether the
    tree that a group's taxa induce has that split.  A split with a side of one taxon is always there."""
    sides = groups.groupBy("group").agg(F.sort_array(F.collect_set("taxon")).alias("every"))
    one = groups.where("part = 1").groupBy("group").agg(F.sort_array(F.collect_set("taxon")).alias("side")).join(sides, "group")
    wanted = one.select("group", F.size("every").alias("m"), F.size("side").alias("k"), split_of(F.col("side"), F.col("every")).alias("split"))
    taxa = groups.select("group", "taxon").distinct()
    inside = members.join(taxa, "taxon").groupBy("tree_id", "group", "node").agg(F.sort_array(F.collect_set("taxon")).alias("c")).join(sides, "group")
    have = inside.select("tree_id", "group", split_of(F.col("c"), F.col("every")).alias("split")).distinct().withColumn("there", F.lit(True))
    trees = members.select("tree_id").distinct()
    every = trees.join(F.broadcast(wanted))
    return every.join(have, ["tree_id", "group", "split"], "left").select("tree_id", "group", (F.coalesce("there", F.lit(False)) | (F.col("k") <= 1) | (F.col("m") - F.col("k") <= 1)).alias("valid"))


def all_splits_valid(members: DataFrame, groups: DataFrame) -> DataFrame:
    """(tree_id, valid): whether all of a recursive division's splits are those of induced subtrees."""
    return splits_induced(members, groups).groupBy("tree_id").agg(F.bool_and("valid").alias("valid"))


def equal_topology(one: DataFrame, other: DataFrame, places: int | None = None) -> DataFrame:
    """(tree_id, same): equal sets of edges, each a split; with `places`, also equal lengths to so many decimals."""

    def edges(tree: DataFrame) -> DataFrame:
        members = clades(tree)
        every = members.groupBy("tree_id").agg(F.sort_array(F.collect_set("taxon")).alias("every"))
        sets = members.groupBy("tree_id", "node").agg(F.sort_array(F.collect_set("taxon")).alias("c")).join(every, "tree_id").where("size(c) < size(every)")
        named = sets.select("tree_id", "node", split_of(F.col("c"), F.col("every")).alias("split")).join(tree.select("tree_id", "node", "length"), ["tree_id", "node"])
        # The two edges at a root are one edge of the unrooted tree.
        found = named.groupBy("tree_id", "split").agg(F.sum("length").alias("length"))
        return found.select("tree_id", "split", *([F.round("length", places).alias("length")] if places is not None else []))

    a, b = stored(edges(one)), stored(edges(other))
    odd = a.exceptAll(b).union(b.exceptAll(a)).groupBy("tree_id").agg(F.count("*").alias("odd"))
    ids = a.select("tree_id").union(b.select("tree_id")).distinct()
    return ids.join(odd, "tree_id", "left").select("tree_id", F.col("odd").isNull().alias("same"))


def symmetric_f1(inferred: DataFrame, reference: DataFrame) -> DataFrame:
    """(tree_id, f): F-score where both sides of every split count; the same as of splits named by one side."""
    return compare(inferred, reference, ["tree_id"]).select("tree_id", F.col("f1").alias("f"))


def pure_clades(tree: DataFrame, group: DataFrame) -> DataFrame:
    """(tree_id, node, inside): maximal clades that are entirely in, or entirely out of, a group (taxon)."""
    marked = clades(tree).join(group.select("taxon").distinct().withColumn("yes", F.lit(1)), "taxon", "left")
    purity = stored(marked.groupBy("tree_id", "node").agg(F.count("yes").alias("yes"), F.count("*").alias("n")))
    pure = purity.where("yes = 0 or yes = n").join(tree.select("tree_id", "node", "parent"), ["tree_id", "node"])
    above = purity.select("tree_id", F.col("node").alias("parent"), ((F.col("yes") == 0) | (F.col("yes") == F.col("n"))).alias("above"))
    return pure.join(above, ["tree_id", "parent"], "left").where("above is null or not above").select("tree_id", "node", (F.col("yes") > 0).alias("inside"))


def diagnose(inferred: DataFrame, reference: DataFrame) -> DataFrame:
    """(tree_id, split, verdict): 'wrong' splits that only the inferred tree has, 'missed' ones that it lacks."""
    a, b = inferred.select("tree_id", "split"), reference.select("tree_id", "split")
    keys = ["tree_id", "split"]
    return a.join(b, keys, "left_anti").withColumn("verdict", F.lit("wrong")).union(b.join(a, keys, "left_anti").withColumn("verdict", F.lit("missed")))


def common(one: DataFrame, other: DataFrame) -> DataFrame:
    """(tree_id, split) in both."""
    return one.select("tree_id", "split").intersect(other.select("tree_id", "split"))


def exact_recovery(inferred: DataFrame, reference: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """(tree_id, exact, error): whether all paths between leaves have as many edges, and the mean difference of their lengths."""
    x = patristic(inferred)
    y = patristic(reference).select("tree_id", "i", "j", F.col("d").alias("d2"), F.col("hops").alias("hops2"))
    both = x.join(y, ["tree_id", "i", "j"], "full_outer")
    off = F.abs(F.col("d") - F.col("d2"))
    return both.groupBy("tree_id").agg(F.bool_and(F.coalesce(F.col("hops") == F.col("hops2"), F.lit(False))).alias("exact"), F.avg(F.when(off > tolerance, off).otherwise(0.0)).alias("error"))


def cherry_bias(inferred: DataFrame, reference: DataFrame) -> DataFrame:
    """(tree_id, bias): cherries of the inferred tree less those of the reference."""
    return cherries(inferred).join(cherries(reference).select("tree_id", F.col("cherries").alias("c")), "tree_id").select("tree_id", (F.col("cherries") - F.col("c")).alias("bias"))


# Building ------------------------------------------------------------------------------------


def merge_children(forest: DataFrame, roots: list[int], parent: int, length: float | None = None) -> DataFrame:
    """The forest with a new node above the given roots (all in the same tree_id)."""
    if not roots:
        raise ValueError("a new node needs children")
    new = forest.where(F.col("node") == roots[0]).select("tree_id", F.lit(parent).cast("long").alias("node"), F.lit(None).cast("long").alias("parent"), F.lit(None).cast("double").alias("length"), F.lit(None).cast("long").alias("taxon"))
    joined = F.col("node").isin(roots)
    return forest.select("tree_id", "node", F.when(joined, F.lit(parent)).otherwise(F.col("parent")).cast("long").alias("parent"), F.when(joined, F.lit(length)).otherwise(F.col("length")).alias("length"), "taxon").unionByName(new)


def set_lengths(tree: DataFrame, value: float | None = None, fun: Column | None = None, uniform: tuple[float, float] | None = None, seed: int = 0) -> DataFrame:
    """Edge lengths from exactly one of a value, an expression over the edge, and a range; the root keeps none."""
    given = [x for x in (value, fun, uniform) if x is not None]
    if len(given) != 1:
        raise ValueError("give exactly one of value, fun and uniform")
    if uniform is not None:
        # A hash of the edge, so that the same edge gets the same length however the rows are dealt.
        share = F.pmod(F.xxhash64("tree_id", "node", F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
        new = F.lit(uniform[0]) + share * (uniform[1] - uniform[0])
    else:
        new = F.lit(float(value)) if fun is None else fun
    return tree.withColumn("length", F.when(F.col("parent").isNotNull(), new))


def restrict_tree(tree: DataFrame, taxa: DataFrame) -> DataFrame:
    """The tree that some taxa (taxon) induce: nodes with one child left are gone, their edges joined."""
    seen = stored(ancestors(tree).join(taxa.select("taxon").distinct(), "taxon", "left_semi"))
    left = seen.groupBy("tree_id", "node").agg(F.min("taxon").alias("low"), F.count("*").alias("n"))
    # Of nodes with the same taxa below, the one nearest to them stays.
    up = seen.join(left, ["tree_id", "node"]).where("taxon = low").select("tree_id", "node", "low", "n", "d", "hops")
    near = stored(up.groupBy("tree_id", "low", "n").agg(F.min_by("node", "hops").alias("node"), F.min("d").alias("d"), F.min("hops").alias("hops")))
    # A node's parent is the next one above with more taxa.
    a = seen.join(near.select("tree_id", "node"), ["tree_id", "node"], "left_semi")
    low = near.select("tree_id", F.col("low").alias("taxon"), F.col("node").alias("child"), F.col("d").alias("d0"), F.col("hops").alias("hops0"))
    above = a.join(low, ["tree_id", "taxon"]).where("hops > hops0").groupBy("tree_id", "child").agg(F.min(F.struct("hops", "node", (F.col("d") - F.col("d0")).alias("length"))).alias("x"))
    nodes = near.select("tree_id", F.col("node").alias("child"), F.when(F.col("n") == 1, F.col("low")).alias("taxon"))
    return nodes.join(above, ["tree_id", "child"], "left").select("tree_id", F.col("child").alias("node"), F.col("x.node").alias("parent"), F.col("x.length").alias("length"), "taxon")


def star(spark: SparkSession, m: int, length: float) -> DataFrame:
    """Leaves 0..m-1 around one hidden node m."""
    n = F.col("id")
    return spark.range(m + 1).select(F.lit(f"star{m}").alias("tree_id"), n.alias("node"), F.when(n < m, F.lit(m).cast("long")).alias("parent"), F.when(n < m, F.lit(length)).alias("length"), F.when(n < m, n).alias("taxon"))


def double_star(spark: SparkSession, m: int, length: float) -> DataFrame:
    """Two joined hidden nodes m and m + 1 with half of the leaves each."""
    n, half = F.col("id"), (m + 1) // 2
    parent = F.when(n < half, F.lit(m)).when(n < m, F.lit(m + 1)).when(n == m + 1, F.lit(m))
    return spark.range(m + 2).select(F.lit(f"double_star{m}").alias("tree_id"), n.alias("node"), parent.cast("long").alias("parent"), F.when(parent.isNotNull(), F.lit(length)).alias("length"), F.when(n < m, n).alias("taxon"))


def hidden_chain(spark: SparkSession, m: int, length: float) -> DataFrame:
    """A hidden Markov model's tree: hidden nodes m..2m-1 in a row, a leaf at each."""
    n = F.col("id")
    parent = F.when(n < m, n + m).when(n > m, n - 1)
    return spark.range(2 * m).select(F.lit(f"hmm{m}").alias("tree_id"), n.alias("node"), parent.alias("parent"), F.when(parent.isNotNull(), F.lit(length)).alias("length"), F.when(n < m, n).alias("taxon"))


def cayley(spark: SparkSession, degree: int, levels: int, length: float) -> DataFrame:
    """A tree in which every inner node has `degree` neighbours, `levels` edges from the root to each leaf."""
    rows, now, fresh = [(0, None)], [0], 1
    for level in range(levels):
        new = []
        for x in now:
            for _ in range(degree if level == 0 else degree - 1):
                rows.append((fresh, x))
                new.append(fresh)
                fresh += 1
        now = new
    leaf = {x: i for i, x in enumerate(now)}
    return of_edges(spark, [(f"cayley{degree}_{levels}", n, p, None if p is None else length, leaf.get(n)) for n, p in rows])
