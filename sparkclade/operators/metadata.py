"""Metadata algebra: ordered subsets of a namespace, their masks and bipartitions, as joins.

A namespace is (ns_ix, label); taxa are (row_ix, label), an ordered subset of it.  A mask
marks some of the taxa: (row_ix, label, inside).  A bipartition is a string of bits, highest
namespace index first, on the side where index 0 has bit 0."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Symbols of the alphabets, in the order of their states.
ALPHABETS = {"dna": "ACGT-", "rna": "ACGU-", "nucleotide": "ACGT-", "protein": "ACDEFGHIKLMNPQRSTVWY-", "binary": "01"}


def alphabet_of(symbols: DataFrame) -> DataFrame:
    """(name): the first alphabet that has all the symbols (symbol) of the data."""
    known = [(k, list(v)) for k, v in ALPHABETS.items()]
    order = F.array(*(F.struct(F.lit(k).alias("name"), F.array(*map(F.lit, v)).alias("has")) for k, v in known))
    used = symbols.agg(F.collect_set("symbol").alias("used"))
    return used.select(F.filter(order, lambda a: F.size(F.array_except(F.col("used"), a["has"])) == 0)[0]["name"].alias("name"))


def default_taxa(spark, m: int) -> DataFrame:
    """Taxa T1..Tm."""
    return spark.range(m).select(F.col("id").alias("row_ix"), F.concat(F.lit("T"), (F.col("id") + 1).cast("string")).alias("label"))


def _all_known(labels: DataFrame, taxa: DataFrame) -> None:
    unknown = labels.join(taxa, "label", "left_anti").limit(1).collect()
    if unknown:
        raise ValueError(f"unknown label {unknown[0]['label']}")


def index_of(taxa: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, row_ix) of labels."""
    return labels.select("label").join(taxa.select("label", "row_ix"), "label")


def taxa_at(taxa: DataFrame, rows: list[int]) -> DataFrame:
    """The taxa at some indices."""
    return taxa.where(F.col("row_ix").isin(rows))


def mask_of(taxa: DataFrame, labels: DataFrame) -> DataFrame:
    """The mask of some labels; all must be taxa."""
    _all_known(labels, taxa)
    inside = labels.select("label").distinct().withColumn("inside", F.lit(True))
    return taxa.select("row_ix", "label").join(inside, "label", "left").select("row_ix", "label", F.coalesce("inside", F.lit(False)).alias("inside"))


def taxa_of(mask: DataFrame) -> DataFrame:
    return mask.where("inside").select("row_ix", "label")


def bipartition(ns: DataFrame, labels: DataFrame) -> DataFrame:
    """(bipartition) of some labels in the namespace."""
    marked = ns.join(labels.select("label").distinct().withColumn("bit", F.lit(1)), "label", "left").select("ns_ix", F.coalesce("bit", F.lit(0)).alias("bit"))
    row = marked.agg(F.array_sort(F.collect_list(F.struct("ns_ix", "bit"))).alias("v"))
    return row.select(F.array_join(F.reverse(F.expr("transform(v, x -> cast(x.bit ^ v[0].bit as string))")), "").alias("bipartition"))


def bipartition_of(ns: DataFrame, mask: DataFrame) -> DataFrame:
    return bipartition(ns, taxa_of(mask))


def of_bipartition(ns: DataFrame, taxa: DataFrame, bits: str) -> DataFrame:
    """The mask, over taxa, of the side of a bipartition that has bits 1."""
    side = ns.where(F.substring(F.lit(bits[::-1]), F.col("ns_ix").cast("int") + 1, F.lit(1)) == "1").select("label")
    return mask_of(taxa, side.join(taxa, "label", "left_semi"))


def invert_bipartition(ns: DataFrame, tree_taxa: DataFrame, bits: str) -> DataFrame:
    """(bipartition) of the taxa of a tree that are not on the side with bits 1."""
    one = ns.where(F.substring(F.lit(bits[::-1]), F.col("ns_ix").cast("int") + 1, F.lit(1)) == "1").select("label")
    return bipartition(ns, tree_taxa.select("label").join(one, "label", "left_anti"))


def renumbered(taxa: DataFrame) -> DataFrame:
    """row_ix without gaps, in the same order; metadata are as many rows as taxa."""
    return taxa.select("label", (F.row_number().over(Window.orderBy("row_ix")) - 1).cast("long").alias("row_ix")).select("row_ix", "label")


def sub_metadata(taxa: DataFrame, labels: DataFrame) -> DataFrame:
    """Metadata of some of the taxa, in their order."""
    _all_known(labels, taxa)
    return renumbered(taxa.join(labels.select("label").distinct(), "label", "left_semi"))


def tree_mask(tree: DataFrame, taxa: DataFrame) -> DataFrame:
    """The mask of a tree's leaves; their `taxon` is the row index."""
    leaves = tree.where("taxon is not null").select(F.col("taxon").alias("row_ix")).distinct().withColumn("inside", F.lit(True))
    return taxa.select("row_ix", "label").join(leaves, "row_ix", "left").select("row_ix", "label", F.coalesce("inside", F.lit(False)).alias("inside"))


def invert_mask(mask: DataFrame, of_tree: DataFrame) -> DataFrame:
    """The taxa of a tree's mask that a mask leaves out; the mask must lie within the tree's."""
    outside = mask.where("inside").join(of_tree.where("inside"), "row_ix", "left_anti")
    if not outside.isEmpty():
        raise ValueError("the mask has taxa that the tree lacks")
    rest = mask.where("inside").select("row_ix").withColumn("was", F.lit(True))
    return of_tree.join(rest, "row_ix", "left").select("row_ix", "label", (F.col("inside") & F.col("was").isNull()).alias("inside"))


def leaves(taxa: DataFrame, labels: DataFrame, tree_id: str = "forest") -> DataFrame:
    """Trees of one node each for some labels: rows of a forest, named by the row index."""
    _all_known(labels, taxa)
    return index_of(taxa, labels.distinct()).select(F.lit(tree_id).alias("tree_id"), F.col("row_ix").alias("node"), F.lit(None).cast("long").alias("parent"), F.lit(None).cast("double").alias("length"), F.col("row_ix").alias("taxon"))


def equal(one: DataFrame, other: DataFrame, ordered: bool = True) -> bool:
    """Whether two metadata have the same taxa, and in the same order."""
    columns = ["row_ix", "label"] if ordered else ["label"]
    a, b = one.select(*columns), other.select(*columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def reindex(matrix: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """A matrix (i, j, s) over the rows of `old` as one over the rows of `new`, for the labels that both have."""
    to = old.join(new.select("label", F.col("row_ix").alias("now")), "label").select("row_ix", "now")
    x, y = to.select(F.col("row_ix").alias("i"), F.col("now").alias("ni")), to.select(F.col("row_ix").alias("j"), F.col("now").alias("nj"))
    return matrix.join(x, "i").join(y, "j").select(F.col("ni").alias("i"), F.col("nj").alias("j"), "s")
