"""Observations (taxon, site, state) from tables, and readers and writers of sequence files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Codes of nucleotide symbols.
DNA = {"A": 0, "C": 1, "G": 2, "T": 3, "U": 3, "-": 4}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def binned(value: Column, cuts: list[float]) -> Column:
    """The number of cuts that a value reaches; a null reaches none."""
    out = F.lit(0)
    for c in cuts:
        out = out + F.coalesce((value >= F.lit(c)).cast("int"), F.lit(0))
    return out


def components(vectors: DataFrame, taxon: str) -> DataFrame:
    """(taxon, site, x): one row for each component of each vector."""
    return vectors.select(F.col(taxon).cast("int").alias("taxon"), F.posexplode("embedding").alias("site", "x")).select("taxon", "site", F.col("x").cast("double").alias("x"))


def of_vectors(vectors: DataFrame) -> DataFrame:
    """Four states: a vector's components in bins."""
    return components(vectors, "vec_id").select("taxon", "site", binned(F.col("x"), [-0.1, 0.0, 0.1]).alias("state"))


def label_means(vectors: DataFrame) -> DataFrame:
    """(taxon, site, x): mean component of each label."""
    return components(vectors.where("label is not null"), "label").groupBy("taxon", "site").agg(F.avg("x").alias("x"))


def of_labels(vectors: DataFrame, cuts: list[float]) -> DataFrame:
    return label_means(vectors).select("taxon", "site", binned(F.col("x"), cuts).alias("state"))


def of_events(events: DataFrame) -> DataFrame:
    """A user's last event type of each day; days without events are missing."""
    codes = {"click": 0, "purchase": 1, "view": 2, "signup": 3}
    code = F.coalesce(*(F.when(F.col("event_type") == k, F.lit(v)) for k, v in codes.items()), F.lit(4))
    last = events.groupBy(F.col("user_id").cast("int").alias("taxon"), F.datediff(F.to_date("ts"), F.lit("1970-01-01")).alias("site")).agg(F.max(F.struct("ts", "event_id", code.alias("state"))).alias("e"))
    return last.select("taxon", "site", F.col("e.state").alias("state"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(label, seq) of FASTA files; a record may be wrapped over many lines and is split off by its '>'."""
    return fasta_records(spark.read.option("lineSep", ">").text(path))


def parse_fasta(texts: DataFrame) -> DataFrame:
    """(label, seq) of whole FASTA texts (value)."""
    return fasta_records(texts.select(F.explode(F.split("value", ">")).alias("value")))


def fasta_records(records: DataFrame) -> DataFrame:
    """(label, seq) of records (value) without their '>'."""
    lines = F.split("value", "\n")
    return records.where("trim(value) <> ''").select(F.regexp_replace(lines[0], r"^\s+|\s+$", "").alias("label"), F.regexp_replace(F.array_join(F.slice(lines, 2, F.size(lines)), ""), r"\s", "").alias("seq"))


def encode(seqs: DataFrame, alphabet: dict[str, int] | None = None) -> DataFrame:
    """(label, seq) to (label, codes); unknown symbols are null."""
    codes = F.create_map(*(F.lit(x) for kv in (alphabet or DNA).items() for x in kv))
    return seqs.select("label", F.transform(F.split("seq", ""), lambda c: codes[c]).alias("codes"))


def decode(coded: DataFrame, symbols: str = "ACGT-") -> DataFrame:
    """(label, codes) to (label, seq)."""
    return coded.select("label", F.array_join(F.transform("codes", lambda i: F.substring(F.lit(symbols), i + 1, F.lit(1))), "").alias("seq"))


def to_sites(coded: DataFrame, missing: int = 4) -> DataFrame:
    """Long form; missing states are no rows, so pairs are compared where both have one."""
    return coded.select("label", F.posexplode("codes").alias("site", "state")).where(F.col("state") != missing)


def phylip(seqs: DataFrame) -> DataFrame:
    """Lines (ix, value) of a relaxed PHYLIP alignment; results.write_lines puts them out in order."""
    head = seqs.agg(F.count("*").alias("m"), F.max(F.length("seq")).alias("n")).select(F.lit(-1).alias("ix"), F.concat_ws(" ", "m", "n").alias("value"))
    return head.union(seqs.select(F.lit(0).alias("ix"), F.concat_ws(" ", F.translate("label", " \t", "__"), "seq").alias("value")))


def read_distances(spark: SparkSession, path: str) -> DataFrame:
    """(a, b, d), both ways, of lines 'a b d'."""
    return distance_lines(spark.read.text(path))


def distance_lines(lines: DataFrame) -> DataFrame:
    """(a, b, d), both ways, of lines (value)."""
    cells = F.split(F.trim("value"), r"\s+")
    rows = lines.select(cells[0].alias("a"), cells[1].alias("b"), cells[2].cast("double").alias("d"))
    return rows.union(rows.select(F.col("b"), F.col("a"), "d"))
