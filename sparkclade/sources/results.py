"""Experiment results and grids, matrices and other text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save(results: DataFrame, path: str, append: bool = True) -> None:
    """Results as Parquet, added to what is there or in its place."""
    results.write.mode("append" if append else "overwrite").parquet(path)


def load(spark: SparkSession, *paths: str) -> DataFrame:
    """All results under the paths; files that can't be read are skipped."""
    return spark.read.option("ignoreCorruptFiles", "true").option("mergeSchema", "true").parquet(*paths)


def write_table(results: DataFrame, path: str, sep: str = ",") -> None:
    results.write.mode("overwrite").option("header", "true").option("sep", sep).csv(path)


def read_table(spark: SparkSession, glob: str, sep: str = ",", schema: str | None = None) -> DataFrame:
    """CSV or TSV files with a header, each row with the file it is from."""
    reader = spark.read.option("header", "true").option("sep", sep)
    rows = (reader.schema(schema) if schema else reader.option("inferSchema", "true")).csv(glob)
    return rows.withColumn("file", F.input_file_name())


def configured(rows: DataFrame, path_col: str, **patterns: str) -> DataFrame:
    """rows with a number for each pattern, taken out of a path."""
    return rows.withColumns({name: F.regexp_extract(path_col, pattern, 1).cast("long") for name, pattern in patterns.items()})


def together(*frames: DataFrame) -> DataFrame:
    """The union of results by name; columns that some lack are null there."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def accuracy(results: DataFrame, keys: list[str], where: str = "true") -> DataFrame:
    """Per key: runs and the share of correct ones, of the runs that a condition leaves."""
    return results.where(where).groupBy(*keys).agg(F.count("*").alias("runs"), F.avg(F.col("correct").cast("int")).alias("accuracy"))


def summary(results: DataFrame, keys: list[str], value: str, places: int = 2) -> DataFrame:
    """Per key: mean, standard deviation and number of a value's runs."""
    return results.groupBy(*keys).agg(F.round(F.avg(value).cast("double"), places).alias("mean"), F.round(F.stddev_samp(F.col(value).cast("double")), places).alias("sd"), F.count("*").alias("runs"))


def quartiles(results: DataFrame, keys: list[str], value: str) -> DataFrame:
    """What a box plot shows: least, quartiles and largest value of each key."""
    v = F.col(value).cast("double")
    q = lambda p: F.percentile(v, F.lit(p))
    return results.groupBy(*keys).agg(F.min(v).alias("low"), q(0.25).alias("q1"), q(0.5).alias("mid"), q(0.75).alias("q3"), F.max(v).alias("high"))


# Matrices -------------------------------------------------------------------------------------


def to_pairs(rows: DataFrame) -> DataFrame:
    """(i, j, s) of matrix rows (i, row array<double>); all rows must be as long as there are rows."""
    m = rows.count()
    if not rows.where(F.size("row") != m).isEmpty():
        raise ValueError("the matrix is not square")
    return rows.select("i", F.posexplode("row").alias("j", "s")).select("i", F.col("j").cast("long").alias("j"), "s")


def to_rows(matrix: DataFrame) -> DataFrame:
    """Matrix rows (i, row) of a full matrix (i, j, s)."""
    return matrix.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "s"))).alias("x")).select("i", F.col("x.s").alias("row"))


def phylip_distances(matrix: DataFrame, taxa: DataFrame) -> DataFrame:
    """Lines (ix, value) of a distance file: the number of taxa, then label and distances by tabs."""
    body = to_rows(matrix).join(taxa.select(F.col("row_ix").alias("i"), "label"), "i")
    lines = body.select(F.col("i").alias("ix"), F.concat_ws("\t", "label", F.array_join(F.transform("row", lambda x: F.format_string("%.6f", x)), "\t")).alias("value"))
    return taxa.agg(F.count("*").cast("string").alias("value")).select(F.lit(-1).cast("long").alias("ix"), "value").unionByName(lines)


def write_lines(lines: DataFrame, path: str) -> None:
    """Lines (ix, value) as one text file, in their order: files of these kinds are read by single programs."""
    lines.orderBy("ix", "value").coalesce(1).select("value").write.mode("overwrite").text(path)


def frequency_rows(lines: DataFrame) -> DataFrame:
    """(row, col, v) of numeric lines (ix, value); lines that begin with % are remarks."""
    kept = lines.where(~F.trim("value").startswith("%") & (F.trim("value") != ""))
    cells = F.split(F.trim(F.regexp_replace("value", "%.*", "")), r"[\s,;]+")
    return kept.select(F.col("ix").alias("row"), F.posexplode(cells).alias("col", "v")).select("row", F.col("col").cast("long").alias("col"), F.col("v").cast("double").alias("v"))


def expanded(rows: DataFrame, frequency: int) -> DataFrame:
    """Frequency rows (row, col, v) as samples (site, taxon, state): a row as often as its column `frequency` says."""
    states = rows.where(F.col("col") < frequency).select("row", F.col("col").alias("taxon"), F.col("v").cast("int").alias("state"))
    often = rows.where(F.col("col") == frequency).select("row", F.col("v").cast("long").alias("n"))
    copies = often.where("n > 0").select("row", F.explode(F.expr("sequence(1L, n)")).alias("copy"))
    return copies.join(states, "row").select(F.concat_ws("/", "row", "copy").alias("site"), "taxon", "state")
