"""A corpus pipeline: five stages over documents, each on all that the one before has kept.

quality classifier  drops the documents that it rejects
language ID         drops those without a language, with none that is likely, and those whose
                    letters the likeliest one can't explain: gibberish, scripts not learnt
near duplicates     keeps one document of each group, the one with the smallest id
secret scans        replaces secrets in the text by a mark
packing             gives the pieces of training sequences

Null and empty texts have no language, so the second stage drops them.  Where ids are null
or repeat, documents are told apart by row, so that texts which differ stay.  Columns other
than doc_id, text and lang may have any names; n_chars is brought up to date where it is
there.  Empty documents give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkclade import attach
from sparkclade.llm import jaccard, langid, packing, quality_gbt, secrets
from sparkclade.llm.common import fresh, released, remove, scratch, small, table, written
from sparkclade.llm.queries import tokenizer

#: Least probability of the likeliest language.
LIKELY = 0.5
#: Least margin of that language over random letters, in nats for each letter.  Measured: learnt
#: languages 1 to 2, related ones that were not learnt -1 to -3, random letters below -5.
MARGIN = -3.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    trees = quality_gbt.train(docs, table(spark, sf_dir, "labels"), ~quality_gbt.held_out())
    score, predicted = fresh(docs, "score", "predicted")
    return quality_gbt.predict(docs, trees, docs.columns, names=(score, predicted)).where(F.col(predicted) == 1).select(*_all(docs))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.train(docs, ~langid.held_out(), tokenizer("byte_bpe_multi_50k.tiktoken"))
    lang, score, margin = fresh(docs, "lang_pred", "score", "margin")
    found = langid.predict(docs, model, docs.columns, added=(lang, score, margin))
    return found.where((F.col(lang) != "und") & (F.col(score) >= LIKELY) & (F.col(margin) >= MARGIN)).select(*_all(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    if docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("doc_id is null or n > 1").isEmpty():
        others = jaccard.join(docs).where("doc_id <> component_id").select("doc_id")
        return docs.join(small(written(others)), "doc_id", "left_anti").select(*_all(docs))
    # The numbers are written with the rows, so that a lost task can't deal them anew.
    (row,) = fresh(docs, "row")
    rows = written(docs.select("*", F.monotonically_increasing_id().alias(row)))
    others = jaccard.join(rows, row).where(F.col(row) != F.col("component_id")).select(row)
    return rows.join(small(written(others)), row, "left_anti").select(*_all(docs))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secrets.redact(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*_all(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"))


def _all(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


STAGES = [("quality classifier", quality), ("language ID", language), ("n-gram Jaccard join", near_duplicates), ("secret scans", secret_scan), ("packing", pack)]

#: SQL can express neither the models nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what the stages wrote for themselves, and each stage's input, is deleted once it has been used."""
    attach(spark)
    docs, used = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        path = scratch(spark)
        with released(spark):
            found = stage(spark, docs, sf_dir)
            found.write.option("compression", "zstd").parquet(path)
        if used:
            remove(spark, used)
        docs, used = spark.read.schema(found.schema).parquet(path), path
    return docs
