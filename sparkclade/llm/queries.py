"""The registered queries of the operators in this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkclade.llm import bpe, embeddings, jaccard, langid, licenses, oracles, packing, quality_gbt, quality_rules, secrets, sharding
from sparkclade.llm.common import table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = sharding.shard(rows, ["doc_id", "size", "text_crc32"], 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs, ~langid.held_out(), tokenizer("byte_bpe_multi_50k.tiktoken"))
    return langid.predict(docs, model, ["doc_id"]).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trees = quality_gbt.train(docs, table(spark, sf_dir, "labels"), ~quality_gbt.held_out())
    return quality_gbt.predict(docs, trees, ["doc_id"]).select("doc_id", quality_gbt.held_out().alias("held_out"), "score", "predicted")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.dedup(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_sharding, op2_language_id, op3_packing, op7_quality_classifier, op8_license_scan, op9_byte_bpe, op10_embedding_dedup)}


def _canonical_sql(text: str) -> str:
    out = f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    for pattern, to in licenses.canonical_steps():
        out = f"regexp_replace({out}, '{pattern}', '{to}', 'g')"
    return f"trim({out}, ' ')"


def _op8_sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in licenses.KNOWN.items())
    return f"""
        WITH known AS (SELECT sha256({_canonical_sql('text')}) AS digest, min(license_id) AS license_id FROM (VALUES {values}) v(license_id, text) GROUP BY 1),
        forms AS (SELECT doc_id, {_canonical_sql('text')} AS form FROM documents),
        hashed AS (SELECT doc_id, CASE WHEN form <> '' THEN sha256(form) END AS digest FROM forms)
        SELECT doc_id, h.digest, license_id FROM hashed h LEFT JOIN known k ON h.digest = k.digest"""


ORACLE_SQL = {"op4_secret_scan": oracles.secret_scan(), "op5_ngram_jaccard": oracles.ngram_jaccard(), "op6_quality_rules": oracles.quality(), "op8_license_scan": _op8_sql(), "op10_embedding_dedup": oracles.embedding_dedup()}


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judge(table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.round(c, 6) for c in ("char_distance", "word_distance")})


QUERIES["op6_quality_rules"] = op6_quality_rules


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


QUERIES["op4_secret_scan"] = op4_secret_scan


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


QUERIES["op5_ngram_jaccard"] = op5_ngram_jaccard
