"""The thin queries opN_<name>: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat_format, clustering, exact_dedup, html_text, lm_score, mixing, near_dedup, phrases, pii, quality, secret_scan, simhash
from .common import table


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = secret_scan.scan(table(spark, sf_dir, "documents"))
    return secret_scan.digests(found)


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    k = F.col("id")
    planted = spark.range(0, 2, 1, 1).select(F.lit(-7).cast("long").alias("conv_id"), k.alias("turn"), F.when(k == 0, "user").otherwise("assistant").alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text"))
    return chat_format.read_back(chat_format.segments(chat_format.events_of_turns(rows.unionByName(planted))))


#: Vocabulary of the public tokenizer that op3 uses.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode(table(spark, sf_dir, "documents"), TOKENIZER))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.components(table(spark, sf_dir, "documents"), shingle=4, percent=80)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"))


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.lloyd(table(spark, sf_dir, "embeddings"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(table(spark, sf_dir, "documents"), shingle=3, radius=2)


QUERIES = {
    "op1_lm_score": op1_lm_score,
    "op2_mixing": op2_mixing,
    "op5_near_dedup": op5_near_dedup,
    "op3_bpe": op3_bpe,
    "op4_chat_format": op4_chat_format,
    "op6_html_text": op6_html_text,
    "op9_secret_scan": op9_secret_scan,
    "op10_pii": op10_pii,
    "op7_quality_rules": op7_quality_rules,
    "op8_exact_dedup": op8_exact_dedup,
    "op11_clusters": op11_clusters,
    "op12_collocations": op12_collocations,
    "op13_simhash": op13_simhash,
}
ORACLE_SQL = {
    "op4_chat_format": chat_format.ORACLE,
    "op8_exact_dedup": exact_dedup.ORACLE,
    "op11_clusters": clustering.oracle(),
    "op12_collocations": phrases.ORACLE,
}
