"""The queries that apply each operator to its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectramesh.llm import decontaminate, hardnegatives, langid, licenses, multiset, oracles, packing, reshard, simhash, tokens, toxicity, urlfilter, vectorcodes, vptree
from spectramesh.llm.common import ship

SHARDS, SEQUENCE, END_ID = 40, 4096, 2
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshard.shard_documents(table(spark, sf_dir, "documents"), SHARDS)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, manifest = tokens.write_files(table(spark, sf_dir, "documents"), vocabulary(), END_ID)
    return tokens.read_files(manifest)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "item_id", "matched", "window")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_documents(table(spark, sf_dir, "documents"))


def op8_vptree_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary(), END_ID, SEQUENCE)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.link_documents(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardnegatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.code_vectors(table(spark, sf_dir, "embeddings"))


def op13_multiset_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset.fingerprint_documents(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_reshard, op2_token_files, op3_language_id, op4_toxicity, op5_url_filter, op6_decontamination, op7_license_scan, op8_vptree_neighbours, op9_packing, op10_simhash, op11_hard_negatives, op12_vector_codes, op13_multiset_fingerprints)}
#: Trained text models, ids of a tokenizer library, files and XXH64 can't be said in SQL; tests compare those with brute-force versions.
ORACLES: dict[str, str] = {"op5_url_filter": oracles.url_filter(RULES), "op6_decontamination": oracles.decontamination(), "op7_license_scan": oracles.scan(), "op8_vptree_neighbours": oracles.neighbours(), "op11_hard_negatives": oracles.hard_negatives(), "op12_vector_codes": oracles.vector_codes()}
