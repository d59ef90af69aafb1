"""Queries of the training-data operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterframe.llm import (ann, decontamination, jaccard_join, license_scan, line_dedup, lm_scoring, mixing, oracles, pii,
                            sharding, toxicity, turn_repair, turn_trie, viterbi_counts)
from meterframe.llm.common import table
from meterframe.llm.pipeline_stages import LEVELS, SHARDS, WEIGHTS, domain

#: Place of the tokenizer's vocabulary; a parameter of op3.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


@register("op1_decontamination", oracles.DECONTAMINATION)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@register("op2_lm_scoring")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_documents(table(spark, sf_dir, "documents"))


@register("op3_token_counts")
def op3(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    return viterbi_counts.count_tokens(table(spark, sf_dir, "documents"), viterbi_counts.read_vocabulary(vocabulary))


@register("op4_sharding")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), [1.0] * SHARDS)


@register("op5_jaccard_join", oracles.JACCARD)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.link_components(table(spark, sf_dir, "documents"), 4, 85, 100)
    return found.select("doc_id", "n_shingles", "component_id")


@register("op6_pii")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.personal_data(table(spark, sf_dir, "documents")))


@register("op7_toxicity")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op8_mixing", oracles.MIXING)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source").withColumn("domain", domain())
    chosen = mixing.choose(docs, mixing.Mix(LEVELS, WEIGHTS, share=0.5, max_epochs=2))
    return chosen.select("doc_id", "domain", "lang", "source", "epoch", "n_tokens", "take_tokens")


@register("op9_ann")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ann.usable(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return ann.neighbours(rows, rows.where(F.col("vec_id") % 20 == 0), k=20)


@register("op10_line_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"))


@register("op11_license_scan", oracles.LICENSES)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.licenses(table(spark, sf_dir, "documents"))


@register("op12_structure_repair")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repair(turn_repair.damaged(table(spark, sf_dir, "conversations")))


@register("op13_prefix_trie")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_trie.prefix_trie(table(spark, sf_dir, "conversations"))
