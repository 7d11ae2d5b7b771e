"""The driver's queries over the corpus operators: one per operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm import bpe, language_model, media, packing, pii, quality_classifier, quality_rules, sharding, simhash, token_files
from claimloom.llm.common import documents


def op1_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posteriors, score and verdict of the weak-label classifier for every document."""
    return quality_classifier.classify(documents(spark, sf_dir), labels=spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_simhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate class of every document."""
    return simhash.classes(documents(spark, sf_dir))


def op3_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements, failure bits and the current policy's verdict for every document."""
    return quality_rules.ledger(documents(spark, sf_dir))


def op4_byte_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's token ids and of the text decoded from them."""
    return bpe.round_trip(documents(spark, sf_dir), bpe.default_path())


def op5_pfor_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start, length and checksum of every document's ids, as read back from the token files."""
    return token_files.token_index(documents(spark, sf_dir))


def op6_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probabilities of every document under the interpolated trigram model and the add-one base."""
    return language_model.scores(documents(spark, sf_dir))


def op7_avi_motion_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every text stored as motion-JPEG and read back, and its shots."""
    return media.described(documents(spark, sf_dir))


def op8_balanced_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document."""
    return sharding.sharded(documents(spark, sf_dir))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bin and place of every piece of every document; documents of one near-duplicate class (op2's) share no bin."""
    cost = F.octet_length(F.coalesce("text", F.lit(""))) + 1
    rows, cluster = simhash.clustered(documents(spark, sf_dir).select("doc_id", "source", "text", cost.alias("cost")))
    return packing.packed(rows, cluster_col=cluster, cost_col="cost")


def op10_information_theoretic_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All spans of personal data and of disclosing terms in every document."""
    return pii.spans(documents(spark, sf_dir))


QUERIES = {
    "op1_weak_label_quality": op1_weak_label_quality,
    "op2_simhash_classes": op2_simhash_classes,
    "op3_rule_ledger": op3_rule_ledger,
    "op4_byte_bpe_round_trip": op4_byte_bpe_round_trip,
    "op5_pfor_token_files": op5_pfor_token_files,
    "op6_deleted_interpolation": op6_deleted_interpolation,
    "op7_avi_motion_jpeg": op7_avi_motion_jpeg,
    "op8_balanced_label_propagation": op8_balanced_label_propagation,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_information_theoretic_pii": op10_information_theoretic_pii,
}
ORACLES = {"op3_rule_ledger": quality_rules.ORACLE_SQL}
