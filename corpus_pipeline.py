"""The corpus pipeline: stages applied in order to ``documents``, each written and read again.

Defined cases: a null or empty text has no words and is rejected by the rules; rows of null ids are rows like any
other. Rows of one id and different texts are different documents; of a class of near copies one row stays, the one
of smallest id (null ids last), ties by a digest of the text and of the row; rows equal in all columns are one. Equal
texts get equal verdicts and equal marks. Very long texts are read in slices and packed as several pieces. Further
columns pass all stages but the last unchanged, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from claimloom.llm import packing, pii, quality_classifier, quality_rules, simhash
from claimloom.llm.common import documents, stored


def _quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier keeps; toxic words are learnt from a bounded sample of labels."""
    return quality_classifier.kept_documents(docs, labels=spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current rule policy keeps."""
    return quality_rules.kept_documents(docs)


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, the one of smallest id.

    Candidates are the SimHash links of five-word shingles and, as those alone miss most copies, sets that share minimum
    hashes; each is verified: similarity 0.8 or more.
    """
    return simhash.one_of_each(docs)


def _personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with identifiers marked and disclosing terms generalised or removed."""
    return pii.sanitised(docs)


def _packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bin and place of every piece of the documents that are left."""
    return packing.packed(docs)


STAGES = [
    ("quality_classifier", _quality_classifier),
    ("quality_rules", _quality_rules),
    ("simhash", _near_duplicates),
    ("pii", _personal_data),
    ("packing", _packing),
]
#: EM, component search and packing have no SQL form; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents`` of a data folder."""
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = out if i == len(STAGES) - 1 else stored(out)
    return docs
