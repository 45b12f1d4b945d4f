"""A corpus pipeline of five operators: each stage takes what its predecessor kept.

quality_rules        rejected documents go
near_dedup           one document of each near-duplicate component stays
decontaminate        words inside benchmark windows are cut; a document with nothing else left goes
pii                  spans become their kind in brackets
sentencepiece        up to two sampled segmentations a document: ids, log probability, inclusion score

All but the last return the columns of documents, with n_chars kept true to the text where there is such a column.

Edge cases, stage by stage (the operators' docstrings have the rest):
null, empty and blank texts fail quality_rules, as they have fewer than 10 words; near_dedup by itself keeps them, decontaminate
drops them, pii leaves them as they are and sentencepiece gives them one row without pieces.
Very long texts pass whole. Null ids pass all stages (near_dedup cannot link them and keeps them); a null or missing language
is one of its own. Of repeated rows and of equal similarity near_dedup keeps one row, with the least id, then the least text;
other stages judge each row. An empty table gives empty ones. Extra columns pass, whatever their names, up to sentencepiece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starweave.llm import decontaminate, neardup, pii, quality, segment
from starweave.llm.scratch import materialize, table


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.dedup(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))).where(F.col("text").rlike(r"\S"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(pii.redact(docs))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return segment.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontaminate", benchmark_decontamination),
    ("pii", personal_data),
    ("sentencepiece", sentencepiece),
]

#: Sampling and JSD references are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
