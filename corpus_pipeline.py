"""A training-corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept,
and returns a DataFrame that is written as Parquet and read again for the next one.
All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockweave.llm import decontaminate, line_quality, mixing, near_dedup, secrets
from blockweave.llm.common import checkpoint_folder, delete_folder, read


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or are depleted by lines that many documents of their host share, go; such lines go from the others."""
    return line_quality.clean(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word shingle similarity 0.8 or more stays."""
    return near_dedup.dedupe(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten words in a row of a benchmark item go."""
    return decontaminate.remove(docs, read(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are masked, and n_chars follows; no document goes."""
    return secrets.redact(docs, secrets.train(docs), length_col="n_chars")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix, with size, source_size, target and the words taken."""
    return mixing.mix(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scan", secret_scan),
    ("source mix", source_mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; what lies between them goes to the shared folder, and what a later stage replaced is deleted."""
    docs = read(spark, sf_dir, "documents")
    at = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{at}/{k}")
            docs = spark.read.parquet(f"{at}/{k}")
            if k:
                delete_folder(spark, f"{at}/{k - 1}")
    return docs


#: Similarity groups and a trained field aren't SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None
