"""The corpus pipeline: documents through quality rules, near-duplicate removal, decontamination, secret redaction and mixing.

Every stage takes what its predecessor kept. All but the last return the columns of
``documents``; the last adds the cell's weight and how often each document is to be
seen. A stage without input rows gives none.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.llm import bottom_k, line_frequency, mixing, secret_scan, templates
from tapeworks.session import work_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line-frequency rules reject go."""
    return line_frequency.without_rejected(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group stays."""
    return bottom_k.without_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, also with other numbers or names, go."""
    return templates.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets become their kind in brackets; every document stays."""
    clean = secret_scan.without_secrets(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn to the target weights of source, language and topic."""
    drawn = mixing.mix_to_targets(docs, keep=tuple(docs.columns)).where("kept")
    return drawn.select(*(F.col(f"kept_{c}").alias(c) for c in docs.columns), "topic", "cell_weight", "copies")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("secrets", secrets), ("mix", mix)]

#: No SQL for all five: byte-pair vocabularies and Unicode templates are out of its reach. The tests hold run() against its operators, one after the other; each operator is held against brute force on its own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written as Parquet to the shared folder and read again."""
    path = f"{sf_dir}/documents.parquet"
    home = f"{work_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, spark.read.parquet(path), sf_dir).write.parquet(path := f"{home}/{k}-{name}")
    return spark.read.parquet(path)
