"""From raw documents to packed training sequences, in five stages of ``watchspan.llm``.

Each stage takes the rows its predecessor kept, as Parquet, and returns the columns of ``documents``; the last one
returns the pieces of packed sequences. Rejected documents, all but one of each group linked by five-word shingle sets
with a Jaccard similarity of 0.8 or more, and documents that hold a benchmark item go; secrets are masked in the text.
What the operators define for nulls, empty and very long texts, ties, repeated rows, empty tables and further columns
holds here; of exactly repeated rows one stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from watchspan.llm.common import keep, table
from watchspan.llm.decontaminate import clean
from watchspan.llm.packing import op9_best_fit_packing
from watchspan.llm.quality import keep_good
from watchspan.llm.secret_scan import redact, scan
from watchspan.llm.shingles import similar_groups
from watchspan.llm.simhash import one_per_group


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, table(spark, sf_dir, "labels", ["doc_id", "quality"]))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_per_group(docs, similar_groups)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean(docs, table(spark, sf_dir, "benchmark", ["item_id", "text"]))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(scan(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op9_best_fit_packing(spark, sf_dir, docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("secrets", secrets), ("packing", packing)]

#: Learned rules, fingerprints, edit distances and token ids are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
