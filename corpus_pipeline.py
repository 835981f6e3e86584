"""The corpus pipeline: quality, near-duplicates, contamination, secrets, packing.

Every stage takes the documents that its predecessor kept, written as Parquet
and read again, and its decisions take effect: rejected, duplicate and
contaminated documents go, secrets are blanked, and the last stage packs what
is left into token sequences.

Null and empty texts fail the quality rules, so they go at once; very long texts
are judged and packed whole. Rows without an id pass the near-duplicate stage, as
nothing names them as copies of one another; of rows that repeat an id and its text
one stays, of a group of near copies the row of the smallest id, then (ties) of the
smallest text hash. Benchmark items without words contaminate nothing. Columns of
any other names, also those that operators use themselves, are handed on untouched
up to the last stage, whose columns are its own. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliant.llm import decontaminate, packing, quality_rules, secrets, simhash
from foliant.session import discard, scratch_made, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(docs)


STAGES = [
    ("quality rules", quality),
    ("simhash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("best-fit packing", pack),
]
#: SQL has neither zstandard nor the tokenizer; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before = scratch_made()
        kept = written(stage(spark, docs, sf_dir), "stage")
        discard(*(scratch_made(before) - {kept._scratch}), *([docs] if hasattr(docs, "_scratch") else []))
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
