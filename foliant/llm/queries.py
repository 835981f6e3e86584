"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliant.llm import decontaminate, fill_middle, html_text, language_id, line_crf, oracle, packing, quality_rules, secrets, simhash, suffix_dedup, token_records, toxicity, vector_codes


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_compression_bands": op1,
    "op2_toxicity_lexicon": toxicity.op2,
    "op3_line_blocks": html_text.op3,
    "op4_credential_linking": secrets.op4,
    "op5_suffix_sort": suffix_dedup.op5,
    "op6_winnowing": decontaminate.op6,
    "op7_token_records": token_records.op7,
    "op8_line_crf": line_crf.op8,
    "op9_best_fit_packing": packing.op9,
    "op10_simhash_pigeonhole": simhash.op10,
    "op11_language_bitmasks": language_id.op11,
    "op12_vector_codes": vector_codes.op12,
    "op13_fill_middle": fill_middle.op13,
}
ORACLE_SQL: dict[str, str] = {
    "op4_credential_linking": oracle.SECRETS_SQL,
    "op6_winnowing": oracle.DECONTAMINATE_SQL,
    "op12_vector_codes": vector_codes.VECTOR_CODES_SQL,
}
