"""The operators' registered queries, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import licence_scan, quality_rules, repeats
from foliospark.llm.common import table


def byte_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliospark.llm.html_extract import extract

    return extract(table(spark, sf_dir, "pages"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliospark.llm.mixing import mix

    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.to_json("copies").alias("copies"))


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.repeated_documents(table(spark, sf_dir, "documents"))
    return found.withColumn("passages", F.to_json("passages"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliospark.llm.token_files import token_files

    return token_files(table(spark, sf_dir, "documents"), byte_bpe_path())


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliospark.llm.decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_scan.licence_scan(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliospark.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), byte_bpe_path())


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliospark.llm.language_id import identify

    return identify(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = quality_rules.quality_rules(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliospark.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_mixing": op2_mixing,
    "op3_repeats": op3_repeats,
    "op4_token_files": op4_token_files,
    "op5_decontamination": op5_decontamination,
    "op6_licence_scan": op6_licence_scan,
    "op7_token_counts": op7_token_counts,
    "op8_language_id": op8_language_id,
    "op9_quality_rules": op9_quality_rules,
    "op10_simhash": op10_simhash,
}

ORACLES: dict[str, str] = {
    "op3_repeats": repeats.oracle(),
    "op6_licence_scan": licence_scan.oracle(),
    "op9_quality_rules": quality_rules.oracle(),
}
