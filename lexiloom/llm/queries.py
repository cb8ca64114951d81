"""Queries of this subpackage, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexiloom.llm.decontamination import LEAKS_SQL
from lexiloom.llm.source_audit import AUDIT_SQL
from lexiloom.llm.source_mix import MIX_SQL
from lexiloom.session import table


def op1_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexiloom.llm.pitman_yor import score_texts

    return score_texts(table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexiloom.llm.licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexiloom.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexiloom.llm.substrings import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexiloom.llm.quality_model import score_quality

    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexiloom.llm.language_id import identify

    return identify(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexiloom.llm.decontamination import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexiloom.llm.quality_rules import quality_verdicts

    judged = quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


def op9_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexiloom.llm.warc import build_derivatives, read_warc_files, responses_of_pages, warc_files

    return build_derivatives(read_warc_files(warc_files(responses_of_pages(table(spark, sf_dir, "pages")))))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lexiloom.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexiloom.llm.source_audit import source_audit

    return source_audit(table(spark, sf_dir, "documents"))


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexiloom.llm.source_mix import mixed_documents

    return mixed_documents(table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexiloom.llm.spelling import spelling_variants

    return spelling_variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pitman_yor": op1_pitman_yor,
    "op2_license_scan": op2_license_scan,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_language_id": op6_language_id,
    "op7_decontamination": op7_decontamination,
    "op8_quality_rules": op8_quality_rules,
    "op9_warc_derivatives": op9_warc_derivatives,
    "op10_packing": op10_packing,
    "op11_source_audit": op11_source_audit,
    "op12_source_mix": op12_source_mix,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLES: dict[str, str] = {"op7_decontamination": LEAKS_SQL, "op11_source_audit": AUDIT_SQL, "op12_source_mix": MIX_SQL}
