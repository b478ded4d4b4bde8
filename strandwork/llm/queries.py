"""The corpus operators' registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import read_table
from .decontam import leaks
from .html_extract import extract
from .jaccard_join import jaccard_classes
from .licenses import scan_licenses
from .oracles import OP5, OP6
from .packing import pack
from .secrets import secret_digest
from .sentence_spans import drop_repeated_spans
from .syncmers import fingerprints
from .toxicity import toxicity_scores
from .url_filter import url_verdicts


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(read_table(spark, sf_dir, "documents"))


def op3_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read_table(spark, sf_dir, "documents"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read_table(spark, sf_dir, "documents"))


def op5_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(read_table(spark, sf_dir, "pages"))


def op6_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(read_table(spark, sf_dir, "documents"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op9_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_spans(read_table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_toxicity,
        op2_jaccard_join,
        op3_syncmer_fingerprints,
        op4_licenses,
        op5_url_verdicts,
        op6_secret_ledger,
        op7_html_extraction,
        op8_decontamination,
        op9_sentence_spans,
        op10_packing,
    )
}

ORACLE_SQL: dict[str, str] = {op5_url_verdicts.__name__: OP5, op6_secret_ledger.__name__: OP6}
