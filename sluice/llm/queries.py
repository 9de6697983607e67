"""One query for each corpus operator, with production parameters over the whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sluice.llm import align, ann, html, katz, linededup, mixing, ngramjoin, packing, pii, quality, secrets, trie, unitdedup
from sluice.llm.common import read


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(read(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(read(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.report(read(spark, sf_dir, "documents"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(read(spark, sf_dir, "pages"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.report(read(spark, sf_dir, "documents"))


def op8_unit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unitdedup.report(read(spark, sf_dir, "documents"), windows=True)


def unit_dedup_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator with lines as units and no least length: of every line all later occurrences go."""
    return unitdedup.report(read(spark, sf_dir, "documents"), by="line", min_unit=1, min_run=1)


def op3_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read(spark, sf_dir, "embeddings"))


def op5_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(read(spark, sf_dir, "documents"))


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(read(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(read(spark, sf_dir, "conversations"))


def op13_galloping_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.report(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_rules, op2_line_dedup, op3_adaptive_scan, op4_ngram_jaccard_join, op5_katz_backoff, op6_html_extraction, op7_secret_scan, op8_unit_dedup, op9_best_fit_packing, op10_source_mixing, op11_personal_data, op12_prefix_trie, op13_galloping_alignment, unit_dedup_lines)}


def oracle_sql() -> dict[str, str]:
    from sluice.llm.oracles import ORACLES

    return dict(ORACLES)
