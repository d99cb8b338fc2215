"""Queries over the text operators, and the same in SQL where it can be said."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gustline.llm import (decontamination, lexical_search, main_text, mixing, ngram_join, prefix_forest, quality, repeats, sharding, sql,
                          token_files, toxicity, url_rules, word_runs)
from gustline.llm.common import table
from gustline.session import ship_package

Run = Callable[[SparkSession, str], DataFrame]


def tokenizer_path() -> str:
    """The byte-level vocabulary that the token queries use."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def _utc(run: Run) -> Run:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        ship_package(spark)
        return run(spark, sf_dir)

    return query


QUERIES: dict[str, Run] = {
    "op1_decontamination": lambda spark, d: decontamination.report(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op2_url_rules": lambda spark, d: url_rules.judged_urls(table(spark, d, "pages"), url_rules.rule_table(spark)),
    "op3_repeated_strings": lambda spark, d: repeats.report(table(spark, d, "documents")),
    "op4_ngram_join": lambda spark, d: ngram_join.report(table(spark, d, "documents")),
    "op5_hilbert_shards": lambda spark, d: sharding.shard_report(table(spark, d, "documents")),
    "op6_toxicity": lambda spark, d: toxicity.scored(table(spark, d, "documents"), table(spark, d, "labels")),
    "op7_token_files": lambda spark, d: token_files.report(table(spark, d, "documents"), tokenizer_path()),
    "op8_main_text": lambda spark, d: main_text.extract(table(spark, d, "pages")),
    "op9_quality_cascade": lambda spark, d: quality.report(table(spark, d, "documents")),
    "op10_source_mix": lambda spark, d: mixing.report(spark, table(spark, d, "documents")),
    "op11_lexical_search": lambda spark, d: lexical_search.report(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op12_prefix_forest": lambda spark, d: prefix_forest.report(table(spark, d, "embeddings")),
    "op13_word_runs": lambda spark, d: word_runs.report(table(spark, d, "documents")),
}

SQL: dict[str, str] = {
    "op1_decontamination": sql.DECONTAMINATION,
    "op2_url_rules": sql.URL_RULES,
    "op9_quality_cascade": sql.QUALITY,
    "op11_lexical_search": sql.LEXICAL_SEARCH,
}


def queries() -> dict[str, Run]:
    return {name: _utc(run) for name, run in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
