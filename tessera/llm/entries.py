"""The queries of this subpackage, by the names under which they are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Name -> (module of this subpackage, its query function).
_QUERIES = {
    "op1_url_filter": ("url_filter", "query"),
    "op2_decontaminate": ("decontaminate", "query"),
    "op3_bpe": ("bpe", "query"),
    "op4_ngram_join": ("ngram_join", "query"),
    "op5_warc": ("warc", "query"),
    "op6_lm_score": ("pitman_yor", "query"),
    "op7_language_id": ("langid", "query"),
    "op8_substring_dedup": ("substring_dedup", "query"),
    "op9_pii": ("pii", "query"),
    "op10_quality": ("quality", "query"),
    "op11_filter_audit": ("filter_audit", "query"),
    "op12_simhash": ("simhash", "query"),
    "op13_resample": ("resampling", "query"),
}


def _lazy(module: str, function: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from importlib import import_module

        return getattr(import_module(f"tessera.llm.{module}"), function)(spark, sf_dir)

    return run


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _lazy(*place) for name, place in _QUERIES.items()} | {"pipeline": _pipeline}


def oracle_sql() -> dict[str, str]:
    from tessera.llm import filter_audit, substring_dedup, warc

    return {"op5_warc": warc.ORACLE_SQL, "op8_substring_dedup": substring_dedup.ORACLE_SQL, "op11_filter_audit": filter_audit.ORACLE_SQL}
