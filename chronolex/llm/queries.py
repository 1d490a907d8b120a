"""One query per training-data operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from . import audit, bpe, decontaminate, golden, html_text, jaccard, langid, media, neighbours, oracles, quality, repeats, secrets, toxicity
from .common import importable, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

VOCABULARY = "word_bpe_49k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(name: str, oracle: str | None = None):
    """Register a query, with its DuckDB SQL where there is one."""

    def register(f):
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            importable(spark)
            return f(spark, sf_dir)

        QUERIES[name] = run
        if oracle:
            ORACLE[name] = oracle
        return run

    return register


@query("op3_bpe_round_trip")
def op3_bpe_round_trip(spark, sf_dir):
    return bpe.digests(bpe.encode(table(spark, sf_dir, "documents"), vocabulary_path()))


@query("op10_benchmark_decontamination", oracles.DECONTAMINATION)
def op10_benchmark_decontamination(spark, sf_dir):
    return decontaminate.report(decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


@query("op9_quality_scores")
def op9_quality_scores(spark, sf_dir):
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op2_toxicity_grades")
def op2_toxicity_grades(spark, sf_dir):
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op5_language_id")
def op5_language_id(spark, sf_dir):
    return langid.report(table(spark, sf_dir, "documents"))


@query("op1_media_sequences")
def op1_media_sequences(spark, sf_dir):
    return media.report(table(spark, sf_dir, "documents"))


@query("op8_page_main_text")
def op8_page_main_text(spark, sf_dir):
    return html_text.report(table(spark, sf_dir, "pages"))


@query("op4_secret_scan")
def op4_secret_scan(spark, sf_dir):
    return secrets.report(table(spark, sf_dir, "documents"))


@query("op7_jaccard_components", oracles.JACCARD)
def op7_jaccard_components(spark, sf_dir):
    return jaccard.join_components(table(spark, sf_dir, "documents"))


@query("op6_repeat_removal", oracles.REPEATS)
def op6_repeat_removal(spark, sf_dir):
    return repeats.report(table(spark, sf_dir, "documents"))


@query("op11_filter_interactions", oracles.INTERACTIONS)
def op11_filter_interactions(spark, sf_dir):
    return audit.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op12_nearest_vectors")
def op12_nearest_vectors(spark, sf_dir):
    return neighbours.report(table(spark, sf_dir, "embeddings"))


@query("op13_golden_records", oracles.GOLDEN)
def op13_golden_records(spark, sf_dir):
    return golden.golden(table(spark, sf_dir, "clients"))
