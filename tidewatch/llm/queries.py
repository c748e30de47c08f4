"""The registered queries of this folder."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm import decontaminate, licenses, mixing, neighbours, quality, runs, sharding
from tidewatch.llm import simhash, spelling, surrogates, syncmers, tokens, toxicity
from tidewatch.llm.common import table
from tidewatch.llm.sql import LICENSE_SQL, MIX_SQL

DEMO_KEY = "surrogate key of the registered query"


def _documents(run):
    return lambda spark, sf_dir: run(table(spark, sf_dir, "documents"))


def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def all_queries():
    return {
        "op1_license_scan": _documents(licenses.scan_licenses),
        "op2_simhash_near_dedup": _documents(simhash.near_duplicates),
        "op3_token_counts": _documents(tokens.count_tokens),
        "op4_toxicity": toxicity_scores,
        "op5_syncmer_fingerprints": _documents(syncmers.fingerprints),
        "op6_pii_surrogates": _documents(lambda docs: surrogates.replace_personal_data(docs, DEMO_KEY)),
        "op7_decontamination": lambda spark, sf_dir: decontaminate.benchmark_overlaps(
            table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
        ),
        "op8_resharding": _documents(sharding.reshard),
        "op9_source_mixing": _documents(mixing.mix),
        "op10_quality": quality_scores,
        "op11_periodic_runs": _documents(runs.run_digests),
        "op12_spelling_variants": _documents(spelling.spelling_variants),
        "op13_nearest_neighbours": lambda spark, sf_dir: neighbours.nearest_neighbours(table(spark, sf_dir, "embeddings")),
        "pipeline": corpus_pipeline.run,
    }


def all_sql() -> dict[str, str]:
    given = {"op1_license_scan": LICENSE_SQL, "op9_source_mixing": MIX_SQL}
    if corpus_pipeline.ORACLE_SQL:
        given["pipeline"] = corpus_pipeline.ORACLE_SQL
    return given
