"""The queries of this subpackage and their SQL for DuckDB."""

from __future__ import annotations

import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from plumbline.llm import (
    contamination, counts, lines, near, negatives, oracles, packing, pii, quality, ranking, secrets, shards, substrings, toxicity,
)

_ROOT = str(Path(__file__).resolve().parents[2])


def _importable(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query with this repository on the path of the Python workers, wherever the driver was
    started."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        environment = spark.sparkContext.environment
        paths = environment.get("PYTHONPATH", "").split(os.pathsep)
        if _ROOT not in paths:
            environment["PYTHONPATH"] = os.pathsep.join([_ROOT, *filter(None, paths)])
        return query(spark, sf_dir)

    return run


QUERIES = {name: _importable(query) for name, query in {
    "op1_nnpu_toxicity": toxicity.op1_nnpu_toxicity,
    "op2_line_first_cleaning": quality.op2_line_first_cleaning,
    "op3_line_dedup": lines.op3_line_dedup,
    "op4_markov_secrets": secrets.op4_markov_secrets,
    "op5_weak_supervision_pii": pii.op5_weak_supervision_pii,
    "op6_columnwise_substrings": substrings.op6_columnwise_substrings,
    "op7_dart_minhash": near.op7_dart_minhash,
    "op8_perfect_hash_shards": shards.op8_perfect_hash_shards,
    "op9_containment_search": contamination.op9_containment_search,
    "op10_best_fit_packing": packing.op10_best_fit_packing,
    "op11_geometric_blocks": ranking.op11_geometric_blocks,
    "op12_residue_hard_negatives": negatives.op12_residue_hard_negatives,
    "op13_token_counts": counts.op13_token_counts,
    "pipeline": corpus_pipeline.run,
}.items()}

ORACLES: dict[str, str] = {name: sql for name, sql in oracles.SQL.items() if name in QUERIES}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
