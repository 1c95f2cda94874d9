"""The registered queries of this subpackage, with production parameters."""

from __future__ import annotations

import importlib.util
import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    decontaminate,
    fingerprints,
    jaccard_join,
    language_model,
    license_scan,
    line_dedup,
    merkle,
    pii,
    piece_sampling,
    quality,
    repair,
    token_counts,
    toxicity,
)
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def _documents(report: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: report(table(spark, sf_dir, "documents"))


def _pipeline_module():
    """corpus_pipeline.py lies beside the package, wherever that is."""
    name = "corpus_pipeline"
    if name not in sys.modules:
        top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        spec = importlib.util.spec_from_file_location(name, os.path.join(top, f"{name}.py"))
        module = importlib.util.module_from_spec(spec)
        sys.modules[name] = module
        spec.loader.exec_module(module)
    return sys.modules[name]


QUERIES: dict[str, Query] = {
    "op1_piece_sampling": _documents(piece_sampling.sampling_report),
    "op2_line_dedup": _documents(line_dedup.line_report),
    "op3_fingerprints": _documents(fingerprints.neighbour_report),
    "op4_decontamination": lambda spark, sf_dir: decontaminate.leak_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
    "op5_license_scan": _documents(license_scan.license_report),
    "op6_token_counts": _documents(token_counts.token_report),
    "op7_language_model": _documents(language_model.score_report),
    "op8_pii": _documents(pii.surrogate_report),
    "op9_jaccard_join": _documents(jaccard_join.jaccard_report),
    "op10_toxicity": lambda spark, sf_dir: toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op11_conversation_repair": lambda spark, sf_dir: repair.repair_report(table(spark, sf_dir, "conversations")),
    "op12_quality": lambda spark, sf_dir: quality.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op13_merkle_manifest": _documents(merkle.manifest_report),
}

SQL: dict[str, str] = {
    "op2_line_dedup": line_dedup.SQL,
    "op9_jaccard_join": jaccard_join.SQL,
    "op11_conversation_repair": repair.SQL,
    "op13_merkle_manifest": merkle.SQL,
}


def all_queries() -> dict[str, Query]:
    return {**QUERIES, "pipeline": lambda spark, sf_dir: _pipeline_module().run(spark, sf_dir)}


def all_sql() -> dict[str, str]:
    return dict(SQL)
