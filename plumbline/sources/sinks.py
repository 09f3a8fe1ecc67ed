"""Prepared data with its manifest, and report tables."""

from __future__ import annotations

import json
import os
from urllib.parse import urlparse

from pyspark.sql import DataFrame, functions as F

from plumbline.functions.columns import data_fields
from plumbline.functions.local import local_frame
from plumbline.plans.context import UsageContext
from plumbline.plans.evaluate import Evaluation
from plumbline.plans.recipe import Recipe, plain_value

BYTE_ORDER_MARK = "\ufeff"


def _location(path: str) -> str:
    return os.path.normpath(urlparse(path).path)


def manifest(source: str, output: str, original: DataFrame, prepared: DataFrame, recipe: Recipe,
             context: UsageContext, comparison: DataFrame | None = None,
             metadata: DataFrame | None = None) -> str:
    """The preparation record as JSON. NaN is refused."""
    body = {
        "source": source, "output": output,
        "original_rows": original.count(), "prepared_rows": prepared.count(),
        "context": context.as_dict(), "steps": recipe.records(),
        # One row per dimension.
        "comparison": [r.asDict() for r in comparison.collect()] if comparison else None,
        "source_metadata": [
            json.loads(r[0]) for r in metadata.select(F.to_json(F.struct("*"))).collect()
        ] if metadata else [],
        "metadata_note": "The metadata describes the source; review units and categories after preparation.",
        "scaling_note": "Fit on training data only and reuse the parameters for validation and test data.",
    }
    return json.dumps(body, ensure_ascii=False, allow_nan=False, default=plain_value)


def write_prepared(original: DataFrame, recipe: Recipe, path: str, context: UsageContext,
                   source: str = "", comparison: DataFrame | None = None,
                   metadata: DataFrame | None = None) -> tuple[str, str]:
    """Write the prepared table as .csv (UTF-8 with byte order mark) or .parquet, without
    the row identity, and the manifest beside it.

    Never overwrites: an existing output or one of the inputs is an error. The manifest
    is built and written first, so bad parameters cannot leave data without a record.
    """
    root, extension = os.path.splitext(path.rstrip("/"))
    if extension.lower() not in (".csv", ".parquet"):
        raise ValueError("Choose a .csv or .parquet output.")
    prepared = recipe.apply(original)
    inputs = {_location(f) for f in original.inputFiles()}
    if any(f == _location(path) or f.startswith(_location(path) + "/") for f in inputs):
        raise ValueError("The output would overwrite its own source.")
    body = manifest(source, os.path.basename(path), original, prepared, recipe, context,
                    comparison, metadata)
    manifest_path = f"{root}_preparation.json"
    spark = original.sparkSession
    spark.createDataFrame([(body,)], "value string").coalesce(1).write.mode("errorifexists").text(manifest_path)
    data = prepared.drop(recipe.row_id)
    if extension.lower() == ".csv":
        first = data_fields(data)[0].name
        named = data.withColumnRenamed(first, BYTE_ORDER_MARK + first)
        named.write.mode("errorifexists").csv(
            path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    else:
        data.write.mode("errorifexists").parquet(path)
    return path, manifest_path


def write_report(evaluation: Evaluation, folder: str, profile: DataFrame | None = None,
                 mode: str = "append", *, info: DataFrame | None = None, context: UsageContext | None = None,
                 histograms: DataFrame | None = None, correlations: DataFrame | None = None) -> None:
    """Report tables as Parquet partitioned by dataset, one folder per table: the evaluation, and what else is given of
    the dataset's profile, information record, context (as JSON), histograms and correlations."""
    tables = {
        "indicators": evaluation.indicators, "findings": evaluation.findings,
        "items": evaluation.items, "dimensions": evaluation.dimensions,
        "scorecard": evaluation.scorecard}
    spark = evaluation.scorecard.sparkSession
    dataset_id = evaluation.scorecard.first()["dataset_id"]
    given = {"profile": profile, "info": info, "histograms": histograms, "correlations": correlations}
    if context is not None:
        given["context"] = local_frame(spark, [(json.dumps(context.as_dict(), ensure_ascii=False),)], "body string")
    tables |= {name: table if "dataset_id" in table.columns else table.withColumn("dataset_id", F.lit(dataset_id))
               for name, table in given.items() if table is not None}
    for name, table in tables.items():
        writer = table.write.mode(mode)
        if "dataset_id" in table.columns:
            writer = writer.partitionBy("dataset_id")
        writer.parquet(f"{folder}/{name}")
