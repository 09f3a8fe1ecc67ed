"""Metadata files chosen per dataset, checked as a table."""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Limits and version of a metadata file.
MAX_METADATA_BYTES = 2 * 1024 * 1024
SCHEMA_VERSION = "1"

METADATA_COLUMNS = ["dataset_id", "body", "source", "sha256", "warnings"]


def envelope_warning(content: Column, valid_utf8: Column, body: Column, sha256: Column) -> Column:
    """Why a metadata body cannot be used, or NULL: encoding, syntax, shape, version,
    checksum, in that order."""
    version = F.try_variant_get(body, f"$.schema_version", "variant")
    expected = F.try_variant_get(body, "$.dataset_sha256", "variant")
    version_ok = (F.schema_of_variant(version) == "STRING") & (
        F.try_variant_get(version, "$", "string") == SCHEMA_VERSION)
    bound = expected.isNotNull() & ~F.is_variant_null(expected)
    checksum_ok = ~bound | F.coalesce(
        (F.schema_of_variant(expected) == "STRING")
        & (F.try_variant_get(expected, "$", "string") == sha256), F.lit(False))
    return (
        F.when(~valid_utf8, "metadata is not valid UTF-8")
        .when(body.isNull(), "metadata is not valid JSON")
        .when(~F.schema_of_variant(body).startswith("OBJECT"), "metadata must be a JSON object")
        .when(~F.coalesce(version_ok, F.lit(False)), f'schema_version must be "{SCHEMA_VERSION}"')
        .when(~F.coalesce(checksum_ok, F.lit(False)),
              "dataset_sha256 does not match this dataset; evidence ignored"))


def checked_metadata(texts: DataFrame) -> DataFrame:
    """Rows of (dataset_id, source, sha256, text) as metadata bundles. A body with a
    warning is withheld; a dataset without a chosen file (NULL text) has neither."""
    parsed = texts.withColumn("_body", F.try_parse_json("text"))
    warning = F.when(F.col("text").isNotNull(), envelope_warning(
        F.col("text"), F.is_valid_utf8("text"), F.col("_body"), F.col("sha256")))
    return parsed.withColumn("_warning", warning).select(
        "dataset_id", F.when(F.col("_warning").isNull(), F.col("_body")).alias("body"),
        "source", "sha256",
        F.array_compact(F.array(F.concat("source", F.lit(": "), "_warning"))).alias("warnings"))


def read_metadata(spark: SparkSession, chosen: Mapping[str, str],
                  fingerprints: DataFrame) -> DataFrame:
    """Metadata bundles for ``fingerprints`` (dataset_id, sha256). ``chosen`` maps a
    dataset to its metadata file; files are never searched for. A file that cannot be
    used gives a warning and no body, never an exception."""
    frames, missing = [], []
    for dataset_id, path in chosen.items():
        source = os.path.basename(path)
        try:
            files = spark.read.format("binaryFile").load(path)
        except AnalysisException:
            missing.append((dataset_id, source, f"{source}: file not found"))
            continue
        named = files.select(F.lit(dataset_id).alias("dataset_id"), F.lit(source).alias("source"),
                             "length", "content")
        # The length filter reaches the reader: the content of a larger file is not read.
        frames.append(named.where(F.col("length") <= MAX_METADATA_BYTES).select(
            "dataset_id", "source", F.col("content").cast("string").alias("text"),
            F.lit(None).cast("string").alias("problem")))
        frames.append(named.where(F.col("length") > MAX_METADATA_BYTES).select(
            "dataset_id", "source", F.lit(None).cast("string").alias("text"),
            F.concat("source", F.lit(": metadata exceeds the 2 MiB limit")).alias("problem")))
    read = spark.createDataFrame(
        [(d, s, None, p) for d, s, p in missing],
        "dataset_id string, source string, text string, problem string")
    for frame in frames:
        read = read.unionByName(frame)
    bundles = checked_metadata(fingerprints.join(F.broadcast(read), "dataset_id", "left"))
    problems = read.where("problem is not null").select("dataset_id", "problem")
    return bundles.join(F.broadcast(problems), "dataset_id", "left").select(
        "dataset_id", "body", "source", "sha256",
        F.when(F.col("problem").isNotNull(), F.array("problem")).otherwise(F.col("warnings"))
        .alias("warnings"))
