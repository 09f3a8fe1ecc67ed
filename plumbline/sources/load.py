"""Load one dataset with its information record and metadata."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.functions.columns import ROW_ID
from plumbline.plans.context import UsageContext
from plumbline.plans.evaluate import score_many
from plumbline.sources.csv import read_csv
from plumbline.sources.files import (
    FORMATS, check_shape, checked_format, dataset_fingerprint, fingerprints, listing,
    with_parquet_position,
)
from plumbline.sources.metadata import read_metadata


@dataclass
class Dataset:
    """A table with row positions, its one-row information frame and its metadata."""

    dataset_id: str
    data: DataFrame
    info: DataFrame
    metadata: DataFrame


def read_parquet(spark: SparkSession, path: str, row_id: str | None = ROW_ID) -> DataFrame:
    table = spark.read.parquet(path)
    return with_parquet_position(table, row_id) if row_id else table


def load(spark: SparkSession, path: str, metadata_path: str | None = None,
         row_id: str | None = ROW_ID, dataset_id: str | None = None) -> Dataset:
    """Read a CSV or Parquet file, or a folder of them named like one."""
    file_format = checked_format(spark, path)
    encoding = delimiter = None
    if file_format == "csv":
        table = read_csv(spark, path, row_id)
        data, encoding, delimiter = table.data, table.encoding, table.delimiter
    else:
        data = read_parquet(spark, path, row_id)
    check_shape(data)
    name = os.path.basename(path.rstrip("/"))
    dataset_id = dataset_id or name
    digest = dataset_fingerprint(fingerprints(spark, path)).select(
        F.lit(dataset_id).alias("dataset_id"), "sha256")
    metadata = read_metadata(spark, {dataset_id: metadata_path} if metadata_path else {}, digest)
    width = len([c for c in data.columns if c != row_id])
    info = metadata.select(
        F.lit(name).alias("file"), F.lit(file_format).alias("format"),
        F.lit(encoding).cast("string").alias("encoding"),
        F.lit(delimiter).cast("string").alias("delimiter"),
        data.agg(F.count(F.lit(1))).scalar().alias("rows"), F.lit(width).alias("columns"),
        "sha256", F.col("source").alias("metadata_file"), F.col("warnings").alias("metadata_warnings"))
    return Dataset(dataset_id, data, info, metadata)


def score_folder(spark: SparkSession, folder: str,
                 contexts: dict[str, UsageContext] | None = None) -> DataFrame:
    """Score every CSV and Parquet file of a folder twice; failures are reported per file
    and the rest continue."""
    names = sorted(row["path"] for row in listing(spark, folder).collect())
    chosen = [n for n in names if os.path.splitext(n)[1].lower() in FORMATS]

    def reader(path: str):
        return lambda: load(spark, path, row_id=None).data

    return score_many({os.path.basename(n): reader(n) for n in chosen}, contexts, repeat=True)
