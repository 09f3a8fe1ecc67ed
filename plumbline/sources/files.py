"""File listing, checks, fingerprints, and row positions."""

from __future__ import annotations

import os
from functools import reduce
from itertools import accumulate

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from plumbline.functions.columns import ROW_ID, quote
from plumbline.functions.digests import file_sha256
from plumbline.functions.lineage import written
from plumbline.functions.local import local_frame

# Readable formats by extension.
FORMATS = {".csv": "csv", ".parquet": "parquet"}


class LoadError(ValueError):
    """A dataset cannot be read."""


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, modificationTime) of the files under a path; contents stay unread."""
    try:
        return spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime")
    except AnalysisException as error:
        raise LoadError(f"File not found: {path}") from error


def checked_format(spark: SparkSession, path: str) -> str:
    extension = os.path.splitext(path.rstrip("/"))[1].lower()
    if extension not in FORMATS:
        raise LoadError(f"Unsupported format {extension!r}; use {' or '.join(FORMATS)}")
    size = listing(spark, path).agg(F.sum("length")).first()[0]
    if not size:
        raise LoadError("The file is empty.")
    return FORMATS[extension]


def check_shape(df: DataFrame) -> None:
    if len([c for c in df.columns if c != ROW_ID]) < 2:
        raise LoadError("Only one column found; the delimiter is probably wrong.")
    if df.isEmpty():
        raise LoadError("The file has no data.")


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) per file. A task reads a file as a stream, so its length is
    limited by time alone; larger datasets go faster as many files."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", file_sha256(spark, F.col("path")).alias("sha256"))


def dataset_fingerprint(files: DataFrame) -> DataFrame:
    """One row: files, bytes, sha256. One file keeps its own digest; several are combined
    in digest order, so the answer does not depend on listing order."""
    digests = files.agg(
        F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"),
        F.sort_array(F.collect_list("sha256")).alias("digests"))
    return digests.select(
        "files", "bytes",
        F.when(F.col("files") == 1, F.col("digests")[0])
        .otherwise(F.sha2(F.concat_ws("", "digests"), 256)).alias("sha256"))


def with_row_position(df: DataFrame, row_id: str = ROW_ID) -> DataFrame:
    """Adds the 0-based position of each row in file order, for a frame read from files.

    Within a file block rows are read in order. Blocks before it in the file, and files before that, are
    running sums: over the blocks of one file, and over the files (see ``file_bases``). The source row of a
    position p is p + 2, counting the header as 1.
    """
    return placed_rows([df], row_id)


def placed_rows(frames: list[DataFrame], row_id: str) -> DataFrame:
    """``with_row_position`` of several frames of the same columns, whose files are put in one order."""
    columns = frames[0].columns
    tagged = reduce(DataFrame.unionByName, [
        df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start")) for df in frames
    ]).withColumn("_id", F.monotonically_increasing_id())
    blocks = tagged.groupBy("_file", "_start").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy("_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    bases = file_bases(tagged.groupBy("_file").agg(F.count(F.lit(1)).alias("_rows")))
    return tagged.join(offsets, ["_file", "_start"]).join(bases, "_file").select(
        *[quote(c) for c in columns], (F.col("_base") + F.col("_before") + F.col("_id") - F.col("_first")).alias(row_id))


def with_parquet_position(df: DataFrame, row_id: str = ROW_ID) -> DataFrame:
    """Like ``with_row_position``, from the row index Parquet files carry."""
    if len(df.inputFiles()) == 1:
        return df.select("*", F.col("_metadata.row_index").alias(row_id))
    tagged = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_id"))
    bases = file_bases(tagged.groupBy("_file").agg(F.count(F.lit(1)).alias("_rows")))
    return tagged.join(bases, "_file").select(*[quote(c) for c in df.columns], (F.col("_base") + F.col("_id")).alias(row_id))


def file_bases(counts: DataFrame) -> DataFrame:
    """(_file, _base): the rows in all files before, from (_file, _rows). Two levels of running sums: within ranges of
    files, and over the ranges, which are as many as shuffle partitions. The ranges are written, so both levels see the same."""
    dealt = written(counts.repartitionByRange("_file").withColumn("_part", F.spark_partition_id()), "files")
    totals = sorted(map(tuple, dealt.groupBy("_part").agg(F.sum("_rows")).collect()))
    ends = list(accumulate(n for _, n in totals))
    parts = local_frame(counts.sparkSession, [(p, e - n) for (p, n), e in zip(totals, ends)], "_part int, _lower bigint")
    before = Window.partitionBy("_part").orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    return dealt.join(F.broadcast(parts), "_part").select(  # a row for each range
        "_file", (F.col("_lower") + F.coalesce(F.sum("_rows").over(before), F.lit(0))).alias("_base"))
