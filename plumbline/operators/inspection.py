"""Bounded looks at one column: counts, shares, records, box statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from plumbline.functions.columns import (
    ROW_ID, as_text, col, data_fields, field_of, finite, literal, missing, missing_sql, number,
    short_sql, short_text,
)
from plumbline.functions.local import local_frame
from plumbline.functions.text import display_sql, quoted_sql
from plumbline.operators.frequencies import top_values
from plumbline.operators.outliers import fences_from_quartiles, outside
from plumbline.operators.quantiles import quantiles
from plumbline.operators.sampling import SAMPLE_ROWS, sample_rows, sample_values

# How much an inspection shows.
SHOWN_COLUMNS = 12
SHOWN_CATEGORIES = 8
SHOWN_RECORDS = 8
SHARE_CATEGORIES = 5
SHOWN_FLIERS = 200

MISSING_LABEL = "Missing values"


def missing_by_column(df: DataFrame, row_id: str | None = None) -> DataFrame:
    """(ordinal, column, rows, missing) of every column, from one aggregation."""
    fields = data_fields(df, row_id)
    if not fields:
        return local_frame(df.sparkSession, [], "ordinal int, column string, rows bigint, missing bigint")
    counted = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.expr(f"count_if({missing_sql(f.name, f.dataType)}) as m{i}") for i, f in enumerate(fields)])
    rows = [f"struct({i} as ordinal, {literal(f.name)} as column, rows, m{i} as missing)"
            for i, f in enumerate(fields)]
    return counted.selectExpr(f"inline(array({', '.join(rows)}))")


def most_missing(df: DataFrame, row_id: str | None = None) -> DataFrame:
    """The twelve columns with the most missing values, zeros included."""
    return missing_by_column(df, row_id).orderBy(F.desc("missing"), "ordinal").limit(SHOWN_COLUMNS)


def category_counts(df: DataFrame, column: str, row_id: str | None = None) -> DataFrame:
    """(rank, label, count) of the eight most frequent values; padded labels are quoted."""
    return top_values(df, [column], SHOWN_CATEGORIES, row_id).select(
        "rank", F.expr(quoted_sql("value")).alias("label"), F.col("n").alias("count"))


def category_share(df: DataFrame, column: str) -> DataFrame:
    """(label, count) of all values with missing as one of them; empty when that makes
    more than five entries. Whether a measurement is that discrete is decided on all
    rows."""
    dtype = field_of(df, column).dataType
    key = short_text(column, dtype)
    groups = df.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("count"))
    few = groups.agg(F.count(F.lit(1)) <= SHARE_CATEGORIES).scalar()
    shares = groups.where(few)
    # At most five rows remain; whole texts of long labels come from the top values.
    texts = top_values(df, [column], SHARE_CATEGORIES).select(
        F.expr(short_sql("value")).alias("key"), "value")
    return shares.join(F.broadcast(texts), "key", "left").select(
        F.expr(f"case when key is null then '{MISSING_LABEL}' else {quoted_sql('coalesce(value, key)')} end")
        .alias("label"), "count")


def missing_records(df: DataFrame, column: str, row_id: str = ROW_ID) -> DataFrame:
    """The first eight rows missing the column: (source_row, value)."""
    return (
        df.where(missing(column, field_of(df, column).dataType)).select(col(row_id).alias("_order"))
        .orderBy("_order").limit(SHOWN_RECORDS)
        .select((F.col("_order") + 2).alias("source_row"), F.lit("Missing").alias("value")))


def outlier_records(df: DataFrame, column: str, fence: dict, row_id: str = ROW_ID) -> DataFrame:
    """The first eight rows outside the fence: (source_row, value)."""
    dtype = field_of(df, column).dataType
    return (
        df.where(outside(number(column, dtype), fence))
        .select(col(row_id).alias("_order"), as_text(column, dtype).alias("value"))
        .orderBy("_order").limit(SHOWN_RECORDS)
        .select((F.col("_order") + 2).alias("source_row"), F.expr(display_sql("value")).alias("value")))


def positions(df: DataFrame, records: DataFrame, row_id: str = ROW_ID) -> DataFrame:
    """Adds ``row``, the 1-based position of each record in the current data. For the few
    records of an inspection: one conditional count per record."""
    rows = records.collect()
    if len(rows) > SHOWN_RECORDS:
        raise ValueError(f"Positions are for at most {SHOWN_RECORDS} records")
    if not rows:
        return records.withColumn("row", F.lit(None).cast("bigint"))
    counts = df.agg(*[F.count_if(col(row_id) <= r["source_row"] - 2) for r in rows]).first()
    schema = records.schema.simpleString()[len("struct<"):-1] + ",row:bigint"
    return local_frame(df.sparkSession, [(*r, c) for r, c in zip(rows, counts)], schema)


def box_statistics(df: DataFrame, columns: list[str], **options) -> DataFrame:
    """(column, q1, median, q3, whisker_low, whisker_high, lower, upper, finite_count,
    outliers). Whiskers are the extreme finite values inside the fences."""
    values = {n: number(n, field_of(df, n).dataType) for n in columns}
    fitted = quantiles(df, {n: finite(v) for n, v in values.items()}, [0.25, 0.5, 0.75], **options)
    columns = [n for n in columns if fitted[n]]
    if not columns:
        return local_frame(
            df.sparkSession, [], "column string, q1 double, median double, q3 double, whisker_low double, "
            "whisker_high double, lower double, upper double, finite_count bigint, outliers bigint")
    fences = {n: fences_from_quartiles(fitted[n][0], fitted[n][2]) for n in columns}
    aggregates = []
    for i, n in enumerate(columns):
        out = outside(values[n], fences[n])
        inside = F.when(~out, finite(values[n]))
        aggregates += [
            F.min(inside).alias(f"low{i}"), F.max(inside).alias(f"high{i}"),
            F.count(finite(values[n])).alias(f"finite{i}"), F.count_if(out).alias(f"out{i}")]
    return df.agg(*aggregates).select(F.inline(F.array(*[
        F.struct(
            F.lit(n).alias("column"), F.lit(fitted[n][0]).alias("q1"),
            F.lit(fitted[n][1]).alias("median"), F.lit(fitted[n][2]).alias("q3"),
            F.coalesce(f"low{i}", F.lit(fitted[n][0])).alias("whisker_low"),
            F.coalesce(f"high{i}", F.lit(fitted[n][2])).alias("whisker_high"),
            F.lit(fences[n]["lower"]).alias("lower"), F.lit(fences[n]["upper"]).alias("upper"),
            F.col(f"finite{i}").alias("finite_count"), F.col(f"out{i}").alias("outliers"))
        for i, n in enumerate(columns)])))


def fliers(df: DataFrame, column: str, fence: dict, row_id: str = ROW_ID,
           size: int = SAMPLE_ROWS) -> DataFrame:
    """(row, value): up to 200 outliers among the sampled finite values."""
    sample = sample_values(df, column, row_id, size)
    return sample.where(outside(F.col("value"), fence)).orderBy("row").limit(SHOWN_FLIERS)


def before_and_after(query: Callable[[DataFrame], DataFrame], before: DataFrame,
                     after: DataFrame) -> DataFrame:
    """One inspection query on the current data and on a previewed change."""
    return query(before).withColumn("version", F.lit("before")).unionByName(
        query(after).withColumn("version", F.lit("after")))


__all__ = [
    "before_and_after", "box_statistics", "category_counts", "category_share", "fliers",
    "missing_by_column", "missing_records", "most_missing", "outlier_records", "positions",
    "sample_rows", "sample_values",
]
