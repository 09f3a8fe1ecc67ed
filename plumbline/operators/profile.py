"""Column profiles: counts, describe, histograms, correlations, plot choices."""

from __future__ import annotations

from math import isfinite

from pyspark.sql import Column, DataFrame, Row, Window, functions as F, types as T

from plumbline.functions.columns import (
    data_fields, field_of, is_measurement, is_plot_numeric, number_sql,
)
from plumbline.functions.local import local_frame
from plumbline.functions.numbers import percentage
from plumbline.operators.comoments import column_ranges, pair_correlations
from plumbline.operators.duplicates import duplicate_count
from plumbline.operators.facts import NUMERIC_TEXT_SHARE, column_facts, table_facts
from plumbline.operators.frequencies import distinct_counts
from plumbline.operators.quantiles import quantiles_and

# Bounds of the visual summaries.
HISTOGRAM_BINS = 24
MIN_PAIRS = 3
MAX_HISTOGRAMS = 6
MAX_CATEGORIES = 4
MAX_CORRELATIONS = 12
IDENTIFIER_PATTERN = "(?i)(^id$|_id$|^id_)"


def dataset_profile(df: DataFrame, row_id: str | None = None) -> DataFrame:
    """One row: rows, columns, missing_percentage, duplicate_rows."""
    facts = table_facts(df, row_id=row_id)
    repeated = duplicate_count(df, row_id).select("duplicate_rows")
    return facts.select(
        "rows", "columns",
        F.expr(percentage("missing_cells", "(rows * columns)", 0.0)).alias("missing_percentage"),
        repeated.scalar().alias("duplicate_rows"),
    )


def column_profile(df: DataFrame, row_id: str | None = None) -> DataFrame:
    """One row per column: type, missing_percentage, unique_count, numbers_stored_as_text."""
    facts = column_facts(df, row_id=row_id)
    return facts.join(F.broadcast(distinct_counts(df, row_id=row_id)), "column").select(
        "ordinal", "column", "type", "kind", "rows", "missing",
        F.expr(percentage("missing", "rows", 0.0)).alias("missing_percentage"),
        F.col("distinct_count").alias("unique_count"),
        numbers_as_text().alias("numbers_stored_as_text"),
    )


# Over column facts: at least 90% of the present texts spell a number.
NUMBERS_AS_TEXT = f"coalesce(try_divide(numeric_texts, rows - missing) >= {NUMERIC_TEXT_SHARE}D, false)"


def numbers_as_text() -> Column:
    return F.expr(NUMBERS_AS_TEXT)


def numeric_describe(df: DataFrame, names: list[str] | None = None,
                     row_id: str | None = None, **options) -> DataFrame:
    """(column, count, mean, std, min, q25, q50, q75, max) of every measurement.

    Missing values are excluded; a statistic that is not finite is NULL. The moments come from the first
    of the reads for the quartiles.
    """
    schema = ("column string, count bigint, mean double, std double, min double, q25 double, q50 double, q75 double, "
              "max double")
    if names is None:
        names = [f.name for f in data_fields(df, row_id) if is_measurement(f.dataType)]
    if not names:
        return local_frame(df.sparkSession, [], schema)
    values = {n: number_sql(n, field_of(df, n).dataType) for n in names}
    functions = ("count", "avg", "stddev_samp", "min", "max")
    quartiles, row = quantiles_and(df, {n: F.expr(v) for n, v in values.items()}, [0.25, 0.5, 0.75], [
        F.expr(f"{function}({v})") for v in values.values() for function in functions], **options)

    def shown(value: float | None) -> float | None:
        return value if value is not None and isfinite(value) else None

    rows = []
    for i, n in enumerate(names):
        count, mean, std, low, high = row[len(functions) * i:len(functions) * (i + 1)]
        rows.append((n, count, *map(shown, (mean, std, low, *(quartiles[n] or [None] * 3), high))))
    return local_frame(df.sparkSession, rows, schema)


def plot_columns(df: DataFrame, row_id: str | None = None, names: list[str] | None = None) -> list[T.StructField]:
    """The numeric or boolean columns in schema order: all, or those among ``names``."""
    fields = [f for f in data_fields(df, row_id) if is_plot_numeric(f.dataType)]
    return fields if names is None else [f for f in fields if f.name in names]


def _finite_values(df: DataFrame, fields: list[T.StructField]) -> tuple[DataFrame, list[str]]:
    """The columns as finite doubles v0, v1, ... or NULL, and their names. Built as text: with many columns a tree of
    column objects takes longer than the job."""
    numbers = [number_sql(f.name, f.dataType) for f in fields]
    return df.selectExpr(*[f"case when abs({v}) < double('inf') then {v} end as v{i}" for i, v in enumerate(numbers)]), [f.name for f in fields]


def _ranges(values: DataFrame, names: list[str]) -> dict[str, Row]:
    """low, high, scale and center per column with values, from one pass."""
    ranges = {}
    for name, found in zip(names, column_ranges(values, [f"v{i}" for i in range(len(names))])):
        if found:
            low, high, mean = found
            scale = max(abs(low), abs(high), 1.0)
            ranges[name] = Row(low=low / scale, high=high / scale, scale=scale, center=mean / scale)
    return ranges


def histograms(df: DataFrame, row_id: str | None = None, names: list[str] | None = None) -> DataFrame:
    """(column, bin, low, high, count): 24 equal bins over each column's finite values.

    All rows count, not a sample. Two passes: ranges, then counts per (column, bin),
    which combine on the map side to at most 24 groups a column. A value on an edge goes to
    the bin that starts there, decided against the edges themselves; the last bin is
    closed on both sides.
    """
    fields = [f for f in plot_columns(df, row_id, names) if not isinstance(f.dataType, T.BooleanType)]
    values, names = _finite_values(df, fields)
    spark = df.sparkSession
    if not names or not (ranges := _ranges(values, names)):
        return local_frame(
            spark, [], "column string, bin int, low double, high double, count bigint")
    x, guess, bins, edges, last = [], [], [], [], HISTOGRAM_BINS - 1
    for k, (name, found) in enumerate(ranges.items()):
        low, high = found.low, found.high
        if low == high:
            low, high = max(-1.0, low - 0.5), min(1.0, high + 0.5)
        step = (high - low) / HISTOGRAM_BINS
        start, width, density = (f"double('{v!r}')" for v in (low, step, HISTOGRAM_BINS / (high - low)))
        x.append(f"v{names.index(name)} / double('{found.scale!r}') as x{k}")
        guess.append(f"case when x{k} is not null then cast(least(floor((x{k} - {start}) * {density}), {last}) as int) end as g{k}")
        bins.append(f"case when x{k} < {start} + g{k} * {width} then g{k} - 1 "
                    f"when g{k} < {last} and x{k} >= {start} + (g{k} + 1) * {width} then g{k} + 1 else g{k} end")
        points = [low + i * step for i in range(HISTOGRAM_BINS)] + [high]
        edges += [(name, k, i, points[i] * found.scale, points[i + 1] * found.scale) for i in range(HISTOGRAM_BINS)]
    counted = (
        values.selectExpr(*x).selectExpr("*", *guess).selectExpr(f"posexplode(array({', '.join(bins)})) as (k, bin)")
        .where("bin is not null").groupBy("k", "bin").agg(F.expr("count(1) as count"))
    )
    frame = local_frame(spark, edges, "column string, k int, bin int, low double, high double")
    return frame.join(F.broadcast(counted), ["k", "bin"], "left").selectExpr(  # at most 24 rows a column
        "column", "bin", "low", "high", "coalesce(count, 0L) as count")


def correlations(df: DataFrame, row_id: str | None = None, names: list[str] | None = None) -> DataFrame:
    """(a, b, r, pairs) for every pair of varying numeric or boolean columns.

    Pearson's r over the rows where both are finite; NULL below 3 pairs or when either
    side is constant on them. One pass finds ranges and means, one more sums products of all pairs
    over all rows (see ``comoments``). Columns are scaled by their largest magnitude and centred, so
    plain sums of products stay finite and lose no digits.
    """
    values, names = _finite_values(df, plot_columns(df, row_id, names))
    ranges = _ranges(values, names) if len(names) > 1 else {}
    varying = {n: f"v{names.index(n)} / double('{x.scale!r}') - double('{x.center!r}')" for n, x in ranges.items() if x.low < x.high}
    if len(varying) < 2:
        return local_frame(df.sparkSession, [], "a string, b string, r double, pairs bigint")
    return pair_correlations(values, varying, MIN_PAIRS)


def preferred_order(target: str | None = None, important: list[str] = ()) -> list[Column]:
    """Sort keys over a column profile: the target, then important columns, then schema."""
    order = list(dict.fromkeys([*([target] if target else []), *important]))
    return [*[F.desc(F.col("column") == name) for name in order], F.asc("ordinal")]


def is_identifier() -> Column:
    return F.col("column").rlike(IDENTIFIER_PATTERN)


def _first(columns: DataFrame, limit: int, target, important) -> DataFrame:
    return columns.orderBy(*preferred_order(target, important)).limit(limit)


def numeric_plot_columns(profile: DataFrame, target=None, important=()) -> DataFrame:
    """Up to six varying measurements that do not look like identifiers."""
    return _first(
        profile.where((F.col("kind") == "measurement") & (F.col("unique_count") > 1)
                      & ~is_identifier()),
        MAX_HISTOGRAMS, target, important)


def category_plot_columns(profile: DataFrame, target=None, important=()) -> DataFrame:
    """Up to four category columns: more than one value, not nearly unique, not nested,
    not an identifier."""
    most = F.greatest(F.col("rows") * F.lit(0.8), F.lit(2.0))
    return _first(
        profile.where(~F.col("kind").isin("measurement", "nested") & (F.col("unique_count") > 1)
                      & (F.col("unique_count") <= most) & ~is_identifier()),
        MAX_CATEGORIES, target, important)


def correlation_plot_columns(profile: DataFrame, target=None, important=()) -> DataFrame:
    """Up to twelve varying numeric or boolean columns that are not identifiers."""
    return _first(
        profile.where(F.col("kind").isin("measurement", "boolean") & (F.col("unique_count") > 1)
                      & ~is_identifier()),
        MAX_CORRELATIONS, target, important)


def strongest_pair(pairs: DataFrame, columns: DataFrame | None = None) -> DataFrame:
    """The defined pair with the largest |r|, among the given columns (at most twelve)."""
    if columns is not None:
        for side in ("a", "b"):
            shown = columns.select(F.col("column").alias(side))
            pairs = pairs.join(F.broadcast(shown), side, "left_semi")
    return pairs.where("r is not null").orderBy(F.desc(F.abs("r")), "a", "b").limit(1)


def missing_ranking(facts: DataFrame, limit: int = 10) -> DataFrame:
    """Columns with missing values, highest share first, with how many there are."""
    ranked = facts.where("missing > 0").select(
        "column", "ordinal", "missing",
        F.expr(percentage("missing", "rows", 0.0)).alias("missing_percentage"))
    # One row per column of the table: the window sees metadata, not data.
    return (
        ranked.withColumn("affected_columns", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))))
        .orderBy(F.desc("missing_percentage"), "ordinal").limit(limit)
    )
