"""Interquartile fences: fit once, then test any data against them."""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions.local import local_frame
from plumbline.functions.columns import data_fields, finite, infinite, is_measurement, number
from plumbline.operators.quantiles import quantiles, quantiles_of_many

# The reach of the fences and the rounding slack around them.
REACH = 1.5
SLACK = 16 * sys.float_info.epsilon
LARGEST = sys.float_info.max

NO_FENCE = {"lower": 0.0, "upper": 0.0, "tolerance": 0.0}


def measurement_names(df: DataFrame, row_id: str | None = None) -> list[str]:
    return [f.name for f in data_fields(df, row_id) if is_measurement(f.dataType)]


def _numbers(df: DataFrame, names: list[str]) -> dict[str, Column]:
    types = {f.name: f.dataType for f in df.schema.fields}
    return {name: number(name, types[name]) for name in names}


def fences_from_quartiles(q1: float, q3: float) -> dict[str, float]:
    """Fences clamped to the double range; the spread is halved first so that it cannot
    overflow. The tolerance depends on the fitted quartiles only, never on later data."""
    half_spread = q3 / 2 - q1 / 2
    reach = min(half_spread * REACH, LARGEST / 2)

    def clamp(half_bound: float) -> float:
        return max(-LARGEST, min(LARGEST, 2 * half_bound))

    spread = min(2 * half_spread, LARGEST)
    return {
        "lower": clamp(q1 / 2 - reach),
        "upper": clamp(q3 / 2 + reach),
        "tolerance": SLACK * max(abs(q1), abs(q3), abs(spread)),
    }


def fit_fences(df: DataFrame, names: list[str] | None = None, row_id: str | None = None,
               **options) -> dict[str, dict[str, float]]:
    """Fences of every measurement from its finite values. A column without finite
    values gets zero fences, under which only infinities count as outliers."""
    names = measurement_names(df, row_id) if names is None else names
    return _fences(quantiles(df, _finite_numbers(df, names), [0.25, 0.75], **options))


def fit_fences_of_many(tables: list[DataFrame], row_id: str | None = None) -> list[dict[str, dict[str, float]]]:
    """``fit_fences`` of all measurements of several tables, in the jobs that one takes."""
    columns = [(df, _finite_numbers(df, measurement_names(df, row_id))) for df in tables]
    return [_fences(fitted) for fitted in quantiles_of_many(columns, [0.25, 0.75])]


def _finite_numbers(df: DataFrame, names: list[str]) -> dict[str, Column]:
    return {name: finite(value) for name, value in _numbers(df, names).items()}


def _fences(fitted: dict[str, list[float] | None]) -> dict[str, dict[str, float]]:
    return {name: fences_from_quartiles(*quartiles) if quartiles else dict(NO_FENCE) for name, quartiles in fitted.items()}


def outside(value: Column, fence: dict[str, float]) -> Column:
    """Strictly beyond a fence and not merely by rounding. Never NULL: a missing value
    is inside, an infinity is outside."""
    tolerance = fence.get("tolerance", 0.0)

    def far(bound: float) -> Column:
        allowed = min(tolerance + SLACK * abs(bound), LARGEST)
        return infinite(value) | (F.abs(value - F.lit(bound)) > allowed)

    below = (value < fence["lower"]) & far(fence["lower"])
    above = (value > fence["upper"]) & far(fence["upper"])
    return F.coalesce(below | above, F.lit(False))


def outlier_counts(df: DataFrame, fences: dict[str, dict[str, float]]) -> DataFrame:
    """(column, outliers, present) for all fenced columns, in one aggregation."""
    columns = _numbers(df, list(fences))
    names = list(fences)
    if not names:
        return local_frame(df.sparkSession, [], "column string, outliers bigint, present bigint")
    counted = df.agg(*[
        aggregate
        for i, name in enumerate(names)
        for aggregate in (
            F.count_if(outside(columns[name], fences[name])).alias(f"o{i}"),
            F.count(columns[name]).alias(f"p{i}"),
        )
    ])
    return counted.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("column"), F.col(f"o{i}").alias("outliers"),
                 F.col(f"p{i}").alias("present"))
        for i, name in enumerate(names)
    ])))
