"""Dimension scores, the weighted overall score, bands and weight overrides.

Everything here is a query over the small ``indicators`` frame, so re-weighting never
touches the data again.
"""

from __future__ import annotations

from math import isfinite
from numbers import Real

from pyspark.sql import DataFrame, functions as F

from plumbline.functions.local import local_frame
from plumbline.functions.numbers import round2
from plumbline.plans import constants as K


def _weighted_mean(entries: str) -> str:
    """Weighted mean of (position, value, weight) structs, added in position order so
    that the last digit does not depend on partitioning."""
    return (f"try_divide(aggregate(sort_array({entries}), 0D, (sum, e) -> sum + e.value * e.weight), "
            f"aggregate(sort_array({entries}), 0D, (sum, e) -> sum + e.weight))")


def dimension_scores(indicators: DataFrame) -> DataFrame:
    """(dataset_id, dimension, applicable, score): the weighted mean of the indicators.

    Values outside [0, 100] and weights that are not positive are refused.
    """
    checked = (
        "case when not applicable or (value between 0 and 100 and weight > 0) then value else raise_error("
        "'Indicator values must lie in 0-100 and indicator weights must be positive') end as value")
    # A dimension has at most six indicators, which bounds the collected array.
    return indicators.selectExpr(
        "dataset_id", "dimension", "applicable", "position", checked, "weight"
    ).groupBy("dataset_id", "dimension").agg(
        F.expr("bool_and(applicable) as applicable"),
        F.expr("collect_list(struct(position, value, weight)) as entries"),
    ).selectExpr(
        "dataset_id", "dimension", "applicable", f"{_weighted_mean('entries')} as mean"
    ).selectExpr(
        "dataset_id", "dimension", "applicable", f"case when applicable then {round2('mean')} end as score")


def check_overrides(task_type: str, overrides: dict[str, float] | None) -> dict[str, float]:
    if task_type not in K.DIMENSION_WEIGHTS:
        raise ValueError(f"No weights for task type {task_type!r}")
    overrides = overrides or {}
    defaults = K.DIMENSION_WEIGHTS[task_type]
    for name, weight in overrides.items():
        if name not in defaults:
            raise ValueError(f"Dimension {name!r} has no weight for this task")
        number = isinstance(weight, Real) and not isinstance(weight, bool)
        if not number or not isfinite(weight) or weight < 0:
            raise ValueError(f"The weight of {name!r} must be a finite number of at least 0")
    return {name: float(weight) for name, weight in overrides.items()}


def task_weights(spark, task_type: str, overrides: dict[str, float] | None = None) -> DataFrame:
    """(dimension, order, weight, default_weight) of one task, overrides applied."""
    overrides = check_overrides(task_type, overrides)
    defaults = K.DIMENSION_WEIGHTS[task_type]
    return local_frame(
            spark, [(name, K.DIMENSIONS.index(name), overrides.get(name, weight), weight)
         for name, weight in defaults.items()],
        "dimension string, order int, weight double, default_weight double")


def default_weights(spark) -> DataFrame:
    """(task_type, dimension, weight) for all tasks."""
    return local_frame(
            spark, [(task, name, weight) for task, weights in K.DIMENSION_WEIGHTS.items()
         for name, weight in weights.items()],
        "task_type string, dimension string, weight double")


def weighted_dimensions(scores: DataFrame, weights: DataFrame) -> DataFrame:
    """Scores with order, weight, default_weight and weight_percentage.

    Only applicable dimensions carry a weight. A weight of 0 removes the influence of a
    dimension, which stays applicable with a share of 0.
    """
    weighted = scores.join(F.broadcast(weights), "dimension", "left").selectExpr(
        "dataset_id", "dimension", "applicable", "score", "order", "default_weight",
        "case when applicable then coalesce(weight, "
        "raise_error(concat('No weight for dimension ', dimension))) end as weight")
    # At most six rows per dataset.
    shares = weighted.selectExpr(
        "*", "try_divide(weight, sum(weight) over (partition by dataset_id)) * 100D as share")
    return shares.selectExpr(
        "dataset_id", "dimension", "applicable", "score", "order", "weight", "default_weight",
        f"case when applicable then {round2('share')} end as weight_percentage")


def band(score: str) -> str:
    """The readiness band of a score, as SQL text."""
    cases = " ".join(f"when {score} >= {minimum} then '{label}'" for minimum, label in reversed(K.SCORE_BANDS))
    return f"case {cases} else '{K.SCORE_BANDS[0][1]}' end"


def scorecard(scores: DataFrame, weights: DataFrame) -> DataFrame:
    """(dataset_id, score, classification, weight_source) over applicable dimensions."""
    totals = weighted_dimensions(scores, weights).where("applicable").groupBy("dataset_id").agg(
        F.expr("collect_list(struct(order as position, score as value, weight)) as entries"),
        F.expr("sum(weight) as total_weight"), F.expr("bool_or(weight <> default_weight) as changed"))
    return totals.selectExpr(
        "dataset_id", "changed",
        f"case when total_weight > 0 then {_weighted_mean('entries')} else raise_error("
        "'No applicable dimension has a positive weight') end as mean"
    ).selectExpr("dataset_id", "changed", f"{round2('mean')} as score").selectExpr(
        "dataset_id", "score", f"{band('score')} as classification",
        f"case when changed then '{K.CUSTOM_SOURCE}' else '{K.DEFAULT_SOURCE}' end as weight_source")
