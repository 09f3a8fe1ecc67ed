"""Ten preparation operations, each fitted once and applied lazily.

``fit`` runs one or two aggregations and returns the operation with its parameters.
``apply`` is a pure plan: fitted operations other than ``duplicates`` are column
expressions or filters, on batch or streaming data alike. ``audit`` and ``examples``
describe what a fitted operation does to a given table.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date, datetime, timedelta
from decimal import Decimal
from math import isfinite

from pyspark.sql import Column, DataFrame, functions as F, types as T

from plumbline.functions import text
from plumbline.functions.columns import (
    ROW_ID, as_text, col, data_fields, field_of, finite, infinite, is_measurement, is_nested,
    is_text, is_variant, missing, number, present, quote,
)
from plumbline.functions.local import local_frame
from plumbline.operators.duplicates import drop_duplicates, duplicate_count, duplicate_pairs
from plumbline.operators.frequencies import most_frequent
from plumbline.operators.outliers import fences_from_quartiles, outside
from plumbline.operators.quantiles import quantiles_and

ROW_ACTIONS = ("duplicates", "drop_missing", "drop_outliers")
CELL_ACTIONS = ("fill_median", "fill_mode", "trim", "casefold", "clip_outliers", "minmax", "standardize")
NUMERIC_ACTIONS = ("fill_median", "clip_outliers", "drop_outliers", "minmax", "standardize")
OUTLIER_ACTIONS = ("clip_outliers", "drop_outliers")
SCALING_ACTIONS = ("minmax", "standardize")
ACTIONS = ROW_ACTIONS + CELL_ACTIONS

SHOWN_EXAMPLES = 8
SHOWN_COLUMNS = 4


@dataclass(frozen=True)
class Operation:
    action: str
    column: str | None = None
    parameters: dict = field(default_factory=dict)


def check(df: DataFrame, operation: Operation, target: str | None = None) -> None:
    """Refuse what the schema alone rules out."""
    action, name = operation.action, operation.column
    if action not in ACTIONS:
        raise ValueError(f"Unknown preparation action: {action}")
    if action == "duplicates":
        if df.isStreaming:
            raise ValueError("Keep-first duplicate removal needs the whole table, not a stream.")
        return
    if name not in df.columns:
        raise ValueError("Choose a column of this dataset.")
    if target is not None and name == target:
        raise ValueError("The target column is protected; choose an input column.")
    dtype = field_of(df, name).dataType
    if action in NUMERIC_ACTIONS and not is_measurement(dtype):
        raise ValueError("Choose a numerical measurement column.")
    if action == "fill_mode" and (is_nested(dtype) or is_variant(dtype)):
        raise ValueError("Nested values cannot be filled.")
    if action in ("trim", "casefold") and not is_text(dtype):
        raise ValueError("Choose a text column for text cleanup.")


def fit(df: DataFrame, operation: Operation, target: str | None = None,
        row_id: str = ROW_ID) -> Operation:
    """The operation with parameters learnt from ``df``; given parameters are kept."""
    check(df, operation, target)
    if df.isStreaming:
        raise ValueError("Fit on a table, then apply to the stream.")
    action, name, given = operation.action, operation.column, dict(operation.parameters)
    if action == "duplicates":
        return Operation(action, None, {"keep": "first", "scope": "all columns"})
    if action == "fill_mode" and "value" not in given:
        value = most_frequent(df, name)
        if value is None:
            raise ValueError("An entirely missing column has no most frequent value.")
        return Operation(action, name, {**given, "value": tagged(value, field_of(df, name).dataType)})
    if action not in NUMERIC_ACTIONS:
        return Operation(action, name, given)

    value = number(name, field_of(df, name).dataType)
    # What is to be learnt as quantiles comes with the shape of the column, from the same reads.
    wanted = [0.5] if action == "fill_median" and "value" not in given else \
        [0.25, 0.75] if action in OUTLIER_ACTIONS and not given else []
    learnt, (infinities, present_values, low, high) = quantiles_and(
        df, {name: finite(value)} if wanted else {}, wanted,
        [F.count_if(infinite(value)), F.count(finite(value)), F.min(finite(value)), F.max(finite(value))])
    if infinities:
        raise ValueError("This column contains infinity; correct those values first.")
    if not present_values and not (action == "fill_median" and "value" in given):
        raise ValueError("This column has no finite values to learn from.")
    if wanted and action == "fill_median":
        (given["value"],) = learnt[name]
    elif wanted:
        given = fences_from_quartiles(*learnt[name])
    elif action in SCALING_ACTIONS and not given:
        given = _fit_scaling(df, action, value, low, high)
    if action in SCALING_ACTIONS:
        _check_scaling(given)
    return Operation(action, name, given)


def tagged(value, dtype: T.DataType):
    """A fitted value in a form that JSON holds exactly: itself, or its kind and exact spelling. An instant is its
    microseconds since 1970, which no time zone changes."""
    if isinstance(value, Decimal):
        return {"decimal": str(value)}
    if isinstance(value, datetime):
        if isinstance(dtype, T.TimestampNTZType):
            return {"timestamp_ntz": value.isoformat(sep=" ")}
        return {"timestamp": int(value.replace(microsecond=0).timestamp()) * 1_000_000 + value.microsecond}
    if isinstance(value, date):
        return {"date": value.isoformat()}
    if isinstance(value, timedelta):
        return {"interval": value // timedelta(microseconds=1)}
    if isinstance(value, (bytes, bytearray)):
        return {"binary": value.hex()}
    return value


def fitted_literal(value) -> Column:
    """The column of a fitted value, tagged or plain."""
    if not isinstance(value, dict):
        return F.lit(value)
    ((kind, exact),) = value.items()
    return {
        "decimal": lambda: F.lit(Decimal(exact)), "timestamp": lambda: F.timestamp_micros(F.lit(exact)),
        "timestamp_ntz": lambda: F.lit(exact).cast("timestamp_ntz"), "date": lambda: F.lit(exact).cast("date"),
        "interval": lambda: F.lit(timedelta(microseconds=exact)), "binary": lambda: F.unhex(F.lit(exact))}[kind]()


def _fit_scaling(df: DataFrame, action: str, value: Column, low: float, high: float) -> dict:
    """Offset and divisor of x / magnitude: dividing first keeps extreme values finite."""
    magnitude = max(abs(low), abs(high)) or 1.0
    if action == "minmax":
        offset = low / magnitude
        divisor = high / magnitude - offset
    else:
        scaled = finite(value) / magnitude
        offset, divisor = df.agg(F.avg(scaled), F.stddev_pop(scaled)).first()
    if low == high or divisor == 0:
        raise ValueError("A constant column cannot be scaled.")
    return {"magnitude": magnitude, "offset": offset, "divisor": divisor}


def _check_scaling(parameters: dict) -> None:
    values = [parameters[k] for k in ("magnitude", "offset", "divisor")]
    if not all(isfinite(v) for v in values) or values[0] <= 0 or values[2] <= 0:
        raise ValueError("Invalid scaling parameters.")


def _without_infinity(value: Column) -> Column:
    return F.when(infinite(value), F.raise_error(F.lit(
        "This column contains infinity; correct those values first.")).cast("double")).otherwise(value)


def new_value(df: DataFrame, operation: Operation) -> Column:
    """The prepared cell of a cell action; missing cells that stay missing are NULL."""
    action, name, p = operation.action, operation.column, operation.parameters
    dtype = field_of(df, name).dataType
    if action == "fill_mode":
        return F.coalesce(present(name, dtype), fitted_literal(p["value"]).cast(dtype))
    if action == "trim":
        return F.expr(text.strip_sql(quote(name)))
    if action == "casefold":
        return F.expr(text.fold_sql(text.strip_sql(quote(name))))
    value = _without_infinity(number(name, dtype))
    if action == "fill_median":
        return F.coalesce(value, F.lit(float(p["value"])))
    if action == "clip_outliers":
        return F.when(value < p["lower"], p["lower"]).when(value > p["upper"], p["upper"]).otherwise(value)
    if action in SCALING_ACTIONS:
        _check_scaling(p)
        scaled = (value / p["magnitude"] - p["offset"]) / p["divisor"]
        return F.when(infinite(scaled) | F.isnan(scaled), F.raise_error(F.lit(
            "Values exceed the supported numerical range after scaling.")).cast("double")).otherwise(scaled)
    raise ValueError(f"Not a cell action: {action}")


def removed(df: DataFrame, operation: Operation) -> Column:
    """Whether ``drop_missing`` or ``drop_outliers`` removes the row."""
    dtype = field_of(df, operation.column).dataType
    if operation.action == "drop_missing":
        return missing(operation.column, dtype)
    return outside(_without_infinity(number(operation.column, dtype)), operation.parameters)


def apply(df: DataFrame, operation: Operation, row_id: str = ROW_ID,
          target: str | None = None) -> DataFrame:
    """The prepared table as a plan; the row identity column, if any, is carried along."""
    check(df, operation, target)
    if operation.action == "duplicates":
        return drop_duplicates(df, row_id)
    if operation.action in ROW_ACTIONS:
        return df.where(~removed(df, operation))
    prepared = new_value(df, operation)
    return df.select(*[
        prepared.alias(n) if n == operation.column else col(n) for n in df.columns])


def _changed(df: DataFrame, operation: Operation) -> Column:
    """Whether a cell changes; missing to missing is no change."""
    dtype = field_of(df, operation.column).dataType
    old = number(operation.column, dtype) if operation.action in NUMERIC_ACTIONS \
        else present(operation.column, dtype)
    return ~old.eqNullSafe(new_value(df, operation))


def audit(df: DataFrame, operation: Operation, row_id: str = ROW_ID) -> DataFrame:
    """One row: rows, affected_rows, changed_cells, removed_rows."""
    if df.isStreaming:
        raise ValueError("Audits need a table, not a stream.")
    zero = F.lit(0).cast("bigint")
    if operation.action == "duplicates":
        return duplicate_count(df, row_id).select(
            "rows", F.col("duplicate_rows").alias("affected_rows"),
            zero.alias("changed_cells"), F.col("duplicate_rows").alias("removed_rows"))
    if operation.action in ROW_ACTIONS:
        counts = df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(removed(df, operation)).alias("n"))
        return counts.select("rows", F.col("n").alias("affected_rows"), zero.alias("changed_cells"),
                             F.col("n").alias("removed_rows"))
    counts = df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(_changed(df, operation)).alias("n"))
    return counts.select("rows", F.col("n").alias("affected_rows"),
                         F.col("n").alias("changed_cells"), zero.alias("removed_rows"))


def _displayed(rows: DataFrame, *names: str) -> DataFrame:
    """Value texts in their example form."""
    return rows.withColumns({
        n: F.expr(f"coalesce({text.display_sql(n)}, '(missing)')") for n in names})


def _positions(df: DataFrame, ids: list[int], row_id: str) -> dict[int, int]:
    """The 1-based places, in row order, of a few rows: one pass with a counter for each."""
    ids = sorted(set(ids))
    counts = df.agg(*[F.count_if(col(row_id) <= i) for i in ids]).first() if ids else []
    return dict(zip(ids, counts))


def examples(df: DataFrame, operation: Operation, row_id: str = ROW_ID) -> DataFrame:
    """The first eight affected rows: row, source_row, before, after, matched_row, matched_source_row.

    ``row`` is the 1-based position in ``df``, ``source_row`` the position in the source, where the header is row 1.
    The matched row is the one that a removed duplicate repeats. Runs at once, as positions need the first rows.
    """
    if df.isStreaming:
        raise ValueError("Examples need a table, not a stream.")
    order, action, name = col(row_id).alias("_order"), operation.action, operation.column
    gone, none = F.lit("Row removed").alias("after"), F.lit(None).cast("bigint").alias("_kept")
    if action == "duplicates":
        pairs = duplicate_pairs(df, row_id).orderBy("removed_row").limit(SHOWN_EXAMPLES)
        fields = data_fields(df, row_id)[:SHOWN_COLUMNS]
        # At most eight pairs are broadcast.
        rows = df.join(F.broadcast(pairs), col(row_id) == F.col("removed_row")).select(
            order, F.col("kept_row").alias("_kept"),
            *[as_text(f.name, f.dataType).alias(f"v{i}") for i, f in enumerate(fields)])
        shown = F.concat_ws("; ", *[
            F.concat(F.lit(f.name + "="), f"v{i}") for i, f in enumerate(fields)])
        first = _displayed(rows, *[f"v{i}" for i in range(len(fields))]).select("_order", shown.alias("before"), gone, "_kept")
    else:
        before = as_text(name, field_of(df, name).dataType).alias("before")
        if action in ROW_ACTIONS:
            affected = df.where(removed(df, operation)).select(order, before, gone, none)
        else:
            after_type = field_of(apply(df, operation, row_id), name).dataType
            changed = df.select(order, before, new_value(df, operation).alias("_after"),
                                _changed(df, operation).alias("_changed")).where("_changed")
            affected = changed.select("_order", "before", as_text("_after", after_type).alias("after"), none)
        first = affected.orderBy("_order").limit(SHOWN_EXAMPLES)
    found = sorted(_displayed(first, "before", "after").collect(), key=lambda r: r["_order"])  # at most eight
    at = _positions(df, [i for r in found for i in (r["_order"], r["_kept"]) if i is not None], row_id)
    return local_frame(df.sparkSession, [
        (at[r["_order"]], r["_order"] + 2, r["before"], r["after"], at.get(r["_kept"]), r["_kept"] + 2 if r["_kept"] is not None else None)
        for r in found], "row bigint, source_row bigint, before string, after string, matched_row bigint, matched_source_row bigint")
