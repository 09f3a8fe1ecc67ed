"""A reproducible row sample that does not depend on partitioning."""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions.columns import ROW_ID, col, field_of, finite, number

SAMPLE_ROWS = 10_000
SEED = 42


def sample_key(row_id: str = ROW_ID, seed: int = SEED) -> Column:
    """A pseudo-random hex text per row identity."""
    return F.md5(F.concat(col(row_id).cast("string"), F.lit(f":{seed}")))


def sample_rows(df: DataFrame, row_id: str = ROW_ID, size: int = SAMPLE_ROWS,
                seed: int = SEED) -> DataFrame:
    """The ``size`` rows with the smallest keys, in row order; all rows if there are fewer.

    Every task keeping its own top ``size`` would send size x tasks rows to one place.
    So rows are first cut to keys below a threshold that a few more than ``size`` rows
    pass. The cut is verified by a count and dropped if too few passed, which makes the
    result the exact smallest keys in any case.
    """
    total = df.count()
    if total <= size:
        return df.orderBy(row_id)
    key = sample_key(row_id, seed)
    share = (size + 10 * sqrt(size) + 100) / total
    pool = df
    if share < 0.5:
        cut = df.where(key < f"{int(share * 2**64):016x}")
        if cut.count() >= size:
            pool = cut
    picked = pool.withColumn("_key", key).orderBy("_key", row_id).limit(size)
    return picked.drop("_key").orderBy(row_id)


def sample_values(df: DataFrame, column: str, row_id: str = ROW_ID,
                  size: int = SAMPLE_ROWS, seed: int = SEED) -> DataFrame:
    """(row, value): up to ``size`` finite values of one measurement."""
    value = finite(number(column, field_of(df, column).dataType))
    values = df.select(col(row_id).alias("row"), value.alias("value")).where("value is not null")
    return sample_rows(values, "row", size, seed)
