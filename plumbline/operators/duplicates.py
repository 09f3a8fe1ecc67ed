"""Whole-row duplicates: counts, keep-first removal, and removed-kept pairs.

Rows are equal when all data columns are equal; missing equals missing, and nested
values compare by content. Grouping always combines on the map side, so one row
repeated across a third of the table does not overload a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from plumbline.functions.columns import (
    ROW_ID, as_text, col, data_fields, group_key, is_inexact, is_nested, is_variant, ordered_entries, present,
)
from plumbline.functions.text import quoted_sql

SALTS_PER_TASK = 4
"""Parts into which the rows of one key may fall, for each shuffle partition."""


def row_keys(df: DataFrame, row_id: str | None = None, keep: list[str] = ()) -> DataFrame:
    """The grouping keys k0, k1, ... of each row, beside the columns named in ``keep``."""
    keys = [group_key(f.name, f.dataType).alias(f"k{i}")
            for i, f in enumerate(data_fields(df, row_id))]
    return df.select(*[col(name) for name in keep], *keys)


def key_names(df: DataFrame, row_id: str | None = None) -> list[str]:
    return [f"k{i}" for i in range(len(data_fields(df, row_id)))]


def duplicate_count(df: DataFrame, row_id: str | None = None) -> DataFrame:
    """One row: rows, distinct_rows, duplicate_rows."""
    groups = row_keys(df, row_id).groupBy(*key_names(df, row_id)).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("rows"),
        F.count(F.lit(1)).alias("distinct_rows"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("duplicate_rows"),
    )


def drop_duplicates(df: DataFrame, row_id: str = ROW_ID) -> DataFrame:
    """Keep the first row of every group of equal rows, with its row identity.

    One shuffle, combined on the map side: rows are grouped by their values, and the smallest identity of each group
    is taken. Most values come back out of the grouping key. Where equal values may be written
    differently (variants, nested floating-point numbers), the first row's own value travels beside it. In top-level
    float columns NaN, which is missing, comes back as NULL.
    """
    fields = data_fields(df, row_id)
    carried = [f.name for f in fields if is_variant(f.dataType) or is_nested(f.dataType) and is_inexact(f.dataType)]
    keys = [(group_key if f.name in carried else _whole_key)(f.name, f.dataType).alias(f"k{i}") for i, f in enumerate(fields)]
    first = F.min("_order") if not carried else F.min_by(F.struct("_order", *[f"c{i}" for i in range(len(carried))]), "_order")
    grouped = (
        df.select(col(row_id).alias("_order"), *keys, *[col(n).alias(f"c{i}") for i, n in enumerate(carried)])
        .groupBy(*[f"k{i}" for i in range(len(fields))]).agg(first.alias("_first"))
    )
    kept = {f.name: F.col(f"_first.c{carried.index(f.name)}") if f.name in carried else _restored(F.col(f"k{i}"), f.dataType)
            for i, f in enumerate(fields)}
    kept[row_id] = F.col("_first._order" if carried else "_first")
    return grouped.select(*[kept[n].alias(n) for n in df.columns if n in kept])


def _whole_key(name: str, dtype: T.DataType):
    """A grouping key out of which the value can be had again."""
    return ordered_entries(present(name, dtype), dtype)


def _restored(key, dtype: T.DataType):
    """Undo ``ordered_entries``."""
    if isinstance(dtype, T.MapType):
        return F.map_from_entries(F.transform(
            key, lambda e: F.struct(
                _restored(e["key"], dtype.keyType).alias("key"),
                _restored(e["value"], dtype.valueType).alias("value"),
            )))
    if isinstance(dtype, T.ArrayType) and is_nested(dtype.elementType):
        return F.transform(key, lambda e: _restored(e, dtype.elementType))
    if isinstance(dtype, T.StructType):
        rebuilt = F.struct(*[_restored(key[f.name], f.dataType).alias(f.name) for f in dtype.fields])
        return F.when(key.isNotNull(), rebuilt)
    return key


def duplicate_pairs(df: DataFrame, row_id: str = ROW_ID) -> DataFrame:
    """(removed_row, kept_row) for every row that keep-first removal drops.

    Rows are dealt by their keys and a salt of the row identity, with several salts for each task, so the share of one
    key and salt stays below a task's share of the table however many rows are equal. First rows meet across salts as
    one row each, and come back to the rows by key and salt.
    """
    salts = SALTS_PER_TASK * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = key_names(df, row_id)
    rows = row_keys(df, row_id, [row_id]).withColumn("_salt", F.pmod(F.xxhash64(col(row_id)), F.lit(salts)))
    parts = rows.groupBy(*keys, "_salt").agg(F.min(col(row_id)).alias("_first"), F.count(F.lit(1)).alias("_n"))
    groups = parts.groupBy(*[F.col(k).alias(f"g{k}") for k in keys]).agg(
        F.min("_first").alias("kept_row"), F.sum("_n").alias("_n")).where("_n > 1").drop("_n")
    kept = parts.join(groups, F.expr(" and ".join(f"{k} <=> g{k}" for k in keys))).select(
        *[F.col(k).alias(f"p{k}") for k in keys], F.col("_salt").alias("_part"), "kept_row")
    return rows.join(kept, F.expr(" and ".join([*(f"{k} <=> p{k}" for k in keys), "_salt = _part"]))).select(
        col(row_id).alias("removed_row"), "kept_row").where("removed_row <> kept_row")


def pair_values(df: DataFrame, pairs: DataFrame, row_id: str = ROW_ID) -> DataFrame:
    """(removed_row, kept_row, column, kept, removed): both rows' values side by side,
    in the given version of the data (working or original)."""
    fields = data_fields(df, row_id)
    texts = df.select(
        col(row_id).alias("_order"),
        *[as_text(f.name, f.dataType).alias(f"v{i}") for i, f in enumerate(fields)],
    ).select("_order", *[
        F.expr(f"coalesce({quoted_sql(f'v{i}')}, '(missing)') as v{i}") for i in range(len(fields))])
    values = [f"v{i}" for i in range(len(fields))]
    kept = texts.select(F.col("_order").alias("kept_row"), F.struct(*values).alias("kept"))
    removed = texts.select(F.col("_order").alias("removed_row"), F.struct(*values).alias("removed"))
    joined = pairs.join(removed, "removed_row").join(kept, "kept_row")
    return joined.select("removed_row", "kept_row", F.inline(F.array(*[
        F.struct(F.lit(f.name).alias("column"), F.col(f"kept.v{i}").alias("kept"),
                 F.col(f"removed.v{i}").alias("removed"))
        for i, f in enumerate(fields)
    ])))
