"""Counts per distinct value, for many columns in one shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from plumbline.functions.columns import (
    as_text, col, data_fields, field_of, has_long_text, instant_sql, is_float, is_measurement, is_nested, is_variant,
    literal, missing, present_sql, quote, short_text,
)
from plumbline.functions.local import local_frame


def _slot(field: T.StructField) -> tuple[str, Column, str]:
    """Where a column's values go in a typed key, the value there, and the SQL that turns it into the column's text."""
    c, dtype = quote(field.name), field.dataType
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "whole", F.expr(f"cast({c} as bigint)"), "cast(whole as string)"
    if isinstance(dtype, T.BooleanType):
        return "whole", F.expr(f"cast(cast({c} as int) as bigint)"), "cast(whole = 1 as string)"
    if isinstance(dtype, T.DateType):
        return "whole", F.expr(f"cast(unix_date({c}) as bigint)"), "cast(date_from_unix_date(cast(whole as int)) as string)"
    if isinstance(dtype, T.TimestampType):
        return "whole", F.expr(f"unix_micros({c})"), instant_sql("timestamp_micros(whole)")
    if is_float(dtype):
        # Adding zero folds -0.0 into 0.0, which are one value.
        return "real", F.expr(f"cast({present_sql(field.name, dtype)} as double) + 0D"), f"cast(cast(real as {dtype.simpleString()}) as string)"
    return "text", short_text(field.name, dtype), "text"


def typed_counts(df: DataFrame, names: list[str], row_id: str | None = None) -> DataFrame:
    """(position, whole, real, text, n[, first_row]): how often each present value of the named columns occurs.

    A key is the column's place among the names and the value in the slot of its type: integers, booleans, dates and
    instants as a 64-bit number, floats as a double, the rest as text (its digest if long). No number becomes text for it.
    Hot values collapse on the map side, so a value held by a third of all rows costs one row per task in the shuffle.
    """
    slots = [_slot(field_of(df, n)) for n in names]
    empty = {"whole": "bigint", "real": "double", "text": "string"}
    wide = df.select(
        *([col(row_id).alias("_order")] if row_id else []),
        *[(value if kind == slot else F.lit(None).cast(t)).alias(f"{kind}{i}") for i, (slot, value, _) in enumerate(slots) for kind, t in empty.items()])
    cells = ", ".join(f"{i}, whole{i}, real{i}, text{i}" for i in range(len(names)))
    long = wide.selectExpr(*(["_order"] if row_id else []), f"stack({len(names)}, {cells}) as (position, whole, real, text)").where(
        "whole is not null or real is not null or text is not null")
    aggregates = [F.count(F.lit(1)).alias("n"), *([F.min("_order").alias("first_row")] if row_id else [])]
    return long.groupBy("position", *empty).agg(*aggregates)


def frequencies(df: DataFrame, names: list[str] | None = None, row_id: str | None = None, whole_texts: bool = False) -> DataFrame:
    """(column, key, n[, first_row]): how often each present value occurs.

    Missing values are dropped and nested values are keyed by their JSON text. Values become text once they are
    counted. Long texts are shown as their digest, or, with ``whole_texts``, as they are: then each different
    one is sent once more.
    """
    names = [f.name for f in data_fields(df, row_id)] if names is None else names
    if not names:
        return local_frame(df.sparkSession, [], "column string, key string, n bigint" + ", first_row bigint" * bool(row_id))
    shown: dict[str, list[int]] = {}
    for i, n in enumerate(names):
        shown.setdefault(_slot(field_of(df, n))[2], []).append(i)
    text = " ".join(f"when position in ({', '.join(map(str, places))}) then {sql}" for sql, places in shown.items())
    named = f"element_at(array({', '.join(map(literal, names))}), position + 1)"
    counted = typed_counts(df, names, row_id).selectExpr(f"{named} as column", f"case {text} end as key", "n", *(["first_row"] if row_id else []))
    long_names = [n for n in names if has_long_text(field_of(df, n).dataType)] if whole_texts else []
    if not long_names:
        return counted
    texts = reduce(DataFrame.unionByName, [
        df.select(F.lit(n).alias("column"), short_text(n, field_of(df, n).dataType).alias("key"), as_text(n, field_of(df, n).dataType).alias("_text"))
        for n in long_names]).where(_is_digest(F.col("key"))).groupBy("column", "key").agg(F.first("_text").alias("_text"))
    return counted.join(texts, ["column", "key"], "left").withColumn("key", F.coalesce("_text", "key")).drop("_text")


def _is_digest(key: Column) -> Column:
    return key.startswith("#") & (F.length(key) == 65)


def distinct_counts(df: DataFrame, names: list[str] | None = None,
                    row_id: str | None = None) -> DataFrame:
    """(column, distinct_count): exact, missing excluded, 0 for an all-missing column."""
    names = [f.name for f in data_fields(df, row_id)] if names is None else names
    every = local_frame(df.sparkSession, list(enumerate(names)), "position int, column string")
    if not names:
        return every.selectExpr("column", "0L as distinct_count")
    counted = typed_counts(df, names).groupBy("position").agg(F.count(F.lit(1)).alias("n"))
    return every.join(F.broadcast(counted), "position", "left").select(  # one row for each column
        "column", F.coalesce("n", F.lit(0)).cast("bigint").alias("distinct_count")
    )


def approximate_distinct_counts(df: DataFrame, names: list[str] | None = None,
                                relative_error: float = 0.02) -> DataFrame:
    """Opt-in sketch of ``distinct_counts``: one aggregation, no shuffle of values."""
    names = [f.name for f in data_fields(df)] if names is None else names
    fields = [field_of(df, name) for name in names]
    row = df.agg(*[
        F.approx_count_distinct(short_text(f.name, f.dataType), relative_error).alias(f"d{i}")
        for i, f in enumerate(fields)
    ])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("column"), F.col(f"d{i}").alias("distinct_count"))
        for i, name in enumerate(names)
    ])))


def top_k(counted: DataFrame, k: int, ties: str = "key") -> DataFrame:
    """The k most frequent values per column with their 1-based rank."""
    order = Window.partitionBy("column").orderBy(F.desc("n"), F.asc(ties))
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_values(df: DataFrame, names: list[str] | None = None, k: int = 5,
               row_id: str | None = None) -> DataFrame:
    """(column, rank, value, n): the most frequent values of the non-measurement columns.

    Equal counts are ordered by first appearance when a row identity is given, else by
    value (long texts by digest). Winners that travelled as digests get their whole
    text back in a second scan that is joined with those few keys only.
    """
    if names is None:
        names = [f.name for f in data_fields(df, row_id) if not is_measurement(f.dataType)]
    if not names:
        return local_frame(df.sparkSession, [], "column string, rank int, value string, n bigint")
    winners = top_k(frequencies(df, names, row_id), k, "first_row" if row_id else "key")
    long_names = [n for n in names if has_long_text(field_of(df, n).dataType)]
    if not long_names:
        return winners.select("column", "rank", F.col("key").alias("value"), "n")
    # Proven bound: at most k digests per column reach the broadcast.
    digests = winners.where(_is_digest(F.col("key")))
    parts = [
        df.select(F.lit(n).alias("column"), short_text(n, field_of(df, n).dataType).alias("key"),
                  as_text(n, field_of(df, n).dataType).alias("text"))
        for n in long_names]
    texts = reduce(DataFrame.unionByName, parts)
    found = (
        texts.join(F.broadcast(digests.select("column", "key")), ["column", "key"], "left_semi")
        .groupBy("column", "key").agg(F.first("text").alias("text"))
    )
    return (
        winners.join(F.broadcast(found), ["column", "key"], "left")
        .select("column", "rank", F.coalesce("text", "key").alias("value"), "n")
    )


def value_counts(df: DataFrame, name: str, row_id: str | None = None) -> DataFrame:
    """(key, n[, first_row]) of one column; long texts as their digest (see ``with_texts``)."""
    return frequencies(df, [name], row_id).drop("column")


def with_texts(counted: DataFrame, df: DataFrame, name: str, key: str = "key") -> DataFrame:
    """``counted`` with whole texts in place of digests in the column ``key``.

    A second scan, joined with the digests that are left; one text per digest comes back.
    """
    dtype = field_of(df, name).dataType
    if not has_long_text(dtype):
        return counted
    digests = counted.where(_is_digest(col(key))).select(col(key).alias("_digest")).distinct()
    texts = df.select(short_text(name, dtype).alias("_digest"), as_text(name, dtype).alias("_text"))
    texts = texts.join(digests, "_digest", "left_semi").groupBy("_digest").agg(F.first("_text").alias("_text"))
    joined = counted.join(texts, col(key) == F.col("_digest"), "left")
    return joined.withColumn(key, F.coalesce("_text", col(key))).drop("_digest", "_text")


def most_frequent(df: DataFrame, name: str):
    """The most frequent present value in the column's own type; the smallest on ties.

    A distributed count and a top-1, because ``mode()`` keeps all distinct values in one
    buffer. None when every value is missing.
    """
    field = field_of(df, name)
    if is_nested(field.dataType) or is_variant(field.dataType):
        raise ValueError("Nested values have no most frequent value to fill with.")
    row = (
        df.where(~missing(name, field.dataType)).groupBy(col(name).alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), F.asc("value")).limit(1).first()
    )
    return row["value"] if row else None
