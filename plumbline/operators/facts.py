"""The shared measurements behind profiles and scores.

``column_facts`` and ``table_facts`` come out of one scan of the table; each score is
then arithmetic over a frame with one row per column.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F, types as T

from plumbline.functions.columns import (
    col, data_fields, field_of, group_key, is_text, is_variant, kind, literal, missing_sql, quote,
    short_sql,
)
from plumbline.functions.local import local_frame
from plumbline.functions.text import fold_sql, is_number_sql, strip_sql

# The share of number-like texts that marks a column as numbers stored as
# text.
NUMERIC_TEXT_SHARE = 0.9

COLUMN_FACTS = T.StructType([
    T.StructField("dataset_id", T.StringType()),
    T.StructField("ordinal", T.IntegerType()),
    T.StructField("column", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("rows", T.LongType()),
    T.StructField("missing", T.LongType()),
    T.StructField("numeric_texts", T.LongType()),
    T.StructField("mixed", T.BooleanType()),
    T.StructField("constant", T.BooleanType()),
])


def _value_kind(name: str) -> str:
    """The kind of one variant value: boolean, number, text or its own type name."""
    word = f"regexp_extract(schema_of_variant({quote(name)}), '^([A-Z_]+)', 1)"
    return (f"(case when {word} = 'BOOLEAN' then 'boolean' when {word} = 'STRING' then 'text' "
            f"when {word} in ('BIGINT', 'DECIMAL', 'DOUBLE', 'FLOAT') then 'number' else {word} end)")


def _scan(df: DataFrame, row_id: str | None) -> DataFrame:
    """One row of counters for all columns, from one aggregation."""
    fields = data_fields(df, row_id)
    absent = {f.name: missing_sql(f.name, f.dataType) for f in fields}
    complete = " and ".join(f"not {a}" for a in absent.values()) or "true"
    aggregates = [F.expr("count(1) as rows"), F.expr(f"count_if({complete}) as complete_rows")]
    for i, f in enumerate(fields):
        aggregates.append(F.expr(f"count_if({absent[f.name]}) as missing{i}"))
        if is_text(f.dataType):
            aggregates.append(F.expr(f"count_if({is_number_sql(quote(f.name))}) as numeric{i}"))
        if is_variant(f.dataType):
            sort = f"case when not {absent[f.name]} then {_value_kind(f.name)} end"
            aggregates.append(F.expr(f"min({sort}) < max({sort}) as mixed{i}"))
        # Smallest = largest is an exact test for at most one distinct value.
        key = group_key(f.name, f.dataType)
        aggregates.append((F.min(key) < F.max(key)).alias(f"varies{i}"))
    return df.agg(*aggregates)


def _column_array(fields: list[T.StructField], dataset_id: str) -> str:
    """The counters of ``_scan`` as an array with an entry per column."""
    if not fields:
        return f"cast(array() as array<{COLUMN_FACTS.simpleString()}>)"
    rows = [
        f"struct({literal(dataset_id)} as dataset_id, {i} as ordinal, {literal(f.name)} as column, "
        f"{literal(f.dataType.simpleString())} as type, {literal(kind(f.dataType))} as kind, rows, "
        f"missing{i} as missing, {f'numeric{i}' if is_text(f.dataType) else '0L'} as numeric_texts, "
        f"{f'coalesce(mixed{i}, false)' if is_variant(f.dataType) else 'false'} as mixed, "
        f"not coalesce(varies{i}, false) as constant)"
        for i, f in enumerate(fields)]
    return f"array({', '.join(rows)})"


def _column_rows(fields: list[T.StructField], dataset_id: str) -> str:
    """The counters of ``_scan`` as one row per column."""
    return f"inline({_column_array(fields, dataset_id)})"


def column_facts(df: DataFrame, dataset_id: str = "dataset", row_id: str | None = None) -> DataFrame:
    """One row per column (see ``COLUMN_FACTS``), from one aggregation."""
    return _scan(df, row_id).selectExpr(_column_rows(data_fields(df, row_id), dataset_id))


def table_facts(df: DataFrame, dataset_id: str = "dataset", row_id: str | None = None) -> DataFrame:
    """One row: dataset_id, rows, columns, missing_cells, complete_rows."""
    fields = data_fields(df, row_id)
    absent = [missing_sql(f.name, f.dataType) for f in fields]
    cells = " + ".join(f"cast({a} as bigint)" for a in absent) or "0L"
    complete = " and ".join(f"not {a}" for a in absent) or "true"
    return df.select(F.expr(f"{cells} as cells"), F.expr(f"{complete} as complete")).agg(
        F.expr(f"{literal(dataset_id)} as dataset_id"), F.expr("count(1) as rows"),
        F.expr(f"{len(fields)} as columns"), F.expr("coalesce(sum(cells), 0L) as missing_cells"),
        F.expr("count_if(complete) as complete_rows"))


def scan_facts(df: DataFrame, dataset_id: str = "dataset",
               row_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Column facts and table facts with the table scanned once, now.

    The result of the scan is one row of counters, kept as a local relation.
    """
    fields = data_fields(df, row_id)
    scan = _scan(df, row_id)
    row = scan.first()
    counters = local_frame(df.sparkSession, [row], scan.schema)
    cells = " + ".join(f"missing{i}" for i in range(len(fields))) or "0L"
    return (
        counters.selectExpr(_column_rows(fields, dataset_id)),
        counters.selectExpr(f"{literal(dataset_id)} as dataset_id", "rows", f"{len(fields)} as columns",
                            f"{cells} as missing_cells", "complete_rows"))


def facts_of_many(tables: dict[str, DataFrame], row_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``scan_facts`` of several tables by dataset id: one job, in which every table is scanned once."""
    scans = []
    for dataset_id, df in tables.items():
        fields = data_fields(df, row_id)
        cells = " + ".join(f"missing{i}" for i in range(len(fields))) or "0L"
        scans.append(_scan(df, row_id).selectExpr(
            f"{literal(dataset_id)} as dataset_id", "rows", f"{len(fields)} as columns", f"{cells} as missing_cells", "complete_rows",
            f"{_column_array(fields, dataset_id)} as facts"))
    scan = reduce(DataFrame.unionByName, scans)
    counters = local_frame(scan.sparkSession, scan.collect(), scan.schema)  # a row for each table
    return counters.selectExpr("inline(facts)"), counters.drop("facts")


def text_variant_columns(df: DataFrame, names: list[str] | None = None,
                         row_id: str | None = None) -> DataFrame:
    """(column, variant_groups): columns where spellings differ only in case or padding.

    Each cell carries its folded key and raw key (digests when long). Distinct pairs
    combine on the map side first, then count per folded key: hash aggregation both
    times, where a smallest and largest text would have to sort.
    """
    if names is None:
        names = [f.name for f in data_fields(df, row_id) if is_text(f.dataType)]
    if not names:
        return local_frame(df.sparkSession, [], "column string, variant_groups bigint")
    # One step per select: each is read several times by the next and computed once.
    cells = (
        df.select(*[col(n) for n in names]).unpivot([], [col(n) for n in names], "column", "raw")
        .where("raw is not null")
        .selectExpr("column", "raw", f"{strip_sql('raw')} as stripped")
        .selectExpr("column", "raw", f"{fold_sql('stripped')} as folded")
        .selectExpr("column", f"{short_sql('raw')} as raw", f"{short_sql('folded')} as folded")
    )
    return (
        cells.distinct().groupBy("column", "folded").agg(F.expr("count(1) as spellings"))
        .where("spellings > 1").groupBy("column").agg(F.expr("count(1) as variant_groups"))
    )


def mixed_type_columns(df: DataFrame) -> DataFrame:
    """(column, kinds): variant columns whose values are of more than one kind."""
    names = [f.name for f in df.schema.fields if is_variant(f.dataType)]
    if not names:
        return local_frame(df.sparkSession, [], "column string, kinds bigint")
    kinds = df.selectExpr(*[
        f"case when not {missing_sql(n, field_of(df, n).dataType)} then {_value_kind(n)} end as {quote(n)}"
        for n in names])
    return (
        kinds.unpivot([], [col(n) for n in names], "column", "sort").where("sort is not null")
        .groupBy("column", "sort").count()
        .groupBy("column").agg(F.expr("count(1) as kinds")).where("kinds > 1")
    )
