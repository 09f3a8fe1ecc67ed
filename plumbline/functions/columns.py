"""Type classes, the missing-value rule, quoting, and grouping keys.

A column's class decides which indicators it enters and depends on its type alone.
NaN in a top-level float column counts as missing; infinity does not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

ROW_ID = "_row"
"""Default name of the row-identity column. It is never one of the data columns."""

LONG_VALUE_BYTES = 64
"""Strings above this size enter grouping keys as their SHA-256 digest, so a shuffle
of keys never carries whole documents."""


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quote(name))


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.CharType, T.VarcharType))


def is_float(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def is_measurement(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_plot_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.NumericType, T.BooleanType))


def is_categorical(dtype: T.DataType) -> bool:
    return not is_plot_numeric(dtype)


def is_nested(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.ArrayType, T.MapType, T.StructType))


def is_variant(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.VariantType)


def kind(dtype: T.DataType) -> str:
    """One word per class; stored with the column facts."""
    if is_measurement(dtype):
        return "measurement"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if is_text(dtype):
        return "text"
    if is_nested(dtype):
        return "nested"
    return "other"


def data_fields(df: DataFrame, row_id: str | None = None) -> list[T.StructField]:
    """The dataset's own columns: everything except the row identity."""
    hidden = {ROW_ID, row_id}
    return [field for field in df.schema.fields if field.name not in hidden]


def field_of(df: DataFrame, name: str) -> T.StructField:
    for field in df.schema.fields:
        if field.name == name:
            return field
    raise ValueError(f"Column not found: {name}")


def literal(text: str) -> str:
    """A string as a SQL literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def missing_sql(name: str, dtype: T.DataType) -> str:
    c = quote(name)
    if is_float(dtype):
        return f"({c} is null or isnan({c}))"
    if is_variant(dtype):
        return f"({c} is null or is_variant_null({c}))"
    return f"({c} is null)"


def present_sql(name: str, dtype: T.DataType) -> str:
    if is_float(dtype) or is_variant(dtype):
        return f"(case when not {missing_sql(name, dtype)} then {quote(name)} end)"
    return quote(name)


def number_sql(name: str, dtype: T.DataType) -> str:
    if isinstance(dtype, T.BooleanType):
        return f"cast(cast({quote(name)} as int) as double)"
    return f"cast({present_sql(name, dtype)} as double)"


def missing(name: str, dtype: T.DataType) -> Column:
    """The one test for a missing value."""
    return F.expr(missing_sql(name, dtype))


def present(name: str, dtype: T.DataType) -> Column:
    """The column with every missing value turned into NULL."""
    return F.expr(present_sql(name, dtype))


def normalise(df: DataFrame) -> DataFrame:
    """NaN to NULL in top-level float columns; all other columns untouched."""
    return df.select(
        *[
            (present(f.name, f.dataType) if is_float(f.dataType) else col(f.name)).alias(f.name)
            for f in df.schema.fields
        ]
    )


def number(name: str, dtype: T.DataType) -> Column:
    """A measurement or boolean as a double, NULL where missing."""
    return F.expr(number_sql(name, dtype))


def finite(value: Column) -> Column:
    """The double where it is finite, else NULL."""
    return F.when(F.abs(value) < float("inf"), value)


def infinite(value: Column) -> Column:
    return F.abs(value) == float("inf")


def _has_map(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.MapType):
        return True
    if isinstance(dtype, T.ArrayType):
        return _has_map(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return any(_has_map(f.dataType) for f in dtype.fields)
    return False


def ordered_entries(value: Column, dtype: T.DataType) -> Column:
    """Maps, at any depth, as their ordered entries: two maps are equal only when
    their entries are equal in order, and the result can be grouped and sorted."""
    if not _has_map(dtype):
        return value
    if isinstance(dtype, T.MapType):
        return F.transform(
            F.map_entries(value),
            lambda e: F.struct(
                ordered_entries(e["key"], dtype.keyType).alias("key"),
                ordered_entries(e["value"], dtype.valueType).alias("value"),
            ),
        )
    if isinstance(dtype, T.ArrayType):
        return F.transform(value, lambda e: ordered_entries(e, dtype.elementType))
    rebuilt = F.struct(
        *[ordered_entries(value[f.name], f.dataType).alias(f.name) for f in dtype.fields]
    )
    return F.when(value.isNotNull(), rebuilt)


def _any(dtype: T.DataType, test) -> bool:
    """Whether the type or one inside it passes a test."""
    inner = ([dtype.elementType] if isinstance(dtype, T.ArrayType) else [dtype.keyType, dtype.valueType] if isinstance(dtype, T.MapType)
             else [f.dataType for f in dtype.fields] if isinstance(dtype, T.StructType) else [])
    return test(dtype) or any(_any(t, test) for t in inner)


def is_inexact(dtype: T.DataType) -> bool:
    """Whether equal values of the type may be written differently, so that a grouping key cannot stand for the value."""
    return _any(dtype, lambda t: is_float(t) or is_variant(t))


#: Whole strings, which stay, or numbers that end in .0.
_NUMBERS = r"""("(?:[^"\\]|\\.)*")|-(0)[.]0(?![0-9E])|(-?[0-9]+)[.]0(?![0-9E])"""


def canonical_variant(value: Column) -> Column:
    """A variant as a text that is equal where two values are equal: its kinds, with all numbers as one, and its JSON,
    in which keys are sorted, 1.0 is 1 and -0.0 is 0. A date is not the text that spells it. Doubles
    that need an exponent differ from integers."""
    kinds = F.regexp_replace(F.schema_of_variant(value), r"BIGINT|DOUBLE|FLOAT|DECIMAL[(][0-9,]+[)]", "NUMBER")
    return F.when(value.isNotNull(), F.concat(kinds, F.lit("|"), F.regexp_replace(F.to_json(value), _NUMBERS, "$1$2$3")))


def comparable(value: Column, dtype: T.DataType) -> Column:
    """A nested value in a form that can be grouped and is equal where the values are: maps as their ordered
    entries, 0.0 for -0.0, variants as their canonical text."""
    if is_variant(dtype):
        return canonical_variant(value)
    if is_float(dtype):
        return value + F.lit(0).cast(dtype)
    if not (is_inexact(dtype) or _has_map(dtype)):
        return value
    if isinstance(dtype, T.MapType):
        return F.transform(F.map_entries(value), lambda e: F.struct(
            comparable(e["key"], dtype.keyType).alias("key"), comparable(e["value"], dtype.valueType).alias("value")))
    if isinstance(dtype, T.ArrayType):
        return F.transform(value, lambda e: comparable(e, dtype.elementType))
    return F.when(value.isNotNull(), F.struct(*[comparable(value[f.name], f.dataType).alias(f.name) for f in dtype.fields]))


def short_sql(value: str) -> str:
    """A string, or '#' and its SHA-256 digest when it is longer than 64 bytes.

    The digest form has 65 bytes, so it can never equal a short string.
    """
    return (f"(case when octet_length({value}) > {LONG_VALUE_BYTES} "
            f"then concat('#', sha2({value}, 256)) else {value} end)")


def group_key(name: str, dtype: T.DataType) -> Column:
    """A groupable value that is equal exactly where the column's values are equal."""
    c = quote(name)
    if is_text(dtype):
        return F.expr(short_sql(c))
    if isinstance(dtype, T.BinaryType):
        return F.expr(short_sql(f"lower(hex({c}))"))
    if is_variant(dtype):
        text = canonical_variant(present(name, dtype))
        return F.when(F.octet_length(text) > LONG_VALUE_BYTES, F.concat(F.lit("#"), F.sha2(text, 256))).otherwise(text)
    if is_nested(dtype):
        return comparable(col(name), dtype)
    return present(name, dtype)


def iso_sql(value: str) -> str:
    """Timestamps as ISO text, with microseconds only where there are any."""
    seconds = f"date_format({value}, \"yyyy-MM-dd'T'HH:mm:ss\")"
    micros = f"date_format({value}, '.SSSSSS')"
    return f"(case when {micros} = '.000000' then {seconds} else concat({seconds}, {micros}) end)"


def instant_sql(value: str) -> str:
    """``iso_sql`` with the offset, except in UTC: two instants never share a text."""
    offset = f"date_format({value}, 'XXX')"
    return f"concat({iso_sql(value)}, case when {offset} = 'Z' then '' else {offset} end)"


def _without_negative_zero(value: Column, dtype: T.DataType) -> Column:
    """0.0 for -0.0 at any depth of a value that has gone through ``ordered_entries``."""
    if is_float(dtype):
        return value + F.lit(0).cast(dtype)
    if not _any(dtype, is_float):
        return value
    if isinstance(dtype, T.MapType):
        return F.transform(value, lambda e: F.struct(
            _without_negative_zero(e["key"], dtype.keyType).alias("key"), _without_negative_zero(e["value"], dtype.valueType).alias("value")))
    if isinstance(dtype, T.ArrayType):
        return F.transform(value, lambda e: _without_negative_zero(e, dtype.elementType))
    return F.when(value.isNotNull(), F.struct(*[_without_negative_zero(value[f.name], f.dataType).alias(f.name) for f in dtype.fields]))


def as_text(name: str, dtype: T.DataType) -> Column:
    """Value as text: bytes as hex, dates and timestamps as ISO, nested values as JSON."""
    if is_nested(dtype):
        body = F.to_json(F.struct(_without_negative_zero(ordered_entries(col(name), dtype), dtype).alias("v")),
                         {"ignoreNullFields": "false"})
        # Without the {"v": ... } wrapper, which to_json needs around plain arrays.
        return F.when(col(name).isNotNull(), F.substr(body, F.lit(6), F.length(body) - 6))
    return F.expr(_flat_text(name, dtype))


def short_text(name: str, dtype: T.DataType) -> Column:
    """``as_text`` in its key form: long texts as their digest."""
    if is_nested(dtype):
        text = as_text(name, dtype)
        digest = F.concat(F.lit("#"), F.sha2(text, 256))
        return F.when(F.octet_length(text) > LONG_VALUE_BYTES, digest).otherwise(text)
    text = _flat_text(name, dtype)
    return F.expr(short_sql(text) if has_long_text(dtype) else text)


def has_long_text(dtype: T.DataType) -> bool:
    """Whether the text of a value can exceed the key size."""
    return not isinstance(dtype, (
        T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType))


def _flat_text(name: str, dtype: T.DataType) -> str:
    c = quote(name)
    if is_text(dtype):
        return c
    if is_float(dtype):
        # Adding zero folds -0.0 into 0.0, which are one value.
        return f"cast({present_sql(name, dtype)} + cast(0 as {dtype.simpleString()}) as string)"
    if isinstance(dtype, T.BinaryType):
        return f"lower(hex({c}))"
    if isinstance(dtype, T.TimestampType):
        return instant_sql(c)
    if isinstance(dtype, T.TimestampNTZType):
        return iso_sql(c)
    if is_variant(dtype):
        return f"to_json({present_sql(name, dtype)})"
    return f"cast({c} as string)"


def _renderable(value: Column, dtype: T.DataType) -> Column:
    """The value with what JSON cannot hold replaced, at any depth: non-finite numbers by
    NULL, bytes by hex, timestamps by ISO text."""
    if is_float(dtype):
        return finite(value)
    if isinstance(dtype, T.BinaryType):
        return F.lower(F.hex(value))
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        seconds, micros = (F.date_format(value, p) for p in ("yyyy-MM-dd'T'HH:mm:ss", ".SSSSSS"))
        return F.when(micros == ".000000", seconds).otherwise(F.concat(seconds, micros))
    if isinstance(dtype, T.ArrayType):
        return F.transform(value, lambda e: _renderable(e, dtype.elementType))
    if isinstance(dtype, T.MapType):
        return F.transform_values(value, lambda _, e: _renderable(e, dtype.valueType))
    if isinstance(dtype, T.StructType):
        parts = [_renderable(value[f.name], f.dataType).alias(f.name) for f in dtype.fields]
        return F.when(value.isNotNull(), F.struct(*parts))
    return value


def json_value(name: str, dtype: T.DataType) -> Column:
    """The JSON-safe rendering of a value, as text; values without one are NULL."""
    if is_nested(dtype):
        body = F.to_json(F.struct(_renderable(col(name), dtype).alias("v")), {"ignoreNullFields": "false"})
        return F.when(col(name).isNotNull(), F.substr(body, F.lit(6), F.length(body) - 6))
    if is_float(dtype):
        return F.when(finite(number(name, dtype)).isNotNull(), as_text(name, dtype))
    return as_text(name, dtype)
