"""Small driver-side results as frames."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.pandas.types import to_arrow_schema


def local_frame(spark: SparkSession, rows: list, schema: T.StructType | str) -> DataFrame:
    """A frame of a few rows that are already on the driver.

    Going through Arrow makes it a local relation in the plan: no tasks to deserialise
    it, a known size, and constant folding of what is computed from it. One partition
    lets grouping and joining such frames do without a shuffle.
    """
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    plain = [row.asDict(recursive=True) if isinstance(row, T.Row)
             else dict(zip(schema.names, row)) for row in rows]
    for row in plain:
        for name, value in row.items():
            if isinstance(value, dict) and isinstance(schema[name].dataType, T.MapType):
                row[name] = list(value.items())
    table = pa.Table.from_pylist(plain, to_arrow_schema(schema))
    return spark.createDataFrame(table, schema).coalesce(1)
