"""Column helpers that the operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: White space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, however often it is named and
    also if it is named inside an inner function."""
    return F.transform(F.array(value), body)[0]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``text`` alone, a missing text as the empty one. Other columns, whatever
    their names, go no further."""
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))


#: Stands for a missing document id inside an operator; it sorts before all others.
NO_ID = -(2**63)


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` (``NO_ID`` if missing), ``tag`` (a hash of the text), ``text`` and ``input``, all
    columns of the row as a struct.

    Operators that bring decisions back to the rows join on ``id`` and ``tag``: rows that
    repeat as a whole share a decision, rows that share only the id do not mix.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(
        F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("tag"),
        text.alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("input"))


def shown_id(column: str = "id") -> Column:
    return F.when(F.col(column) != NO_ID, F.col(column)).alias("doc_id")


def renewed(rows: DataFrame, docs: DataFrame, values: dict[str, Column]) -> DataFrame:
    """The columns of ``docs`` out of ``input``, some of them with new values of the old type."""
    return rows.select(*[
        (values[c].cast(docs.schema[c].dataType) if c in values else F.col("input")[c]).alias(c) for c in docs.columns])
