"""Apply a recipe fitted on a table to a stream.

Fitted steps are stateless, so the stream needs no watermark and no state; removing
duplicates, fitting and audits look at the whole table and are refused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from plumbline.plans.recipe import Recipe


def apply_to_stream(stream: DataFrame, recipe: Recipe) -> DataFrame:
    if not stream.isStreaming:
        raise ValueError("This is a table; use Recipe.apply.")
    return recipe.apply(stream)


def write_prepared(stream: DataFrame, recipe: Recipe, path: str, checkpoint: str,
                   available_now: bool = False) -> StreamingQuery:
    """Append the prepared stream to Parquet files, exactly once. ``checkpoint`` must be
    a folder that all executors share."""
    writer = (
        apply_to_stream(stream, recipe).writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint))
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
