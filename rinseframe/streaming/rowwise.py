"""Cleaning rows as they arrive.

Row-level operators (replace, type changes, date parts, deletion, column choice)
run on a streaming table as they are. Fitted operators take their parameters from
a batch table first: ``apply_normalize``, ``apply_fill``, ``apply_bins`` and the like.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def clean_stream(
    spark: SparkSession,
    source: str,
    schema,
    steps: Iterable[Callable[[DataFrame], DataFrame]],
    target: str,
    checkpoint: str,
) -> StreamingQuery:
    """Append cleaned Parquet files for every new Parquet file below ``source``.

    Processes what is there and stops; called again it goes on where it ended.
    """
    rows = spark.readStream.schema(schema).parquet(source)
    for step in steps:
        rows = rows.transform(step)
    return (
        rows.writeStream.format("parquet")
        .outputMode("append")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
