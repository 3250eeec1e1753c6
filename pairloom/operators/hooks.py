"""Places for a user's own batch function and metric."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

BatchFunction = Callable[[pa.RecordBatch], pa.RecordBatch]
Metric = Callable[[DataFrame, list[str]], DataFrame]


def map_batches(df: DataFrame, function: BatchFunction, schema: str) -> DataFrame:
    """Apply ``function`` to Arrow batches; only its columns remain."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield function(batch)

    return df.mapInArrow(apply, schema)


def batch_metric(
    df: DataFrame, by: list[str], partial: BatchFunction, sums: list[str], finish: dict[str, Column]
) -> DataFrame:
    """A user's metric per evaluation, from sums that ``partial`` makes of Arrow batches.

    ``partial`` gets batches of any rows and returns one row for each key it saw: the columns
    ``by`` and the numbers ``sums``. Spark adds them up by key, so no evaluation is ever collected,
    and ``finish`` names the results as expressions over the sums.
    """
    schema = T.StructType([df.schema[k] for k in by] + [T.StructField(s, T.DoubleType()) for s in sums])
    parts = df.mapInArrow(lambda batches: map(partial, batches), schema)
    added = parts.groupBy(*by).agg(*[F.sum(s).alias(s) for s in sums])
    return added.select(*by, *[c.alias(name) for name, c in finish.items()])


def evaluate(df: DataFrame, metrics: list[Metric], by: list[str]) -> DataFrame:
    """Join the results of several metrics, each one row per ``by``.

    A metric gets the predictions and the key columns and returns its columns
    beside the keys.
    """
    out = df.select(*by).distinct()
    for metric in metrics:
        out = out.join(metric(df, by), by, "left")
    return out
