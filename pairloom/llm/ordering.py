"""Positions in an order that may put any share of the rows under one key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pairloom.session import materialize

_ROW_BITS = (1 << 33) - 1  # the part of monotonically_increasing_id that counts rows


def numbered(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Add ``pos`` (from 0 within the key), ``n`` (rows of the key) and ``chunk``.

    Rows are cut into chunks by range, so a key of any size spreads over tasks; a row's place in
    its chunk plus the counts of the key's earlier chunks is its position. Equal rows take places
    in any order, and a mass of equal rows is cut as well. The order is stored, as a second
    evaluation could cut it elsewhere. ``rows`` is read twice: give a stored table.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*keys, *order, "_row"]
    ranged = (
        rows.withColumn("_row", F.monotonically_increasing_id())
        .repartitionByRange(parts, *by)
        .sortWithinPartitions(*by)
        .drop("_row")
    )
    at = F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS))
    stored = materialize(
        ranged.select("*", F.spark_partition_id().alias("chunk"), at.alias("_at")), "ordered"
    )
    counts = stored.groupBy(*keys, "chunk").agg(
        F.min("_at").alias("_first"), F.count("*").alias("_rows")
    )
    of_key = Window.partitionBy(*keys).orderBy("chunk")
    earlier = of_key.rowsBetween(Window.unboundedPreceding, -1)
    whole = of_key.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = counts.select(
        *keys, "chunk", "_first",
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_rows").over(whole).alias("n"),
    )
    return stored.join(offsets, [*keys, "chunk"]).select(
        *rows.columns,
        (F.col("_before") + F.col("_at") - F.col("_first")).alias("pos"),
        "n",
        "chunk",
    )


def sized(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:`` and the value as text."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(
        F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)
    )
