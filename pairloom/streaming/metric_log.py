"""Metric log as a stream: append without repeats, windows, best so far.

Streaming sources and sinks are files; state and output live in the shared
folder. Windows and bests are written in update mode: each micro-batch appends
its changed rows with the batch number, and a reader takes the newest row per
key. No row waits for a watermark that never comes, and a replayed batch
overwrites its own folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from pairloom.operators.checkpoints import best_per_run


def append_log(log: DataFrame, out: str, state: str, *, delay: str | None) -> StreamingQuery:
    """Append log entries once each, by event_id.

    With ``delay=None`` every id is remembered, so nothing is lost in whatever order files come;
    state grows with the ids, which is right for a backfill. A live log that is nearly in order
    can name a delay: ids are then forgotten after it, and rows later than it are lost.
    """
    if delay is None:
        unique = log.dropDuplicates(["event_id"])
    else:
        unique = log.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])
    return (
        unique.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .outputMode("append")
        .start()
    )


def _update(df: DataFrame, out: str, state: str) -> StreamingQuery:
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return (
        df.writeStream.outputMode("update")
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )


def _newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v"))
    return latest.select(*keys, "v.*")


def window_stream(
    log: DataFrame, out: str, state: str, width: str = "1 day", *, delay: str | None
) -> StreamingQuery:
    """Count, sum and maximum per run and window.

    With ``delay=None`` all rows count, however late; state is one row per run and window. A
    delay forgets windows that old and loses rows later than it.
    """
    timed = log if delay is None else log.withWatermark("ts", delay)
    windows = (
        timed.groupBy(F.window("ts", width).alias("w"), "run")
        .agg(F.count("*").alias("n"), F.sum("metric").alias("metric_sum"), F.max("metric").alias("metric_max"))
        .select(F.col("w.start").alias("window_start"), "run", "n", "metric_sum", "metric_max")
    )
    return _update(windows, out, state)


def read_windows(spark, out: str) -> DataFrame:
    newest = _newest(spark.read.parquet(out), ["window_start", "run"])
    return newest.select(
        "window_start", "run", "n",
        F.round(F.col("metric_sum") / F.col("n"), 9).alias("metric_mean"), "metric_max",
    )


def best_stream(log: DataFrame, out: str, state: str) -> StreamingQuery:
    """Best entry so far of each run, the lowest id on a tie."""
    return _update(best_per_run(log), out, state)


def read_best(spark, out: str) -> DataFrame:
    return _newest(spark.read.parquet(out), ["run"])
