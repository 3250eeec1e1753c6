"""Metric logs: steps, logged means, best checkpoints, early stopping.

A run may hold a large part of the log, so nothing orders a whole run in one
task: steps and running values come from one ``scan`` of ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from pairloom.operators.ranking import scan

LOGGING_STEPS = 50
KEEP_LAST = 2
PATIENCE = 3
DIGITS = 9

_ORDER = ["ts", "event_id"]


def numbered_log(log: DataFrame) -> DataFrame:
    """The log with ``step``, the place of an entry in its run, and ``chunk``."""
    return scan(log, ["run"], _ORDER, {})


def logged_means(numbered: DataFrame, every: int = LOGGING_STEPS) -> DataFrame:
    """Mean metric of every ``every`` steps, logged at the last of them."""
    return (
        numbered.groupBy("run", F.floor((F.col("step") - 1) / every).alias("interval"))
        .agg(
            F.max("step").alias("step"),
            F.round(F.avg("metric"), DIGITS).alias("metric"),
        )
        .drop("interval")
    )


def best_checkpoints(checkpoints: DataFrame, keep_last: int = KEEP_LAST) -> DataFrame:
    """Per run the best checkpoint (earliest on a tie) and the last ones.

    The row-number filter is cut to ``keep_last`` rows per run and task before
    the shuffle.
    """
    best = checkpoints.groupBy("run").agg(
        F.max_by("step", F.struct("metric", -F.col("step"))).alias("step"),
        F.max("metric").alias("metric"),
    )
    latest_first = Window.partitionBy("run").orderBy(F.desc("step"))
    last = (
        checkpoints.withColumn("_rn", F.row_number().over(latest_first))
        .where(F.col("_rn") <= keep_last)
        .select("run", "step", "metric")
    )
    both = best.select("*", F.lit(True).alias("is_best")).unionByName(
        last.select("*", F.lit(False).alias("is_best"))
    )
    return both.groupBy("run", "step", "metric").agg(F.bool_or("is_best").alias("is_best"))


def early_stops(log: DataFrame, patience: int = PATIENCE) -> DataFrame:
    """First step of each run after ``patience`` entries without a new best.

    An entry improves where the running maximum is first reached, so the step of the last
    improvement is that of the current maximum, and one scan gives all.
    """
    metric = F.col("metric")
    best = scan(
        log.select("run", *_ORDER, "metric"), ["run"], _ORDER,
        {"best": ("max", metric), "last_improved": ("first_max", metric)},
    )
    stopped = F.col("step") - F.coalesce("last_improved", F.lit(0)) >= patience
    return best.groupBy("run").agg(
        F.count("*").alias("n_steps"),
        F.min(F.when(stopped, F.col("step"))).alias("stop_step"),
        F.min_by("best", F.when(stopped, F.col("step"))).alias("best_at_stop"),
    )


def running_best(log: DataFrame) -> DataFrame:
    """Every entry with the best metric of its run up to then."""
    best = scan(log, ["run"], _ORDER, {"best_so_far": ("max", F.col("metric"))})
    return best.drop("chunk", "step")


def best_per_run(log: DataFrame) -> DataFrame:
    """Best entry per run, the lowest id on a tie."""
    order = F.struct("metric", -F.col("event_id"))
    return log.groupBy("run").agg(
        F.max_by("event_id", order).alias("event_id"), F.max("metric").alias("metric")
    )


def metric_windows(log: DataFrame, width: str = "1 day") -> DataFrame:
    """Mean and maximum per run and time window."""
    return (
        log.groupBy(F.window("ts", width).alias("w"), "run")
        .agg(
            F.count("*").alias("n"),
            F.round(F.avg("metric"), DIGITS).alias("metric_mean"),
            F.max("metric").alias("metric_max"),
        )
        .select(F.col("w.start").alias("window_start"), "run", "n", "metric_mean", "metric_max")
    )
