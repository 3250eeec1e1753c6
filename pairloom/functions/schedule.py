"""Training-schedule arithmetic as columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _ceil_div(a: Column, b: Column) -> Column:
    return F.ceil(a / b).cast("long")


def eval_interval(n: Column) -> Column:
    return F.least(F.lit(200).cast("long"), F.floor(n / 4).cast("long"))


def save_interval(n: Column) -> Column:
    return F.least(F.lit(500).cast("long"), F.floor(n / 2).cast("long"))


def total_steps(n: Column, batch: Column, accumulate: Column, epochs: Column) -> Column:
    """Optimiser steps: batches per epoch, grouped by accumulation, times epochs."""
    return _ceil_div(_ceil_div(n, batch), accumulate) * epochs


def warmup_rate(base: Column, step: Column, warmup: int = 100) -> Column:
    """Learning rate logged at ``step`` while it rises to ``base``.

    The logged value belongs to the update before the step, hence ``step - 1``.
    """
    return base * F.least(F.lit(1.0), (step - 1) / F.lit(float(warmup)))
