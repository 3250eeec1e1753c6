"""Equi-joins that stay balanced when a few keys hold most of the rows.

A key is heavy when it holds more than 1/parts of the rows, so there are fewer
than ``parts`` heavy keys whatever the size of the data, and a table of them is
always small enough to broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

LOOKUP_PARTS = 4096
JOIN_PARTS = 64


def heavy_keys(df: DataFrame, on: list[str], parts: int, out: str) -> DataFrame:
    """Keys with more than 1/parts of the rows and the pieces to cut them into."""
    counts = df.groupBy(*on).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()
    return counts.where(F.col("_n") * parts > total).select(
        *on, F.ceil(F.col("_n") * parts / total).cast("int").alias(out)
    )


def salted_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    left_id: list[str],
    right_id: list[str] | None,
    condition: Column | None = None,
    how: str = "inner",
    parts: int = JOIN_PARTS,
) -> DataFrame:
    """Join on ``on`` with heavy keys cut into pieces on either side.

    A row of a heavy key goes to one piece of its own side and is repeated for
    the pieces of the other side, so each matching pair meets exactly once.
    ``right_id=None`` says the right side is unique on ``on``. With ``how`` =
    "left" every left row must meet one cell only, so the right side must be
    unique. ``condition`` may use all columns of both sides.
    """
    if how == "left" and right_id is not None:
        raise ValueError("a left join needs a right side unique on its key")
    cuts = heavy_keys(left, on, parts, "_lp")
    if right_id is not None:
        cuts = cuts.join(heavy_keys(right, on, parts, "_rp"), on, "full")
    else:
        cuts = cuts.withColumn("_rp", F.lit(1))
    cuts = cuts.select(
        *on,
        F.coalesce("_lp", F.lit(1)).alias("_lp"),
        F.coalesce("_rp", F.lit(1)).alias("_rp"),
    )

    def place(df: DataFrame, ids: list[str], own: str, other: str, own_at: str, other_at: str):
        cut = df.join(F.broadcast(cuts), on, "left")
        n_own = F.coalesce(own, F.lit(1))
        n_other = F.coalesce(other, F.lit(1))
        at = F.pmod(F.xxhash64(*ids), n_own).cast("int") if ids else F.lit(0)
        return cut.select(
            *df.columns,
            at.alias(own_at),
            F.explode(F.sequence(F.lit(0), n_other - 1)).alias(other_at),
        )

    a = place(left, left_id, "_lp", "_rp", "_la", "_ra")
    b = place(right, right_id or [], "_rp", "_lp", "_ra", "_la")
    joined = a.join(b, [*on, "_la", "_ra"], how)
    if condition is not None:
        joined = joined.where(condition)
    return joined.drop("_la", "_ra")


def weighted_lookup(
    rows: DataFrame,
    table: DataFrame,
    on: list[str],
    weight: str,
    spread_by: list[str],
    parts: int = LOOKUP_PARTS,
) -> DataFrame:
    """Left join of ``rows`` to ``table``, unique on ``on``, in one pass.

    ``weight`` is a column of ``table`` proportional to how many rows have that
    key. Heavy keys are answered by a broadcast; their rows then take a salted
    key, so that the shuffle of the others is not disturbed by them.
    """
    values = [c for c in table.columns if c not in on]
    total = table.agg(F.sum(weight)).scalar()
    is_heavy = F.col(weight) * parts > total
    heavy = table.where(is_heavy).select(*on, F.struct(*values).alias("_heavy"))
    light = table.where(~is_heavy).select(
        *on, F.lit(0).alias("_salt"), F.struct(*values).alias("_light")
    )
    marked = rows.join(F.broadcast(heavy), on, "left").withColumn(
        "_salt",
        F.when(F.col("_heavy").isNull(), 0).otherwise(
            1 + F.pmod(F.xxhash64(*spread_by), F.lit(parts)).cast("int")
        ),
    )
    found = marked.join(light, [*on, "_salt"], "left")
    return found.select(
        *rows.columns,
        *[F.coalesce(f"_heavy.{v}", f"_light.{v}").alias(v) for v in values],
    )
