"""Ranks and running values over a whole order without a one-task window.

Three ways, by what is known about the order:

* ``bucketed_rank`` when a bucket column already cuts the order into many small
  pieces (a hash prefix, a length and a block of ids);
* ``ordered_chunks`` when the order is arbitrary and a key may hold a large part
  of the rows: a range partitioning on the full order cuts any key into pieces
  of about equal size;
* ``scan`` for the same order in one pass: the rows of a range are run through
  where they land, and only the states at the ends of ranges are combined.

All count per piece, add up the counts of the pieces before (a table of the
size of the number of pieces) and number the rows inside each piece.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from pairloom.operators.scans import scan_batches
from pairloom.session import materialize


def _sum_before(column: str, ordered) -> Column:
    """Sum of the rows before, 0 for the first."""
    return F.coalesce(F.sum(column).over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def bucketed_rank(
    df: DataFrame,
    buckets: list[str],
    order: list[str],
    out: str = "rank",
    per: list[str] | None = None,
    kept: Callable[[Column, Column, Column], Column] | None = None,
) -> DataFrame:
    """1-based rank by ``buckets`` then ``order``, plus the row count ``<out>_of``.

    With ``per`` the ranks start again for each of its values. The order inside
    a bucket must be total. Bucket counts are added up in two levels: over the
    values of the first bucket column, and inside each of them over the others,
    so a task sees no more than one level's counts.

    ``kept`` says of a bucket's first rank, last rank and the row count whether any of its rows are
    asked for; all rows are counted, but those of other buckets are left out before rows move. The table of
    buckets is sent to all tasks then, so their number has to be bounded.
    """
    per = list(per or [])
    keys = [*per, *buckets]
    head, rest = [*per, buckets[0]], buckets[1:]
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    ordered = Window.partitionBy(*per).orderBy(buckets[0])
    everything = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = counts.groupBy(*head).agg(F.sum("_n").alias("_n")).select(
        *head,
        _sum_before("_n", ordered).alias("_before"),
        F.sum("_n").over(everything).alias(f"{out}_of"),
    )
    if rest:
        nested = Window.partitionBy(*head).orderBy(*rest)
        offsets = (
            counts.select(*keys, _sum_before("_n", nested).alias("_inner"))
            .join(offsets, head)
            .withColumn("_before", F.col("_before") + F.col("_inner"))
            .drop("_inner")
        )
    if kept:
        asked = kept(F.col("_before") + 1, F.col("_before") + F.col("_n"), F.col(f"{out}_of"))
        offsets = F.broadcast(counts.join(offsets, keys).where(asked).drop("_n"))
    inside = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.join(offsets, keys)
        .withColumn(out, F.col("_before") + F.row_number().over(inside))
        .drop("_before")
    )


def ordered_chunks(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Add ``chunk``: consecutive pieces of the order ``keys`` + ``order``.

    The number of chunks is the number of shuffle partitions. The result is
    stored, because a second evaluation could sample other range borders.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *keys, *order)
    return materialize(
        ranged.withColumn("chunk", F.spark_partition_id()), "ordered-chunks"
    )


def running(
    chunks: DataFrame,
    keys: list[str],
    order: list[str],
    values: dict[str, tuple[str, Column]],
    inclusive: bool = True,
) -> DataFrame:
    """Running aggregates per key over a table from ``ordered_chunks``.

    ``values`` maps an output name to ("sum" | "max" | "min" | "xor", column). Each value
    is combined from the chunks before (one row per key and chunk) and the rows
    before inside the chunk. ``inclusive=False`` leaves the current row out.
    """
    functions = {"sum": F.sum, "max": F.max, "min": F.min, "xor": F.bit_xor}
    totals = chunks.groupBy(*keys, "chunk").agg(
        *[functions[f](c).alias(f"_t_{name}") for name, (f, c) in values.items()]
    )
    earlier = (
        Window.partitionBy(*keys)
        .orderBy("chunk")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = totals.select(
        *keys,
        "chunk",
        *[
            functions[f](f"_t_{name}").over(earlier).alias(f"_c_{name}")
            for name, (f, _) in values.items()
        ],
    )
    last = 0 if inclusive else -1
    inside = (
        Window.partitionBy(*keys, "chunk")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, last)
    )
    combine = {
        "sum": lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b),
        "max": F.greatest,
        "min": F.least,
        "xor": lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a.bitwiseXOR(b)),
    }
    local = chunks.select(
        "*",
        *[functions[f](c).over(inside).alias(f"_l_{name}") for name, (f, c) in values.items()],
    )
    joined = local.join(carried, [*keys, "chunk"])
    return joined.select(
        *chunks.columns,
        *[
            combine[f](F.col(f"_c_{name}"), F.col(f"_l_{name}")).alias(name)
            for name, (f, _) in values.items()
        ],
    )


def scan(
    df: DataFrame, keys: list[str], order: list[str], values: dict[str, tuple[str, Column]]
) -> DataFrame:
    """Running values per key along ``order``, with one exchange; stored.

    Adds ``step`` (the row's number in its key, from 1) and for every entry of ``values`` a
    column: ("sum" | "max" | "min", column), nulls and NaN left out, or ("first_max", column), the
    step at which the running maximum was first reached. Rows are cut by range and run through in their
    order; each task leaves the state at its end, one row, and only those rows, at most two a
    task, are combined and sent to all: a key of any size is spread, and no row moves twice.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    inputs = {name: c.alias(f"_v_{name}") for name, (_, c) in values.items()}
    ranged = (
        df.select("*", *inputs.values())
        .repartitionByRange(parts, *keys, *order)
        .sortWithinPartitions(*keys, *order)
    )
    kinds = {name: f for name, (f, _) in values.items()}
    kept = [f for f in ranged.schema if not f.name.startswith("_v_")]
    found = [T.StructField("_n", T.LongType())]
    for name, kind in kinds.items():
        found.append(T.StructField(f"_l_{name}", ranged.schema[f"_v_{name}"].dataType))
        if kind == "first_max":
            found.append(T.StructField(f"_p_{name}", T.LongType()))
    marks = [T.StructField("_first", T.BooleanType()), T.StructField("_last", T.BooleanType())]
    schema = T.StructType([*kept, *found, *marks])
    names = [f.name for f in schema]
    local = ranged.mapInArrow(
        lambda batches: scan_batches(batches, keys, kinds, [f.name for f in kept], names), schema
    )
    stored = materialize(local.withColumn("chunk", F.spark_partition_id()), "scanned")

    # The state that a chunk takes over: of the earlier chunks that end in its first key.
    state = [f.name for f in found]
    ends = stored.where("_last").select(*keys, F.col("chunk").alias("at"), *state, F.lit(False).alias("asks"))
    asks = stored.where("_first").select(
        *keys, (F.col("chunk")).alias("at"),
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in found], F.lit(True).alias("asks"),
    )
    before = (
        Window.partitionBy(*keys).orderBy("at", F.desc("asks")).rowsBetween(Window.unboundedPreceding, -1)
    )
    both = ends.unionByName(asks).withColumn("_c_n", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    carried = {"sum": F.sum, "max": F.max, "min": F.min}
    for name, kind in kinds.items():
        if kind == "first_max":
            whole = F.struct(F.col(f"_l_{name}").alias("v"), (-(F.col("_c_n") + F.col(f"_p_{name}"))).alias("p"))
            of = F.max(F.when(F.col(f"_l_{name}").isNotNull(), whole))
        else:
            of = carried[kind](f"_l_{name}")
        both = both.withColumn(f"_c_{name}", of.over(before))
    carries = both.where("asks").select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col("at").alias("_at"), "_c_n", *[f"_c_{name}" for name in kinds]
    )
    same = F.col("chunk") == F.col("_at")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = stored.join(F.broadcast(carries), same, "left")  # one row a chunk
    step = F.col("_n") + F.coalesce("_c_n", F.lit(0))
    out = []
    for name, kind in kinds.items():
        c, v = F.col(f"_c_{name}"), F.col(f"_l_{name}")
        if kind == "first_max":
            own = F.coalesce("_c_n", F.lit(0)) + F.col(f"_p_{name}")
            out.append(F.when(c.isNull() | (v > c["v"]), own).otherwise(-c["p"]).alias(name))
        elif kind == "sum":
            out.append(F.when(c.isNull(), v).when(v.isNull(), c).otherwise(c + v).alias(name))
        else:
            out.append((F.greatest if kind == "max" else F.least)(c, v).alias(name))
    return joined.select(*df.columns, "chunk", step.alias("step"), *out)
