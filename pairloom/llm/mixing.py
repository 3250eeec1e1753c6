"""Mixing sources to target weights by a low-discrepancy schedule.

Every source is a stream of its documents in hashed order, cut into blocks of equally many words
and repeated as often as its target asks. The mix is a row of slots: slot k has the point
frac(k * golden ratio), the cumulative weights of the sources say which source that point falls
to, the slot's rank among the slots of its source says which block it takes. So every stretch of
the mix, not only the whole, has the sources near their weights.

Only DataFrame functions are used. No step gathers a source: ranks and word positions are summed
within pieces of bounded size and carried over the few numbers per piece.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from pairloom.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
# The golden ratio's fraction times 2**31, to the next odd number: a fixed value.
POINTS = 1 << 31
GOLDEN = 1_327_217_885
CELL_BITS = 21
SLOTS_A_PIECE = 1 << 16
DOCS_A_PIECE = 1 << 12
COPIES_A_ROW = 1 << 12


class Mix(NamedTuple):
    """A planned mix.

    sources: source, source_rank, weight, source_size, target, quota, n_blocks, n_slots
    schedule: slot, source_rank, turn, block, words (how many of the block's words it takes)
    placed: doc_id, source_rank, bucket, place, copy, size, begin (its first word in its stream)
    """

    sources: DataFrame
    schedule: DataFrame
    placed: DataFrame
    block_words: int


def source_targets(sizes: DataFrame, weights: tuple[int, ...], most: float) -> DataFrame:
    """Target words per source: shares by weight, at most ``most`` times the source's size.

    The level of a source is target over weight. Sources sorted by their highest possible level
    stop there one after the other; the first whose limit lies above the level left for the rest
    fixes the level of all that follow. That is the end of resharing the excess by weight.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = per.withColumn(
        "source_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    )
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    limits = (
        ranked.withColumn("weight", F.get(cycle, F.col("source_rank") % len(weights)))
        .withColumn("limit", F.col("source_size") * F.lit(float(most)))
        .withColumn("top", F.col("limit") / F.col("weight"))
    )
    order = Window.orderBy("top", "source_rank")
    everything = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    levels = limits.withColumn(
        "level",
        (F.sum(F.col("source_size")).over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
        / F.sum("weight").over(onward),
    )
    fixed = F.max(F.when(F.col("level") <= F.col("top"), F.col("level"))).over(everything)
    return levels.withColumn(
        "target", F.least("limit", F.coalesce(fixed, F.lit(0.0)) * F.col("weight"))
    ).select("source", "source_rank", "weight", "source_size", "target")


def _with_quota(targets: DataFrame, block_words: int, most: float) -> DataFrame:
    size, quota = F.col("source_size"), F.col("quota")
    blocks = F.ceil(size / F.lit(block_words)).cast("long")
    whole = F.when(size > 0, F.floor(quota / F.greatest(size, F.lit(1)))).otherwise(0).cast("long")
    rest = quota - whole * size
    return (
        targets.withColumn(
            "quota", F.least(F.round("target"), F.floor(size * F.lit(float(most)))).cast("long")
        )
        .withColumn("n_blocks", blocks)
        .withColumn(
            "n_slots", whole * blocks + F.ceil(rest / F.lit(block_words)).cast("long")
        )
    )


def slot_sources(sources: DataFrame, n_slots: int) -> DataFrame:
    """slot, source_rank: the golden-ratio points mapped through the cumulative weights."""
    spark = sources.sparkSession
    upto = F.sum("n_slots").over(Window.orderBy("source_rank"))
    edge = lambda c: F.floor(c / F.lit(max(n_slots, 1)) * F.lit(float(POINTS))).cast("long")
    bounds = (
        sources.withColumn("high", edge(upto))
        .withColumn("low", edge(upto - F.col("n_slots")))
        .where("high > low")
        .select(
            "source_rank",
            "low",
            "high",
            F.explode(
                F.sequence(
                    F.shiftright("low", CELL_BITS),
                    F.shiftright(F.col("high") - 1, CELL_BITS),
                )
            ).alias("cell"),
        )
    )
    points = spark.range(n_slots).select(
        F.col("id").alias("slot"), ((F.col("id") % POINTS) * GOLDEN % POINTS).alias("point")
    )
    return (
        points.withColumn("cell", F.shiftright("point", CELL_BITS))
        .join(bounds, "cell")
        .where("point >= low AND point < high")
        .select("slot", "source_rank")
    )


def ranked_slots(slots: DataFrame) -> DataFrame:
    """Adds ``turn``, the slot's rank within its source, counted piece by piece."""
    cut = slots.withColumn("piece", F.floor(F.col("slot") / SLOTS_A_PIECE))
    carried = (
        cut.groupBy("source_rank", "piece")
        .agg(F.count("*").alias("_n"))
        .withColumn(
            "_before",
            F.sum("_n").over(Window.partitionBy("source_rank").orderBy("piece")) - F.col("_n"),
        )
        .drop("_n")
    )
    inside = F.row_number().over(Window.partitionBy("source_rank", "piece").orderBy("slot")) - 1
    return (
        cut.withColumn("_inside", inside)
        .join(carried, ["source_rank", "piece"])
        .select("slot", "source_rank", (F.col("_before") + F.col("_inside")).alias("turn"))
    )


def mix_schedule(sources: DataFrame, block_words: int) -> DataFrame:
    """The slots with the block that each takes.

    A source whose points come up a few times too often leaves its last slots idle; one that is
    short by a few (their number grows with the logarithm of the slots) has them at the end.
    """
    n_slots = sources.agg(F.coalesce(F.sum("n_slots"), F.lit(0)).alias("n")).first()["n"]
    drawn = ranked_slots(slot_sources(sources, n_slots))
    counts = drawn.groupBy("source_rank").agg(F.count("*").alias("_drawn"))
    short = (
        sources.join(counts, "source_rank", "left")
        .withColumn("_drawn", F.coalesce("_drawn", F.lit(0)))
        .where("_drawn < n_slots")
        .select("source_rank", F.explode(F.sequence(F.col("_drawn"), F.col("n_slots") - 1)).alias("turn"))
        .select(
            (F.lit(n_slots) + F.col("turn")).alias("slot"), "source_rank", "turn"
        )
    )
    lap, block = F.floor(F.col("turn") / F.col("n_blocks")), F.col("turn") % F.col("n_blocks")
    done = lap * F.col("source_size") + block * block_words
    return (
        drawn.unionByName(short)
        .join(sources, "source_rank")
        .where("turn < n_slots")
        .select(
            "slot",
            "source_rank",
            "turn",
            block.alias("block"),
            F.least(F.lit(block_words), F.col("quota") - done).alias("words"),
        )
    )


def _copies(groups: DataFrame) -> DataFrame:
    """One row per copy of a group of equal rows (n); large groups are spread before that."""
    few = groups.where(F.col("n") <= COPIES_A_ROW).withColumn("copy", F.lit(0).cast("long"))
    pieces = F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(COPIES_A_ROW).cast("long"))
    many = groups.where(F.col("n") > COPIES_A_ROW).withColumn("copy", F.explode(pieces))
    last = F.least(F.col("n"), F.col("copy") + COPIES_A_ROW) - 1
    return few.unionByName(many.repartition("source_rank", "bucket", "place", "copy")).withColumn(
        "copy", F.explode(F.sequence(F.col("copy"), last))
    )


def _placed(sizes: DataFrame, sources: DataFrame, buckets: int) -> DataFrame:
    """Documents with their first word's position in the shuffled stream of their source.

    Rows of one id, source and size are alike to the mix. They are placed as one, side by side,
    so an id that many rows share, or a null one, is no more than its different sizes.
    """
    of = sources.select(F.col("source").alias("_source"), "source_rank")
    keyed = (
        sizes.groupBy("doc_id", "source", "size")
        .agg(F.count("*").alias("n"))
        .join(of, F.col("source").eqNullSafe(F.col("_source")))
        .select(
            "doc_id",
            "source_rank",
            "size",
            "n",
            F.pmod(F.xxhash64("doc_id", F.lit("bucket")), F.lit(buckets)).alias("bucket"),
            F.xxhash64("doc_id", F.lit("order")).alias("_key"),
        )
    )
    words = F.col("n") * F.col("size")
    carried = (
        keyed.groupBy("source_rank", "bucket")
        .agg(F.sum(words).alias("_n"))
        .withColumn(
            "_before",
            F.sum("_n").over(Window.partitionBy("source_rank").orderBy("bucket")) - F.col("_n"),
        )
        .drop("_n")
    )
    inside = Window.partitionBy("source_rank", "bucket").orderBy("_key", "doc_id", "size")
    groups = (
        keyed.withColumn("place", F.row_number().over(inside))
        .withColumn("_upto", F.sum(words).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .join(carried, ["source_rank", "bucket"])
        .withColumn("_begin", F.col("_before") + F.col("_upto") - words)
    )
    return _copies(groups).select(
        "doc_id",
        "source_rank",
        "bucket",
        "place",
        "copy",
        "size",
        (F.col("_begin") + F.col("copy") * F.col("size")).alias("begin"),
    )


def plan_mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (1, 2, 3),
    most: float = 3.0,
    block_words: int = 512,
    size: Column | None = None,
) -> Mix:
    """Plan the mix of ``docs`` (doc_id, text, source).

    Sources in code point order, null last, take the ``weights`` in turn; together they share as
    many words as there are. ``size`` is the number of words, null texts 0. Rows of one id stay
    rows of their own. Sources without words get nothing; an empty table gives an empty mix.
    The same table gives the same mix in every run, however it is partitioned.
    """
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)) if size is None else size
    sizes = materialize(docs.select("doc_id", "source", words.cast("long").alias("size")), "mix-sizes")
    sources = materialize(
        _with_quota(source_targets(sizes, weights, most), block_words, most), "mix-sources"
    )
    buckets = max(1, -(-sizes.count() // DOCS_A_PIECE))
    return Mix(
        sources, mix_schedule(sources, block_words), _placed(sizes, sources, buckets), block_words
    )


def mixed_spans(mix: Mix) -> DataFrame:
    """Every document cut at block borders, with the slots that take the piece.

    from_word and to_word are positions within the document. Pieces that no slot takes, and
    documents without words, come once with a null slot and no words.
    """
    b = mix.block_words
    begin, end = F.col("begin"), F.col("begin") + F.col("size")
    blocks = F.when(
        F.col("size") > 0,
        F.sequence(F.floor(begin / b), F.floor((end - 1) / b)),
    )
    pieces = mix.placed.select("*", F.explode_outer(blocks).alias("block"))
    first = F.greatest(begin, F.col("block") * b)
    last = F.least(end, F.col("block") * b + F.coalesce("words", F.lit(0)))
    return pieces.join(mix.schedule, ["source_rank", "block"], "left").select(
        "slot",
        "doc_id",
        "source_rank",
        "bucket",
        "place",
        "copy",
        "size",
        (first - begin).alias("from_word"),
        F.greatest(last - begin, first - begin).alias("to_word"),
    )


def taken_words(mix: Mix) -> DataFrame:
    """Per document: doc_id, size, source_size, target (its source's), taken."""
    taken = F.coalesce(F.sum(F.col("to_word") - F.col("from_word")), F.lit(0)).cast("long")
    per = (
        mixed_spans(mix)
        .groupBy("source_rank", "bucket", "place", "copy", "doc_id", "size")
        .agg(taken.alias("taken"))
    )
    return per.join(mix.sources, "source_rank").select(
        "doc_id", "source", "size", F.col("source_size").cast("long"), "target", "taken"
    )
