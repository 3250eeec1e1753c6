"""Batches in rank order, padding, and label masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pairloom.functions.text import MAX_TOKENS, PAD, encode, is_truncated, language_code, word_count, words
from pairloom.operators.ranking import bucketed_rank

BATCH = 8
# Fixed value: label entries that the loss ignores.
IGNORED = -100
RANK_BLOCK = 1_000_000


def encode_pairs(pairs: DataFrame) -> DataFrame:
    """Encoded source and target; the columns of the text are dropped.

    ``pairs`` has ``lang``, the two-letter language of both sides.
    """
    code = language_code(F.col("lang"))
    keep = [c for c in pairs.columns if c not in ("source", "target", "lang")]
    sides = pairs.select(
        *keep, code.alias("code"), words(F.col("source")).alias("s"), words(F.col("target")).alias("t")
    )
    return sides.select(
        *keep,
        encode(F.col("s"), F.col("code")).alias("input_tokens"),
        encode(F.col("t"), F.col("code")).alias("label_tokens"),
        is_truncated(F.col("s")).alias("input_truncated"),
        is_truncated(F.col("t")).alias("label_truncated"),
    )


def with_batches(df: DataFrame, size: int = BATCH) -> DataFrame:
    """Batch and place in it from ``rk``, within each split."""
    at = F.col("rk") - 1
    return df.withColumn("batch_id", F.floor(at / size)).withColumn("place", at % size)


def encoded_size(text: Column, limit: int = MAX_TOKENS) -> Column:
    """Number of entries that ``encode`` gives for a text."""
    return F.least(word_count(text), F.lit(limit - 2)) + 2


def with_width(df: DataFrame, size: Column) -> DataFrame:
    """``width``: the largest ``size`` in the row's batch; a window sees one batch only."""
    return df.withColumn("width", F.max(size).over(Window.partitionBy("split", "batch_id")))


def pad(df: DataFrame, tokens: str, fill: str = PAD) -> DataFrame:
    """Pad to ``width``."""
    return df.withColumn(
        "padded",
        F.concat(tokens, F.array_repeat(F.lit(fill), F.col("width") - F.size(tokens))),
    )


def padded(df: DataFrame, tokens: str, fill: str = PAD) -> DataFrame:
    """Pad to the longest member of the batch."""
    return pad(with_width(df, F.size(tokens)), tokens, fill)


def length_batches(df: DataFrame, tokens: str, size: int = BATCH) -> DataFrame:
    """Batches of rows of about equal length, within each split.

    The order (length, rk) is cut into blocks of ranks, so a length that many
    rows share is numbered in many tasks.
    """
    keyed = df.withColumn("n_tokens", F.size(tokens)).withColumn(
        "_block", F.floor(F.col("rk") / RANK_BLOCK)
    )
    ranked = bucketed_rank(
        keyed, ["n_tokens", "_block"], ["rk"], out="length_rank", per=["split"]
    )
    return ranked.withColumn(
        "batch_id", F.floor((F.col("length_rank") - 1) / size)
    ).drop("_block", "length_rank_of")


def waste(df: DataFrame, tokens: str) -> DataFrame:
    """Share of padding in all batches of ``df``, by split."""
    per_batch = df.groupBy("split", "batch_id").agg(
        F.count("*").alias("n"),
        F.sum(F.size(tokens)).alias("used"),
        F.max(F.size(tokens)).alias("width"),
    )
    return (
        per_batch.groupBy("split")
        .agg(
            F.count("*").alias("n_batches"),
            F.sum("used").alias("used"),
            F.sum(F.col("n") * F.col("width")).alias("total"),
        )
        .withColumn("waste", F.round((F.col("total") - F.col("used")) / F.col("total"), 9))
    )


def token_ids(tokens):
    """Hashed token ids below 2**24."""
    return F.transform(
        tokens, lambda t: F.conv(F.substring(F.md5(t), 1, 6), 16, 10).cast("int")
    )


def unmask(labels, pad_id: int):
    """Ignored label entries replaced by the pad id."""
    return F.transform(labels, lambda x: F.when(x == IGNORED, F.lit(pad_id)).otherwise(x))


def unmask_tokens(tokens):
    """The same on token text: the ignored mark becomes the pad token."""
    return F.transform(tokens, lambda t: F.when(t == str(IGNORED), F.lit(PAD)).otherwise(t))
