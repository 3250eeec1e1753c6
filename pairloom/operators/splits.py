"""Seeded train / validation / test splits and nested prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pairloom.functions.text import word_count
from pairloom.operators.ranking import bucketed_rank

SEED = 42
SPLITS = ("train", "val", "test")
BUCKET_DIGITS = 4  # hex digits of the hash that name a bucket: at most 65,536


def check_ratios(train: float, val: float, test: float) -> None:
    if not abs(train + val + test - 1.0) < 1e-6:
        raise ValueError("split ratios must sum to 1")


def split_hash(key: Column, seed: int = SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def unit_interval(digest: Column) -> Column:
    """First 13 hex digits of a digest as a number in [0, 1)."""
    digits = F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")
    return digits.cast("double") / F.lit(float(16**13))


def hash_split(
    df: DataFrame,
    key: str,
    train: float = 0.8,
    val: float = 0.1,
    test: float = 0.1,
    seed: int = SEED,
) -> DataFrame:
    """Split by a threshold on the key's hash: no count, no shuffle.

    A row keeps its split when rows are added. With a group key, all rows of the
    group share a split.
    """
    check_ratios(train, val, test)
    u = unit_interval(split_hash(F.col(key), seed))
    return df.withColumn(
        "split",
        F.when(u < F.lit(float(train)), "train")
        .when(u < F.lit(float(train + val)), "val")
        .otherwise("test"),
    )


def exact_split(
    df: DataFrame,
    key: str = "pair_id",
    train: float = 0.8,
    val: float = 0.1,
    test: float = 0.1,
    seed: int = SEED,
    ranks: dict[str, int | None] | None = None,
) -> DataFrame:
    """Split with exact sizes; ``rk`` numbers the rows inside their split from 1.

    Rows are ordered by the key's hash. What is left after training is
    ceil((1 - train) * n), and the test part of it ceil((1 - val share) * rest).
    ``ranks`` names the splits that are asked for and the last rank of each (None: all its rows). Splits and
    ranks are those of all rows; rows that are not asked for do not move, but for those of a few buckets.
    """
    check_ratios(train, val, test)
    hashed = df.withColumn("_h", split_hash(F.col(key), seed)).withColumn(
        "_bucket", F.substring("_h", 1, BUCKET_DIGITS)
    )

    def ends(n: Column) -> tuple[Column, Column]:
        """The last rank of training, and that of validation."""
        rest = F.ceil(F.lit(1 - train) * n).cast("long")
        tested = F.ceil(F.lit(1 - val / (val + test)) * rest).cast("long")
        return n - rest, n - tested

    def asked(first: Column, last: Column, n: Column) -> Column:
        """Whether any rank from first to last is asked for."""
        trained, validated = ends(n)
        spans = {"train": (F.lit(0), trained), "val": (trained, validated), "test": (validated, n)}
        out = F.lit(False)
        for split, most in ranks.items():
            before, end = spans[split]
            end = end if most is None else F.least(end, before + most)
            out = out | (first <= end) & (last > before)
        return out

    ranked = bucketed_rank(hashed, ["_bucket"], ["_h", key], out="_rank", kept=asked if ranks else None)
    n_train, n_tried = ends(F.col("_rank_of"))
    rank = F.col("_rank")
    out = (
        ranked.withColumn(
            "split",
            F.when(rank <= n_train, "train")
            .when(rank <= n_tried, "val")
            .otherwise("test"),
        )
        .withColumn(
            "rk",
            F.when(rank <= n_train, rank)
            .when(rank <= n_tried, rank - n_train)
            .otherwise(rank - n_tried),
        )
        .drop("_h", "_bucket", "_rank", "_rank_of")
    )
    for split in SPLITS if ranks else ():
        most = ranks.get(split, 0)
        if most is not None:
            out = out.where((F.col("split") != split) | (F.col("rk") <= most))
    return out


def split_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.count("*").alias("n"))


def prefix(df: DataFrame, size: int) -> DataFrame:
    """First ``size`` rows by ``rk``; all rows when there are fewer."""
    return df.where(F.col("rk") <= size)


def sizes_up_to(df: DataFrame, sizes: list[int], last: int | None = None) -> DataFrame:
    """Sizes not larger than the row count, with their place in the list.

    ``last`` adds a final size capped at the row count, which may repeat an
    earlier one and keeps its own place.
    """
    spark = df.sparkSession
    listed = spark.createDataFrame(
        [(i + 1, s, False) for i, s in enumerate(sizes)]
        + ([(len(sizes) + 1, last, True)] if last is not None else []),
        "run_seq long, data_size long, capped boolean",
    )
    n = df.agg(F.count("*")).scalar()
    return (
        listed.withColumn(
            "data_size",
            F.when(F.col("capped"), F.least(F.col("data_size"), n)).otherwise(
                F.col("data_size")
            ),
        )
        .where((F.col("data_size") <= n) & (F.col("data_size") > 0))
        .drop("capped")
    )


def nested_prefix_stats(train: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rows, words and largest source of every nested prefix.

    Each row is first folded into the band between two neighbouring sizes, so
    the data is read and aggregated once however many sizes there are; a prefix
    is then the running total of a few bands.
    """
    ladder = sizes.agg(F.sort_array(F.collect_set("data_size"))).scalar()
    covering = F.filter("ladder", lambda s: s >= F.col("rk"))
    bands = (
        train.select("rk", "source", "target", ladder.alias("ladder"))
        .select(
            F.try_element_at(covering, F.lit(1)).alias("band"),
            word_count(F.col("source")).alias("source_words"),
            word_count(F.col("target")).alias("target_words"),
        )
        .where(F.col("band").isNotNull())
        .groupBy("band")
        .agg(
            F.count("*").alias("n"),
            F.sum("source_words").alias("source_words"),
            F.sum("target_words").alias("target_words"),
            F.max("source_words").alias("max_source_words"),
        )
    )
    return (
        sizes.join(bands, bands["band"] <= sizes["data_size"])
        .groupBy("run_seq", "data_size")
        .agg(
            F.sum("n").alias("n_pairs"),
            F.sum("source_words").alias("source_words"),
            F.sum("target_words").alias("target_words"),
            F.max("max_source_words").alias("max_source_words"),
        )
    )


def leakage(df: DataFrame, text: Column) -> DataFrame:
    """Rows whose normalised text also stands in an earlier-used split.

    Copies of one text collapse to a few (text, split) rows before the shuffle
    output is compared, so a text held by a third of all rows is no hot group.
    """
    seen = (
        df.select(F.md5(text).alias("text_hash"), "split")
        .groupBy("text_hash")
        .agg(
            F.count_if(F.col("split") == "train").alias("n_train"),
            F.count_if(F.col("split") == "val").alias("n_val"),
            F.count_if(F.col("split") == "test").alias("n_test"),
        )
    )
    leaking = (
        F.when(F.col("n_train") > 0, 1).otherwise(0)
        + F.when(F.col("n_val") > 0, 1).otherwise(0)
        + F.when(F.col("n_test") > 0, 1).otherwise(0)
    ) > 1
    return seen.where(leaking)


def shared_ids(df: DataFrame, key: str) -> DataFrame:
    """Keys whose rows stand in more than one split, with their rows per split."""
    per_key = df.groupBy(key).agg(
        *[F.count_if(F.col("split") == s).alias(f"n_{s}") for s in ("train", "val", "test")]
    )
    used = sum((F.col(f"n_{s}") > 0).cast("int") for s in ("train", "val", "test"))
    return per_key.where(used > 1)
