"""Parallel text: scans, derived pair corpora, and split storage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

from pairloom.session import read_or_default, spread, table

PAIR_SCHEMA = T.StructType(
    [T.StructField("source", T.StringType()), T.StructField("target", T.StringType())]
)

SPLITS = ("train", "val", "test")


def read_json_array(spark: SparkSession, path: str) -> DataFrame:
    """Records of one JSON array per file.

    An array file cannot be cut into tasks; prefer ``read_json_lines`` or
    Parquet for large corpora.
    """
    return spark.read.schema(PAIR_SCHEMA).option("multiLine", True).json(path)


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAIR_SCHEMA).json(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


MANIFEST_SCHEMA = "data string, committed timestamp, counts map<string, long>"


def write_splits(df: DataFrame, path: str) -> DataFrame:
    """Store a split corpus under one folder and return the counts per split.

    The data goes to a folder of its own; only when it is complete, an entry of the manifest
    names it. What an interrupted write leaves behind is in no entry, so no reader sees it. The
    counts are taken while writing, the data is not read again.
    """
    spark = df.sparkSession
    name = f"data-{uuid.uuid4().hex}"
    seen = Observation(name)
    counted = df.observe(seen, *[F.count_if(F.col("split") == s).alias(s) for s in SPLITS])
    counted.write.partitionBy("split").parquet(f"{path}/{name}")
    found = seen.get
    counts = spark.createDataFrame([(s, found[s]) for s in SPLITS], "split string, n long")
    entry = spark.range(1).select(
        F.lit(name).alias("data"), F.current_timestamp().alias("committed"),
        F.create_map(*[F.lit(x) for s in SPLITS for x in (s, found[s])]).alias("counts"),
    )
    entry.write.mode("append").json(f"{path}/manifest")
    return counts.where("n > 0")


def _committed(spark: SparkSession, path: str):
    """The first complete entry of the manifest, or None: one row of names and counts."""
    entries = read_or_default(
        spark, lambda: spark.read.schema(MANIFEST_SCHEMA).json(f"{path}/manifest"), MANIFEST_SCHEMA
    )
    return entries.orderBy("committed", "data").first()


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    """Stored splits; a filter on ``split`` reads only its folder."""
    entry = _committed(spark, path)
    if entry is None:
        raise FileNotFoundError(f"no stored splits at {path}; create them first")
    return spark.read.parquet(f"{path}/{entry['data']}")


def stored_counts(spark: SparkSession, path: str) -> dict[str, int]:
    """Rows per split as the manifest says."""
    entry = _committed(spark, path)
    return dict(entry["counts"]) if entry else {}


def splits_or_create(spark: SparkSession, path: str, create) -> DataFrame:
    """Read stored splits, or store the result of ``create()`` once.

    Of two writers at the same time both finish, and all readers take the entry committed first.
    """
    if _committed(spark, path) is None:
        write_splits(create(), path)
    return read_splits(spark, path)


def conversation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turn and the assistant turn that follows it.

    A join on (conversation, turn) instead of a window per conversation: the key
    is unique, so one very long conversation still spreads over all tasks.
    """
    turns = table(spark, sf_dir, "conversations")
    asked = turns.where("role = 'user'").select(
        "conv_id", "turn", F.col("text").alias("source")
    )
    answered = turns.where("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("target")
    )
    return asked.join(answered, ["conv_id", "turn"]).select(
        F.concat_ws(":", "conv_id", "turn").alias("pair_id"),
        "conv_id",
        "turn",
        "source",
        "target",
    )


def line_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line of a document with the line after it, made inside the row."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    lines = docs.select("doc_id", "lang", F.split("text", "\n").alias("lines")).where(F.size("lines") > 1)
    n = F.size("lines") - 1
    # The pairs of a document are built before they become rows, so no row carries all its lines.
    pairs = F.arrays_zip(
        F.slice("lines", F.lit(1), n).alias("source"), F.slice("lines", F.lit(2), n).alias("target")
    )
    return (
        lines.select("doc_id", "lang", F.posexplode(pairs).alias("at", "pair"))
        .select(
            F.concat_ws(":", "doc_id", F.col("at") + 1).alias("pair_id"),
            "doc_id",
            "lang",
            F.col("pair.source").alias("source"),
            F.col("pair.target").alias("target"),
        )
    )
