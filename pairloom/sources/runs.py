"""Run tables, metric logs and run documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from pairloom.session import read_or_default, table

# Sizes, grid and defaults of the experiment.
DATA_SIZES = (500, 1000, 2000, 3000, 5000, 10000)
LAST_SIZE = 21059
RANKS = (8, 16, 32)
ALPHAS = (16, 32, 64)
DROPOUTS = (0.0, 0.1, 0.2)
DEFAULT_CONFIG = {"r": 16, "alpha": 32, "dropout": 0.1}
DEFAULT_SIZE = 2000
SMALLEST_SIZE = 500
FAILED_SCORE = 0.0
FAILED_LOSS = 999.0

# Patterns of the run folders and the schemas of run documents.
SIZE_FOLDER = r"data_size_(\d+)"
CHECKPOINT_FOLDER = r"checkpoint-(\d+)"
SIZE_RUN_SCHEMA = "data_size int, bleu double, chrf double, loss double, failed boolean"
GRID_RUN_SCHEMA = (
    "r int, alpha int, dropout double, bleu double, chrf double, loss double, failed boolean"
)
CONFIG_SCHEMA = "r int, alpha int, dropout double"
SUMMARY_SCHEMA = (
    "optimal_size int, recommended_size int, "
    "all_results array<struct<data_size: int, bleu: double, chrf: double, "
    "loss: double, failed: boolean>>"
)
FINAL_SCHEMA = (
    "validation_bleu double, validation_chrf double, test_bleu double, test_chrf double, "
    "configuration struct<r: int, alpha: int, dropout: double>, data_size int, "
    "sample_predictions array<string>, sample_references array<string>"
)
TRAINER_STATE_SCHEMA = (
    "best_global_step long, best_metric double, best_model_checkpoint string, epoch double, "
    "eval_steps long, global_step long, logging_steps long, max_steps long, "
    "num_train_epochs long, save_steps long, total_flos double, train_batch_size long, "
    "log_history array<struct<epoch: double, grad_norm: double, learning_rate: double, "
    "loss: double, step: long>>"
)
ADAPTER_SCHEMA = (
    "r int, lora_alpha int, lora_dropout double, bias string, peft_type string, "
    "task_type string, target_modules array<string>, "
    "alpha_pattern map<string, double>, rank_pattern map<string, double>"
)
SPECIAL_TOKENS_SCHEMA = (
    "additional_special_tokens array<string>, "
    "pad_token struct<content: string, lstrip: boolean, normalized: boolean, "
    "rstrip: boolean, single_word: boolean>"
)


def _pick(values, index) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def event_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as one run of the experiment.

    Size and phase follow the event id, the grid point follows the user, error
    events are failed runs, and the value gives the scores.
    """
    events = table(spark, sf_dir, "events").select(
        "event_id", "user_id", "event_type", "value"
    )
    place = F.col("event_id") % 6
    failed = F.col("event_type") == "error"
    bleu = F.floor(F.least(F.col("value"), F.lit(100.0)) * F.lit(0.4)) / F.lit(100.0)
    return (
        events.select(
            F.col("event_id").alias("run_seq"),
            F.when(place < 3, "1").when(place < 5, "2").otherwise("3").alias("phase"),
            _pick(DATA_SIZES, place).cast("long").alias("data_size"),
            _pick(RANKS, F.col("user_id") % 3).alias("r"),
            _pick(ALPHAS, F.floor(F.col("user_id") / 3) % 3).alias("alpha"),
            _pick(DROPOUTS, F.floor(F.col("user_id") / 9) % 3).alias("dropout"),
            F.when(failed, F.lit(FAILED_SCORE)).otherwise(bleu).alias("bleu"),
            F.when(failed, F.lit(True)).alias("failed"),
        )
        .withColumn("chrf", F.when(F.col("failed"), F.lit(FAILED_SCORE)).otherwise(F.col("bleu") * 100))
        .withColumn("loss", F.when(F.col("failed"), F.lit(FAILED_LOSS)).otherwise(1 - F.col("bleu")))
    )


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a metric log: run, time, metric."""
    return _as_log(table(spark, sf_dir, "events"))


def event_log_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int = 1) -> DataFrame:
    """The log as a stream; the table may be one file or a folder of parts in any order."""
    schema = table(spark, sf_dir, "events").schema
    stream = (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(f"{sf_dir.rstrip('/')}/events.parquet*")
    )
    # Watermarks need an instant, not a local time.
    return _as_log(stream).withColumn("ts", F.col("ts").cast("timestamp"))


def _as_log(events: DataFrame) -> DataFrame:
    return events.select(
        "event_id", F.col("event_type").alias("run"), "ts", F.col("value").alias("metric")
    )


def write_run_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_run_csv(spark: SparkSession, path: str, schema: str = SIZE_RUN_SCHEMA) -> DataFrame:
    """Run table; columns are matched by the header, absent ones become null."""
    wanted = T.StructType.fromDDL(schema)
    raw = spark.read.option("header", True).csv(path)
    return raw.select(
        *[
            (F.col(f.name).cast(f.dataType) if f.name in raw.columns
             else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in wanted
        ]
    )


def write_document(df: DataFrame, path: str) -> None:
    """One JSON document per row."""
    df.write.mode("overwrite").json(path)


def read_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole-file JSON documents; a malformed one raises."""
    return (
        spark.read.schema(schema)
        .option("multiLine", True)
        .option("mode", "FAILFAST")
        .json(path)
    )


def write_scalar(df: DataFrame, path: str) -> None:
    df.select(F.col(df.columns[0]).cast("string")).write.mode("overwrite").text(path)


def read_scalar(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.text(path)
    return text.select(F.trim("value").cast("long").alias("value"))


def read_size(spark: SparkSession, path: str, default: int = DEFAULT_SIZE) -> DataFrame:
    """The stored recommendation (value), or the default where there is no such file."""
    return read_or_default(spark, lambda: read_scalar(spark, path), "value long", [(default,)])


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """Configuration from a stored document (r, alpha, dropout).

    Absent keys, and an absent document as a whole, take their defaults.
    """
    found = read_or_default(
        spark, lambda: read_document(spark, path, CONFIG_SCHEMA), CONFIG_SCHEMA, [(None, None, None)]
    )
    return found.select(*[F.coalesce(k, F.lit(v)).alias(k) for k, v in DEFAULT_CONFIG.items()])


def parse_config(document: F.Column) -> F.Column:
    """Configuration struct from JSON text, each absent key by its default."""
    parsed = F.from_json(document, CONFIG_SCHEMA, {"mode": "FAILFAST"})
    return F.struct(
        *[
            F.coalesce(parsed[k], F.lit(v)).alias(k)
            for k, v in DEFAULT_CONFIG.items()
        ]
    )


def read_run_folders(spark: SparkSession, root: str) -> DataFrame:
    """Trainer states below ``root`` joined with their adapter settings.

    One row per logged step; a run without log entries keeps one row.
    """
    folder = F.regexp_replace("_metadata.file_path", "/[^/]+$", "")

    def documents(name: str, schema: str) -> DataFrame:
        found = read_document(spark, f"{root}/*/*/{name}", schema)
        return found.select("*", folder.alias("folder"))

    state = documents("trainer_state.json", TRAINER_STATE_SCHEMA)
    adapter = documents("adapter_config.json", ADAPTER_SCHEMA).select(
        "folder", "r", "lora_alpha", "lora_dropout", "target_modules"
    )
    logged = state.select(
        "*", F.explode_outer("log_history").alias("log")
    ).drop("log_history")
    return (
        logged.join(adapter, "folder", "left")
        .withColumn("data_size", F.regexp_extract("folder", SIZE_FOLDER, 1).cast("long"))
        .withColumn("checkpoint", F.regexp_extract("folder", CHECKPOINT_FOLDER, 1).cast("long"))
        .select("*", F.col("log.step").alias("log_step"), F.col("log.loss").alias("log_loss"),
                F.col("log.learning_rate").alias("log_learning_rate"))
        .drop("log")
    )


def read_language_codes(spark: SparkSession, path: str) -> DataFrame:
    """Codes listed as additional special tokens."""
    doc = read_document(spark, path, SPECIAL_TOKENS_SCHEMA)
    return doc.select(F.explode("additional_special_tokens").alias("code"))
